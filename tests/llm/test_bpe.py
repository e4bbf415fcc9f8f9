import hashlib
import random

import public_tokenizers
import pytest

from lodestrand.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["\x1c a\x1d\x85b", "  　x", "a" * 3000, " " * 500 + "x", "日本語のテキスト" * 50, "😀😀👨‍👩‍👧", "'s'S I'll", "\n\n\n \t x\r\n", "¹²³½ٱ٢", "", "abc" * 1000]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.codec(PATH, PATTERN).vocabulary.ranks, special_tokens={})


def _random(seed, n, chars="abct he\n 1!é日😀'sd\x1c "):
    r = random.Random(seed)
    return ["".join(r.choices(chars, k=r.randrange(200))) for _ in range(n)]


def test_equals_the_library_and_decodes(library):
    own = bpe.codec(PATH, PATTERN)
    for text in ODD + _random(1, 200):
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_appends_and_edits_are_exact():
    v, r = bpe.codec(PATH, PATTERN).vocabulary, random.Random(2)
    for text in _random(3, 60, "etaoinsrhé日 "):
        data, new = text.encode(), b"".join(r.choices([b"th", b"e", b"\xc3", b" "], k=r.randrange(6)))
        cut = r.randint(0, len(data))
        grown = bpe.Prefixes(v, data[:cut])
        grown.append(data[cut:])
        assert grown.last == bpe.Prefixes(v, data).last
        stop = r.randint(cut, min(len(data), cut + 9))
        grown.replace(cut, stop, new)
        assert grown.last == bpe.Prefixes(v, data[:cut] + new + data[stop:]).last
    long = bpe.Prefixes(v, b"the quick brown fox " * 400)
    assert long.replace(4000, 4005, b"slow") < 2000


def test_round_trip(spark, library):
    texts = [None, *ODD]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "x y", 1), (0, None, 1)], "doc_id long, text string, ids int")
    got = bpe.round_trip(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = (texts[r.doc_id] or "") if r.doc_id is not None else "x y"
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.round_trip(df.limit(0)).count() == 0
    both = bpe.decode(bpe.encode(df)).where("doc_id = 5").first()
    assert bytes(both.decoded).decode() == texts[5]
