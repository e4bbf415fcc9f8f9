import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestrand.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["\x1c a\x1d\x85b", "  　x", "A" * 3000, " " * 500 + "x", "日本語のテキスト" * 50, "😀😀👨‍👩‍👧" * 9, "'s'S I'll", "\n\n\n \t x\r\n", "¹²³½ٱ٢", "é ́x ̈́", "Σς ΑΣ", "<|endoftext|> x", "a \x01 b\x01c", "", "x<|startoftext|>y,<|ENDOFTEXT|>.", "ALİ, İ. ali̇,", "שׁ, क़.", "t<|", "K, ſ;"]
FRESH = Tokenizer.from_file(PATH)
PIECES = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", " ", "\n", ".", ",", "!", "?", "|", ";", ":", "İ", "שׁ", "יִ", "क़", "Σ", "ς", "ſ", "K", "é", "é", "'s", "'S", "a", "B", "xyz", "1", "\x01", "\x1c", "\x85", "日", "😀"]


def _texts():
    r = random.Random(1)
    return ODD + ["".join(r.choices("abct he\n 1!é日😀'sd\x1c\x01 ́̈", k=200)) for _ in range(100)] + ["".join(r.choices(PIECES, k=r.randint(1, 40))) for _ in range(1500)]


def _plain(text):
    return FRESH.encode(text, add_special_tokens=False).ids



def test_the_library_takes_special_tokens_in_texts():
    flat, _ = ts.encoder(PATH).encode(pa.array(["<|endoftext|>"]))
    assert flat.tolist() == [49407] == _plain("<|endoftext|>")


def test_words_alone_equal_whole_texts():
    texts = [None, *_texts()]
    flat, offsets = ts.encoder(PATH).encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert flat[offsets[k] : offsets[k + 1]].tolist() == _plain(t or "")


def test_shards_read_single_documents_and_refuse_damage():
    ids = [np.arange(k, dtype="<u2").tobytes() for k in (0, 5, 300)]
    writer = ts.ShardWriter(b"", 2)
    for x in ids:
        writer.add(x)
    blob = writer.close()
    shard = ts.ShardReader(blob, b"")
    assert [shard.ids(k).tobytes() for k in (2, 0, 1)] == [ids[2], ids[0], ids[1]]
    assert [shard.start(k) for k in range(3)] == [0, 0, 5]
    with pytest.raises(ValueError):
        ts.ShardReader(b"x" + blob, b"")
    with pytest.raises(ValueError):
        ts.ShardReader(blob, b"another")


def test_written_and_read_back(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ts, "SHARD_BYTES", 300)
    rows = [(1000 - k, t) for k, t in enumerate([None, *_texts()])] + [(None, "null id"), (990, "again"), (990, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    at = f"{tmp_path.as_uri()}/store"
    ts.write(df, PATH, 1, at)
    store = ts.open_store(spark, at)
    assert store.shards.count() > 4 and store.dictionary
    assert sorted(ts.ids_of(store, 990)) == sorted([*_plain(t or ""), 1] for i, t in rows if i == 990)
    assert ts.ids_of(store, 1000) == [[1]] and ts.ids_of(store, 5000) == []
    got = sorted(ts.read(store).collect(), key=lambda r: r.start)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = _plain(t or "") + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert ts.read(ts.write(df.limit(0), PATH, 1)).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(ts, "CACHE_WORDS", 60)
    monkeypatch.setattr(ts, "CACHE_KEPT", 20)
    own = ts.WordEncoder(PATH)
    for text in _texts() * 2:
        flat, _ = own.encode(pa.array([text, text + " common words"]))
        assert flat.tolist() == _plain(text) + _plain(text + " common words")
