import itertools
import random

import pytest

from lodestrand.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint int, fp string, component_id string"


@pytest.mark.parametrize("copies", [1, 2])
def test_masks_cover_every_pair_of_bits(copies):
    masks = simhash.covering_masks(copies)
    assert len(masks) == (7 if copies == 1 else 31)
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)
    assert min(m.bit_count() for m in masks) >= (32 if copies == 1 else 40)


def test_fingerprint_by_definition():
    import xxhash

    text = "One two THREE four\tfive\x0bsix".encode()
    words = text.lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(4)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(text) & (1 << 64) - 1 == want
    assert simhash.fingerprint(b"a b") & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def _texts(n, seed):
    r = random.Random(seed)
    words = [f"w{k}é" for k in range(300)]
    base = [" ".join(r.choices(words, k=80)) for _ in range(5)]
    out = [None, "", "  ", "solo", "solo", "Solo", " ".join(["x"] * 30_000)]
    for k in range(n):
        w = base[k % 5].split()
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(80)] = r.choice(words)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("bucket", [24, 1])
def test_components_equal_brute_force(spark, bucket):
    texts = _texts(220, 3)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, bucket=bucket).collect()}
    want = simhash.brute_force([(i, t.encode() if t else None) for i, t in rows])
    assert got == want
    assert len({c for _, c in got.values()}) < len(got)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(200)] + [(501, 500)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {501: 500}


def test_empty_repeated_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, "other words are here")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect()) == [("5", 5), ("5", 5), ("7", 5), ("9", 9), ("None", 5)]
    assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == ["5", "9", "None"]
