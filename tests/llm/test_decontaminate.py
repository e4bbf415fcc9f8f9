import random

from lodestrand.llm import decontaminate as d


def _brute(texts, items, window=8):
    out = []
    for t in texts:
        w, hit, found = d.words_of(t.encode() if t else None), set(), set()
        for name, body in items:
            b = d.words_of(body.encode() if body else None)
            m = min(window, len(b))
            pats = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i : i + m]) in pats:
                    hit |= set(range(i, i + m))
                    found.add("null" if name is None else str(name))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_equals_brute_force(spark):
    r = random.Random(5)
    v = ["a", "b", "C", "dé", "9"]
    items = [(k, " ".join(r.choices(v, k=n))) for k, n in enumerate([1, 2, 3, 7, 8, 9, 12, 20])] + [(1, "b b b"), (None, "A c a"), (77, None), (78, "!!")]
    items[0] = (0, "unique")
    texts = [" ".join(r.choices(v, k=r.randrange(60))) for _ in range(60)] + [None, "", "--", "unique", (items[7][1] + " ") * 500]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _brute(texts, items)
    for block_bytes in (d.BLOCK_BYTES, 40):
        got = {r.doc_id: r for r in d._digest(spark, d.scan(docs.select("doc_id", "text"), bench, block_bytes=block_bytes)).collect()}
        for i, (n, hit, found) in enumerate(want):
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, hit, len(found), len(found) >= 2)
    spans = d.scan(docs, bench).where("doc_id = 63").first()
    assert spans["items"] == "s" and spans["scan"]["items"] == ["0"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.scan(docs, none).first()["scan"]["n_words"] == 2
    assert d._digest(spark, d.scan(docs.limit(0), none)).count() == 0


def test_long_items_in_pieces_and_clashing_names(spark, monkeypatch):
    """Windows over the edges of pieces are found; columns of any name stay."""
    monkeypatch.setattr(d, "PIECE", 7)
    r = random.Random(8)
    words = [f"w{k}" for k in range(90)]
    items = [(1, " ".join(words)), (2, "w3 w4 w5"), (3, " ".join(words[40:55]))]
    texts = [" ".join(words[k : k + r.randrange(6, 14)]) for k in range(80)] + ["x " * 100_000 + " ".join(words)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "k") for i, t in enumerate(texts)], "doc_id long, text string, body int, scan int, row int, name string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (d.BLOCK_BYTES, 60):
        got = d.scan(docs, bench, block_bytes=block_bytes)
        assert got.columns == ["doc_id", "body", "row", "name", "scan"]
        rows = {x.doc_id: x for x in got.collect()}
        for i, (n, _, found) in enumerate(_brute(texts, items)):
            assert (rows[i].scan["n_words"], rows[i].scan["items"], rows[i].body, rows[i].row) == (n, found, 1, 3)
    assert d.clean(docs, bench).columns == docs.columns


def test_a_block_is_small():
    """Ten bytes and a word list for each byte of text, not an object for each window."""
    import pickle
    import tracemalloc

    r = random.Random(1)
    words = [f"word{k}" for k in range(20_000)]
    items = [(str(k), " ".join(r.choices(words, k=500)).encode()) for k in range(200)]  # 1 MB
    tracemalloc.start()
    block = d.Benchmark(items)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    size = sum(len(t) for _, t in items)
    assert held < 20 * size and len(pickle.dumps(block)) < 12 * size
