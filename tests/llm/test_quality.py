import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import quality as q


def _wide(n, seed):
    """Text of many words, so that what is never seen is rare."""
    r = random.Random(seed)
    letters = random.Random(0)
    words = ["".join(letters.choices("etaoinshrd", k=letters.randint(2, 7))) for _ in range(1500)]
    return [" ".join(r.choices(words, weights=[1 / (k + 1) for k in range(1500)], k=r.randint(30, 80))) + "." for _ in range(n)]


def _corpus(n, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "runs", "cat", "Dog", "tree.", "house,", "sees"]
    return [" ".join(r.choices(words, weights=[9, 7, 2, 3, 2, 4, 2, 1], k=r.randint(3, 40))) for _ in range(n)]


def _ids(words, text):
    w = text.split()
    return [0, 0, *(3 if k and w[k - 1] == x else words.numbers[x] if x in words.numbers else words.number(x) for k, x in enumerate(w)), 1]


def _brute(texts, words):
    """Interpolated modified Kneser-Ney by nested dictionaries; ``words``: the model's."""
    names = words.numbers
    c = {3: Counter(), 2: Counter(), 1: Counter()}
    for t in texts:
        s = [w for w in _ids(words, t) if w != 3]
        c[3].update(tuple(s[i - 2 : i + 1]) for i in range(2, len(s)))
    for k in (2, 1):
        c[k].update(g[1:] for g in c[k + 1])
    d, ctx = {}, {k: defaultdict(Counter) for k in c}
    for k in c:
        n = Counter(c[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d[k] = [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i) for i in (1, 2, 3))] if all(n[i] for i in (1, 2, 3, 4)) else [0, 0.5, 1, 1.5]
        for g, m in c[k].items():
            ctx[k][g[:-1]][g[-1]] = m

    def p(g):
        if not g:
            return 1 / (len(names) - 1)
        seen = ctx[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        total, dd = sum(seen.values()), d[len(g)]
        return max(seen[g[-1]] - dd[min(seen[g[-1]], 3)], 0) / total + sum(dd[min(m, 3)] for m in seen.values()) / total * p(g[1:])

    return p, names


@pytest.mark.parametrize(("head", "heavy"), [(400_000, 1_000), (60, 3), (0, 1)])
def test_perplexities_equal_brute_force(spark, monkeypatch, head, heavy):
    """Each fold's documents under the other fold's model, whatever share of n-grams is joined and whichever are salted."""
    monkeypatch.setattr(q, "HEAD", max(1, head))
    monkeypatch.setattr(q, "HEAVY", heavy)
    trusted = _corpus(60) + ["Zebra! x9 the"] * 2 + [f"a{k * k}x the {chr(97 + k % 20) * 3} of b{chr(97 + k)}" for k in range(24)]
    docs = [(k, t, "en") for k, t in enumerate(trusted)] + [(100, "the cat sees nobody, Ever!", "en"), (101, "the the the of", "en"), (102, "x", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    folds = {r.doc_id: r.f for r in df.select("doc_id", q.fold_of().alias("f")).collect()}
    labels = spark.createDataFrame([(k, 1) for k in range(len(trusted))], "doc_id long, quality int")
    got = {r.doc_id: r for r in q.judge(df, labels).collect()}
    good = q._good(labels)
    model = q.fit(q._sample(df, good))[0]
    words = model.words
    assert model.spell.min() < -0.5 and not model.spell[:, [0, 1, 3, words.numbers["the"]]].any()
    models = [_brute([t for k, t in enumerate(trusted) if folds[k] != f], words) for f in (0, 1)]
    for i, t, _ in docs:
        p, names = models[folds[i]]
        s = _ids(words, t)
        want = -sum(math.log10(p(tuple(s[k - 2 : k + 1]))) for k in range(2, len(s))) / (len(s) - 2)
        want -= sum(model.spell[folds[i], w] for w in s[2:]) / (len(s) - 2)
        assert math.log10(got[i].perplexity) == pytest.approx(want, rel=1e-4) and got[i].n_tokens == len(t.split())
    p, names = models[0]
    for context in [(0, 0), (names["the"], names["cat"]), (names["of"], 2)]:
        assert sum(p((*context, w)) for w in names.values() if w != 0) == pytest.approx(1)


def test_shapes():
    assert [q.shape(w) for w in ("house,", "THE", "Thé.", "a1", "x%%%", "日本", "a-b-c-d")] == ["\0a,", "\0A", "\0Aa.", "\0a9", "\0a%", "\0a", "\0a-a-+"]


def test_junk_goes_and_clean_stays(spark):
    clean = _wide(200, 2)
    junk = [" ".join(w + "%%%" for w in t.split()) for t in _wide(10, 3)] + ["Dog " * 60, " | ".join(_wide(1, 4)[0].split()) + " |" * 20]
    rows = [(k, t, "en") for k, t in enumerate(clean)] + [(1000 + k, t, "en") for k, t in enumerate(junk)] + [(2000, None, "en"), (2001, " ", None), (2002, clean[3], None), (0, clean[0], "en"), (None, clean[5], "xx")]
    docs = spark.createDataFrame([(i, t, lang, 1) for i, t, lang in rows], "doc_id long, text string, lang string, keep int")
    labels = spark.createDataFrame([(k, 1) for k in range(150)] + [(k, 1) for k in range(20)] + [(1000, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = {}
    for r in q.judge(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[0]) == 2 and got[2000][0].perplexity is None
    assert not any(r.keep for i in (*range(1000, 1000 + len(junk)), 2000, 2001) for r in got[i])
    assert sum(r.keep for i in range(200) for r in got[i]) >= 198
    assert got[2002][0].keep and got[None][0].keep
    kept = q.judge(docs, labels, carry=True)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for x in got.values() for r in x)


def test_nothing_trusted(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.keep for r in q.judge(docs, none).collect()} == {1: True, 2: False}
    assert q.judge(docs.limit(0), none).count() == 0


def test_long_texts_and_clashing_names(spark):
    clean = _wide(120, 2)
    rows = [(k, t, "en", 1, 2, 3) for k, t in enumerate(clean)] + [(500, " ".join(_wide(4000, 7)), "en", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, doc int, fold int")
    labels = spark.createDataFrame([(k, 1) for k in range(100)], "doc_id long, quality int")
    kept = q.judge(docs, labels, carry=True)
    assert kept.columns == docs.columns
    found = {r.doc_id: r for r in kept.collect()}
    assert 500 in found and (found[500].row, found[500].doc, found[500].fold) == (1, 2, 3) and found[500].text == rows[-1][1]


def test_the_driver_takes_no_row_for_each_word(spark, monkeypatch):
    """Rows on the driver are objects of some hundred bytes; what grows with the vocabulary comes in columns."""
    docs = spark.createDataFrame([(k, t + f" lone{k}", "en") for k, t in enumerate(_wide(120, 2))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(120)], "doc_id long, quality int")
    sample, taken, plain = q._sample(docs, q._good(labels)), [], type(docs).collect

    def collect(df):
        rows = plain(df)
        taken.append(len(rows))
        return rows

    monkeypatch.setattr(type(docs), "collect", collect)
    model, _ = q.fit(sample)
    assert max(taken) < 50 < len(model.words.numbers) // 5


def test_models_learn_from_all_trusted_texts(spark):
    """More texts than a sample would hold; each word stands in one text of each fold, so a text left out loses its words."""
    ids = spark.range(20_600).select(F.col("id").alias("doc_id")).select("doc_id", q.fold_of().alias("f")).collect()
    nth, rows = [0, 0], []
    for r in ids:
        rows.append((r.doc_id, f"word{nth[r.f]} is here", "en"))
        nth[r.f] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r.doc_id, 1) for r in ids], "doc_id long, quality int")
    sample = q._sample(docs, q._good(labels))
    assert sample.count() == len(ids)
    numbers = q.fit(sample)[0].words.numbers
    assert all(f"word{k}" in numbers for k in range(min(nth))) and f"word{max(nth)}" not in numbers


def test_passes_add_up(spark, monkeypatch):
    """Perplexities are those of all n-grams if the joins are made in several passes."""
    monkeypatch.setattr(q, "PASS", 100)
    test_perplexities_equal_brute_force(spark, monkeypatch, 60, 3)


def test_no_table_of_ngrams_is_written(spark, monkeypatch):
    """What is written on the way is a row for each word, document or bigram of a frequent word, not for each n-gram."""
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(_wide(400, 2))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(400)], "doc_id long, quality int")
    ngrams = {tuple(w[k : k + n]) for r in docs.collect() for w in [r.text.split()] for n in (2, 3) for k in range(len(w) - n + 1)}
    written, plain = [], q.materialize

    def materialize(df, name):
        out = plain(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(q, "materialize", materialize)
    assert q.judge(docs, labels).count() == 400
    assert max(written) < len(ngrams) // 4


def test_runs_of_a_word_in_trusted_texts(spark, monkeypatch):
    """They count once and are scored whole, wherever in a text they stand and however n-grams are dealt."""
    monkeypatch.setattr(q, "PASS", 50)
    monkeypatch.setattr(q, "HEAVY", 2)
    monkeypatch.setattr(q, "BLOCK", (10, 10))
    monkeypatch.setattr(q, "CHUNK", 20)
    r = random.Random(5)
    runs = [" ".join(w for x in t.split() for w in [x] * r.choice([1, 1, 1, 2, 4])) for t in _corpus(40, 3)]
    monkeypatch.setitem(globals(), "_corpus", lambda n, seed=1: runs)
    test_perplexities_equal_brute_force(spark, monkeypatch, 100, 2)
