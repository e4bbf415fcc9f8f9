import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestrand.llm import lm_score as lm


def _tokens(text):
    return [*text.encode().lower().split(), lm.END] if text else [lm.END]


def _docs(n, seed):
    r = random.Random(seed)
    tongues = [[f"{p}{k}" for k in range(40)] for p in ("a", "É", "z")]
    return [(k, " ".join(r.choices(tongues[k % 3], k=60))) for k in range(n)]


def test_classes_sum_to_one_and_training_helps():
    rows = _docs(90, 1)
    texts = [_tokens(t) for _, t in rows]
    counts = Counter(t for x in texts for t in x)
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    words = [lm.END] + [t for t, _ in top if t != lm.END][:50]
    rest = [t for t, _ in top if t not in words]
    totals = {k: (counts[w], 1) for k, w in enumerate(words)} | {len(words): (sum(counts[t] for t in rest), len(rest))}
    lex = lm.Lexicon(top, words, [], totals)
    model = lm.Model(lex.n_class)
    batch = lm.Batch(pa.array([t for _, t in rows]))
    (_, classes), starts = lex.read(batch), batch.starts
    seq, where = model.padded(classes, starts)
    before = model.log10_probabilities(classes, starts).mean()
    r = np.random.default_rng(3)
    for _ in range(60):
        model.update(seq, where[:4000], r)
    assert model.log10_probabilities(classes, starts).mean() > before + 0.05
    p, _ = model.predict(seq, where[:5], int(where[0]))
    direct = (p @ model.Q.T + model.b).astype(float)
    direct = np.exp(direct) / np.exp(direct).sum(1, keepdims=True)
    assert direct.sum(1) == pytest.approx(1)
    own = np.log10(direct[np.arange(5), classes[:5]])
    assert model.log10_probabilities(classes, starts)[:5] == pytest.approx(own, abs=1e-4)


@pytest.mark.parametrize("head", [lm.HEAD, 30])
def test_counts_and_scores(spark, head):
    rows = _docs(150, 2) + [(900, None), (901, ""), (902, " \n"), (903, "unseen " * 3), (3, "a1 a1"), (None, "a1 zz"), (904, "long " * 20_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, token string")
    got = sorted(map(tuple, lm.score(df, head).collect()), key=str)
    assert len(got) == len(rows)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    texts = [(i, _tokens(t)) for i, t in rows]
    c = Counter(w for i, x in texts if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held[i], len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) for i, x in texts), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and math.isfinite(g[6])
    mean = lambda k: sum(g[k] for g in got if g[1] and g[2] > 20) / sum(g[2] for g in got if g[1] and g[2] > 20)
    assert mean(6) > mean(5)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = lm.score(df).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert lm.score(df.limit(0)).count() == 0


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(_docs(200, 5) + [(7, "again a1 a2"), (None, "a1 zz")], "doc_id long, text string")
    one, many = ({(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in lm.score(x).collect()} for x in (df.repartition(1), df.orderBy("text").repartition(7)))
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], rel=1e-4, abs=1e-3) for k in one)
