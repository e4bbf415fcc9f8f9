"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

The model predicts the class of the next token: frequent words and the end are classes of their own, other words share
the class of their last two bytes. A token's probability is that of its class, normalised over all classes by one matrix
product for thousands of positions, times the token's share in its class, smoothed from counts over the whole corpus.
The prediction is bilinear: the two last classes and the mean of the last ``SPAN``, each through its own diagonal.

Training reads every training document once. Documents are dealt by hashes of doc_id and text to ``ROUNDS`` rounds and, in each, to
shards, as many as their tokens need. A shard runs stochastic updates over its documents in order of doc_id, from the
values of the round before; the shards' parameters are then averaged, weighted by tokens. So the model depends on the
documents alone (but for rounding of sums), not on files, partitions or tasks. Counts of frequent tokens are sent to all
tasks (a bounded table); the others meet their counts in a join by token.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import materialize, small_batches, table

#: Classes for single words (the end is one) and for endings of the other words (one takes the rest).
WORDS, ENDINGS = 256, 128
#: Size of vectors, tokens of the averaged context, positions of one update, noise samples of one update.
SIZE, SPAN, CHUNK, NOISE = 16, 16, 4096, 24
#: Positions that are scored at once; the table of classes for them stays in cache.
SCORED = 1024
#: Rounds of training, and tokens for which a round has a shard (but no fewer than LEAST_SHARDS).
ROUNDS, SHARD_TOKENS, LEAST_SHARDS = 2, 8_000_000, 12
#: Updates that a shard makes at least, going over its first chunks again.
LEAST_UPDATES, KEPT_CHUNKS, RATE = 200, 64, 0.1
#: Frequent tokens whose counts every task holds at most (all that are as frequent, or none of them); entries of a task's partial counts before they are sent on.
HEAD, FLUSH = 120_000, 150_000
ADD = 0.1
END = b""


class Batch:
    """Words of a batch of texts, A-Z lower-cased: each distinct one once, and which of them stands where."""

    def __init__(self, texts: pa.Array):
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        coded = words.flatten().dictionary_encode()
        self.distinct: list[bytes] = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        codes, real = coded.indices.to_numpy(), np.fromiter(map(len, self.distinct), np.int64, len(self.distinct)) > 0
        offsets = np.asarray(words.offsets)
        mask = real[codes]
        self.sizes = np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets - offsets[0]])
        self.codes = codes[mask]

    def with_ends(self, of_words: np.ndarray, end) -> np.ndarray:
        """Values of the distinct words at each token, each text followed by ``end``."""
        out = np.full(len(self.codes) + len(self.sizes), end, of_words.dtype)
        out[np.arange(len(self.codes)) + np.repeat(np.arange(len(self.sizes)), self.sizes)] = of_words[self.codes]
        return out

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes + 1)[:-1])) if len(self.sizes) else np.zeros(0, np.int64)


class Model:
    """Parameters: context vectors R (the last row: before the text), targets Q, biases b, diagonals C (3, SIZE)."""

    def __init__(self, class_counts: np.ndarray, seed: int = 7):
        r, n = np.random.default_rng(seed), len(class_counts)
        q = class_counts + ADD
        self.log_q = np.log(q / q.sum()).astype(np.float32)
        self.noise = np.cumsum(q / q.sum())[:-1]
        self.R = r.normal(0, 0.3, (n + 1, SIZE)).astype(np.float32)
        self.Q = r.normal(0, 0.1, (n, SIZE)).astype(np.float32)
        self.b = self.log_q.copy()
        self.C = np.ones((3, SIZE), np.float32)
        self.squares = [np.full(x.shape, 1e-2, np.float32) for x in self.parameters()]
        self.updates = 0

    def state(self) -> np.ndarray:
        return self.flat().copy()

    def restore(self, flat: np.ndarray) -> None:
        self.put(flat)

    def parameters(self) -> list[np.ndarray]:
        return [self.R, self.Q, self.b, self.C]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parameters()])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.parameters():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    @property
    def before(self) -> int:
        return len(self.Q)

    def padded(self, classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text behind SPAN marks of its beginning; and where the tokens are."""
        where = np.arange(len(classes)) + SPAN * np.repeat(np.arange(1, len(starts) + 1), np.diff(np.append(starts, len(classes))))
        out = np.full(len(classes) + SPAN * len(starts), self.before, np.int32)
        out[where] = classes
        return out, where

    def predict(self, seq: np.ndarray, at: np.ndarray, low: int) -> tuple[np.ndarray, tuple]:
        """Predicted vectors at positions ``at`` of ``seq``, which lie in [low, ...)."""
        first = low - SPAN
        v = self.R[seq[first : at[-1]]]
        sums = np.zeros((len(v) + 1, SIZE), np.float32)
        np.cumsum(v, axis=0, out=sums[1:])
        rel = at - first
        parts = (v[rel - 1], v[rel - 2], (sums[rel] - sums[rel - SPAN]) / SPAN)
        return parts[0] * self.C[0] + parts[1] * self.C[1] + parts[2] * self.C[2], parts

    def update(self, seq: np.ndarray, at: np.ndarray, r: np.random.Generator) -> None:
        """One step of noise-contrastive estimation with noise shared by all positions ``at``."""
        self.updates += 1
        n, low, target = len(self.Q), int(at[0]), seq[at]
        p, parts = self.predict(seq, at, low)
        noise = np.searchsorted(self.noise, r.random(NOISE))
        log_k = math.log(NOISE)
        with np.errstate(over="ignore"):
            data = 1 / (1 + np.exp(np.einsum("ij,ij->i", p, self.Q[target]) + self.b[target] - self.log_q[target] - log_k))
            false = -1 / (1 + np.exp(log_k + self.log_q[noise] - self.b[noise] - p @ self.Q[noise].T))
        every = np.arange(SIZE)

        def gathered(ids, rows, k):  # sums of the rows of each id
            return np.bincount((ids[:, None] * SIZE + every).ravel(), rows.ravel(), k * SIZE).reshape(k, SIZE)

        d_p = data[:, None] * self.Q[target] + false @ self.Q[noise]
        d_q = gathered(target, data[:, None] * p, n)
        np.add.at(d_q, noise, false.T @ p)
        d_b = np.bincount(target, data, n)
        np.add.at(d_b, noise, false.sum(0))
        d_c = np.stack([(d_p * x).sum(0) for x in parts])
        first = low - SPAN
        spread = np.zeros((at[-1] + 1 - first + SPAN, SIZE), np.float32)
        spread[at - first] = d_p
        sums = np.concatenate([np.zeros((1, SIZE), np.float32), np.cumsum(spread, axis=0)])
        m = at[-1] - first
        g = spread[1 : m + 1] * self.C[0] + spread[2 : m + 2] * self.C[1] + (sums[1 + SPAN : m + 1 + SPAN] - sums[1 : m + 1]) * (self.C[2] / SPAN)
        ids = seq[first : at[-1]]
        d_r = gathered(ids, g, n + 1)
        for x, d, s in zip(self.parameters(), (d_r, d_q, d_b, d_c), self.squares, strict=True):
            d = (d / len(at)).astype(np.float32) * 30
            s += d * d
            x += RATE * d / np.sqrt(s)

    def log10_probabilities(self, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each token's class given those before it in its text, normalised over all classes."""
        seq, where = self.padded(classes, starts)
        out, ones = np.empty(len(classes)), np.ones(len(self.Q), np.float32)
        for k in range(0, len(where), SCORED):
            at = where[k : k + SCORED]
            p, _ = self.predict(seq, at, int(at[0]))
            logits = p @ self.Q.T
            logits += self.b
            own = logits[np.arange(len(at)), seq[at]].astype(np.float64)
            np.exp(logits, out=logits)
            out[k : k + SCORED] = own - np.log((logits @ ones).astype(np.float64))
        return out / math.log(10)


class Lexicon:
    """Frequent tokens, their counts and classes; endings; each class's tokens and distinct tokens."""

    def __init__(self, head: list[tuple[bytes, int]], words: list[bytes], endings: list[bytes], totals: dict[int, tuple[int, int]]):
        self.words = {w: k for k, w in enumerate(words)}
        self.endings = {e: len(words) + 1 + k for k, e in enumerate(endings)}
        self.rest = len(words)
        self.index = {t: k for k, (t, _) in enumerate(head)}
        self.classes = np.array([self.class_of(t) for t, _ in head] + [0], np.int32)
        self.log_count = np.array([math.log10(c + ADD) for _, c in head] + [0.0])
        self.seen = np.array([c > 0 for _, c in head] + [False])
        n = len(words) + 1 + len(endings)
        self.n_class = np.array([totals.get(k, (0, 0))[0] for k in range(n)], np.int64)
        kinds = np.array([totals.get(k, (0, 0))[1] for k in range(n)], np.int64)
        self.tokens, self.kinds = int(self.n_class.sum()), int(kinds.sum())
        self.log_all = math.log10(self.tokens + ADD * (self.kinds + 1))
        self.log_class = np.log10(self.n_class + ADD * (kinds + 1))
        self.single = np.arange(n) < len(words)

    def class_of(self, token: bytes) -> int:
        k = self.words.get(token)
        return k if k is not None else self.endings.get(token[-2:], self.rest)

    def read(self, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``head`` (-1: not there) and classes of all tokens."""
        found = np.fromiter(map(self.index.get, batch.distinct, repeat(-1)), np.int64, len(batch.distinct))
        classes = self.classes[found]
        for k in np.flatnonzero(found < 0).tolist():
            classes[k] = self.class_of(batch.distinct[k])
        return batch.with_ends(found, self.index.get(END, -1)), batch.with_ends(classes, self.words[END])


def _tails(batch: Batch, lex: Lexicon) -> tuple[pa.Array, pa.Array]:
    """Of each text: its distinct words that are not in the head, and how often each stands in it."""
    missing = np.fromiter((w not in lex.index for w in batch.distinct), bool, len(batch.distinct))
    at = np.flatnonzero(missing[batch.codes])
    texts = np.repeat(np.arange(len(batch.sizes)), batch.sizes)[at]
    keys, n = np.unique(texts * len(batch.distinct) + batch.codes[at], return_counts=True)
    offsets = pa.array(np.searchsorted(keys, np.arange(len(batch.sizes) + 1) * len(batch.distinct)), pa.int32())
    words = pa.array(batch.distinct, pa.binary()).take(pa.array(keys % max(1, len(batch.distinct))))
    return pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))


def held_out() -> Column:
    """By the CRC-32 of doc_id as text; a null doc_id counts as an empty text, so is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def token_counts(train: DataFrame) -> DataFrame:
    """(token binary, c long) over all of ``train``: summed in each task, then by token."""

    def run(batches):
        held: Counter = Counter()

        def sent():
            row = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
            held.clear()
            return row

        for batch in batches:
            own = Batch(batch.column("body"))
            counts = np.bincount(own.codes, minlength=len(own.distinct)).tolist()
            for word, n in zip(own.distinct, counts, strict=True):
                if n:
                    held[word] += n
            held[END] += batch.num_rows
            if len(held) >= FLUSH:
                yield sent()
        yield sent()
        pa.default_memory_pool().release_unused()

    return train.select("body").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def lexicon(counts: DataFrame, head: int = HEAD) -> Lexicon:
    so_far, least = 0, 1 << 62
    for c, n in sorted(((r["c"], r["n"]) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True):  # a row for each count
        if so_far + n > head:
            break
        so_far, least = so_far + n, c
    top = sorted(((bytes(r["token"]), r["c"]) for r in counts.where(F.col("c") >= least).collect()), key=lambda t: (-t[1], t[0]))
    if END not in dict(top):  # its count is always at hand
        top.append((END, sum(r["c"] for r in counts.where(F.col("token") == F.lit(bytearray(END))).collect())))
    words = [END, *[t for t, _ in top if t != END][: WORDS - 1]]
    own = counts.sparkSession.createDataFrame([(w, k) for k, w in enumerate(words)], "token binary, word int")
    known = counts.join(F.broadcast(own), "token", "left").withColumn("ending", F.expr("substring(token, greatest(1, length(token) - 1), 2)"))
    sums = known.where("word is null").groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"))
    rows = sorted(((bytes(r["ending"]), r["n"], r["kinds"]) for r in sums.collect()), key=lambda r: (-r[1], r[0]))  # at most 65,792
    endings = [e for e, _, _ in rows[: ENDINGS - 1]]
    totals = {len(words) + 1 + k: (n, kinds) for k, (_, n, kinds) in enumerate(rows[: ENDINGS - 1])}
    totals[len(words)] = (sum(r[1] for r in rows[ENDINGS - 1 :]), sum(r[2] for r in rows[ENDINGS - 1 :]))
    counted = dict(top)
    totals |= {k: (counted[w], int(counted[w] > 0)) for k, w in enumerate(words)}
    return Lexicon(top, words, endings, totals)


def train_model(train: DataFrame, lex) -> Model:
    """``lex``: a broadcast Lexicon; ``train``: (doc_id, body). Rounds of shards and means, as said above."""
    spark, start = train.sparkSession, Model(lex.value.n_class)
    shards = max(LEAST_SHARDS, -(-lex.value.tokens // (ROUNDS * SHARD_TOKENS)))
    placed = train.select("doc_id", "body", F.pmod(F.xxhash64(F.lit("round"), "doc_id", "body"), F.lit(ROUNDS)).alias("round"), F.pmod(F.xxhash64(F.lit("shard"), "doc_id", "body"), F.lit(shards)).cast("int").alias("shard"))
    kind = "flat binary, tokens long"

    def total(batches):
        flat, tokens = 0.0, 0
        for batch in batches:
            for x, n in zip(batch.column("flat"), batch.column("tokens"), strict=True):
                flat, tokens = flat + np.frombuffer(x.as_py()), tokens + n.as_py()
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["flat", "tokens"])

    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(start.state())

        def run(batches, shared=shared, k=k):
            own = lex.value
            shard = None

            def end():
                while kept and model.updates < LEAST_UPDATES:
                    for seq, at in kept:
                        model.update(seq, at, r)
                return pa.RecordBatch.from_arrays([pa.array([(model.flat().astype(np.float64) * tokens).tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["flat", "tokens"])

            for batch in batches:
                ids = batch.column("shard").to_numpy()
                for first, last in _spans(ids):
                    if ids[first] != shard:
                        if shard is not None:
                            yield end()
                        shard, kept, tokens, rest = ids[first], [], 0, None
                        model = Model(own.n_class)
                        model.restore(shared.value)
                        r = np.random.default_rng([11, k, int(shard)])
                    read = Batch(batch.column("body").slice(first, last - first))
                    seq, where = model.padded(own.read(read)[1], read.starts)
                    tokens += len(where)
                    if rest is not None:  # positions that no update had yet, so that chunks don't depend on batches
                        seq, where = np.concatenate([rest[0], seq]), np.concatenate([rest[1], where + len(rest[0])])
                    whole = len(where) // CHUNK * CHUNK
                    for at in np.split(where[:whole], whole // CHUNK) if whole else []:
                        model.update(seq, at, r)
                        if len(kept) < KEPT_CHUNKS:
                            low = int(at[0]) - SPAN
                            kept.append((seq[low : at[-1] + 1].copy(), at - low))
                    rest = _tail(seq, where[whole:])
            if shard is not None:
                if rest is not None and len(rest[1]):
                    model.update(*rest, r)
                    kept = kept or [rest]
                yield end()

        # several shards may share a task; each has a model of its own
        part = placed.where(F.col("round") == k).repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "body").select("shard", "body")
        sums = part.mapInArrow(run, kind).repartition(8).mapInArrow(total, kind).collect()
        if sums:
            start.put(sum(np.frombuffer(bytes(p["flat"])) for p in sorted(sums, key=lambda p: bytes(p["flat"]))) / sum(p["tokens"] for p in sums))
        shared.destroy()
    return start


def _spans(ids: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values, as (first, last exclusive)."""
    borders = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
    return [(a, b) for a, b in zip(borders, borders[1:], strict=False) if a < b]


def _tail(seq: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """What is left of a padded sequence for later updates, with as much before it as contexts need."""
    if not len(where):
        return None
    low = int(where[0]) - SPAN
    return seq[low:].copy(), where - low


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    A null text counts as empty: its only token is the end. Repeated rows are counted and scored each. With no training
    document all counts are 0. Texts of any length are read whole; equal texts of one doc_id are ties that change nothing.
    Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.col("text").alias("body"), held_out().alias("held_out"))
    train = rows.where("not held_out")
    counts = materialize(token_counts(train), "counts")
    lex = spark.sparkContext.broadcast(lexicon(counts, head))
    model = spark.sparkContext.broadcast(train_model(train.select("doc_id", "body"), lex))
    id_kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own, lm, n_row = lex.value, model.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            read = Batch(batch.column("body"))
            found, classes = own.read(read)
            starts, sizes = read.starts, read.sizes + 1
            rare = ~own.single[classes]
            by_class = lm.log10_probabilities(classes, starts)
            by_class += np.where(rare, own.log_count[found] - own.log_class[classes], 0)
            base = own.log_count[found] - own.log_all
            n = len(sizes)
            tails = _tails(read, own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(n_row, n_row + n), pa.int64()),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(sizes),
                    pa.array(np.add.reduceat(own.seen[found].astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(by_class, starts)),
                    *tails,
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "tail_n"],
            )
            n_row += n

    kind = f"row long, doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<binary>, tail_n array<bigint>"
    scored = materialize(rows.mapInArrow(run, kind), "scored")
    tokens = lex.value.tokens
    lex.destroy()  # so that reused Python workers drop their copies
    model.destroy()
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("token"), F.col("t.tail_n").alias("n"))
    met = tail.join(counts, "token", "left").groupBy("row").agg(F.sum(F.expr(f"n * log10(coalesce(c, 0) + {ADD}D)")).alias("more"), F.sum(F.expr("if(c > 0, n, 0)")).alias("known"))
    return scored.drop("tail", "tail_n").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
