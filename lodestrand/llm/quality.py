"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Trusted documents are those labelled quality 1. All of them, in two folds by a hash of doc_id, fit two models; every
document is scored by the model of the fold that it isn't in, so none by one that saw it.
Documents meet counts in shards of their n-grams' middle words: one exchange brings the trusted documents' trigrams to their
shards, which tell the counts of counts and the continuation counts of words; from these the driver makes the discounts and
the words' probabilities. Another exchange brings all documents' trigrams: each shard counts the trusted ones, gives every
word its probability under the other fold's model, and returns sums for each document. No table of n-grams is written; texts
are read and cut into words twice instead. N-grams of a frequent middle word are dealt to several shards by their first word,
and the counts of their bigrams are added up between the two exchanges. Each language's limit is a quantile of the
perplexities of all trusted documents. Words are told apart by 64-bit hashes, n-grams by their words' numbers. Words that are
not in both folds are told apart by their shape only, and share its probability evenly. A run of one word counts once in
training (labels are noisy, and a model that learns such runs from a few documents takes any for prose); elsewhere each
further word of it costs what an unseen word does.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, repeat
from operator import eq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestrand.llm.common import discard, materialize, release_shuffles, small_batches, table

#: Most words, and fewest trusted occurrences of one, whose n-grams are dealt to several shards by their first word.
HEAD, HEAVY = 2_000, 1_000
#: Words' worth of n-grams in a shard, about (the session's number of shuffle partitions is the least number of shards); in
#: what a task counts at once; and in what is sent together, at least and at most.
PASS, CHUNK, BLOCK = 1_000_000, 2_000_000, (200_000, 2_000_000)
#: Documents meet the shards in so many passes, each of a part of all shards, to need less disk at once.
PASSES = 2
#: Words whose numbers a task keeps at hand.
CACHE = 400_000
#: Rejected rows whose numbers are sent to all tasks; more are joined.
FEW = 2_000_000
#: Limit: this quantile of log10 perplexity of trusted documents of the language, plus a margin. A language with fewer
#: than LEAST of them takes the quantile over all languages.
QUANTILE, MARGIN, LEAST = 0.99, 0.15, 25
#: Words' worth of the language's mean that a document's own mean is drawn to, so that short texts aren't judged by chance.
PRIOR = 12
_RUNS = regex.compile(r"(?P<A>[\p{Lu}\p{Lt}]+)|(?P<a>[\p{Ll}\p{Lo}\p{Lm}][\p{Ll}\p{Lo}\p{Lm}\p{M}]*)|(?P<n>\p{N}+)|(?P<p>[^\p{L}\p{N}]+)")


def shape(word: str) -> str:
    """What stands for an unknown word: its runs of capitals, other letters, digits and each other character, up to four."""
    out = []
    for m in _RUNS.finditer(word):
        kind = m.lastgroup
        out.append({"A": "A", "a": "a", "n": "9"}.get(kind) or m[0][0])
        if len(out) == 5:
            break
    return "\0" + "".join(out[:4]) + ("+" if len(out) > 4 or len(word) > 24 else "")


def _hashes(words: list[str]) -> np.ndarray:
    """Spark's xxhash64 of each word."""
    return np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], np.uint64).view(np.int64)


class Numbers:
    """The number of each known word: of ``names`` by name, of the others after them, by their ``ranks``, which lie in the
    order of their sorted ``hashes``."""

    def __init__(self, names: list[str], hashes: np.ndarray, ranks: np.ndarray):
        self.names, self.hashes, self.ranks = {w: k for k, w in enumerate(names)}, hashes, ranks

    def __len__(self) -> int:
        return len(self.names) + len(self.hashes)

    def of(self, words: list[str]) -> np.ndarray:
        """-1 for unknown words."""
        out = np.full(len(words), -1, np.int64)
        if len(self.hashes) and words:
            h = _hashes(words)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, self.ranks[at] + np.int64(len(self.names)), -1)
        for k, w in enumerate(words):
            if w in self.names:
                out[k] = self.names[w]
        return out

    def __contains__(self, word: str) -> bool:
        return self.of([word])[0] >= 0

    def __getitem__(self, word: str) -> int:
        n = int(self.of([word])[0])
        if n < 0:
            raise KeyError(word)
        return n

    def values(self) -> range:
        return range(len(self))


class Words:
    """Numbers of words and shapes; 0 begins a text, 1 ends it, 2 is any other shape, 3 the word before once more."""

    def __init__(self, hashes: np.ndarray, ranks: np.ndarray, shapes: list[str]):
        self.numbers = Numbers(["\0<s>", "\0</s>", "\0?", "\0=", *shapes], hashes, ranks)
        self.cache: dict[str, int] = dict(self.numbers.names)

    def number(self, word: str) -> int:
        """Of a word that is not known by itself."""
        return self.numbers.names.get(shape(word), 2)

    def _learn(self, words: list[str]) -> None:
        if len(self.cache) + len(words) > CACHE:
            self.cache = dict(self.numbers.names)
        for w, n in zip(words, self.numbers.of(words).tolist(), strict=True):
            self.cache[w] = n if n >= 0 else self.number(w)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' words, each text within two beginnings and an end; and where each text begins."""
        split = [["\0<s>", "\0<s>", *t.split(), "\0</s>"] for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        every = list(chain.from_iterable(split))
        ids = np.fromiter(map(self.cache.get, every, repeat(-1)), np.int64, len(every))
        new = np.flatnonzero(ids < 0).tolist()
        if new:
            self._learn(list({every[k]: None for k in new}))
            # a cache that was emptied lacks other words, not these
            ids[new] = [self.cache[every[k]] for k in new]
        same = np.fromiter(map(eq, every[1:], every), bool, max(0, len(every) - 1))
        ids[1:][same & (ids[1:] > 1)] = 3
        return ids, np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)


def _trigrams(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the last words of all trigrams within a text, and how many each text has."""
    inside = np.ones(len(ids), bool)
    inside[starts] = False
    inside[starts + 1] = False
    return np.flatnonzero(inside), np.diff(np.append(starts, len(ids))) - 2


def _without_runs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    real = ids != 3
    return ids[real], starts - np.concatenate(([0], np.cumsum(~real)))[starts]


#: What a text's n-grams are for: its fold, and whether they are counted and scored.
_ONE, _COUNTED, _SCORED = 1, 2, 4


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the least ones first: those of frequent words differ in few of them."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").reshape(n).astype(np.int64)


def _packed(words: Sequence[np.ndarray], sizes: np.ndarray, flags: np.ndarray) -> bytes:
    """Columns ``words`` of trigrams in the order of their texts, ``sizes`` and ``flags`` of these."""
    n, texts = len(words[0]), len(sizes)
    raw = b"".join([np.array([n, texts], "<i8").tobytes(), *map(_planes, words), _planes(sizes), flags.astype(np.uint8).tobytes()])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(body: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns, the place of each trigram's text, and the texts' flags."""
    raw = pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True)
    n, texts = np.frombuffer(raw, "<i8", 2).tolist()
    words = [_from_planes(raw, 16 + 4 * n * k, n) for k in range(3)]
    return words, np.repeat(np.arange(texts), _from_planes(raw, 16 + 12 * n, texts)), np.frombuffer(raw, np.uint8, texts, 16 + 12 * n + 4 * texts).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(29)) * np.uint64(0x165667B19E3779F9) >> np.uint64(20)).astype(np.int64)


class Model:
    """``words``; of each fold and word, ``p1``: probability without a context; ``spell``: log10 of a word's share of its shape.
    ``parts``: to how many of ``shards`` or more the n-grams of a middle word are dealt, 1 for words beyond. D1, D2 and D3+ of bigrams (``d2``)
    and trigrams (``d3``) of each fold."""

    def __init__(self, words: Words, parts: np.ndarray, spell: np.ndarray, shards: int):
        self.words, self.parts, self.spell, self.shards = words, parts, spell, shards
        self.p1 = self.d2 = self.d3 = None

    def __getstate__(self):
        # only names have shares
        return self.__dict__ | {"spell": self.spell[:, : len(self.words.numbers.names)]}

    def shard(self, u: np.ndarray, v: np.ndarray, shards: int) -> np.ndarray:
        of = self.parts[np.minimum(v, len(self.parts) - 1)]
        return (_mixed(v) + _mixed(u) % of) % shards

    def heavy(self, v: np.ndarray) -> np.ndarray:
        return self.parts[np.minimum(v, len(self.parts) - 1)] > 1

    def dealt(self, ids: np.ndarray, at: np.ndarray, sizes: np.ndarray, flags: np.ndarray, shards: int, nth: int = 0, of: int = 1) -> Iterator[tuple[int, bytes]]:
        """(shard, packed trigrams) of those with last words at ``at``; of each ``of`` shards, the ``nth``."""
        u, v, w = ids[at - 2], ids[at - 1], ids[at]
        text = np.repeat(np.arange(len(sizes)), sizes)
        shard = self.shard(u, v, shards)
        if of > 1:
            on = shard % of == nth
            u, v, w, text, shard = u[on], v[on], w[on], text[on], shard[on]
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        u, v, w, text, shard = u[order], v[order], w[order], text[order], shard[order]
        new = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(new.tolist(), [*new.tolist(), len(shard)][1:], strict=True):
            yield int(shard[a]), _packed([u[a:b], v[a:b], w[a:b]], np.bincount(text[a:b], minlength=len(sizes)), flags)


class Shard:
    """Counts of the trigrams of some middle words ``own`` (sorted), as sorted keys: a middle word's place, the model, then
    first and last word."""

    def __init__(self, own: np.ndarray, size: int):
        self.own, self.bits = own, size.bit_length()
        if 2 * self.bits + 1 + len(own).bit_length() > 63:
            raise ValueError(f"{size} words and {len(own)} middle words in a shard don't fit a key; lower PASS")
        self.keys, self.counts, self.waiting = np.empty(0, np.int64), np.empty(0, np.int64), []

    def key(self, model: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return ((np.searchsorted(self.own, v) << 1 | model) << self.bits | u) << self.bits | w

    def add(self, body: bytes) -> None:
        (u, v, w), text, flags = _unpacked(body)
        flag = flags[text]
        on = (flag & _COUNTED) > 0
        # a text counts for the model that scores the other fold
        self.waiting.append(self.key(1 - (flag[on] & _ONE), u[on], v[on], w[on]))
        if sum(map(len, self.waiting)) > CHUNK:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate(self.waiting) if self.waiting else self.keys[:0]
        keys, counts = np.unique(keys, return_counts=True)
        self.waiting = []
        if len(self.keys):
            both, at = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
            counts = np.bincount(at, np.concatenate((self.counts, counts)), len(both)).astype(np.int64)
            keys = both
        self.keys, self.counts = keys, counts

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys (place, model, last word) and continuation counts."""
        return np.unique(self.keys >> 2 * self.bits << self.bits | self.keys & (1 << self.bits) - 1, return_counts=True)

    def parsed(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Model, middle and last word of keys of bigrams."""
        return pairs >> self.bits & 1, self.own[pairs >> self.bits + 1], pairs & (1 << self.bits) - 1


def _contexts(keys: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted ``keys``, the sums of their counts, and the weight that discounts ``d`` leave to the lower order."""
    if not len(keys):
        return keys, counts, np.empty(0)
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    total = np.add.reduceat(counts, first)
    return keys[first], total, np.add.reduceat(d, first) / total


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` among sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _discounts(n: Sequence[int]) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney; 0.5, 1 and 1.5 where counts of counts (of 1 to 4) are too thin to tell."""
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3)]


def _few(model: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each model, how many counts are 1 to 4."""
    return np.array([np.bincount(np.minimum(counts[model == f], 5), minlength=6)[1:5] for f in (0, 1)])


def _owned(model: Model, shard: int, shards: int) -> np.ndarray:
    """Middle words that may be in a shard."""
    every = np.arange(len(model.words.numbers))
    return every[model.heavy(every) | (_mixed(every) % shards == shard)]


def _by_shard(batches: Iterable[pa.RecordBatch], *columns: str) -> dict[int, list[tuple]]:
    """Rows of ``columns`` of each shard, as they came, n-grams still packed."""
    held = defaultdict(list)
    for batch in batches:
        for shard, *row in zip(batch.column("shard").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            held[shard].append(tuple(row))
    return held


def _blocks(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches that are sent together: the more, the more shards share them."""
    held, size, most = [], 0, 6 * min(BLOCK[1], max(BLOCK[0], 4_000 * shards))
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("text").nbytes
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _shards(spark: SparkSession, words: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1 + words // PASS)


def fit(sample: DataFrame) -> tuple[Model, DataFrame]:
    """The models of all texts in ``sample`` (text, fold), and the counts of bigrams (key, c) that begin with a word of several
    shards."""
    spark = sample.sparkSession
    counted = materialize(sample.select("fold", F.explode(F.split("text", r"\s+")).alias("w")).where("w <> ''").groupBy("w").agg(F.max(F.col("fold") == 0).alias("in0"), F.max(F.col("fold") == 1).alias("in1"), F.count("*").alias("m")), "words")
    own = counted.where("in0 and in1").where(~F.col("w").startswith("\0")).select(F.xxhash64("w").alias("h"), "m").toArrow()
    known, at = np.unique(own.column("h").to_numpy(), return_index=True)
    often = own.column("m").to_numpy()[at]
    del own
    ranks = np.empty(len(known), np.int32)
    ranks[np.lexsort((known, -often))] = np.arange(len(known), dtype=np.int32)  # frequent words have small numbers

    def shaped(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(shape, batch.column("w").to_pylist()), pa.string()), batch.column("in1"), batch.column("m")], names=["shape", "in1", "m"])

    lone = counted.where("in0 <> in1").select("w", "in1", "m").mapInArrow(shaped, "shape string, in1 boolean, m long").groupBy("shape").agg(F.count_if(~F.col("in1")).alias("n0"), F.count_if("in1").alias("n1"), F.sum("m").alias("m"))
    shapes: list[Counter] = [Counter(), Counter()]
    lone = materialize(lone, "shapes")
    own = lone.where("n0 > 0 and n1 > 0").toArrow()  # a row for each shape
    uses = {}
    for name, n0, n1, m in zip(*(own.column(c).to_pylist() for c in ("shape", "n0", "n1", "m")), strict=True):
        shapes[0][name], shapes[1][name], uses[name] = n0, n1, m
    lost = lone.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n0", "n1", "m")]).first()
    words = Words(known, ranks, sorted(shapes[0]))
    discard(counted, lone)
    release_shuffles(spark)
    size = len(words.numbers)
    # a shape stands for many words: each has an even share, as many as the fold's texts tell of (any other shape: of all)
    spell = np.zeros((2, size))
    for f in (0, 1):
        spell[f, 2] = -np.log10(1 + lost[1 - f])
        for name in shapes[0]:
            spell[f, words.numbers[name]] = -np.log10(1 + shapes[1 - f][name])
    uses = np.concatenate(([sample.count(), 0, lost[2] - sum(uses.values()), 0], [uses[w] for w in sorted(shapes[0])], np.sort(often)[::-1])).astype(np.int64)
    total = int(uses.sum())
    shards = _shards(spark, total)
    heavy = np.flatnonzero(uses > max(HEAVY, total // shards))
    heavy = heavy[np.argsort(-uses[heavy], kind="stable")[:HEAD]]
    parts = np.ones(2 + max(3, int(heavy.max(initial=0))), np.int64)
    parts[heavy] = np.minimum(shards, 1 + uses[heavy] * shards // max(1, total))
    parts[3] = shards  # no model has n-grams of a word that is the one before once more
    model = Model(words, parts, spell, shards)
    shared = spark.sparkContext.broadcast(model)

    def deal(batches):
        for block in _blocks(batches, shards):
            rows = [(t, f) for b in block for t, f in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True) if t]
            rows.sort(key=lambda r: r[1])  # all texts of a fold as one
            if rows:
                at, sizes = _trigrams(*(found := _without_runs(*shared.value.words.read([t for t, _ in rows]))))
                by_fold = np.bincount([f for _, f in rows], sizes, 2).astype(np.int64)
                out = list(shared.value.dealt(found[0], at, by_fold, np.array([_COUNTED, _COUNTED | _ONE]), shards))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["shard", "body"])

    def count(batches):
        model = shared.value
        for k, rows in _by_shard(batches, "body").items():
            own = Shard(_owned(model, k, shards), len(model.words.numbers))
            for (body,) in rows:
                own.add(body)
            own.settle()
            pairs, n = own.bigrams()
            f, v, w = own.parsed(pairs)
            many = model.heavy(v)
            words, c = np.unique(f[~many] << 32 | w[~many], return_counts=True)
            few = np.concatenate([_few(own.keys >> 2 * own.bits & 1, own.counts).ravel(), _few(f[~many], n[~many]).ravel()])
            for kind, at, middle, c in (0, np.arange(16), np.zeros(16), few), (1, words, np.zeros(len(words)), c), (2, f[many] << 32 | w[many], v[many], n[many]):
                columns = [pa.array(np.full(len(at), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (at, middle, c))]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "w", "v", "c"])

    met = sample.select("text", "fold").mapInArrow(deal, "shard int, body binary").repartitionById(shards, "shard")
    counted = materialize(met.mapInArrow(count, "kind int, w long, v long, c long"), "counts")
    pairs = materialize(counted.where("kind = 2").groupBy("w", "v").agg(F.sum("c").alias("c")), "pairs")
    few = np.zeros(16, np.int64)
    for r in counted.where("kind = 0").groupBy("w").agg(F.sum("c").alias("c")).collect():
        few[r["w"]] = r["c"]
    few = few.reshape(2, 2, 4)
    for r in pairs.groupBy(F.shiftright("w", 32).alias("f")).agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect():
        few[1, r["f"]] += [r[f"n{k}"] for k in (1, 2, 3, 4)]
    model.d3, model.d2 = (np.array([[0, *_discounts(n)] for n in x.tolist()]) for x in few)
    own = counted.where("kind = 1").select("w", "c").unionByName(pairs.groupBy("w").agg(F.count("*").alias("c"))).groupBy("w").agg(F.sum("c").alias("c")).toArrow()  # a row for each word
    at, c = own.column("w").to_numpy(), own.column("c").to_numpy()
    del own
    model.p1 = np.full((2, size), 1 / (size - 1), np.float32)
    for f in (0, 1):
        on = at >> 32 == f
        if on.any():
            n = c[on]
            d = np.array([0, *_discounts(_few(np.zeros(len(n)), n)[0].tolist())])[np.minimum(n, 3)]
            model.p1[f] = d.sum() / n.sum() / (size - 1)
            model.p1[f, at[on] & (1 << 32) - 1] += (n - d) / n.sum()
    discard(counted)
    release_shuffles(spark)
    shared.destroy()  # so that reused Python workers drop their copies
    return model, pairs


def _good(labels: DataFrame) -> DataFrame:
    """Ids of documents whose labels all say quality 1."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__q"))
    return known.where("__q = 1").select(F.col("doc_id").alias("__id"))


def fold_of() -> Column:
    """0 or 1, by a hash of doc_id; a null doc_id has one of its own."""
    return F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int")


def _sample(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(text, fold) of the documents that fit the models: all trusted ones. Texts need no exchange as long as the trusted
    documents' ids fit every task."""
    ids = F.broadcast(good) if good.count() <= FEW else good
    return docs.select("doc_id", "text").where("text is not null").join(ids, F.col("doc_id") == F.col("__id"), "left_semi").select("text", fold_of().alias("fold"))


def _scores(model: Model, own: Shard, pairs: Sequence[tuple[np.ndarray, ...]]):
    """A function that gives trigrams' log10 probabilities; ``pairs``: (w with model, v, c) of bigrams of words of several
    shards."""
    bits = own.bits
    keys2, c2 = own.bigrams()
    here = ~model.heavy(own.parsed(keys2)[1])
    more = [np.concatenate(x) for x in zip(*pairs, strict=True)] if pairs else [np.empty(0, np.int64)] * 3
    of = (np.searchsorted(own.own, more[1]) << 1 | more[0] >> 32) << bits | more[0] & (1 << 32) - 1
    keys2, c2 = np.concatenate((keys2[here], of)), np.concatenate((c2[here], more[2]))
    order = np.argsort(keys2)
    keys2, c2 = keys2[order], c2[order]
    d2 = model.d2[keys2 >> bits & 1, np.minimum(c2, 3)]
    of2, total2, weight2 = _contexts(keys2 >> bits, c2, d2)
    d3 = model.d3[own.keys >> 2 * bits & 1, np.minimum(own.counts, 3)]
    of3, total3, weight3 = _contexts(own.keys >> bits, own.counts, d3)

    def step(keys, c, d, of, total, weight, key, context, lower):
        at, hit = _at(keys, key)
        in_, seen = _at(of, context)
        if not len(of):
            return lower
        p = weight[in_] * lower + np.where(hit, c[at] - d[at], 0) / total[in_]
        return np.where(seen, p, lower)

    def score(f, u, v, w):
        key = own.key(f, u, v, w)
        p = step(keys2, c2, d2, of2, total2, weight2, key >> 2 * bits << bits | w, key >> 2 * bits, model.p1[f, w])
        p = step(own.keys, own.counts, d3, of3, total3, weight3, key, key >> bits, p)
        names = model.spell.shape[1]
        return np.log10(p) + np.where(w < names, model.spell[f, np.minimum(w, names - 1)], 0)

    return score


def _score(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The columns of ``docs`` but the text, n: words, sum: log10 probability of words and end, under the other fold's model."""
    spark = docs.sparkSession
    model, pairs = fit(_sample(docs, good))
    shared = spark.sparkContext.broadcast(model)
    trusted = F.broadcast(good) if good.count() <= FEW else good
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(model.shards, _shards(spark, size // 6))
    passes = min(PASSES, shards)
    given = docs.withColumn("fold", fold_of()).join(trusted.select("__id", F.lit(True).alias("__good")), F.col("doc_id") == F.col("__id"), "left")
    given = given.select("text", "fold", F.coalesce("__good", F.lit(False)).alias("good"), F.struct(*[c for c in docs.columns if c != "text"], F.xxhash64("text").alias("__h")).alias("doc"))
    carried = T.StructType([T.StructField("n", T.LongType()), given.schema["doc"]])
    kind = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("docs", T.ArrayType(carried))])
    summed = T.StructType(kind.fields[1:])

    def rows(shard, block, body, docs=None):
        """Rows without documents, or one with some."""
        n = len(body)
        empty = pa.nulls(n, list_type)
        return pa.RecordBatch.from_arrays([*([pa.array(shard, pa.int32())] if shard is not None else []), pa.array(block, pa.int64()), pa.array(body, pa.binary()), empty if docs is None else docs], names=kind.names[shard is None :])

    list_type = to_arrow_type(T.ArrayType(carried))

    def deals(nth):
        def deal(batches):
            model, block = shared.value, TaskContext.get().partitionId() << 40
            for held in _blocks(batches, shards):
                texts, folds, goods = ([x for b in held for x in b.column(c).to_pylist()] for c in ("text", "fold", "good"))
                flags = np.array(folds, np.int64) * _ONE
                ids, starts = model.words.read([t or "" for t in texts])
                at, sizes = _trigrams(ids, starts)
                docs = pa.concat_arrays([b.column("doc") for b in held])
                structs = pa.StructArray.from_arrays([pa.array(sizes - 1, pa.int64()), docs.cast(list_type.value_type.field("doc").type)], fields=list(list_type.value_type))
                yield rows([block % shards], [block], [None], pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), structs).cast(list_type))
                # runs of a word are scored, but counted once: where a trusted text has one, what is counted and scored is sent apart
                counts = np.array([bool(g and t) for g, t in zip(goods, texts, strict=True)])
                text, run = np.repeat(np.arange(len(texts)), sizes), ids == 3
                apart = counts[text] & (run[at] | run[at - 1] | run[at - 2])
                number = lambda of: np.bincount(of, minlength=len(texts))
                sent = [(ids, at[~apart], number(text[~apart]), flags | _SCORED | _COUNTED * counts)]
                if apart.any():
                    sent.append((ids, at[apart], number(text[apart]), flags | _SCORED))
                    left, (less, begin) = np.flatnonzero(~run), _without_runs(ids, starts)
                    at, sizes = _trigrams(less, begin)
                    text = np.repeat(np.arange(len(texts)), sizes)
                    on = counts[text] & (left[at] - left[at - 2] > 2)
                    sent.append((less, at[on], number(text[on]), flags | _COUNTED))
                for each in sent:
                    out = list(model.dealt(*each, shards, nth, passes))
                    yield rows([x for x, _ in out], [block] * len(out), [x for _, x in out])
                block += 1

        def deal_pairs(batches):
            model = shared.value
            for batch in batches:
                w, v, c = (batch.column(x).to_numpy() for x in ("w", "v", "c"))
                order = np.argsort(w >> 32, kind="stable")  # a model's number is in the upper bits
                w, v, c = w[order], v[order], c[order]
                of = model.parts[v]
                every = np.repeat(np.arange(len(v)), of)
                shard = (_mixed(v[every]) + np.arange(len(every)) - np.repeat(np.cumsum(of) - of, of)) % shards
                for k in np.unique(shard[shard % passes == nth]).tolist():
                    on = every[shard == k]
                    body = _packed([w[on] & (1 << 32) - 1, v[on], c[on]], np.bincount(w[on] >> 32, minlength=2), np.zeros(2))
                    yield rows([k], [-1], [body])

        return deal, deal_pairs

    def meet(batches):
        model, held = shared.value, defaultdict(list)
        for batch in batches:
            plain = batch.column("docs").is_null().to_numpy(zero_copy_only=False)
            if not plain.all():
                yield batch.filter(pa.array(~plain)).select(summed.names)
            for k, *row in zip(*(batch.filter(pa.array(plain)).column(x).to_pylist() for x in ("shard", "block", "body")), strict=True):
                held[k].append(row)
        for k, found in held.items():
            own = Shard(_owned(model, k, shards), len(model.words.numbers))
            pairs = []
            for block, body in found:
                if block >= 0:
                    own.add(body)
                else:
                    (w, v, c), f, _ = _unpacked(body)
                    pairs.append((f << 32 | w, v, c))
            own.settle()
            score, sums = _scores(model, own, pairs), []
            for block, body in found:
                if block < 0:
                    continue
                (u, v, w), text, flags = _unpacked(body)
                on = (flags[text] & _SCORED) > 0
                if on.any():
                    value = score(flags[text[on]] & _ONE, u[on], v[on], w[on])
                    sums.append((block, np.bincount(text[on], value, len(flags)).astype("<f4").tobytes()))
            if sums:
                yield rows(None, [x for x, _ in sums], [x for _, x in sums])

    def add(batches):
        docs, sums = {}, {}
        for batch in batches:
            for k, block in enumerate(batch.column("block").to_pylist()):
                if (body := batch.column("body")[k].as_py()) is None:
                    docs[block] = batch.column("docs")[k].values
                else:
                    own = np.frombuffer(body, "<f4")
                    sums[block] = sums[block] + own if block in sums else own.astype(float)
        for block, own in docs.items():
            doc = own.field("doc")
            yield pa.RecordBatch.from_arrays([*(doc.field(k) for k in range(doc.type.num_fields)), own.field("n"), pa.array(sums.get(block, np.zeros(len(own))))], names=last.names)

    last = T.StructType([*given.schema["doc"].dataType.fields, T.StructField("n", T.LongType()), T.StructField("sum", T.DoubleType())])
    found = []
    for nth in range(passes):
        deal, deal_pairs = deals(nth)
        met = given.mapInArrow(deal, kind).unionByName(pairs.mapInArrow(deal_pairs, kind)).repartitionById(shards, "shard")
        found.append(materialize(met.mapInArrow(meet, summed).repartition("block").mapInArrow(add, last), "pass"))
        release_shuffles(spark)
    # equal rows of equal texts have equal sums, so passes need not read rows in the same order
    every = functools.reduce(DataFrame.unionByName, [df.withColumn("__pass", F.lit(k)) for k, df in enumerate(found)])
    own = [c for c in last.names if c != "sum"]
    every = every.groupBy(*own).agg(F.count_if(F.col("__pass") == 0).alias("__k"), F.sum("sum").alias("sum"))
    every = every.withColumn("sum", F.col("sum") / F.col("__k")).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__k").cast("int"))))
    out = materialize(every.drop("__k", "__h"), "sums")
    discard(pairs, *found)
    shared.destroy()
    return out


def judge(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, level, limit, keep) of each row; with ``carry``, the columns of ``docs`` that are kept.

    ``perplexity`` is the model's; ``level`` is it drawn to the language's by ``PRIOR`` words, which is held against
    ``limit``. A null or empty text has no words and no perplexity, and is rejected. A null language is one of its own.
    Repeated rows are judged each; a level that equals the limit stays. Texts of any length are scored whole. Without
    trusted documents nothing can be judged: the limit is null and every text with words is kept.
    """
    small_batches(docs.sparkSession, 200)
    good = materialize(_good(labels), "good")
    if carry:
        # a row's number must be the same whenever it is read
        given = docs.select(F.monotonically_increasing_id().alias("row"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"))
        given = materialize(given, "numbered")
        read = given.select("row", "doc.doc_id", "doc.lang", "text")
    else:
        read = docs.select("doc_id", "lang", "text")
    thin = _score(read, good).withColumn("of", F.coalesce("lang", F.lit("")))
    own = materialize(thin.where("n > 0").join(good, F.col("doc_id") == F.col("__id"), "left_semi").select("of", "n", "sum"), "trusted")
    mean = -F.sum("sum") / F.sum(F.col("n") + 1)
    means = own.groupBy("of").agg(mean.alias("mean"))
    overall = own.agg(mean.alias("mean")).first()["mean"]

    def level(at: Column) -> Column:
        return (-F.col("sum") + PRIOR * at) / (F.col("n") + 1 + PRIOR)

    quantile = F.percentile_approx(level(F.col("mean")), F.lit(QUANTILE), F.lit(10_000))
    with_mean = own.join(F.broadcast(means), "of")  # a row for each language
    limits = with_mean.groupBy("of").agg(quantile.alias("q"), F.first("mean").alias("mean"), F.count("*").alias("n")).collect()
    pooled = with_mean.agg(quantile).first()[0]
    known = [r for r in limits if r["n"] >= LEAST]

    def pick(of, other) -> Column:
        of_lang = F.create_map(*chain.from_iterable((F.lit(r["of"]), F.lit(of(r))) for r in known))[F.col("of")] if known else F.lit(None).cast("double")
        return F.coalesce(of_lang, F.lit(other).cast("double"))

    at_most = pick(lambda r: r["q"] + MARGIN, None if pooled is None else pooled + MARGIN)
    value = level(pick(lambda r: r["mean"], overall if overall is not None else 0.0))
    fits = F.coalesce((F.col("n") > 0) & (F.lit(pooled is None) | (value <= at_most)), F.lit(False))
    if carry:
        # texts need no exchange as long as the rejected rows' numbers fit every task
        gone = thin.where(~fits).select("row")
        kept = given.join(F.broadcast(gone) if gone.count() <= FEW else gone, "row", "left_anti")
        return kept.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
    words = lambda x: F.when(F.col("n") > 0, F.pow(F.lit(10.0), x))
    return thin.select(
        "doc_id", "lang", F.col("n").alias("n_tokens"), words(-F.col("sum") / (F.col("n") + 1)).alias("perplexity"),
        words(value).alias("level"), F.pow(F.lit(10.0), at_most).alias("limit"), fits.alias("keep"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
