"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``WINDOW`` consecutive words of a test item is a pattern. A table over hashed word pairs says how far the
search may jump; where it says zero, the pair's hash selects a bucket of patterns, the hash of the first pair narrows it by
bisection, and a direct comparison confirms. Texts are read once for each block of the benchmark, nothing is shuffled. A
block is a few flat arrays, some ten bytes for each of its bytes of text; the driver and each worker hold one at a time.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import materialize, small_batches, table

WINDOW = 8
#: Bytes of test texts that one search holds; a larger benchmark is searched in several passes. Longer items are parted
#: into pieces of so many windows, which may lie in different blocks.
BLOCK_BYTES, PIECE = 8_000_000, 50_000
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes(b if b in _KEEP else 32 for b in range(256))
_MIX = 0x9E3779B1


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 ``text``: runs of digits, a-z (after lower-casing A-Z) and everything beyond ASCII."""
    return text.lower().translate(_TABLE).split() if text else []


class Search:
    """Patterns of one length: windows of ``flat`` (numbers of words) at ``starts``, each of the item in ``owners``."""

    def __init__(self, length: int, flat: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        self.length, self.block = length, min(2, length)
        windows = flat[starts[:, None] + np.arange(length)]
        unique, first, back = np.unique(windows, axis=0, return_index=True, return_inverse=True)
        self.bits = max(8, int(2 * len(unique)).bit_length())
        suffix, prefix = self._hash(unique[:, length - self.block :]), self._hash(unique[:, : self.block])
        order = np.lexsort((prefix, suffix))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        shift = np.full(1 << self.bits, length - self.block + 1, np.uint8 if length < 250 else np.int32)
        for end in range(self.block, length + 1):
            np.minimum.at(shift, self._hash(unique[:, end - self.block : end]), length - end)
        self.shift = array("B" if length < 250 else "i", shift.tobytes())
        self.heads = array("i", np.searchsorted(suffix[order], np.arange((1 << self.bits) + 1)).astype(np.int32).tobytes())
        self.prefix = array("q", prefix[order].tobytes())
        self.starts = array("i", starts[first][order].astype(np.int32).tobytes())
        pairs = np.unique(np.stack([rank[back.ravel()], owners], axis=1), axis=0)
        self.owner_heads = array("i", np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)).astype(np.int32).tobytes())
        self.owners = array("i", pairs[:, 1].astype(np.int32).tobytes())

    def _hash(self, pairs: np.ndarray) -> np.ndarray:
        pairs = pairs.astype(np.int64)
        return (pairs[:, 0] * _MIX + pairs[:, -1]) & (1 << self.bits) - 1

    def find(self, ids: array, flat: array) -> Iterator[tuple[int, Sequence[int]]]:
        """(start, items) of each occurrence. A word of no pattern (-1) rules out every window over it."""
        m, two, shift, mask = self.length, self.block - 1, self.shift, (1 << self.bits) - 1
        at, n = m - 1, len(ids)
        while at < n:
            last = ids[at]
            if last < 0:
                at += m
                continue
            key = (ids[at - two] * _MIX + last) & mask
            jump = shift[key]
            if jump:
                at += jump
                continue
            start, high = at - m + 1, self.heads[key + 1]
            first = (ids[start] * _MIX + ids[start + two]) & mask
            k = bisect_left(self.prefix, first, self.heads[key], high)
            while k < high and self.prefix[k] == first:
                own = self.starts[k]
                if flat[own : own + m] == ids[start : at + 1]:
                    yield start, self.owners[self.owner_heads[k] : self.owner_heads[k + 1]]
                    break
                k += 1
            at += 1


class Benchmark:
    """The searches for all lengths over a shared word list. ``items``: (name, UTF-8 text)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.flat, self.names = array("i"), sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        by_length: dict[int, tuple[array, array]] = defaultdict(lambda: (array("i"), array("i")))
        for name, text in items:
            words = words_of(text)
            size, at = min(window, len(words)), len(self.flat)
            self.flat.extend(self.ids.setdefault(w, len(self.ids)) for w in words)
            if size:
                starts, owners = by_length[size]
                starts.extend(range(at, at + len(words) - size + 1))
                owners.extend(repeat(number[name], len(words) - size + 1))
        flat = np.array(self.flat, np.int32)
        self.searches = [Search(k, flat, np.array(a), np.array(b)) for k, (a, b) in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """[(start, end)] of occurrences, end exclusive, and the items that they come from."""
        ids = array("i", map(self.ids.get, words, repeat(-1)))
        spans, items = [], set()
        for search in self.searches:
            for start, found in search.find(ids, self.flat):
                spans.append((start, start + search.length))
                items.update(self.names[k] for k in found)
        return spans, items


def _pieces(benchmark: DataFrame) -> DataFrame:
    """(name, seq, body) of test items; long ones in pieces that overlap by a window less a word, so that none is lost."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text").cast("binary").alias("body")).where("body is not null")

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body"), strict=True):
                words = words_of(body.as_py())
                at = [k for k in range(0, len(words), PIECE) if k == 0 or k + WINDOW <= len(words)]
                parts = [b" ".join(words[k : k + PIECE + WINDOW - 1]) for k in at]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(range(len(at)), pa.int32()), pa.array(parts, pa.binary())], names=["name", "seq", "body"])

    return materialize(rows.mapInArrow(run, "name string, seq int, body binary"), "benchmark")


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[Benchmark, bool]]:
    """Test items in blocks of bounded size, each built when it is asked for; and whether it is the last."""
    rows = _pieces(benchmark)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("name", "seq"), F.lit(count)) == k)
        yield Benchmark([(r["name"], bytes(r["body"])) for r in part.select("name", "body").toLocalIterator()]), k + 1 == count


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of test windows in every text.

    Returns ``docs`` without ``text`` and with one column ``scan``: struct<n_words long, spans array<struct<start int,
    stop int>> (words, stop exclusive; may overlap), items array<string>>. A null or empty text has no words and no hits;
    one of any length is searched whole; equal item ids are one item, a null item id is the item "null"; test items without
    words are never found; an empty benchmark finds nothing. Repeated rows stay. A column ``scan`` is replaced, all others
    keep their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    other = [c for c in docs.columns if c not in (text, "scan")]
    row = F.struct(*[F.col(f"`{c}`") for c in other]) if other else F.lit(0)
    found = docs.select(row.alias("row"), F.col(text).cast("binary").alias("body"), F.lit(None).cast("struct<n_words:bigint,spans:array<struct<start:int,stop:int>>,items:array<string>>").alias("scan"))
    for block, last in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        del block

        def run(batches, shared=shared):
            search = shared.value
            for batch in batches:
                out = []
                for body, before in zip(batch.column("body"), batch.column("scan").to_pylist(), strict=True):
                    words = words_of(body.as_py())
                    spans, items = search.hits(words)
                    if before:
                        spans += [(s["start"], s["stop"]) for s in before["spans"]]
                        items |= set(before["items"])
                    out.append({"n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in sorted(set(spans))], "items": sorted(items)})
                kind = batch.schema.field("scan").type
                yield batch.set_column(batch.schema.get_field_index("scan"), "scan", pa.array(out, kind))

        found = found.mapInArrow(run, found.schema)
        if not last:
            found = materialize(found, "scan")
            shared.destroy()
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in other], "scan")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of a test item, with all columns as they are."""
    found = scan(docs.select(F.struct("*").alias("row"), F.col("text").alias("of")), benchmark, "of")
    return found.where(F.size("scan.items") == 0).select("row.*")


def _digest(spark: SparkSession, found: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            scans = batch.column("scan").to_pylist()
            hit = []
            for s in scans:
                mark = bytearray(s["n_words"]) if s["spans"] else b""
                for x in s["spans"]:
                    mark[x["start"] : x["stop"]] = b"\x01" * (x["stop"] - x["start"])
                hit.append(mark.count(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([s["n_words"] for s in scans], pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array([len(s["items"]) for s in scans], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(s["items"])).encode()).hexdigest() for s in scans], pa.string()),
                    pa.array([len(s["items"]) >= 2 for s in scans], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item; see ``scan`` for odd rows."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _digest(spark, found)


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT item, w, least(8, len(w)) AS size, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hits AS (SELECT rid, i, size, item FROM dw JOIN bw USING (size, win)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
