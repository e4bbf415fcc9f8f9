"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position gets a vector over {0,1}; a mask keeps the positions whose vector has an odd inner product with the
mask's number. Two fingerprints that differ in at most ``radius`` bits always agree under some mask, since so few
vectors leave a direction that is orthogonal to all of them. Small buckets are compared pair by pair. Buckets beyond
``BUCKET`` would need a square of comparisons; their members are linked through midpoints instead: two fingerprints
differ in at most 2 bits exactly if both lie within 1 bit of a common value, so 65 rows for each give the same links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import discard, materialize, small_batches, table

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Largest bucket whose pairs are compared.
BUCKET = 24
#: Beyond so many distinct fingerprints, masks keep about 3/4 of the bits (31 tables) instead of 4/7 (7 tables).
FINE = 1 << 27


def covering_masks(copies: int = 1, bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """2^(copies*radius+1)-1 masks; a bit stays if any of its ``copies`` vectors has an odd product with the mask's number."""
    space = 1 << (copies * radius + 1)
    vectors = [[1 + (i * copies + c * (1 + i // 7)) % (space - 1) for c in range(copies)] for i in range(bits)]
    return [sum(1 << i for i in range(bits) if any((x & v).bit_count() & 1 for x in vectors[i])) for v in range(1, space)]


def hashes_of(words: list[bytes], width: int) -> np.ndarray:
    """Hashes (uint64) of each run of ``width`` words, of the whole if there are not more."""
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    spans = zip(starts[: 1 - width].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of ``hashes`` (uint64) have; 0 if there is none. Signed, as Spark holds it."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes | None) -> int:
    """Bit b is 1 if set in over half of the shingles' hashes; no words: 0. Signed, as Spark holds it."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    return majority(hashes_of(words, SHINGLE))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp long) of each row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col(text).cast("binary").alias("body"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(x.as_py()) for x in batch.column("body")], pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def links(fps: DataFrame, bucket: int = BUCKET, copies: int | None = None) -> DataFrame:
    """(a, b) with a > b whose connected components are those of all fingerprints ``fp`` (distinct) within 2 bits."""
    if copies is None:
        copies = 1 if fps.count() < FINE else 2
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(copies)]
    cells = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "cell"))
    sizes = cells.groupBy("mask", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(cells.join(sizes, ["mask", "cell"]), "cells")
    pairs = (
        shared.where(F.col("n") <= bucket)
        .groupBy("mask", "cell")
        .agg(F.collect_list("fp").alias("f"))
        .select(F.explode(F.expr("flatten(transform(f, x -> transform(filter(f, y -> y < x and bit_count(x ^ y) <= 2), y -> struct(x as a, y as b))))")).alias("p"))
        .select("p.a", "p.b")
    )
    crowded = shared.where(F.col("n") > bucket).groupBy("fp").agg(F.lit(1).alias("one")).select("fp")
    near = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    points = crowded.select("fp", F.explode(near).alias("mid"))
    least = points.groupBy("mid").agg(F.min("fp").alias("b"))
    stars = points.join(least, "mid").where("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes of ``edges`` (a, b) but the roots.

    Alternates two rewritings of the edge list that keep components: each node hands its larger neighbours, then its
    smaller ones, to its least neighbour. The rounds grow with the logarithm of a component's size.
    """
    state, edges = None, materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    while True:
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a))")).first())
        if now[0] == 0 or now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.expr("array(struct(a as a, m as b), struct(b as a, m as b))")).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        old, edges = edges, materialize(small, "edges")
        discard(old)


def near_duplicates(docs: DataFrame, text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row.

    component_id is the least doc_id of all documents that links of at most 2 differing bits reach, itself included. A
    null, empty or blank text has the fingerprint zero and is linked like any other. Repeated rows stay, each with its
    component. A null doc_id never names a component (null if there is no other). Other columns are not read.
    """
    rows = materialize(fingerprints(docs, text), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(fps, bucket))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, find=near_duplicates) -> DataFrame:
    """``docs`` with one document of each component that ``find`` gives: that of the least doc_id.

    Of rows that share this doc_id the one with the least text stays. Rows without a doc_id stay. The columns are those
    of ``docs``, whatever their names.
    """
    from pyspark.sql import Window

    found = find(docs.select("doc_id", "text"))
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.lit(1).alias("one")).select(F.col("doc_id").alias("id"))
    rows = docs.select(F.col("doc_id").alias("of"), F.col("text").alias("by"), F.struct("*").alias("row"))
    kept = rows.where("of is not null").join(first, F.col("of") == F.col("id"))
    once = kept.withColumn("k", F.row_number().over(Window.partitionBy("of").orderBy("by"))).where("k = 1")
    return once.select("row.*").unionByName(docs.where("doc_id is null"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, bytes | None]]) -> dict[int, tuple[str, int]]:
    """doc_id: (fingerprint, component_id), comparing all pairs. For tests."""
    fps = [(i, fingerprint(t) & (1 << 64) - 1) for i, t in rows]
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, f) in enumerate(fps):
        for j, g in fps[:k]:
            if (f ^ g).bit_count() <= RADIUS and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    return {i: (f"{f:016x}", find(i)) for i, f in fps}
