"""Document fingerprints from closed syncmers of words.

A k-mer of words is chosen if the least hash among its inner s-mers stands at its first or last place: a property of the
k-mer alone, so the same passage gives the same anchors wherever it stands. A fingerprint holds, with their first
positions, the chosen k-mers whose hash lies in the least quarter of all hashes, and the ``ANCHORS`` of least hash anyway:
it grows with the text, so that a passage within a long one keeps its anchors. Two fingerprints are as alike as the share
of anchors, up to the hash to which both hold all, that they have in common and that keep their distance: positions must
shift alike, as in an edited copy. A text of fewer words than a k-mer, or without a chosen one, has its words as anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import materialize, table

#: Words of a k-mer and of an inner s-mer (fixed by the expressions below); anchors of a fingerprint at least, and the
#: (signed) hash below which all are kept.
K, S, ANCHORS, ALL_BELOW = 4, 2, 32, -(1 << 62)
#: A word is cut after so many characters, so that text without blanks has anchors, too.
PIECE = r"[^\x20\x09-\x0D]{1,16}"
#: Words by which shared anchors may shift otherwise than most: at least, and as a share of the last position.
SLACK, SLACK_SHARE = 8, 8


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column) -> Column:
    """struct<h array<bigint>, p array<int>>: hashes in ascending order and their first positions; both empty without words."""

    def least(chosen: Column) -> Column:
        def firsts(x: Column) -> Column:
            once = F.filter(x, lambda y, i: (i == 0) | (y["h"] != F.get(x, i - 1)["h"]))
            kept = F.filter(once, lambda y, i: (i < ANCHORS) | (y["h"] < ALL_BELOW))
            return _let(kept, lambda k: F.struct(F.transform(k, lambda y: y["h"]).alias("h"), F.transform(k, lambda y: y["p"]).alias("p")))

        # sort_array compares natively; array_sort would interpret a comparator for each comparison
        low = _let(F.sort_array(F.filter(chosen, lambda y: y["h"] < ALL_BELOW)), firsts)
        # below ALL_BELOW all are kept, so the others are sorted only if these are fewer than ANCHORS
        return _let(low, lambda x: F.when(F.size(x["h"]) >= ANCHORS, x).otherwise(_let(F.sort_array(chosen), firsts)))

    def choose(words: Column) -> Column:
        single = F.transform(words, lambda w, i: F.struct(w.alias("h"), i.alias("p")))

        def windows(s: Column) -> Column:
            def edge(x: Column, i: Column) -> Column:
                last = F.get(s, i + 2)
                return F.when((i < F.size(s) - 2) & ((x <= F.get(s, i + 1)) & (x <= last) | (last <= x) & (last <= F.get(s, i + 1))), F.struct(F.xxhash64(x, last).alias("h"), i.alias("p")))

            found = F.filter(F.transform(s, edge), lambda x: x.isNotNull())
            return _let(found, lambda c: F.when(F.size(c) > 0, c).otherwise(single))

        pairs = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1))), 1, F.greatest(F.lit(0), F.size(words) - 1))
        return F.when(F.size(words) == 0, F.array().cast("array<struct<h:bigint,p:int>>")).when(F.size(words) < K, single).otherwise(_let(pairs, windows))

    hashed = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda w: F.xxhash64(w))
    none = F.struct(F.array().cast("array<bigint>").alias("h"), F.array().cast("array<int>").alias("p"))
    return _let(hashed, lambda words: _let(choose(words), lambda chosen: F.when(F.size(chosen) == 0, none).otherwise(least(chosen))))


def written(a: Column) -> Column:
    """A fingerprint as text: ``hash@position`` in ascending order of hashes."""
    return F.array_join(F.transform(F.arrays_zip(a["h"].alias("h"), a["p"].alias("p")), lambda x: F.concat(F.lower(F.lpad(F.hex(x["h"]), 16, "0")), F.lit("@"), x["p"].cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1. Two fingerprints without anchors are alike (1), one without and one with are not (0)."""

    def cover(x: Column) -> Column:
        """The hash up to which a fingerprint holds all anchors."""
        return F.when(F.size(x["h"]) < ANCHORS, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.element_at(x["h"], -1), F.lit(ALL_BELOW - 1)))

    def within(x: Column, side: int, bound: Column) -> Column:
        rows = F.transform(F.arrays_zip(x["h"].alias("h"), x["p"].alias("p")), lambda y: F.struct(y["h"].alias("h"), F.lit(side).alias("side"), y["p"].alias("p")))
        return F.filter(rows, lambda y: y["h"] <= bound)

    def compare(both: Column) -> Column:
        def share(shifts: Column) -> Column:
            slack = F.greatest(F.lit(SLACK), (F.greatest(F.array_max(a["p"]), F.array_max(b["p"])) / SLACK_SHARE).cast("int"))
            middle = F.get(F.sort_array(shifts), ((F.size(shifts) - 1) / 2).cast("int"))
            # once for a pair, not for each of its shifts
            aligned = _let(F.struct((middle - slack).alias("lo"), (middle + slack).alias("hi")), lambda m: F.size(F.filter(shifts, lambda x: (x >= m["lo"]) & (x <= m["hi"]))))
            return F.when(F.size(shifts) == 0, 0.0).otherwise(aligned / (F.size(both) - F.size(shifts)))

        next_to = F.transform(both, lambda x, i: F.when(F.get(both, i + 1)["h"] == x["h"], F.get(both, i + 1)["p"] - x["p"]))
        return _let(F.filter(next_to, lambda d: d.isNotNull()), share)

    either = (F.size(a["h"]) == 0) | (F.size(b["h"]) == 0)
    both = (F.size(a["h"]) == 0) & (F.size(b["h"]) == 0)
    every = _let(F.least(cover(a), cover(b)), lambda bound: F.sort_array(F.concat(within(a, 0, bound), within(b, 1, bound))))
    return F.when(both, 1.0).when(either, 0.0).otherwise(_let(every, compare))


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, n, next_id) from distinct (doc_id, n): the next larger doc_id, after the largest the smallest.

    Ids are dealt by range; within a range the next one is a neighbour, and each range's last one takes the first of the
    next range (one row a range on the driver).
    """
    spark = ids.sparkSession
    dealt = materialize(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = sorted(dealt.groupBy("part").agg(F.min("doc_id").alias("low")).collect(), key=lambda r: r["part"])
    after = [(r["part"], firsts[(k + 1) % len(firsts)]["low"]) for k, r in enumerate(firsts)]
    borders = F.broadcast(spark.createDataFrame(after, f"part int, after {ids.schema['doc_id'].dataType.simpleString()}"))
    by_range = Window.partitionBy("part").orderBy("doc_id")
    return dealt.withColumn("next_id", F.lead("doc_id").over(by_range)).join(borders, "part").select("doc_id", "n", F.coalesce("next_id", "after").alias("next_id"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last floor(n_chars/4) code points replaced by the first as many of the next document. A null
    text counts as empty. Of rows that share a doc_id, the one with the least text stands for it as a next document, and
    all have the same next. A row without a doc_id has no next: its edited text is its own, near_next is 0. Texts of any
    length are read whole; an empty table gives no rows; other columns are not read.
    """
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own, lost = every.where("doc_id is not null"), every.where("doc_id is null").withColumn("a", anchors(F.col("text")))
    links = following(own.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")))
    links = links.select(F.col("doc_id").alias("for_id"), (F.col("n") / 4).cast("int").alias("need"), "next_id")
    # one exchange of texts and anchors serves both joins: nothing may be filtered below only one of them
    marked = own.withColumn("a", anchors(F.col("text"))).repartition("doc_id")
    alone = marked.withColumn("before", F.lag(F.lit(1)).over(Window.partitionBy("doc_id").orderBy("text"))).where("before is null")
    heads = alone.join(links, F.col("doc_id") == F.col("next_id")).select("for_id", F.expr("substring(text, 1, need)").alias("head"), F.col("a").alias("next_a"))
    n, r = F.length("text"), (F.length("text") / 4).cast("int")
    joined = marked.join(heads, F.col("doc_id") == F.col("for_id"), "left").unionByName(lost, allowMissingColumns=True)
    edited = joined.withColumn("edited", F.when(F.col("for_id").isNull(), F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), n - r), F.substring("head", F.lit(1), r))))
    found = edited.withColumn("e", anchors(F.col("edited")))
    return found.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("a")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"),
        F.when(F.col("for_id").isNull(), 0.0).otherwise(likeness(F.col("a"), F.col("next_a"))).alias("near_next"),
    )


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
