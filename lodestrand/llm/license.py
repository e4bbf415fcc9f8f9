"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Compared are windows of a text as long as the template, wherever one of the template's bigrams stands: a notice is found
within a longer line or paragraph, too. Of a template's distinct bigrams a window must hold THRESHOLD/(2-THRESHOLD) to
reach the threshold; so it holds one of any few more than the rest. Those few, the template's rarest, are its anchors: a
text without an anchor of any template is passed over after one look-up of each bigram, and the same bound on sizes prunes
templates and starts of windows before any is compared.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import ascii_lower, table
from lodestrand.llm.license_texts import TEMPLATES, Template

THRESHOLD = 0.8
#: Words that make a bigram a poor anchor.
_COMMON = frozenset("a all an and any are as at be by for from if in is it its may not of on or that the this to under with you".split())
_FOUND = "array<struct<license:string,dice:double,start:int,stop:int,unit:string>>"
_CAND = "array<struct<start:int,tid:int,stop:int,dice:double>>"


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]


def bigrams_of(words: Sequence[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _hash(pair: str) -> int:
    a, b = pair.split(" ")
    h = xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42))
    return h - (1 << 64) if h >> 63 else h


def least_shared(size: int, threshold: float = THRESHOLD) -> int:
    """How many of a template's ``size`` distinct bigrams a window must hold at least."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9)


def anchors_of(distinct: Sequence[str], threshold: float = THRESHOLD) -> list[str]:
    """Bigrams of which every match holds one: the rarest by the words in them."""
    rarest = sorted(distinct, key=lambda g: (sum(w in _COMMON for w in g.split(" ")), -len(g), g))
    return rarest[: len(distinct) - least_shared(len(distinct), threshold) + 1]


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _longs(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(_hash(v)).cast("long") for v in values]).cast("array<bigint>")


def matches(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` and a column ``found``: array<struct<license, dice, start, stop, unit>>, by start.

    start and stop count the text's words of a-z and 0-9 (A-Z lower-cased, all else parts words), ``unit`` is what stands
    there. Going through windows that reach ``threshold`` and hold what their template must have, by start and template:
    one that overlaps the last that is kept replaces it if its coefficient is higher, or equal over more words. A null or
    empty text, or one of a single word, has none; a text of any length is read whole. Replaces a column ``found``; other
    columns, repeated rows and ids stay as they are.
    """
    known = []
    for k, t in enumerate(templates):
        grams = bigrams_of(words_of(t.text))
        known.append((k, grams, sorted(set(grams))))
    every = sorted({_hash(g) for _, _, d in known for g in d})
    anchors = sorted({_hash(g) for _, _, d in known for g in anchors_of(d, threshold)})
    table_of = F.array(*[
        F.struct(F.lit(k).alias("tid"), F.lit(len(grams)).alias("len"), F.lit(least_shared(len(d), threshold)).alias("need"), _longs(d).alias("grams"), _longs(anchors_of(d, threshold)).alias("anchors"), _longs(templates[k].must).alias("must"))
        for k, grams, d in known
    ])

    def windows(g: Column, hits: Column, t: Column) -> Column:
        own = F.filter(hits, lambda y: F.array_contains(t["grams"], y["x"]))

        def compared(hit: Column) -> Column:
            starts = F.filter(F.transform(hit, lambda y, k: F.struct(y["i"].alias("i"), F.get(hit, k + t["need"] - 1)["i"].alias("last"))), lambda z: z["last"] < z["i"] + t["len"])

            def window(z: Column) -> Column:
                def score(distinct: Column) -> Column:
                    dice = 2.0 * F.size(F.array_intersect(distinct, t["grams"])) / (F.size(distinct) + F.size(t["grams"]))
                    fits = F.forall(t["must"], lambda m: F.array_contains(distinct, m))
                    stop = F.least(z["i"] + t["len"], F.size(g)) + 1
                    return F.when(fits, F.struct(z["i"].alias("start"), t["tid"].alias("tid"), stop.alias("stop"), dice.alias("dice")))

                return _let(F.array_distinct(F.slice(g, z["i"] + 1, t["len"])), score)

            return F.filter(F.transform(starts, window), lambda w: w["dice"] >= threshold)

        return F.when(F.size(own) >= t["need"], _let(own, compared)).otherwise(F.array().cast(_CAND))

    def kept(cand: Column) -> Column:
        none = F.lit(None).cast("struct<start:int,tid:int,stop:int,dice:double>")

        def step(acc: Column, x: Column) -> Column:
            last = acc["last"]
            better = (x["dice"] > last["dice"]) | ((x["dice"] == last["dice"]) & (x["stop"] - x["start"] > last["stop"] - last["start"]))
            fresh = last.isNull() | (x["start"] >= last["stop"])
            return F.struct(
                F.when(fresh & last.isNotNull(), F.concat(acc["kept"], F.array(last))).otherwise(acc["kept"]).alias("kept"),
                F.when(fresh | better, x).otherwise(last).alias("last"),
            )

        return F.aggregate(cand, F.struct(F.array().cast(_CAND).alias("kept"), none.alias("last")), step, lambda acc: F.when(acc["last"].isNull(), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(acc["last"]))))

    def scan(words: Column) -> Column:
        grams = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1))), 1, F.greatest(F.size(words) - 1, F.lit(0)))

        def in_grams(g: Column) -> Column:
            hits = F.filter(F.transform(g, lambda x, i: F.when(x.isin(every), F.struct(i.alias("i"), x.alias("x")))), lambda y: y.isNotNull())

            def in_hits(h: Column) -> Column:
                seen = F.array_distinct(F.transform(h, lambda y: y["x"]))
                some = _let(seen, lambda s: F.filter(table_of, lambda t: F.arrays_overlap(t["anchors"], s)))
                cand = F.array_sort(F.flatten(F.transform(some, lambda t: windows(g, h, t))))
                names = F.array(*[F.lit(t.name) for t in templates])
                return F.transform(kept(cand), lambda m: F.struct(F.get(names, m["tid"]).alias("license"), m["dice"].alias("dice"), m["start"].alias("start"), m["stop"].alias("stop"), F.array_join(F.slice(words, m["start"] + 1, m["stop"] - m["start"]), " ").alias("unit")))

            return F.when(F.exists(g, lambda x: x.isin(anchors)), _let(hits, in_hits))

        return _let(grams, in_grams)

    plain = F.split(F.trim(F.regexp_replace(ascii_lower(F.col("text")), "[^a-z0-9]+", " ")), " ")
    return docs.withColumn("found", F.coalesce(_let(plain, scan).cast(_FOUND), F.array().cast(_FOUND)))


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_matches, licenses, best_dice) of each document; licenses: sorted names, comma-joined; best_dice 0 without."""
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"),
    )


def brute_force(text: str | None, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """(license, dice, start, stop), comparing every window with every template. For tests."""
    grams = bigrams_of(words_of(text or ""))
    last, out = None, []
    for start in range(len(grams)):
        for t in templates:
            own = bigrams_of(words_of(t.text))
            window = set(grams[start : start + len(own)])
            dice = 2.0 * len(window & set(own)) / (len(window) + len(set(own)))
            if grams[start] not in own or dice < threshold or not window.issuperset(t.must):
                continue
            x = (t.name, dice, start, min(start + len(own), len(grams)) + 1)
            if last is None or start >= last[3]:
                out += [last] if last else []
                last = x
            elif (dice, x[3] - x[2]) > (last[1], last[3] - last[2]):
                last = x
    return out + ([last] if last else [])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP6_SQL = f"""
WITH RECURSIVE t AS (SELECT tid, name, must, string_split(trim(regexp_replace(lower(txt), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM (VALUES {", ".join(f"({k}, {_quoted(t.name)}, {_quoted(t.text)}, [{', '.join(map(_quoted, t.must))}]::VARCHAR[])" for k, t in enumerate(TEMPLATES))}) v(tid, name, txt, must)),
tg AS (SELECT tid, name, must, len(w) - 1 AS len, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM t),
tb AS (SELECT tid, len, len(grams) AS size, unnest(grams) AS gram FROM tg),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT rid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM d WHERE len(w) > 1),
p AS (SELECT rid, unnest(g) AS gram, unnest(range(len(g))) AS i FROM g),
hit AS (SELECT rid, tid, i, size, len, count(*) OVER (PARTITION BY rid, tid ORDER BY i RANGE BETWEEN CURRENT ROW AND len - 1 FOLLOWING) AS n FROM p JOIN tb USING (gram)),
win AS (SELECT rid, tid, i, list_distinct(g[i + 1 : i + len]) AS win, least(i + len, len(g)) + 1 AS stop FROM hit JOIN g USING (rid) WHERE n * {2 - THRESHOLD} >= size * {THRESHOLD} - 1e-6),
cand AS (SELECT rid, tid, i AS start, stop, name, 2.0::DOUBLE * len(list_intersect(win, grams)) / (len(win) + len(grams)) AS dice FROM win JOIN tg USING (tid) WHERE list_has_all(win, must)),
c AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY start, tid) AS k FROM cand WHERE dice >= {THRESHOLD}),
sweep AS (SELECT rid, k, name, dice, start, stop, true AS fresh FROM c WHERE k = 1 UNION ALL
  SELECT s.rid, c.k, CASE WHEN c.start >= s.stop OR c.dice > s.dice OR c.dice = s.dice AND c.stop - c.start > s.stop - s.start THEN c.name ELSE s.name END,
    CASE WHEN c.start >= s.stop OR c.dice > s.dice THEN c.dice ELSE s.dice END,
    CASE WHEN c.start >= s.stop OR c.dice > s.dice OR c.dice = s.dice AND c.stop - c.start > s.stop - s.start THEN c.start ELSE s.start END,
    CASE WHEN c.start >= s.stop OR c.dice > s.dice OR c.dice = s.dice AND c.stop - c.start > s.stop - s.start THEN c.stop ELSE s.stop END, c.start >= s.stop
  FROM sweep s JOIN c ON c.rid = s.rid AND c.k = s.k + 1),
kept AS (SELECT * FROM (SELECT rid, name, dice, coalesce(lead(fresh) OVER (PARTITION BY rid ORDER BY k), true) AS last FROM sweep) WHERE last),
a AS (SELECT rid, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(dice) AS best_dice FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, coalesce(best_dice, 0.0)::DOUBLE AS best_dice FROM d LEFT JOIN a USING (rid)
"""
