"""Pairs of records: the feature vector, candidate generation by blocking, and the models that score pairs.

Models are small: they are fitted on the driver from a matrix whose size is checked, and applied as column expressions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import names
from lodestrand.functions import similarity as s
from lodestrand.functions.numbers import sigmoid

#: The order of features is part of a model.
FEATURES = ["exactNameMatch", "normalizedNameMatch", "anyVariantNormalizedMatch", "sortedTokenMatch", "tokenJaccard", "tokenContainment", "orderedPrefixContainment", "firstTokenMatch", "lastTokenMatch", "levenshteinRatio", "jaroWinkler", "trigramDice", "bestVariantTrigramDice", "lengthRatio", "tokenCountRatio", "singleTokenSide", "acronymMatch", "sameScript", "jurisdictionBothKnown", "jurisdictionCountryMatch", "jurisdictionCountryConflict", "officialNameBothPresent", "aliasesEitherPresent", "digitSetConflict", "romanNumeralConflict", "legalFormConflict", "structuralTokenAsymmetry", "coreNameMatch", "coreTokenJaccard", "coreTrigramDice", "idfWeightedJaccard", "maxSharedTokenIdf"]
#: Words that tell entities of one family apart.
STRUCTURAL = [
    "holding", "holdings", "group", "groupe", "finance", "financial", "capital", "international", "intressenter", "pharma",
    "pharmaceutical", "pharmaceuticals", "services", "solutions", "trust", "partners", "partnership", "ventures", "investments",
    "investment", "management", "operating", "properties", "entertainment", "technologies", "systems", "industries", "enterprises",
]
#: Largest matrix that is fitted on the driver.
FIT_ROWS = 200_000
#: Records of a block that meet as many others in a task.
PART = 1_000


def features(pairs: DataFrame, idf: dict[str, float] | None = None, structural: Sequence[str] = STRUCTURAL) -> DataFrame:
    """Columns a, b and the 32 features, doubles, of struct pairs (a, b) of (name, official_name, aliases, jurisdiction).

    ``idf``: weights of words in [0, 1]; a word that it lacks weighs 1.
    """
    text = pairs
    for x in "ab":
        text = text.withColumn(f"n{x}", names.normalize_name(F.col(f"{x}.name"))).withColumn(f"c{x}", names.strip_forms(names.fold_name(F.col(f"{x}.name")), [], ["limited", "ltd", "inc", "llc", "gmbh", "plc", "co"]))
        spellings = F.filter(F.concat(F.array(f"{x}.name", f"{x}.official_name"), F.coalesce(F.col(f"{x}.aliases"), F.array().cast("array<string>"))), lambda v: F.length(F.trim(v)) > 0)
        text = text.withColumn(f"v{x}", F.transform(spellings, lambda v: names.normalize_name(v, unicode=False)))
        text = text.withColumn(f"t{x}", names.tokens(F.col(f"n{x}"))).withColumn(f"k{x}", names.tokens(F.col(f"c{x}"))).withColumn(f"f{x}", names.legal_form(F.col(f"{x}.name"))).withColumn(f"j{x}", names.country(F.col(f"{x}.jurisdiction")))
    c = F.col
    weights = F.create_map(*[F.lit(v) for p in idf.items() for v in p]) if idf else None
    weight = (lambda t: F.coalesce(F.try_element_at(weights, t), F.lit(1.0))) if idf else (lambda t: F.lit(1.0))
    share = lambda p, q: F.when(F.greatest(p, q) == 0, 1.0).otherwise(F.least(p, q) / F.greatest(p, q))
    crossed = F.flatten(F.transform("va", lambda x: F.transform("vb", lambda y: F.struct(x.alias("x"), y.alias("y")))))
    part = lambda t: F.array_sort(F.array_distinct(F.filter(t, lambda w: w.isin(list(structural)))))
    short = lambda t, u: (F.size(u) == 1) & (F.length(s.acronym(t)) > 1) & (s.acronym(t) == F.get(u, 0))
    known = c("ja").isNotNull() & c("jb").isNotNull()
    many = lambda x: F.size(F.coalesce(c(f"{x}.aliases"), F.array().cast("array<string>"))) > 0
    values = [
        c("a.name") == c("b.name"), (c("na") != "") & (c("na") == c("nb")), F.exists(crossed, lambda p: (p["x"] != "") & (p["x"] == p["y"])), (F.size("ta") > 0) & (F.array_sort("ta") == F.array_sort("tb")),
        s.jaccard(c("ta"), c("tb")), s.containment(c("ta"), c("tb")), s.ordered_prefix(c("ta"), c("tb")), F.coalesce(F.get("ta", 0) == F.get("tb", 0), F.lit(False)),
        (F.size("ta") > 0) & (F.size("tb") > 0) & (F.element_at(F.concat(F.array(F.lit("")), "ta"), -1) == F.element_at(F.concat(F.array(F.lit("")), "tb"), -1)), s.levenshtein_ratio(c("na"), c("nb")), s.jaro_winkler(c("na"), c("nb")), s.trigram_dice(c("na"), c("nb")),
        F.coalesce(F.array_max(F.transform(crossed, lambda p: s.trigram_dice(p["x"], p["y"]))), F.lit(0.0)), share(F.length("na"), F.length("nb")), share(F.size("ta"), F.size("tb")), (F.size("ta") == 1) | (F.size("tb") == 1),
        short(c("ta"), c("tb")) | short(c("tb"), c("ta")), s.script_of(c("a.name")) == s.script_of(c("b.name")), known, known & (c("ja") == c("jb")), known & (c("ja") != c("jb")),
        (F.coalesce("a.official_name", F.lit("")) != "") & (F.coalesce("b.official_name", F.lit("")) != ""), many("a") | many("b"), s.sets_differ(s.digit_runs(c("a.name")), s.digit_runs(c("b.name"))),
        s.sets_differ(s.roman_numerals(c("ta")), s.roman_numerals(c("tb"))), F.coalesce(c("fa") != c("fb"), F.lit(False)), s.sets_differ(part(c("ta")), part(c("tb"))) | (F.size(F.filter("ta", lambda w: w.isin(list(structural)))) != F.size(F.filter("tb", lambda w: w.isin(list(structural))))),
        (c("ca") != "") & (c("ca") == c("cb")), s.jaccard(c("ka"), c("kb")), s.trigram_dice(c("ca"), c("cb")), s.weighted_jaccard(c("ka"), c("kb"), weight), s.max_shared(c("ka"), c("kb"), weight),
    ]
    return text.select("a", "b", *[v.cast("double").alias(n) for n, v in zip(FEATURES, values, strict=True)])


def candidates(records: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(ref_a, ref_b, block) of (ref, name): all records that share a normalised name or its first word, with the least such
    block; and the blocks of more than ``most`` records (block, members), whose pairs are made like all others.

    Names that are equal begin alike, so pairs meet by first words alone, part by part of about ``PART`` records; their least
    block follows from the names of both. So no pair is exchanged or grouped.
    """
    n = names.normalize_name(F.col("name"))
    named = records.where("ref is not null").select("ref", n.alias("n")).where("n <> ''").distinct()
    word = F.split_part("n", F.lit(" "), F.lit(1))
    named = named.withColumn("meet", F.when(word != "", F.concat(F.lit("w:"), word)).otherwise(F.concat(F.lit("n:"), F.col("n"))))
    keyed = named.select("ref", F.explode(F.array_distinct(F.array(F.concat(F.lit("n:"), "n"), "meet"))).alias("block")).distinct()
    sizes = keyed.groupBy("block").agg(F.count("*").alias("members"))

    # of a record of several names all go with it
    whole = named.groupBy("ref").agg(F.collect_set("n").alias("ns"), F.collect_set("meet").alias("ms"))
    some = whole.select("ref", F.explode("ms").alias("meet"), F.when(F.size("ns") == 1, F.get("ns", 0)).alias("n"), *[F.when(F.size("ns") > 1, F.col(c)).alias(c) for c in ("ns", "ms")])
    parts = some.groupBy("meet").agg(F.count("*").alias("members")).where("members > 1").select("meet", F.ceil(F.col("members") / PART).cast("int").alias("parts"))
    dealt = some.join(parts, "meet").withColumn("part", F.expr("cast(pmod(xxhash64(ref), parts) as int)"))
    side = lambda s, p, q: dealt.select("meet", *[F.col(c).alias(f"{c}_{s}") for c in ("ref", "n", "ns", "ms")], p.alias("p"), q.alias("q"))
    one = side("x", F.col("part"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)))
    two = side("y", F.explode(F.sequence(F.lit(0), F.col("part"))), F.col("part"))
    p = one.join(two, ["meet", "p", "q"]).where("p < q or ref_x < ref_y")
    single = F.col("n_x").isNotNull() & F.col("n_y").isNotNull()
    every = lambda s, many, own: F.coalesce(f"{many}_{s}", F.array(own))
    met = F.array_min(F.array_intersect(every("x", "ms", "meet"), every("y", "ms", "meet")))
    shared = F.array_min(F.array_intersect(every("x", "ns", "n_x"), every("y", "ns", "n_y")))
    shared = F.when(single, F.when(F.col("n_x") == F.col("n_y"), F.col("n_x"))).otherwise(shared)
    block = F.coalesce(F.concat(F.lit("n:"), shared), "meet")
    found = p.where(single | (F.col("meet") == met)).select(F.least("ref_x", "ref_y").alias("ref_a"), F.greatest("ref_x", "ref_y").alias("ref_b"), block.alias("block"))
    return found, sizes.where(F.col("members") > most)


def matrix(labelled: DataFrame, columns: Sequence[str] = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    rows = labelled.select(*columns, F.col("label").cast("double"))
    if (n := rows.count()) > FIT_ROWS:
        raise ValueError(f"{n} rows; at most {FIT_ROWS} are fitted on the driver")
    m = np.array([tuple(r) for r in rows.collect()], float).reshape(-1, len(columns) + 1)
    return m[:, :-1], m[:, -1]


def fit_logistic(x: np.ndarray, y: np.ndarray, rate: float = 0.5, epochs: int = 4000, l2: float = 0.002, positive: float = 4.0) -> dict:
    """Weights of standardised features by full-batch descent; positives count ``positive`` times, the intercept is free."""
    mean, deviation = x.mean(0), x.std(0)
    deviation[deviation == 0] = 1.0
    z, sample = (x - mean) / deviation, np.where(y == 1, positive, 1.0)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        error = sample * (1 / (1 + np.exp(-(z @ w + b))) - y) / sample.sum()
        w, b = w - rate * (z.T @ error + l2 * w), b - rate * error.sum()
    return {"kind": "logistic", "mean": mean.tolist(), "deviation": deviation.tolist(), "weights": w.tolist(), "intercept": float(b)}


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, depth: int = 3, least: int = 12, l2: float = 1.0, stride: int = 32) -> dict:
    """Boosted trees: each leaf takes a Newton step, splits go by its gain over at most ``stride`` thresholds a feature."""

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> dict:
        value = -g[rows].sum() / (h[rows].sum() + l2)
        gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
        best = (1e-9, None)
        if left and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                cuts = np.unique(x[rows, f])
                for lo, hi in list(pairwise(cuts[:: max(1, len(cuts) // stride)])):
                    t = (lo + hi) / 2
                    side = x[rows, f] <= t
                    if least <= side.sum() <= len(rows) - least:
                        won = gain(rows[side]) + gain(rows[~side]) - gain(rows)
                        if won > best[0]:
                            best = (won, (f, t, side))
        if best[1] is None:
            return {"value": rate * float(value)}
        f, t, side = best[1]
        return {"feature": f, "threshold": float(t), "low": grow(rows[side], g, h, left - 1), "high": grow(rows[~side], g, h, left - 1)}

    def value(tree: dict, m: np.ndarray) -> np.ndarray:
        if "value" in tree:
            return np.full(len(m), tree["value"])
        side = m[:, tree["feature"]] <= tree["threshold"]
        out = np.empty(len(m))
        out[side], out[~side] = value(tree["low"], m[side]), value(tree["high"], m[~side])
        return out

    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    logit, trees = np.full(len(y), np.log(share / (1 - share))), []
    start = float(logit[0]) if len(y) else 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
        logit += value(trees[-1], x)
    return {"kind": "trees", "start": start, "trees": trees}


def score(model: dict, columns: Sequence[str] = FEATURES) -> Column:
    """The model's probability as an expression of feature columns."""
    if model["kind"] == "logistic":
        logit = F.lit(model["intercept"])
        for name, w, m, d in zip(columns, model["weights"], model["mean"], model["deviation"], strict=True):
            logit = logit + F.lit(w) * (F.col(name) - m) / d
        return sigmoid(logit)

    def leaf(tree: dict) -> Column:
        if "value" in tree:
            return F.lit(tree["value"])
        return F.when(F.col(columns[tree["feature"]]) <= tree["threshold"], leaf(tree["low"])).otherwise(leaf(tree["high"]))

    logit = F.lit(model["start"])
    for tree in model["trees"]:
        logit = logit + leaf(tree)
    return sigmoid(logit)


def contributions(model: dict, columns: Sequence[str] = FEATURES) -> Column:
    """Of a logistic model: map of each feature's part in the logit."""
    return F.create_map(*[x for name, w, m, d in zip(columns, model["weights"], model["mean"], model["deviation"], strict=True) for x in (F.lit(name), F.lit(w) * (F.col(name) - m) / d)])


def digest(model: dict) -> str:
    """SHA-256 of the weights alone."""
    return hashlib.sha256(json.dumps(model, sort_keys=True).encode()).hexdigest()


def leakage(pairs: DataFrame, forbidden: Sequence[str] = ("lei", "cik", "qid", "identifier")) -> DataFrame:
    """(check, violations) of (pair_id, label, partition, subject_a, subject_b): what a fair test must not have."""
    sides = pairs.select("partition", F.explode(F.array("subject_a", "subject_b")).alias("subject")).distinct()
    checks = [
        ("subjects_in_two_partitions", sides.groupBy("subject").count().where("count > 1")),
        ("repeated_pair_ids", pairs.groupBy("pair_id").count().where("count > 1")),
        ("pairs_with_two_labels", pairs.groupBy(F.least("subject_a", "subject_b"), F.greatest("subject_a", "subject_b")).agg(F.count_distinct("label").alias("n")).where("n > 1")),
        ("subjects_paired_with_themselves", pairs.where("subject_a = subject_b and label = 0")),
    ]
    found = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in checks]
    fields = pairs.sparkSession.createDataFrame([("forbidden_fields", sum(any(f in c.lower() for f in forbidden) for c in pairs.columns))], "check string, violations long")
    for df in found:
        fields = fields.unionByName(df)
    return fields
