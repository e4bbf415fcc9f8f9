"""Metrics of a run against held-out answers. A ratio without a denominator is null, never 0 or 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.aggregates import pair_counts


def _ratio(name: str, part: int, whole: int) -> dict:
    return {"metric": name, "part": part, "whole": whole, "value": part / whole if whole else None}


def clusters(assigned: DataFrame) -> list[dict]:
    """Of (mention, truth, system): pairwise precision and recall, and truth clusters that were recovered exactly."""
    p = pair_counts(assigned, "truth", "system").first()
    shape = lambda c: assigned.groupBy(c).agg(F.array_join(F.array_sort(F.collect_set("mention")), "\x01").alias("members")).select("members")
    exact = shape("truth").join(shape("system"), "members", "left_semi").count()
    return [_ratio("pairwise precision", p["tp"], p["tp"] + p["fp"]), _ratio("pairwise recall", p["tp"], p["tp"] + p["fn"]), _ratio("exact clusters", exact, assigned.select("truth").distinct().count())]


def must_not_merge(assigned: DataFrame, pairs: DataFrame) -> dict:
    """Pairs (a, b) of mentions that belong apart and were kept apart."""
    side = lambda c: assigned.select(F.col("mention").alias(c), F.col("system").alias(f"{c}_s"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return _ratio("must not merge", both.where("a_s <> b_s").count(), both.count())


def relationships(found: DataFrame, expected: DataFrame) -> list[dict]:
    """Of (type, src, dst), either direction: precision, recall."""
    key = lambda df: df.select("type", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    f, e = key(found), key(expected)
    hit = f.join(e, ["type", "x", "y"], "left_semi").count()
    return [_ratio("relationship precision", hit, f.count()), _ratio("relationship recall", hit, e.count())]


def mention_coverage(mentions: DataFrame, decisions: DataFrame) -> dict:
    """Mentions (mention) for which there is a decision that resolves them."""
    resolved = decisions.where("status = 'resolved'").select("mention").distinct()
    return _ratio("mention coverage", mentions.select("mention").distinct().join(resolved, "mention", "left_semi").count(), mentions.select("mention").distinct().count())


def alias_attachment(aliases: DataFrame, expected: DataFrame) -> dict:
    """Expected (alias, entity_id) that are attached so, whatever the case of letters."""
    key = lambda df: df.select(F.lower(F.trim("alias")).alias("alias"), "entity_id").distinct()
    return _ratio("alias attachment", key(expected).join(key(aliases), ["alias", "entity_id"], "left_semi").count(), key(expected).count())


def classification_agreement(found: DataFrame, expected: DataFrame) -> dict:
    """Of edges (type, src, dst, classification) that both have, in either direction, those of the same class."""
    key = lambda df, c: df.select("type", F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), F.col("classification").alias(c)).distinct()
    both = key(found, "f").join(key(expected, "e"), ["type", "x", "y"])
    return _ratio("classification agreement", both.where("f = e").count(), both.count())


def community_f1(groups: DataFrame, expected: DataFrame) -> dict:
    """Pairwise F1 of (id, community) against expected (id, key), over the ids that both have."""
    p = pair_counts(groups.join(expected, "id"), "key", "community").first()
    return {"metric": "community pairwise f1", "part": p["tp"], "whole": p["tp"] + p["fn"], "value": p["f1"]}


def top_signal(ranked: DataFrame, expected: DataFrame) -> dict:
    """Expected signals (signal_type, id) whose id is first of its type in ``ranked`` (signal_type, id, score), ties by id."""
    first = ranked.groupBy("signal_type").agg(F.min_by("id", F.struct((-F.col("score")).alias("s"), "id")).alias("id")).select("signal_type", "id")
    e = expected.select("signal_type", "id").distinct()
    return _ratio("expected signal first", e.join(first, ["signal_type", "id"], "left_semi").count(), e.count())


def hidden_connections(edges: DataFrame, expected: DataFrame) -> dict:
    """Expected pairs (a, b) that some path joins."""
    from lodestrand.operators.graph import hops

    reach = hops(edges.select("src", "dst", F.lit("any").alias("type")), expected.select(F.col("a").alias("id")).distinct())
    e = expected.select("a", "b").distinct()
    hit = e.join(reach.select(F.col("source").alias("a"), F.col("id").alias("b")), ["a", "b"], "left_semi")
    return _ratio("hidden connections", hit.count(), e.count())


def recall(found: DataFrame, expected: DataFrame, keys: list[str], name: str) -> dict:
    e = expected.select(*keys).distinct()
    return _ratio(name, e.join(found.select(*keys).distinct(), keys, "left_semi").count(), e.count())


def completeness(df: DataFrame, columns: list[str]) -> dict:
    """Rows of which all provenance columns are there."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    r = df.agg(F.count("*").alias("n"), F.count_if(ok).alias("ok")).first()
    return _ratio("provenance completeness", r["ok"], r["n"])


def align(mentions: DataFrame, answers: DataFrame) -> DataFrame:
    """(mention, entity_key): the answer whose record reference is the longest prefix of the mention's, of equal ones that of
    the same name, then the least. Prefixes are exploded and met by equality."""
    m = mentions.select("mention", "ref", "name").withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("ref"), F.lit(1))), lambda k: F.left("ref", k))))
    j = m.join(answers.select(F.col("ref").alias("prefix"), F.col("name").alias("answer_name"), "entity_key"), "prefix")
    best = F.max_by("entity_key", F.struct(F.length("prefix"), F.col("name") == F.col("answer_name")))
    return j.groupBy("mention").agg(best.alias("entity_key"))


def report(metrics: list[dict]) -> str:
    lines = ["| metric | value | counts |", "|-|-|-|"]
    return "\n".join(lines + [f"| {m['metric']} | {'n/a' if m['value'] is None else f'{100 * m['value']:.1f} %'} | {m['part']}/{m['whole']} |" for m in metrics]) + "\n"
