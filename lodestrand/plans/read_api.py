"""Read queries: filtered, ordered, paged views of the pipeline's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators import graph
from lodestrand.operators.corroborate import RANK

DEFAULT_LIMIT, MOST, MOST_FINDINGS, SNAPSHOT, MOST_SNAPSHOT, MOST_IDS = 25, 100, 200, 200, 400, 25


def page(df: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = DEFAULT_LIMIT, most: int = MOST) -> DataFrame:
    """Rows offset .. offset+limit of a total order; limit is kept within 1..most, offset at 0 or more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def capped_ids(ids: Column, most: int = MOST_IDS) -> Column:
    """A reference list: sorted, distinct, at most ``most``."""
    return F.slice(F.array_sort(F.array_distinct(ids)), 1, most)


def facts(records: DataFrame, record_type: str | None = None, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return page(records if record_type is None else records.where(F.col("record_type") == record_type), ["id"], offset, limit)


def entities(table: DataFrame, kind: str | None = None, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Persons first, then by kind and id."""
    return page(table if kind is None else table.where(F.col("kind") == kind), [F.when(F.col("kind") == "person", 0).otherwise(1), "kind", "id"], offset, limit)


def search(table: DataFrame, aliases: DataFrame, needle: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Entities whose label, kind or an alias holds ``needle``, whatever the case; label hits first."""
    has = lambda c: F.contains(F.lower(c), F.lit(needle.lower()))
    by_alias = aliases.where(has(F.col("alias"))).select(F.col("entity_id").alias("id")).distinct().withColumn("by_alias", F.lit(True))
    hits = table.join(by_alias, "id", "left").withColumn("in_label", has(F.col("label")))
    return page(hits.where(F.col("in_label") | has(F.col("kind")) | F.coalesce("by_alias", F.lit(False))), [F.desc("in_label"), "label", "id"], 0, limit).drop("by_alias", "in_label")


def findings(table: DataFrame, kind=None, finding_type=None, classification=None, entity=None, graph_version=None, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Findings of the current graph version, strongest class first, then type and id."""
    for column, value in (("kind", kind), ("finding_type", finding_type), ("classification", classification), ("graph_version", graph_version)):
        table = table if value is None else table.where(F.col(column) == value)
    table = table if entity is None else table.where(F.array_contains("entity_ids", entity))
    rank = F.coalesce(*[F.when(F.col("classification") == c, k) for c, k in RANK.items()])
    return page(table, [rank, "finding_type", "id"], offset, limit, MOST_FINDINGS)


def snapshot(vertices: DataFrame, edges: DataFrame, most: int = SNAPSHOT, focus=None) -> tuple[DataFrame, DataFrame, bool]:
    """The vertices of highest degree (by id among equal), the edges among them, and whether any vertex is left out.

    With ``focus``: that vertex and its neighbours, the focus first, under the same bound.
    """
    most = min(max(1, most), MOST_SNAPSHOT)
    ranked = graph.degrees(vertices, edges)
    if focus is not None:
        e = graph.undirected(edges)
        near = e.where(F.col("src") == F.lit(focus)).select(F.col("dst").alias("id"))
        ranked = ranked.where(F.col("id") == F.lit(focus)).unionByName(ranked.where(F.col("id") != F.lit(focus)).join(near, "id", "left_semi"))
    order = [F.desc(F.col("id") == F.lit(focus))] if focus is not None else []
    top = ranked.orderBy(*order, F.desc("degree"), "id").limit(most + 1).select("id")
    kept = graph.cut(top)
    truncated = kept.count() > most
    if truncated:
        kept = graph.cut(ranked.orderBy(*order, F.desc("degree"), "id").limit(most).select("id"))
    return kept, graph.induced(edges, kept), truncated


def evidence_counts(table: DataFrame, column: str) -> dict[str, int]:
    return {r[column]: r["count"] for r in table.groupBy(column).count().collect()}
