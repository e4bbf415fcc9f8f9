"""Queries over the sample tables, one for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import names, similarity
from lodestrand.functions.numbers import half_up
from lodestrand.operators import aggregates, corroborate, graph, joins

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as activity: users at places (types of event), each its own evidence item."""
    e = _t(spark, sf, "events")
    return e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("location"), F.col("ts").alias("at"), F.col("event_id").alias("evidence_id"), F.col("event_id").alias("record_id"))


#: SQL of rounding halves up, and of activity events.
_R6 = "floor(({}) * 1000000.0 + 0.5) / 1000000.0"
_ACT = "act AS (SELECT user_id AS subject, event_type AS location, ts AS tm, epoch_us(ts) // 1000 AS ms, event_id AS evidence_id FROM events)"


# --- scans, projections, facts


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_returnflag = 'R'")
def scan_project_filter(spark, sf):
    l = _t(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz '1998-01-01' and l_shipdate < timestamp_ntz '1999-01-01' and l_returnflag = 'R'")
    return l.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query("""
SELECT event_id, 'k' AS field_path, 'attribute' AS fact_type, json_extract_string(props, '$.k') AS observed FROM events WHERE json_extract_string(props, '$.k') <> ''
UNION ALL SELECT event_id, 'event_type', 'entity_mention', event_type FROM events WHERE event_type <> ''
UNION ALL SELECT event_id, 'user', 'relationship_mention', user_id || ':' || event_type FROM events WHERE event_type = 'purchase'""")
def json_extract_facts(spark, sf):
    """One item to many facts: each field that is there gives a row."""
    e = _t(spark, sf, "events")
    fact = lambda path, kind, value: F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.lit(path).alias("field_path"), F.lit(kind).alias("fact_type"), value.alias("observed")))
    bought = F.when(F.col("event_type") == "purchase", F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type"))
    facts = F.array(fact("k", "attribute", F.get_json_object("props", "$.k")), fact("event_type", "entity_mention", F.col("event_type")), fact("user", "relationship_mention", bought))
    return e.select("event_id", F.inline(F.filter(facts, lambda x: x.isNotNull())))


def _mentions(spark, sf):
    part, cust, supp = _t(spark, sf, "part"), _t(spark, sf, "customer"), _t(spark, sf, "supplier")
    rows = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), F.col(value).alias("value"), F.concat(F.lit(kind[0]), F.col(key).cast("string")).alias("id"))
    return rows(part, "part", "p_partkey", "p_name").unionByName(rows(cust, "customer", "c_custkey", "c_mktsegment")).unionByName(rows(supp, "supplier", "s_suppkey", "s_name"))


_MENTIONS = "m AS (SELECT 'part' AS kind, p_name AS value, 'p' || p_partkey AS id FROM part UNION ALL SELECT 'customer', c_mktsegment, 'c' || c_custkey FROM customer UNION ALL SELECT 'supplier', s_name, 's' || s_suppkey FROM supplier)"


@query(f"WITH {_MENTIONS} SELECT kind, value, count(*) AS mentions, min(id) AS first_id FROM m GROUP BY 1, 2")
def canonical_entities(spark, sf):
    return _mentions(spark, sf).groupBy("kind", "value").agg(F.count("*").alias("mentions"), F.min("id").alias("first_id"))


@query("SELECT event_id, 'event_' || left(sha256(concat_ws(chr(1), lower(trim(event_type)), user_id)), 16) AS id FROM events")
def content_ids(spark, sf):
    from lodestrand.functions.ids import content_id

    return _t(spark, sf, "events").select("event_id", content_id("event", F.col("event_type"), F.col("user_id")).alias("id"))


# --- joins


@query("WITH u AS (SELECT s_acctbal AS b, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1) SELECT c_custkey, s_suppkey FROM customer JOIN u ON floor(c_acctbal) = floor(b)")
def unique_name_match(spark, sf):
    """Customers with suppliers whose balance is theirs alone, on whole amounts."""
    own = joins.unique_matches(_t(spark, sf, "supplier"), "s_acctbal", "s_suppkey").select(F.floor("s_acctbal").alias("amount"), "s_suppkey")
    return _t(spark, sf, "customer").select("c_custkey", F.floor("c_acctbal").alias("amount")).join(own, "amount").select("c_custkey", "s_suppkey")


@query("SELECT p_name, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def ambiguous_name(spark, sf):
    return joins.ambiguous_matches(_t(spark, sf, "part"), "p_name", "p_partkey")


def _contributions(spark, sf):
    o, l = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.lit("financial").alias("type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.col("l_orderkey").alias("evidence_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("record_id"), F.col("l_shipdate").alias("at"),
        F.lit(None).cast("int").alias("duration"), (F.col("l_extendedprice") * 100).cast("decimal(18,0)").alias("amount"), F.col("o_orderpriority").alias("currency"), F.lit("order").alias("method"),
    )


_EDGES = "e AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, count(*) AS event_count, count(DISTINCT l_orderkey) AS evidence_count, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS total_cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query(f"WITH {_EDGES} SELECT *, CASE WHEN evidence_count >= 2 THEN 'corroborated_fact' ELSE 'observed_fact' END AS classification FROM e")
def edge_aggregate(spark, sf):
    """Customer to supplier edges from order lines."""
    e = aggregates.aggregate_edges(_contributions(spark, sf))
    return e.select("src", "dst", "event_count", F.size("evidence_ids").cast("long").alias("evidence_count"), "first_at", "last_at", F.col("total_amount").cast("long").alias("total_cents"), "classification")


@query("SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n, count(DISTINCT l_orderkey) AS evidence_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2")
def derived_edges_owner_rollup(spark, sf):
    """Edges lifted from identifiers to their owners: nations of customer and supplier, where they differ."""
    o, l = _t(spark, sf, "orders").select("o_orderkey", "o_custkey"), _t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    c, s = _t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), _t(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    parts = joins.parts_of(l)
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "src").repartition(parts, "o_orderkey")
    l = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "dst").repartition(parts, "l_orderkey")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("src <> dst")
    per_order = j.groupBy("src", "dst", "l_orderkey").agg(F.count("*").alias("n"))
    return per_order.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.count("*").alias("evidence_count"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_missing(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey").join(_t(spark, sf, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 40) AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < 5000)")
def semi_join_endpoints(spark, sf):
    """Lines of which both ends exist."""
    l = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ok = l.join(_t(spark, sf, "part").where("p_size > 40").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(_t(spark, sf, "supplier").where("s_acctbal < 5000").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return ok.select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def insert_if_absent(spark, sf):
    known = _t(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    return joins.insert_if_absent(_t(spark, sf, "events").select(F.col("user_id").alias("id")), known)


@query("SELECT n_nationkey, n_name, coalesce(s.n, 0) AS suppliers, coalesce(r_name, n_name) AS label FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def label_enrichment(spark, sf):
    n, r = _t(spark, sf, "nation"), _t(spark, sf, "region")
    s = _t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("suppliers"), F.coalesce("r_name", "n_name").alias("label"))


# --- space and time


@query(f"WITH {_ACT}, pairs AS (SELECT a.subject AS subject_a, b.subject AS subject_b, count(*) AS pair_count, min(abs(a.ms - b.ms)) AS gap, list_distinct(list_concat(list(a.tm::DATE), list(b.tm::DATE))) AS days, list_distinct(list_concat(list(a.evidence_id), list(b.evidence_id))) AS ev FROM act a JOIN act b ON a.subject < b.subject AND b.ms BETWEEN a.ms - 1800000 AND a.ms + 1800000 GROUP BY 1, 2) SELECT subject_a, subject_b, pair_count, len(days) AS distinct_days, CAST(floor(gap / 1000.0 + 0.5) AS BIGINT) AS min_gap_seconds, len(ev) AS evidence_count, CASE WHEN pair_count >= 2 THEN 'corroborated_fact' ELSE 'algorithmic_signal' END AS classification FROM pairs WHERE len(ev) >= 2")
def temporal_co_occurrence(spark, sf):
    return corroborate.temporal_overlaps(_events(spark, sf).drop("location"))


@query(f"WITH {_ACT}, p AS (SELECT location, subject, count(*) AS n, list(DISTINCT evidence_id) AS e, min(tm) AS low, max(tm) AS high FROM act WHERE location IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2) SELECT location, a.subject AS subject_a, b.subject AS subject_b, a.n AS count_a, b.n AS count_b, len(list_distinct(list_concat(a.e, b.e))) AS evidence_count, CAST(floor(((epoch_us(greatest(a.high, b.high)) // 1000) - (epoch_us(least(a.low, b.low)) // 1000)) / 1000.0 + 0.5) AS BIGINT) AS span_seconds, CASE WHEN len(list_distinct(list_concat(a.e, b.e))) >= 2 THEN 'corroborated_fact' ELSE 'algorithmic_signal' END AS classification FROM p a JOIN p b USING (location) WHERE a.subject < b.subject")
def co_location_pairs(spark, sf):
    return corroborate.co_locations(_events(spark, sf))


_REPEATED = f"{_ACT}, rp AS (SELECT a.location, a.subject AS subject_a, b.subject AS subject_b, count(*) AS occurrences, len(list_distinct(list_concat(list(a.evidence_id), list(b.evidence_id)))) AS evidence_count FROM act a JOIN act b ON a.location = b.location AND a.subject < b.subject AND floor(abs(a.ms - b.ms) / 1000.0 + 0.5) <= 1800 GROUP BY 1, 2, 3 HAVING count(*) >= 2)"


@query(f"WITH {_REPEATED} SELECT *, CASE WHEN evidence_count >= 2 THEN 'corroborated_fact' ELSE 'algorithmic_signal' END AS classification FROM rp")
def repeated_overlap(spark, sf):
    return corroborate.repeated_overlaps(_events(spark, sf))


def _places(spark, sf):
    """Suppliers as places in a box of a few degrees, by a formula of their keys."""
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (28.4 + (F.col("s_suppkey") * 7919 % 1000) / 2000.0).alias("lat"), (76.9 + (F.col("s_suppkey") * 104729 % 1000) / 2000.0).alias("lon"))


_PLACES = "pl AS (SELECT s_suppkey AS id, 28.4 + (s_suppkey * 7919 % 1000) / 2000.0 AS lat, 76.9 + (s_suppkey * 104729 % 1000) / 2000.0 AS lon FROM supplier)"
_HAVERSINE = "CAST(floor(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))) + 0.5) AS BIGINT)"


@query(f"WITH {_PLACES}, d AS (SELECT a.id AS a, b.id AS b, {_HAVERSINE.format(a='a', b='b')} AS metres FROM pl a JOIN pl b ON a.id < b.id) SELECT * FROM d WHERE metres > 0 AND metres <= 3000")
def spatial_pairs_haversine(spark, sf):
    return joins.near_join(_places(spark, sf), 3000)


@query(f"WITH {_PLACES}, act AS (SELECT user_id AS subject, event_id % (SELECT count(*) FROM supplier) AS location, ts AS tm, event_id AS record_id FROM events), s AS (SELECT subject, location, tm, record_id, lead(location) OVER w AS l2, lead(tm) OVER w AS t2 FROM act WINDOW w AS (PARTITION BY subject ORDER BY tm, record_id)), j AS (SELECT subject, least(location, l2) AS location_a, greatest(location, l2) AS location_b, tm, record_id, {_HAVERSINE.format(a='p', b='q')} AS metres, CAST(floor(abs(epoch_us(t2) // 1000 - epoch_us(tm) // 1000) / 1000.0 + 0.5) AS BIGINT) AS seconds FROM s JOIN pl p ON p.id = location JOIN pl q ON q.id = l2 WHERE l2 <> location), f AS (SELECT *, CASE WHEN seconds > 0 THEN metres / seconds WHEN metres > 0 THEN 'infinity'::DOUBLE ELSE 0.0 END AS speed FROM j) SELECT subject, location_a, location_b, metres, seconds, CASE WHEN isfinite(speed) THEN floor(speed * 1000.0 + 0.5) / 1000.0 END AS speed_mps FROM f WHERE speed > 55 QUALIFY row_number() OVER (PARTITION BY subject, location_a, location_b ORDER BY speed DESC, tm, record_id) = 1")
def travel_contradiction(spark, sf):
    """Users at suppliers' places: the event number deals them."""
    places = _places(spark, sf)
    n = places.agg(F.count("*").alias("n"))
    e = _events(spark, sf).crossJoin(F.broadcast(n)).withColumn("location", F.col("record_id") % F.col("n"))  # one row
    return corroborate.travel_contradictions(e, places)


def _findings(spark, sf, only=None):
    e = _events(spark, sf)
    types = {"spatial_co_location": corroborate.co_locations(e), "temporal_co_occurrence": corroborate.temporal_overlaps(e.drop("location"), only=only), "repeated_overlap": corroborate.repeated_overlaps(e, only=only)}
    rows = [df.select(F.lit(t).alias("finding_type"), "subject_a", "subject_b", (F.col("location") if t != "temporal_co_occurrence" else F.lit(None).cast("string")).alias("location"), "classification") for t, df in types.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_FINDINGS = (
    f"WITH {_REPEATED}, pp AS (SELECT location, subject, count(*) AS n, list(DISTINCT evidence_id) AS e FROM act WHERE location IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2), "
    "tc AS (SELECT a.subject AS subject_a, b.subject AS subject_b, count(*) AS n FROM act a JOIN act b ON a.subject < b.subject AND b.ms BETWEEN a.ms - 1800000 AND a.ms + 1800000 GROUP BY 1, 2 HAVING len(list_distinct(list_concat(list(a.evidence_id), list(b.evidence_id)))) >= 2), "
    "fi AS (SELECT 'spatial_co_location' AS finding_type, a.subject AS subject_a, b.subject AS subject_b, location, CASE WHEN len(list_distinct(list_concat(a.e, b.e))) >= 2 THEN 'corroborated_fact' ELSE 'algorithmic_signal' END AS classification FROM pp a JOIN pp b USING (location) WHERE a.subject < b.subject "
    "UNION ALL SELECT 'temporal_co_occurrence', subject_a, subject_b, NULL, CASE WHEN n >= 2 THEN 'corroborated_fact' ELSE 'algorithmic_signal' END FROM tc UNION ALL SELECT 'repeated_overlap', subject_a, subject_b, location, CASE WHEN evidence_count >= 2 THEN 'corroborated_fact' ELSE 'algorithmic_signal' END FROM rp) "
)


@query(_FINDINGS + "SELECT subject_a, subject_b, count(*) AS total, count(*) FILTER (classification = 'corroborated_fact') AS corroborated, count(*) FILTER (finding_type = 'spatial_co_location') AS spatial_co_location, count(*) FILTER (finding_type = 'temporal_co_occurrence') AS temporal_co_occurrence, count(*) FILTER (finding_type = 'repeated_overlap') AS repeated_overlap FROM fi GROUP BY 1, 2")
def pair_overlap_rollup(spark, sf):
    return corroborate.pair_rollup(_findings(spark, sf))


@query(_FINDINGS + "SELECT * FROM fi WHERE classification = 'corroborated_fact' AND finding_type = 'repeated_overlap' AND 7 IN (subject_a, subject_b)")
def finding_filters(spark, sf):
    """Findings by class, type and subject."""
    return _findings(spark, sf, F.col("subject") == 7).where("classification = 'corroborated_fact' and finding_type = 'repeated_overlap' and (subject_a = 7 or subject_b = 7)")


# --- order, pages, counts

_REVENUE = "rev AS (SELECT o_custkey, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents FROM orders GROUP BY 1)"


def _revenue(spark, sf):
    return _t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query(f"WITH {_REVENUE} SELECT o_custkey, cents, row_number() OVER (ORDER BY cents DESC, o_custkey) AS rank FROM rev")
def ranking_total_order(spark, sf):
    """Every customer's rank: a global order, reached by ranges rather than in one task."""
    return aggregates.running_sums(_revenue(spark, sf), [F.desc("cents"), F.col("o_custkey")], {"rank": F.lit(1)})


@query(f"WITH {_REVENUE} SELECT c_nationkey, o_custkey, cents, rank FROM (SELECT c_nationkey, o_custkey, cents, row_number() OVER (PARTITION BY c_nationkey ORDER BY cents DESC, o_custkey) AS rank FROM rev JOIN customer ON c_custkey = o_custkey) WHERE rank <= 12")
def topk_sections(spark, sf):
    """The twelve largest of each section."""
    j = _revenue(spark, sf).join(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("cents"), "o_custkey"))).where("rank <= 12").select("c_nationkey", "o_custkey", "cents", "rank")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def pagination(spark, sf):
    """The third page of 25 in a total order."""
    from lodestrand.plans.read_api import page

    return page(_t(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], offset=50, limit=25)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'X') AS x FROM orders GROUP BY 1")
def status_pivot_counts(spark, sf):
    return aggregates.census(_t(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P", "X"], ["o_orderpriority"])


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS readings, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS observed FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def attribute_disagreement(spark, sf):
    """Subjects with two or more readings of one attribute, each kept."""
    o = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("r"))
    return o.where(F.size("r") > 1).select("o_custkey", F.size("r").cast("long").alias("readings"), F.array_join("r", ",").alias("observed"))


@query(f"SELECT source, count(*) AS items, count(*) FILTER (n_chars >= 200) AS accepted, count(*) FILTER (n_chars < 200) AS rejected, {_R6.format('coalesce(avg(quality), 1.0)')} AS mean_confidence FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id) GROUP BY 1")
def evidence_inventory(spark, sf):
    """Items of each source, accepted and rejected; a source without confidences has a mean of 1."""
    d = _t(spark, sf, "documents").select("doc_id", "source", "n_chars")
    l = _t(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return d.join(l, "doc_id", "left").groupBy("source").agg(F.count("*").alias("items"), F.count_if(F.col("n_chars") >= 200).alias("accepted"), F.count_if(F.col("n_chars") < 200).alias("rejected"), half_up(F.coalesce(F.avg("quality"), F.lit(1.0)), 6).alias("mean_confidence"))


@query("SELECT doc_id, source, first_n FROM (SELECT doc_id, source, md5(text) AS h, count(*) OVER (PARTITION BY md5(text)) AS first_n, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first_wins(spark, sf):
    """Of equal texts the least doc_id; an argmin by hash, no group is sorted or gathered."""
    d = _t(spark, sf, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    g = d.groupBy("h").agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("r"), F.count("*").alias("first_n"))
    return g.select("r.doc_id", "r.source", "first_n")


@query("SELECT count(*) AS records, count(*) FILTER (doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL) AS complete FROM documents")
def provenance_completeness(spark, sf):
    return _t(spark, sf, "documents").agg(F.count("*").alias("records"), F.count_if(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).alias("complete"))


@query("SELECT user_id, min(ts) AS first_at, nullif(max(ts), min(ts)) AS last_at, count(*) AS n FROM events GROUP BY 1")
def activity_window(spark, sf):
    """First and last observation; an instant has no end."""
    return _t(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_at"), F.nullif(F.max("ts"), F.min("ts")).alias("last_at"), F.count("*").alias("n"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS label FROM customer WHERE contains(lower(c_name), '#0000000') UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '#0000000')")
def entity_search(spark, sf):
    c, s = _t(spark, sf, "customer"), _t(spark, sf, "supplier")
    rows = c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label")).unionByName(s.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")))
    return rows.where(F.contains(F.lower("label"), F.lit("#0000000")))


# --- names and similarity

_DECORATED = "SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ', INC' WHEN 2 THEN ' & Co' WHEN 3 THEN '''s (Trading) LLC' ELSE '' END AS raw FROM part"
_NORMAL = r"trim(regexp_replace(regexp_replace(replace(replace(lower(raw), '&', ' and '), '''', ''), '[.,\"()\[\]{}_/\\:;!?*|@#-]', ' ', 'g'), '\s+', ' ', 'g'))"


def _decorated(spark, sf):
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, " Pvt. Ltd.").when(k == 1, ", INC").when(k == 2, " & Co").when(k == 3, "'s (Trading) LLC").otherwise("")
    return _t(spark, sf, "part").select("p_partkey", F.concat("p_name", tail).alias("raw"))


@query(f"SELECT p_partkey, {_NORMAL} AS with_suffix, regexp_replace({_NORMAL}, '^(.+?)(?: (?:{'|'.join(names.SUFFIXES)}))+$', '\\1') AS normalized FROM ({_DECORATED})")
def normalize_name(spark, sf):
    return _decorated(spark, sf).select("p_partkey", names.with_suffix(F.col("raw")).alias("with_suffix"), names.normalize_name(F.col("raw")).alias("normalized"))


@query(rf"SELECT p_partkey, trim(regexp_replace(replace(lower(raw), '.', ''), '[^a-z0-9]+', ' ', 'g')) AS folded FROM ({_DECORATED})")
def fold_name(spark, sf):
    return _decorated(spark, sf).select("p_partkey", names.fold_name(F.col("raw")).alias("folded"))


@query("SELECT c_custkey, array_to_string(regexp_extract_all(c_name, '[0-9]+'), ',') AS runs FROM customer")
def digit_runs(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", F.array_join(similarity.digit_runs(F.col("c_name")), ",").alias("runs"))


_WORDS = "w AS (SELECT DISTINCT p_name, string_split(p_name, ' ')[1] AS lead FROM part)"


def _name_pairs(spark, sf):
    """Distinct part names that share their first word, a < b: blocking bounds what is compared."""
    n = _t(spark, sf, "part").select("p_name").distinct().withColumn("lead", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return n.select("lead", F.col("p_name").alias("a")).join(n.select("lead", F.col("p_name").alias("b")), "lead").where("a < b")


_PAIRS = f"{_WORDS}, pr AS (SELECT x.lead, x.p_name AS a, y.p_name AS b FROM w x JOIN w y ON x.lead = y.lead AND x.p_name < y.p_name)"


@query(f"WITH {_PAIRS} SELECT a, b, levenshtein(a, b) AS distance, {_R6.format('1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE')} AS ratio FROM pr")
def levenshtein_pairs(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"), half_up(similarity.levenshtein_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(f"WITH {_PAIRS}, t AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM pr) SELECT a, b, {_R6.format('len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y)))')} AS jaccard, {_R6.format('len(list_intersect(x, y))::DOUBLE / least(len(x), len(y))')} AS containment FROM t")
def token_jaccard_pairs(spark, sf):
    a, b = names.tokens(F.col("a")), names.tokens(F.col("b"))
    return _name_pairs(spark, sf).select("a", "b", half_up(similarity.jaccard(a, b), 6).alias("jaccard"), half_up(similarity.containment(a, b), 6).alias("containment"))


@query(f"WITH {_PAIRS}, g AS (SELECT a, b, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) AS x, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS y FROM pr) SELECT a, b, {_R6.format('2.0 * len(list_intersect(x, y)) / (len(x) + len(y))')} AS dice FROM g")
def trigram_dice_pairs(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", half_up(similarity.trigram_dice(F.col("a"), F.col("b")), 6).alias("dice"))


@query("WITH n AS (SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part), l AS (SELECT p_name, string_split(p_name, ' ')[1] AS lead FROM n) SELECT x.p_name AS a, y.p_name AS b FROM l x JOIN l y USING (lead) WHERE x.p_name < y.p_name AND starts_with(y.p_name, x.p_name || ' ')")
def prefix_containment(spark, sf):
    """Names of which one is the beginning of the other, word by word."""
    part = _t(spark, sf, "part").select("p_name")
    lead = F.split_part("p_name", F.lit(" "), F.lit(1))
    n = part.unionByName(part.select(lead.alias("p_name"))).distinct().withColumn("lead", lead)
    p = n.select("lead", F.col("p_name").alias("a")).join(n.select("lead", F.col("p_name").alias("b")), "lead").where("a < b")
    return p.where(similarity.ordered_prefix(names.tokens(F.col("a")), names.tokens(F.col("b")))).select("a", "b")


@query(f"WITH {_WORDS} SELECT lead, count(*) AS members, count(*) * (count(*) - 1) // 2 AS pairs FROM w GROUP BY 1")
def blocking_candidates(spark, sf):
    """Blocks by first word and the pairs that each stands for, without making them."""
    n = _t(spark, sf, "part").select("p_name").distinct().withColumn("lead", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return n.groupBy("lead").agg(F.count("*").alias("members")).withColumn("pairs", F.expr("members * (members - 1) div 2"))


# --- metrics and features

_SCORED = "sc AS (SELECT quality AS label, n_chars / 100 AS bucket FROM labels JOIN documents USING (doc_id)), s AS (SELECT label, least(floor(bucket), 60) AS score FROM sc)"


def _scored(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "n_chars")
    return _t(spark, sf, "labels").join(d, "doc_id").select(F.col("quality").alias("label"), F.least(F.floor(F.col("n_chars") / 100.0), F.lit(60)).cast("double").alias("score"))


@query(f"WITH {_SCORED}, c AS (SELECT count(*) FILTER (score >= 10 AND label = 1) AS tp, count(*) FILTER (score >= 10 AND label = 0) AS fp, count(*) FILTER (score < 10 AND label = 1) AS fn, count(*) FILTER (score < 10 AND label = 0) AS tn FROM s) SELECT tp, fp, fn, tn, {_R6.format('tp::DOUBLE / (tp + fp)')} AS precision, {_R6.format('tp::DOUBLE / (tp + fn)')} AS recall, {_R6.format('2.0 * tp / (2 * tp + fp + fn)')} AS f1, {_R6.format('fp::DOUBLE / (fp + tn)')} AS false_merge_rate, {_R6.format('fn::DOUBLE / (fn + tp)')} AS false_split_rate FROM c")
def confusion_at_threshold(spark, sf):
    return aggregates.confusion(_scored(spark, sf), 10)


@query(f"WITH {_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s) SELECT {_R6.format('(sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))')} AS roc_auc FROM r")
def roc_auc(spark, sf):
    return aggregates.roc_auc(_scored(spark, sf))


@query(f"WITH {_SCORED}, g AS (SELECT score, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS n FROM s GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS all_p FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), q AS (SELECT score, tp / all_p AS r, tp / (tp + fp) AS pr FROM c), a AS (SELECT (r - coalesce(lag(r) OVER (ORDER BY score DESC), 0)) * (pr + coalesce(lag(pr) OVER (ORDER BY score DESC), 1)) / 2 AS x FROM q) SELECT {_R6.format('sum(x)')} AS pr_auc FROM a")
def pr_auc(spark, sf):
    return aggregates.pr_auc(_scored(spark, sf))


@query(f"WITH {_SCORED}, g AS (SELECT score, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS n FROM s GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), m AS (SELECT score, 2 * tp / (tp + fp + ap) AS f1, fp / an AS fmr FROM c) SELECT score AS threshold, {_R6.format('f1')} AS f1, {_R6.format('fmr')} AS false_merge_rate, fmr <= 0.5 AS feasible FROM m ORDER BY fmr <= 0.5 DESC, floor(f1 * 1e12 + 0.5) DESC, score LIMIT 1")
def threshold_selection(spark, sf):
    return aggregates.threshold_selection(_scored(spark, sf), 0.5)


@query("SELECT 'l_quantity' AS feature, floor(avg(l_quantity) * 10000.0 + 0.5) / 10000.0 AS mean, floor(stddev_pop(l_quantity) * 10000.0 + 0.5) / 10000.0 AS deviation FROM lineitem UNION ALL SELECT 'l_discount', floor(avg(l_discount) * 10000.0 + 0.5) / 10000.0, floor(stddev_pop(l_discount) * 10000.0 + 0.5) / 10000.0 FROM lineitem UNION ALL SELECT 'l_tax', floor(avg(l_tax) * 10000.0 + 0.5) / 10000.0, floor(stddev_pop(l_tax) * 10000.0 + 0.5) / 10000.0 FROM lineitem")
def standardise_features(spark, sf):
    return aggregates.standardised(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


_TOKENS = "tk AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\n]+')) AS token FROM documents), df AS (SELECT token, count(*) AS df FROM tk WHERE token <> '' GROUP BY 1 HAVING count(*) >= 2)"


def _frequencies(spark, sf):
    d = _t(spark, sf, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = d.select("doc_id", F.explode(F.array_distinct(F.split(lowered, r"[ \n]+"))).alias("token")).where("token <> ''")
    return aggregates.document_frequency(w, "token", "doc_id", distinct=True)


@query(f"WITH {_TOKENS} SELECT token, df FROM df")
def token_document_frequency(spark, sf):
    return _frequencies(spark, sf)


@query(f"WITH {_TOKENS} SELECT token, {_R6.format('ln(1 + n / df.df::DOUBLE) / ln(1 + n)')} AS idf FROM df, (SELECT count(*)::DOUBLE AS n FROM documents)")
def idf(spark, sf):
    n = _t(spark, sf, "documents").agg(F.count("*").cast("double").alias("n"))
    return _frequencies(spark, sf).crossJoin(F.broadcast(n)).select("token", half_up(aggregates.idf(F.col("df"), F.col("n")), 6).alias("idf"))  # one row


@query("""
WITH s AS (SELECT p_type AS place, p_partkey, string_split(p_name, ' ') AS w FROM part), t AS (SELECT place, count(*) AS entities FROM s GROUP BY 1),
g AS (SELECT place, p_partkey, 'leading' AS side, array_to_string(w[1:k], ' ') AS gram FROM s, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k) WHERE k <= len(w)
UNION SELECT place, p_partkey, 'trailing', array_to_string(w[len(w) - k + 1:], ' ') FROM s, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k) WHERE k <= len(w))
SELECT place, side, gram, count(*) AS n, floor(count(*)::DOUBLE / any_value(entities) * 1000000.0 + 0.5) / 1000000.0 AS share FROM g JOIN t USING (place) GROUP BY 1, 2, 3""")
def edge_ngram_mining(spark, sf):
    """How often runs of words open or close the names of a place, and their share."""
    from lodestrand.plans.legal_forms import edge_ngrams

    return edge_ngrams(_t(spark, sf, "part").select(F.col("p_type").alias("place"), F.col("p_partkey").alias("entity"), F.col("p_name").alias("name")))


@query(f"WITH b AS (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type), t AS (SELECT count(*) AS n FROM part GROUP BY p_brand), s AS (SELECT count(*) AS n FROM part GROUP BY p_type), x AS (SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM b) AS tp, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM t) AS t, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM s) AS s) SELECT tp, s - tp AS fp, t - tp AS fn, {_R6.format('tp::DOUBLE / s')} AS precision, {_R6.format('tp::DOUBLE / t')} AS recall, {_R6.format('2 * (tp::DOUBLE / s) * (tp::DOUBLE / t) / (tp::DOUBLE / s + tp::DOUBLE / t)')} AS f1 FROM x")
def pairwise_cluster_f1(spark, sf):
    """Two groupings of parts against each other, from sizes of groups."""
    return aggregates.pair_counts(_t(spark, sf, "part"), "p_brand", "p_type")


# --- graphs


def _chain(spark, sf):
    """Customers of a nation next to each other by balance, where the gap is small: long thin components."""
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    c = _t(spark, sf, "customer").withColumn("dst", F.lead("c_custkey").over(w)).withColumn("gap", F.lead("c_acctbal").over(w) - F.col("c_acctbal"))
    return c.where("gap <= 150").select(F.col("c_custkey").alias("src"), "dst", F.lit("next").alias("type"), F.lit(1).alias("weight"))


_CHAIN = "ch AS (SELECT c_custkey, c_nationkey, c_acctbal, lead(c_custkey) OVER w AS nxt, lead(c_acctbal) OVER w - c_acctbal AS gap, c_acctbal - lag(c_acctbal) OVER w AS back FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey))"


@query(f"WITH {_CHAIN}, i AS (SELECT *, sum(CASE WHEN back <= 150 THEN 0 ELSE 1 END) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS UNBOUNDED PRECEDING) AS island FROM ch) SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, island) AS component FROM i")
def connected_components(spark, sf):
    return graph.connected_components(_t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), _chain(spark, sf))


@query(f"WITH {_CHAIN}, e AS (SELECT c_custkey AS id, 1 AS o, 0 AS i FROM ch WHERE gap <= 150 UNION ALL SELECT nxt, 0, 1 FROM ch WHERE gap <= 150) SELECT c_custkey AS id, count(e.id) AS degree, CAST(coalesce(sum(i), 0) AS BIGINT) AS in_degree, CAST(coalesce(sum(o), 0) AS BIGINT) AS out_degree FROM customer LEFT JOIN e ON e.id = c_custkey GROUP BY 1")
def degree_breakdown(spark, sf):
    return graph.degrees(_t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), _chain(spark, sf)).select("id", "degree", "in_degree", "out_degree")


@query(f"WITH {_CHAIN}, e AS (SELECT c_custkey AS id FROM ch WHERE gap <= 150 UNION ALL SELECT nxt FROM ch WHERE gap <= 150) SELECT c_custkey AS id, {_R6.format('count(e.id)::DOUBLE / ((SELECT count(*) FROM customer) - 1)')} AS centrality FROM customer LEFT JOIN e ON e.id = c_custkey GROUP BY 1")
def degree_centrality(spark, sf):
    return graph.degree_centrality(_t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), _chain(spark, sf))


def _bipartite(spark, sf):
    l = _t(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    l = l.repartition(joins.parts_of(l), "l_partkey", "l_suppkey").distinct()
    return l.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("supplies").alias("type"), F.lit(1).alias("weight"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, h) AS (SELECT 's1', 0 UNION SELECT u.b, h + 1 FROM r JOIN u ON u.a = r.id WHERE h < 6)
SELECT id, min(h) AS hops FROM r GROUP BY 1""")
def shortest_path_hops(spark, sf):
    """Hops from one supplier to every part and supplier that it reaches."""
    found = graph.hops(_bipartite(spark, sf), spark.createDataFrame([("s1",)], "id string"))
    return found.select("id", "hops")


@query("SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_suppkey = 1 OR FALSE")
def neighbourhood(spark, sf):
    """One supplier, what is next to it, and the edges among these."""
    return graph.neighbourhood(_bipartite(spark, sf), "s1").select("src", "dst")


@query()
def betweenness(spark, sf):
    """Nations by trade, where it is at least average: paths through each."""
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    e = graph.cut(derived_edges_owner_rollup(spark, sf))  # read several times
    mean = e.agg(F.avg("n").alias("mean"))
    return graph.betweenness(n, e.crossJoin(F.broadcast(mean)).where("n >= mean").select("src", "dst"))  # one row


@query()
def articulation_points(spark, sf):
    return graph.articulation_points(_t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), _chain(spark, sf))


@query()
def communities(spark, sf):
    return graph.communities(_t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), _chain(spark, sf))


# --- pairs, dossiers, questions (no SQL)


@query()
def pair_features(spark, sf):
    """The feature vector of blocked pairs of part names."""
    from lodestrand.plans.pairs import features

    p = _name_pairs(spark, sf).select(*[F.struct(F.col(s).alias("name"), F.lit(None).cast("string").alias("official_name"), F.array().cast("array<string>").alias("aliases"), F.lit("IN").alias("jurisdiction")).alias(s) for s in "ab"])
    return features(p)


@query()
def question_grounding(spark, sf):
    """Opening turns read as questions: intent and the known names that they hold."""
    from lodestrand.plans.ask import ground

    names_of = _t(spark, sf, "nation").select(F.col("n_name").alias("label"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    asked = _t(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("question"))
    return ground(asked, names_of)


# --- the stages, over the sample tables as evidence


def _evidence(spark, sf):
    """Customers and suppliers as account records, order lines as payments between the accounts."""
    holder = lambda t, key, name, kind: _t(spark, sf, t).select(F.concat(F.lit(t[0]), F.col(key).cast("string")).alias("id"), F.lit("bank_account_record").alias("item_type"), F.to_json(F.struct(F.concat(F.lit(t[0].upper()), F.col(key).cast("string")).alias("account"), F.col(name).alias("holderName"), F.lit(kind).alias("accountKind"))).alias("content"))
    o, l = _t(spark, sf, "orders").select("o_orderkey", "o_custkey"), _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    pay = F.struct(line.alias("txnRef"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("fromAccount"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("toAccount"), F.round(F.col("l_quantity") * 100).cast("long").alias("amount"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("valueDate"), F.lit("").alias("currency"))
    parts = joins.parts_of(l)
    paid = l.repartition(parts, "l_orderkey").join(o.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(line.alias("id"), F.lit("financial_transaction_record").alias("item_type"), F.to_json(pay).alias("content"))
    return holder("customer", "c_custkey", "c_name", "personal").unionByName(holder("supplier", "s_suppkey", "s_name", "business")).unionByName(paid)


_HOLDERS = "h AS (SELECT 'c' || c_custkey AS id, 'C' || c_custkey AS account, c_name AS holder, 'personal' AS kind FROM customer UNION ALL SELECT 's' || s_suppkey, 'S' || s_suppkey, s_name, 'business' FROM supplier)"
_PAID = "p AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'C' || o_custkey AS a, 'S' || l_suppkey AS b, round(l_quantity * 100)::BIGINT AS amount, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""WITH {_HOLDERS}, {_PAID}
SELECT id AS item, 'entity_mention' AS record_type, 'account' AS field_path, 'bank_account_named' AS fact_type, NULL AS subject, account AS observed, NULL::DOUBLE AS amount FROM h
UNION ALL SELECT id, 'attribute_mention', 'accountKind', 'account_kind', account, kind, NULL FROM h
UNION ALL SELECT id, 'relationship_mention', 'holderName', 'account_held_by', account, holder, NULL FROM h
UNION ALL SELECT id, 'entity_mention', 'holderName.person', 'person_named_as_holder', NULL, holder, NULL FROM h
UNION ALL SELECT id, 'event_mention', '$', 'financial_transaction', NULL, NULL, amount::DOUBLE FROM p""")
def extracted_facts(spark, sf):
    from lodestrand.operators.extract import extract

    f = extract(_evidence(spark, sf))
    return f.select(F.col("evidence_item_id").alias("item"), "record_type", "field_path", "fact_type", "subject", "observed", "amount")


@query("""
WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT 'c' || c_custkey AS item, CASE WHEN n > 1 THEN 'shared_identifier_merge' ELSE 'new_entity' END AS type, 'resolved' AS status, CASE WHEN n > 1 THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence FROM customer JOIN n USING (c_nationkey, c_mktsegment)
UNION ALL SELECT 's' || s_suppkey, CASE WHEN c_custkey IS NULL THEN 'unlinked_mention' WHEN s_suppkey % 2 = 0 THEN 'exact_name_match' ELSE 'normalized_name_match' END, CASE WHEN c_custkey IS NULL THEN 'unresolved' ELSE 'resolved' END, CASE WHEN c_custkey IS NULL THEN 0.5 WHEN s_suppkey % 2 = 0 THEN 0.6 ELSE 0.55 END::DOUBLE FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey""")
def resolution_decisions(spark, sf):
    """Customers that share an account (nation and segment) are one; suppliers written as customers match them by name."""
    from lodestrand.operators.extract import extract
    from lodestrand.operators.resolve import resolve

    c, s = _t(spark, sf, "customer"), _t(spark, sf, "supplier")
    as_item = lambda df, key, content: df.select(F.concat(F.lit(key[0]), F.col(key).cast("string")).alias("id"), F.lit("suspect_record").alias("item_type"), F.to_json(content).alias("content"))
    named = F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    items = as_item(c, "c_custkey", F.struct(F.col("c_name").alias("name"), F.array(F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment")).alias("accounts"))).unionByName(as_item(s, "s_suppkey", F.struct(F.when(F.col("s_suppkey") % 2 == 0, named).otherwise(F.concat(F.upper(named), F.lit(" Ltd."))).alias("name"))))
    facts = graph.cut(extract(items))
    d = resolve(facts)["decisions"].join(facts.select(F.col("id").alias("mention"), F.col("evidence_item_id").alias("item")), "mention")
    return d.select("item", "type", "status", "confidence")


@query(f"""WITH {_HOLDERS}, {_PAID}
SELECT 'ownership' AS type, holder AS src, account AS dst, count(*) AS event_count, NULL::DOUBLE AS total_amount, NULL AS first_at, 'observed_fact' AS classification FROM h GROUP BY 2, 3
UNION ALL SELECT 'financial', a, b, count(*), sum(amount)::DOUBLE, min(day), CASE WHEN count(DISTINCT id) >= 2 THEN 'corroborated_fact' ELSE 'observed_fact' END FROM p GROUP BY 2, 3
UNION ALL SELECT 'financial', x.holder, y.holder, count(*), sum(amount)::DOUBLE, min(day), 'ai_inference' FROM p JOIN h x ON x.account = a JOIN h y ON y.account = b GROUP BY 2, 3""")
def synthesized_edges(spark, sf):
    """Accounts and payments as observed, holders' links as inferred from them."""
    from lodestrand.operators.extract import extract
    from lodestrand.operators.resolve import resolve
    from lodestrand.operators.synthesize import synthesize

    facts = graph.cut(extract(_evidence(spark, sf)))
    found = {k: graph.cut(v) for k, v in resolve(facts).items()}
    e = synthesize(facts, found, spark.createDataFrame([], "id string, label string, key string"))
    name = lambda c: found["entities"].select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    return e.join(name("src"), "src").join(name("dst"), "dst").select("type", F.col("src_label").alias("src"), F.col("dst_label").alias("dst"), "event_count", "total_amount", "first_at", "classification")


from lodestrand import queries_more  # noqa: E402,F401  # adds its queries
