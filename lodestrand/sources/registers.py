"""Public registers to one record shape: (registry, record_id, subject_kind, name, official_name, aliases, identifiers,
relations, jurisdiction, status). Payloads are read from files; fetching them is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

APPROVED = ["APPROVED", "APPROVED_WITH_RESTRICTIONS"]
LEI, QID = r"^[A-Z0-9]{18}[0-9]{2}$", r"(Q[0-9]+)$"


def source_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of sources with quoted fields; its ``;``-separated list column becomes an array."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.withColumn("fields", F.filter(F.transform(F.split("fields", ";"), lambda x: F.trim(x)), lambda x: x != "")) if "fields" in df.columns else df


def require_approved(sources: DataFrame, source_id: str) -> None:
    if sources.where((F.col("source_id") == source_id) & F.col("status").isin(APPROVED)).isEmpty():
        raise PermissionError(f"source {source_id} is not approved")


def _present(*pairs: tuple[str, Column]) -> Column:
    """Identifiers of which there is a value."""
    every = F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(s).alias("scheme"), v.alias("value"))) for s, v in pairs])
    return F.filter(every, lambda x: x.isNotNull())


def _names(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(x, lambda v: F.coalesce(F.trim(v), F.lit("")) != "")))


def gleif(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """LEI records: of an LEI that occurs twice the first file's, first position's, counts."""
    schema = "data array<struct<attributes:struct<lei:string,ocid:string,entity:struct<legalName:struct<name:string>,otherNames:array<struct<name:string>>,transliteratedOtherNames:array<struct<name:string>>,jurisdiction:string,status:string,registeredAt:struct<id:string>,registeredAs:string>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(paths).select(F.input_file_name().alias("file"), F.posexplode("data").alias("at", "d")).select("file", "at", "d.attributes.*")
    first = Window.partitionBy("lei").orderBy("file", "at")
    r = raw.where(F.col("lei").rlike(LEI)).withColumn("k", F.row_number().over(first)).where("k = 1")
    others = _names(F.concat(F.coalesce(F.col("entity.otherNames.name"), F.array().cast("array<string>")), F.coalesce(F.col("entity.transliteratedOtherNames.name"), F.array().cast("array<string>"))))
    national = F.when(F.col("entity.registeredAt.id").isNotNull() & F.col("entity.registeredAs").isNotNull(), F.struct(F.concat(F.lit("NATIONAL_REGISTER:"), "entity.registeredAt.id").alias("scheme"), F.col("entity.registeredAs").alias("value")))
    ids = F.filter(F.concat(_present(("LEI", F.col("lei")), ("OPENCORPORATES", F.col("ocid"))), F.array(national)), lambda x: x.isNotNull())
    return r.select(F.lit("GLEIF").alias("registry"), F.col("lei").alias("record_id"), F.lit("organisation").alias("subject_kind"), F.col("entity.legalName.name").alias("name"), F.col("entity.legalName.name").alias("official_name"), F.array_except(others, F.array("entity.legalName.name")).alias("aliases"), ids.alias("identifiers"), F.col("entity.jurisdiction").alias("jurisdiction"), F.col("entity.status").alias("status"))


def gleif_relations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(record_id, relations) between LEIs; predicates in lower snake case."""
    node = "struct<id:string,type:string>"
    schema = f"data array<struct<attributes:struct<relationship:struct<startNode:{node},endNode:{node},type:string>>>>"
    r = spark.read.schema(schema).option("multiLine", True).json(paths).select(F.explode("data.attributes.relationship").alias("r")).where("r.startNode.type = 'LEI' and r.endNode.type = 'LEI'")
    predicate = F.trim(F.regexp_replace(F.lower(F.trim("r.type")), "[^a-z0-9]+", "_"), F.lit("_"))
    return r.groupBy(F.col("r.startNode.id").alias("record_id")).agg(F.array_sort(F.collect_set(F.struct(predicate.alias("predicate"), F.col("r.endNode.id").alias("target")))).alias("relations"))


def wikidata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Query bindings folded by item: the cross product of its values becomes sets; the official name is the least."""
    fields = ["item", "itemLabel", "itemLabelHi", "lei", "official", "shortName", "ocid", "cik", "countryCode"]
    schema = "results struct<bindings:array<struct<" + ",".join(f"{f}:struct<value:string>" for f in fields) + ">>>"
    b = spark.read.schema(schema).option("multiLine", True).json(paths).select(F.explode("results.bindings").alias("b")).select(*[F.col(f"b.{f}.value").alias(f) for f in fields])
    b = b.withColumn("record_id", F.regexp_extract("item", QID, 1)).where("record_id <> ''")
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set(_present(("LEI", F.col("lei")), ("OPENCORPORATES", F.col("ocid")), ("CIK", F.regexp_replace("cik", "^0+", "")))))))
    g = b.groupBy("record_id").agg(F.min("itemLabel").alias("name"), F.min("official").alias("official_name"), _names(F.flatten(F.collect_set(F.array("itemLabelHi", "shortName", "official")))).alias("a"), ids.alias("identifiers"), F.min("countryCode").alias("jurisdiction"))
    return g.select(F.lit("WIKIDATA").alias("registry"), "record_id", F.lit("organisation").alias("subject_kind"), "name", "official_name", F.array_except("a", F.array("name")).alias("aliases"), "identifiers", "jurisdiction", F.lit(None).cast("string").alias("status"))


def edgar(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Submissions: former names as aliases; states as US jurisdictions."""
    r = spark.read.schema("cik string, name string, entityType string, stateOfIncorporation string, formerNames array<struct<name:string>>").option("multiLine", True).json(paths)
    cik = F.regexp_replace("cik", r"\D", "")
    return r.where(cik != "").select(F.lit("EDGAR").alias("registry"), F.lpad(cik, 10, "0").alias("record_id"), F.lit("organisation").alias("subject_kind"), "name", F.col("name").alias("official_name"), F.array_except(_names(F.coalesce(F.col("formerNames.name"), F.array().cast("array<string>"))), F.array("name")).alias("aliases"), _present(("CIK", F.regexp_replace(cik, "^0+", ""))).alias("identifiers"), F.when(F.col("stateOfIncorporation") != "", F.concat(F.lit("US-"), "stateOfIncorporation")).alias("jurisdiction"), F.lit(None).cast("string").alias("status"))


def violations(records: DataFrame) -> DataFrame:
    """``records`` with ``errors``: what keeps each from being used (no licence, no name, a reference that isn't its own)."""
    c = F.col
    checks = [("no name", F.coalesce(c("name"), F.lit("")) == ""), ("no licence", F.coalesce(c("license"), F.lit("")) == ""), ("bad reference", c("record_ref") != F.concat_ws(":", "registry", "record_id"))]
    return records.withColumn("errors", F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull()))
