"""Entities from mentions: shared identifiers first, then exact, then normalised names; never a forced merge.

An ambiguous match stays apart and is said to be ambiguous. Names index entities of shared identifiers only; what is
attached by name never extends the index. Every choice among equals is a least id, so no result depends on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.ids import content_id
from lodestrand.functions.names import normalize_name
from lodestrand.operators.graph import connected_components, cut

#: Confidences of decisions, the schemes whose equal values make one entity, direct identifiers.
CONFIDENCE = {"canonical_identifier": 1.0, "shared_identifier_merge": 0.95, "new_entity": 1.0, "exact_name": 0.6, "normalized_name": 0.55, "unlinked": 0.5, "ambiguous": 0.2}
MERGEABLE = ["LEI"]
DIRECT = ["has_phone", "has_account", "has_vehicle"]
IDENTIFIERS = ["phone", "imei", "vehicle", "bank_account"]
SUBJECTS = ["person", "organisation"]


def identifiers(facts: DataFrame) -> DataFrame:
    """(id, kind, label, mentions): one entity for each (kind, value) that is mentioned or bound."""
    m = facts.where(F.col("mention_kind").isin(IDENTIFIERS)).select(F.col("mention_kind").alias("kind"), F.col("observed").alias("label"), F.col("id").alias("m"))
    kind_of = F.create_map(*[F.lit(x) for p in (("has_phone", "phone"), ("has_account", "bank_account"), ("has_vehicle", "vehicle"), ("phone_bound_to_imei", "imei"), ("imei_bound_to_phone", "phone")) for x in p])
    bound = facts.where("record_type = 'relationship_mention'").select(F.try_element_at(kind_of, F.col("relationship_type")).alias("kind"), F.col("observed").alias("label"), F.col("id").alias("m")).where("kind is not null")
    g = m.unionByName(bound).groupBy("kind", "label").agg(F.array_sort(F.collect_set("m")).alias("mentions"))
    return g.select(content_id("entity", F.col("kind"), F.col("label")).alias("id"), "kind", "label", "mentions")


def _keys(facts: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mention, key) of identifiers that merge, and mentions (mention) that contradict themselves: two values of one scheme."""
    rel = facts.where("record_type = 'relationship_mention'").select("evidence_item_id", "relationship_type", "subject", "observed")
    direct = rel.where(F.col("relationship_type").isin(DIRECT)).select("evidence_item_id", "subject", F.concat_ws(":", "relationship_type", "observed").alias("key"), F.lit(None).cast("string").alias("scheme"))
    named = rel.where("relationship_type = 'has_identifier'").withColumn("scheme", F.upper(F.split_part("observed", F.lit(":"), F.lit(1)))).where(F.col("scheme").isin(MERGEABLE))
    every = direct.unionByName(named.select("evidence_item_id", "subject", F.col("observed").alias("key"), "scheme"))
    own = mentions.join(every, "evidence_item_id").where("subject is null or subject = name").select("mention", "key", "scheme").distinct()
    torn = own.where("scheme is not null").groupBy("mention", "scheme").agg(F.count("*").alias("n")).where("n > 1").select("mention").distinct()
    return own.join(torn, "mention", "left_anti").select("mention", "key"), torn


def resolve(facts: DataFrame) -> dict[str, DataFrame]:
    """entities (id, kind, label, mentions), decisions (mention, entity_id, type, status, confidence, candidates), aliases.

    A mention that contradicts itself stands alone and is ambiguous, whatever else it shares.
    """
    mentions = facts.where((F.col("record_type") == "entity_mention") & F.col("mention_kind").isin(SUBJECTS)).select(F.col("id").alias("mention"), "evidence_item_id", F.col("mention_kind").alias("kind"), F.col("observed").alias("name"))
    keys, torn = _keys(facts, mentions)
    keyed = keys.join(mentions.select("mention", "kind"), "mention").select("mention", F.concat_ws("|", "kind", "key").alias("key"))
    nodes = keyed.select(F.concat(F.lit("m:"), "mention").alias("id")).distinct()
    parts = connected_components(nodes.unionByName(keyed.select(F.concat(F.lit("k:"), "key").alias("id")).distinct()), keyed.select(F.concat(F.lit("m:"), "mention").alias("src"), F.concat(F.lit("k:"), "key").alias("dst")))
    joined = parts.where(F.startswith("id", F.lit("m:"))).select(F.expr("substring(id, 3)").alias("mention"), "component").join(mentions, "mention")
    named = _entity(joined, "component")
    tier_a = cut(named.select("mention", "kind", "name", "entity_id", F.when(F.col("n") > 1, "shared_identifier_merge").otherwise("new_entity").alias("type"), F.lit("resolved").alias("status"), F.when(F.col("n") > 1, CONFIDENCE["shared_identifier_merge"]).otherwise(CONFIDENCE["new_entity"]).alias("confidence")))

    rest = mentions.join(tier_a.select("mention"), "mention", "left_anti").withColumn("norm", normalize_name(F.col("name")))
    rest = rest.join(torn.withColumn("torn", F.lit(True)), "mention", "left")

    def index(key: Column, of: str) -> DataFrame:
        found = tier_a.select("kind", key.alias(of), "entity_id").where(F.col(of) != "").distinct()
        return found.groupBy("kind", of).agg(F.count("*").alias(f"{of}_n"), F.min("entity_id").alias(f"{of}_e"))

    tried = rest.join(index(F.col("name"), "name"), ["kind", "name"], "left").join(index(normalize_name(F.col("name")), "norm"), ["kind", "norm"], "left")
    n1, n2 = F.coalesce("name_n", F.lit(0)), F.coalesce("norm_n", F.lit(0))
    conflict = F.coalesce("torn", F.lit(False))
    alone = content_id("entity", F.col("kind"), F.col("mention"))
    choice = [
        (conflict, alone, "ambiguous_identifier_conflict", "ambiguous", CONFIDENCE["ambiguous"], F.lit(0)),
        (n1 == 1, F.col("name_e"), "exact_name_match", "resolved", CONFIDENCE["exact_name"], n1),
        (n1 > 1, alone, "ambiguous_name_conflict", "ambiguous", CONFIDENCE["ambiguous"], n1),
        (n2 == 1, F.col("norm_e"), "normalized_name_match", "resolved", CONFIDENCE["normalized_name"], n2),
        (n2 > 1, alone, "ambiguous_normalized_name_conflict", "ambiguous", CONFIDENCE["ambiguous"], n2),
        (F.lit(True), alone, "unlinked_mention", "unresolved", CONFIDENCE["unlinked"], F.lit(0)),
    ]
    pick = None
    for when, entity, kind, status, confidence, n in choice:
        row = F.struct(entity.alias("entity_id"), F.lit(kind).alias("type"), F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), n.cast("long").alias("candidates"))
        pick = F.when(when, row) if pick is None else pick.when(when, row)
    tier_b = tried.select("mention", "kind", "name", pick.alias("c")).select("mention", "kind", "name", "c.*")
    decided = cut(tier_a.withColumn("candidates", F.lit(1).cast("long")).select(tier_b.columns).unionByName(tier_b))

    note = facts.where("record_type = 'attribute_mention' and attribute = 'note'").groupBy("evidence_item_id").agg(F.max(F.contains(F.lower("observed"), F.lit("variant"))).alias("variant"))
    ranked = decided.join(mentions.select("mention", "evidence_item_id"), "mention").join(note, "evidence_item_id", "left")
    label = F.min_by("name", F.struct(F.coalesce("variant", F.lit(False)), "name", "mention"))
    entities = ranked.groupBy("entity_id", "kind").agg(label.alias("label"), F.array_sort(F.collect_set("mention")).alias("mentions")).withColumnRenamed("entity_id", "id")
    said = facts.where(F.col("relationship_type").isin("has_alias", "alias_of")).select("evidence_item_id", F.col("observed").alias("alias"), F.col("id").alias("record"))
    by_item = ranked.select("evidence_item_id", F.col("entity_id")).distinct()
    spelled = ranked.select("entity_id", F.col("name").alias("alias"), F.col("mention").alias("record")).unionByName(by_item.join(said, "evidence_item_id").select("entity_id", "alias", "record"))
    own = spelled.join(entities.select(F.col("id").alias("entity_id"), "label"), "entity_id").where(F.lower(F.trim("alias")) != F.lower(F.trim("label")))
    aliases = own.groupBy("entity_id", F.lower(F.trim("alias")).alias("k")).agg(F.min_by("alias", "record").alias("alias"), F.min("record").alias("record")).select(content_id("alias", F.col("entity_id"), F.col("k")).alias("id"), "entity_id", "alias", "record")
    return {"entities": entities.unionByName(identifiers(facts).select("id", "kind", "label", "mentions")), "decisions": decided, "aliases": aliases}


def _entity(joined: DataFrame, group: str) -> DataFrame:
    """Each mention with its entity: an id from the kind and all member ids in order."""
    members = F.array_join(F.array_sort(F.collect_set("mention")), ",")
    groups = joined.groupBy(group, "kind").agg(F.count("*").alias("n"), members.alias("m")).select(group, "n", content_id("entity", F.col("kind"), F.col("m")).alias("entity_id"))
    return joined.join(groups, group)
