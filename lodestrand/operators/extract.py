"""Facts from evidence items: a table of rules by item type, one pass, each field that is there gives a row.

Items: (id, item_type, content JSON string). Content is read as a variant: a field that is missing, empty or of another
type is absent; nothing is thrown for it. An unknown item type is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.ids import content_id

ITEM_TYPES = ["fir", "suspect_record", "alias_record", "phone_record", "imei_record", "vehicle_record", "bank_account_record", "location_record", "cdr_event", "financial_transaction_record", "witness_statement", "crime_event", "public_record"]
#: Columns of a fact beside record_type, field_path and fact_type; doubles where said.
FIELDS = ["mention_kind", "relationship_type", "attribute", "subject", "observed", "event_kind", "caller", "callee", "started_at", "tower", "txn_ref", "from_account", "to_account", "value_date", "currency", "event_ref", "occurred_at", "scene"]
NUMBERS = ["duration", "amount", "latitude", "longitude"]
_V = "__v"


def _text(path: str, of: Column | str = _V) -> Column:
    """The string at ``path``; null if it is empty or no string."""
    return F.when(F.schema_of_variant(F.try_variant_get(of, path, "variant")) == "STRING", F.nullif(F.try_variant_get(of, path, "string"), F.lit("")))


def _number(path: str) -> Column:
    """The finite number at ``path``."""
    n = F.try_variant_get(_V, path, "double")
    return F.when(F.schema_of_variant(F.try_variant_get(_V, path, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)") & ~n.isin(float("inf"), float("-inf")) & ~F.isnan(n), n)


def texts(path: str) -> Column:
    """The strings of the array at ``path``."""
    each = F.coalesce(F.try_variant_get(_V, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(each, lambda x: _text("$", x)), lambda x: x.isNotNull())


def _fact(record_type: str, path: Column | str, fact_type: Column | str, when: Column, **data: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    values = [data.get(n, F.lit(None)).cast("string").alias(n) for n in FIELDS] + [data.get(n, F.lit(None)).cast("double").alias(n) for n in NUMBERS]
    return F.when(when, F.struct(F.lit(record_type).alias("record_type"), lit(path).alias("field_path"), lit(fact_type).alias("fact_type"), *values))


def _mention(path: str, fact_type: str, kind: str, value: Column, when: Column | None = None, **more: Column) -> Column:
    return _fact("entity_mention", path, fact_type, value.isNotNull() if when is None else when & value.isNotNull(), mention_kind=F.lit(kind), observed=value, **more)


def _relation(path, fact_type: str, value: Column, subject: Column, kind: Column | str | None = None, when: Column | None = None) -> Column:
    return _fact("relationship_mention", path, fact_type, value.isNotNull() if when is None else when, relationship_type=F.lit(fact_type) if kind is None else kind, subject=subject, observed=value)


def _attribute(path: str, fact_type: str, value: Column, subject: Column | None = None, name: str | None = None) -> Column:
    return _fact("attribute_mention", path, fact_type, value.isNotNull(), attribute=F.lit(name or path), observed=value, **({} if subject is None else {"subject": subject}))


def _each(values: Column, path: str, build) -> Column:
    return F.transform(values, lambda x, i: build(x, F.concat(F.lit(path + "["), i.cast("string"), F.lit("]"))))


def _rules() -> tuple[dict[str, list[Column]], dict[str, Column]]:
    """Arrays of facts of each item type, and the columns of content that they read, by name: each is read once for an item,
    however often facts use it."""
    one, read = F.array, {}

    def text(path: str, of: Column | None = None) -> Column:
        return _text(path, of) if of is not None else field(f"__text {path}", _text(path))

    def number(path: str) -> Column:
        return field(f"__number {path}", _number(path))

    def field(called: str, value: Column) -> Column:
        read[called] = value
        return F.col(f"`{called}`")

    name, number_, imei, plate, account, holder = text("$.name"), text("$.number"), text("$.imei"), text("$.plate"), text("$.account"), text("$.holderName")
    both = lambda *xs: F.array_contains(F.array(*[x.isNull() for x in xs]), True) == F.lit(False)
    person = lambda x, p: _fact("entity_mention", p, "person_named", F.lit(True), mention_kind=F.lit("person"), observed=x)
    rel = lambda t: lambda x, p: _relation(p, t, x, name)
    sub, reg, alias, primary = text("$.subscriberName"), text("$.registeredTo"), text("$.alias"), text("$.primaryName")
    ids = F.coalesce(F.try_variant_get(_V, "$.identifiers", "array<variant>"), F.array().cast("array<variant>"))
    links = F.coalesce(F.try_variant_get(_V, "$.relations", "array<variant>"), F.array().cast("array<variant>"))
    kind = F.when(text("$.subjectKind") == "organisation", "organisation").otherwise("person")
    licensed = both(text("$.registry"), text("$.registryRecordId"), name, text("$.license"), text("$.sourceUrl"))
    register = ["registry", "registryRecordId", "license", "licenseUrl", "sourceUrl", "retrievedAt", "observedAt", "jurisdiction", "status"]
    snake = {"registryRecordId": "registry_id", "licenseUrl": "license_url", "sourceUrl": "source_url", "retrievedAt": "retrieved_at", "observedAt": "observed_at"}
    public = [
        one(_fact("entity_mention", "name", F.concat(kind, F.lit("_named")), F.lit(True), mention_kind=kind, observed=name)),
        _each(ids, "identifiers", lambda x, p: _relation(p, "subject_has_identifier", F.concat_ws(":", text("$.scheme", x), text("$.value", x)), name, F.lit("has_identifier"))),
        _each(texts("$.aliases"), "aliases", lambda x, p: _relation(p, "alias_of", x, name)),
        _each(links, "relations", lambda x, p: _relation(p, "registry_relation", text("$.targetRegistryRecordId", x), text("$.registryRecordId"), text("$.predicate", x))),
        one(*[_attribute(f, f"public_record_{snake.get(f, f)}", text(f"$.{f}"), name, f"public_record_{snake.get(f, f)}") for f in register]),
    ]
    statement = texts("$.aboutNames")
    return {
        "fir": [_each(texts("$.accused"), "accused", person), one(_attribute("firNumber", "fir_number", text("$.firNumber"), name="fir_number"), _attribute("filedAt", "fir_filed_at", text("$.filedAt"), name="filed_at"), _mention("seizedVehicle.plate", "vehicle_named", "vehicle", text("$.seizedVehicle.plate")), _attribute("seizedVehicle.colour", "vehicle_colour", text("$.seizedVehicle.colour"), text("$.seizedVehicle.plate"), "colour"))],
        "suspect_record": [one(_mention("name", "person_named", "person", name), *[_attribute(a, f"suspect_{a}", text(f"$.{a}"), name) for a in ("role", "residence", "note")], _relation("linkedPhone", "has_phone", text("$.linkedPhone"), name)), *[_each(texts(f"$.{k}"), k, rel(t)) for k, t in (("phones", "has_phone"), ("accounts", "has_account"), ("vehicles", "has_vehicle"), ("knownAliases", "has_alias"))]],
        "alias_record": [one(_relation("alias", "alias_of", alias, primary, when=both(alias, primary)), _mention("primaryName.person", "person_named_as_alias_subject", "person", primary, alias.isNotNull()))],
        "phone_record": [one(_mention("number", "phone_named", "phone", number_), _relation("imei", "phone_bound_to_imei", imei, number_, when=both(number_, imei)), _relation("subscriberName", "phone_subscriber", sub, number_, when=both(number_, sub)), _mention("subscriberName.person", "person_named_as_subscriber", "person", sub, number_.isNotNull()))],
        "imei_record": [one(_mention("imei", "imei_named", "imei", imei), _relation("boundNumber", "imei_bound_to_phone", text("$.boundNumber"), imei, when=both(imei, text("$.boundNumber"))))],
        "vehicle_record": [one(_mention("plate", "vehicle_named", "vehicle", plate), _attribute("colour", "vehicle_colour", text("$.colour"), plate), _relation("registeredTo", "vehicle_registered_to", reg, plate, when=both(plate, reg)), _mention("registeredTo.person", "person_named_as_owner", "person", reg, plate.isNotNull()))],
        "bank_account_record": [one(_mention("account", "bank_account_named", "bank_account", account), _attribute("accountKind", "account_kind", text("$.accountKind"), account, "account_kind"), _relation("holderName", "account_held_by", holder, account, when=both(account, holder)), _mention("holderName.person", "person_named_as_holder", "person", holder, account.isNotNull()))],
        "location_record": [one(_mention("label", "location_named", "location", text("$.label"), attribute=text("$.locationType"), latitude=number("$.latitude"), longitude=number("$.longitude")))],
        "cdr_event": [one(_fact("event_mention", "$", "communication_event", both(text("$.callerNumber"), text("$.calleeNumber"), text("$.startedAt")), event_kind=F.lit("communication"), caller=text("$.callerNumber"), callee=text("$.calleeNumber"), started_at=text("$.startedAt"), duration=number("$.durationSeconds"), tower=text("$.cellTower")))],
        "financial_transaction_record": [one(_fact("event_mention", "$", "financial_transaction", both(text("$.txnRef"), text("$.fromAccount"), text("$.toAccount"), text("$.valueDate")) & number("$.amount").isNotNull(), event_kind=F.lit("financial_transaction"), txn_ref=text("$.txnRef"), from_account=text("$.fromAccount"), to_account=text("$.toAccount"), amount=number("$.amount"), value_date=text("$.valueDate"), currency=text("$.currency")))],
        "witness_statement": [one(_attribute("text", "statement_text", text("$.text"), text("$.statementId"))), _each(statement, "aboutNames", person)],
        "crime_event": [one(_fact("event_mention", "$", "crime_event", both(text("$.eventId"), text("$.occurredAt")), event_kind=F.lit("crime"), event_ref=text("$.eventId"), occurred_at=text("$.occurredAt"), observed=text("$.firNumber"), tower=text("$.nearestTower"), scene=text("$.sceneLabel")))],
        "public_record": [F.when(licensed, part) for part in public],
    }, read


def extract(items: DataFrame) -> DataFrame:
    """One row a fact: id, evidence_item_id, record_type, field_path, fact_type and the fields of ``FIELDS`` and ``NUMBERS``.

    The id follows from the item and the path. An unlicensed public record gives no facts. The types that occur are looked
    up first (one column is read); each then has a plan of its own, small enough to be compiled, over its own items.
    """
    kinds = sorted(str(r["item_type"]) for r in items.select("item_type").distinct().collect())  # as many as there are types
    if unknown := [k for k in kinds if k not in ITEM_TYPES]:
        raise ValueError(f"no extractor for item type {unknown[0]}")
    (rules, read), out = _rules(), None
    for kind in kinds or ITEM_TYPES[:1]:
        own = items.where(F.col("item_type") == kind).select(F.col("id").alias("evidence_item_id"), F.try_parse_json("content").alias(_V))
        own = own.select("*", *[c.alias(name) for name, c in read.items()])
        facts = F.flatten(F.filter(F.array(*rules[kind]), lambda p: p.isNotNull()))
        rows = own.select("evidence_item_id", F.inline(F.filter(facts, lambda x: x.isNotNull())))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("id", content_id("extracted_record", F.col("evidence_item_id"), F.col("field_path")))
