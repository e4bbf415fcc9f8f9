"""Content-addressed ids: equal parts give equal ids, whatever the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 16


def content_id(kind: str, *parts: Column) -> Column:
    """``kind_`` and the first digits of the SHA-256 of the parts, each trimmed and lower-cased; a null part is empty."""
    joined = F.concat_ws("\x01", *[F.coalesce(F.lower(F.trim(p.cast("string"))), F.lit("")) for p in parts])
    return F.concat(F.lit(kind + "_"), F.left(F.sha2(joined, 256), F.lit(DIGITS)))


def is_id_of(kind: str, x: Column) -> Column:
    return x.startswith(kind + "_")


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of an object with its fields in order of name, nulls written out."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of ``canonical_json``."""
    return F.sha2(canonical_json(fields), 256)
