"""String and set similarity. All but Jaro-Winkler are native expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Writing systems and the code points that tell them.
SCRIPTS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x4FF), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)]
ROMAN = r"^(?=[ivxlcdm]+$)m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k in range(4) if k >= len(a) or k >= len(b) or a[k] != b[k]), 4)
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """With a common prefix of up to 4 at weight 0.1, whatever the Jaro value."""
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ngrams(x: Column, n: int = 3) -> Column:
    """Distinct n-grams of characters; a shorter string is padded with blanks."""
    padded = F.rpad(x, F.greatest(F.length(x), F.lit(n)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n))))


def trigram_dice(a: Column, b: Column) -> Column:
    x, y = ngrams(a), ngrams(b)
    return F.when(a == b, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Common elements over the smaller set's; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def ordered_prefix(a: Column, b: Column) -> Column:
    """Whether the shorter list is the start of the longer one, and not empty."""
    short, long = F.when(F.size(a) < F.size(b), a).otherwise(b), F.when(F.size(a) < F.size(b), b).otherwise(a)
    return (F.size(short) > 0) & (F.size(short) < F.size(long)) & (F.slice(long, 1, F.greatest(F.size(short), F.lit(1))) == short)


def acronym(words: Column) -> Column:
    """First letters of two words or more, else empty."""
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda t: F.left(t, F.lit(1))), "")).otherwise(F.lit(""))


def digit_runs(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"[0-9]+"), F.lit(0))


def roman_numerals(words: Column) -> Column:
    return F.filter(words, lambda t: t.rlike(ROMAN))


def sets_differ(a: Column, b: Column) -> Column:
    """Whether two sets differ; false if either is empty."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0))


def script_of(x: Column) -> Column:
    """The writing system of the first character that belongs to one."""
    first = F.regexp_extract(x, "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for _, a, b in SCRIPTS) + "]", 0)
    out = F.lit("unknown")
    for name, a, b in SCRIPTS:
        out = F.when(first.rlike(f"^[\\x{{{a:X}}}-\\x{{{b:X}}}]"), name).otherwise(out)
    return out


def weighted_jaccard(a: Column, b: Column, weight) -> Column:
    """Of two arrays, each element counting ``weight(element)``; 0 if either is empty."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, t: acc + weight(t))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(total(F.array_intersect(a, b)) / total(F.array_union(a, b)))


def max_shared(a: Column, b: Column, weight) -> Column:
    return F.coalesce(F.array_max(F.transform(F.array_intersect(a, b), weight)), F.lit(0.0))


def register(spark) -> None:
    """Make the function that SQL lacks callable from it."""
    spark.udf.register("jaro_winkler", jaro_winkler)
