"""Search specifications: cleaning, views and fingerprints (expressions on columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def clean_list(values: Column, most: int) -> Column:
    """White space collapsed, blanks dropped, each value once whatever its case, `most` at most."""
    tidy = F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: F.length(v) > 0)
    return F.slice(_once(tidy), 1, most)


def _once(values: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.aggregate(values, empty, lambda seen, v: F.when(F.exists(seen, lambda u: F.lower(u) == F.lower(v)), seen).otherwise(F.concat(seen, F.array(v))))


def fingerprint(*parts: Column) -> Column:
    """A digest of the parts as JSON lists, each sorted and lower-cased."""
    return F.sha2(F.to_json(F.array(*(F.array_sort(F.transform(p, F.lower)) for p in parts))), 256)


def overflow(total: Column, scanned: Column, authorized: Column, most: int, scan_limit: int) -> Column:
    """Why a complete answer isn't possible, or null."""
    return F.when(authorized > most, "authorized_overflow").when((total > scanned) & (scanned >= max(most + 1, scan_limit)), "scan_limit_reached")


def cited(answer: Column, n: Column) -> Column:
    """Numbers in brackets that name one of n results, each once."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,4})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= n))))


def file_probe(values: Column) -> Column:
    """Anchors as one strict query: words with a plus sign, several words as a phrase."""
    return F.array_join(F.transform(values, lambda v: F.when(F.contains(v, F.lit(" ")), F.concat(F.lit('+"'), v, F.lit('"'))).otherwise(F.concat(F.lit("+"), v))), " ")
