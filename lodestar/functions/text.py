"""Text normalisation and query parsing as column expressions; Arrow UDFs where case folding or Unicode forms need Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.types import NUMBER, TEXT

QUOTES = "„“”«»‚‘’"
# Fillers that searching drops.
STOPWORDS = ("the", "of", "and", "to", "in", "a", "is", "der", "die", "das", "und", "le", "la", "les", "de", "el", "los")


@F.pandas_udf(TEXT)
def folded_name(names: pd.Series) -> pd.Series:
    """Compatibility form, case folded, everything but letters and digits a space."""
    return names.map(lambda n: None if n is None else re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", n).casefold()).strip())


@F.pandas_udf(TEXT)
def predicate_name(values: pd.Series) -> pd.Series:
    """ASCII capitals joined by underscores, 64 at most."""
    plain = lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode()
    return values.map(lambda v: None if v is None else re.sub(r"[^A-Z0-9]+", "_", plain(v).upper()).strip("_")[:64])


def straight_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES, '""""' + '"' + "'''")


def comparable(text: Column) -> Column:
    """For duplicate tests: no tags, line-end hyphens joined, punctuation and case gone."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    out = F.regexp_replace(out, r"([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])", "$1$2")
    return F.trim(F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}_]+", " "))


def chunkable(text: Column) -> Column:
    """Line ends unified, blanks collapsed, at most one empty line in a row."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"))


def search_terms(text: Column) -> Column:
    """Distinct words of two letters or more that aren't stop words, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS)))


def plain_query(text: Column) -> Column:
    """A query without its Boolean signs, quotes and brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(^|\s)[+-]", "$1"), '["()]', " "), r"\s+", " "))


def unwrap_groups(text: Column) -> Column:
    """+(word) and +("a phrase") without their brackets."""
    return F.regexp_replace(text, r'([+-])\(\s*("[^"]+"|[\p{L}\p{N}_./-]+)\s*\)', "$1$2")


def phone_key(value: Column) -> Column:
    """Digits, and the plus sign in front if there is one."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.trim(value).startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)


def email_key(value: Column) -> Column:
    return F.lower(F.trim(value))


LEGAL_FORMS = r"\b(gmbh|ag|kg|ug|eg|ev|e v|inc|ltd|llc|co)\b"


def organisation_key(name: Column) -> Column:
    """Lower case, abbreviations of legal forms spelled one way, punctuation gone."""
    out = F.lower(name)
    for long, short in ((r"unternehmergesellschaft(\s*\(haftungsbeschränkt\))?", "ug"), (r"eingetragene genossenschaft|e\.\s?g\.", "eg"), (r"eingetragener verein|e\.\s?v\.", "ev"), (r"\bincorporated\b", "inc"), (r"\blimited\b", "ltd")):
        out = F.regexp_replace(out, long, short)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), " +", " "))


def organisation_core(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(organisation_key(name), LEGAL_FORMS, " "), " +", " "))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """A version-5 UUID from SHA-1, in native expressions."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def person_aliases(first: Column, last: Column) -> Column:
    """Array of (value, kind, weight): full, reversed, comma, initial and family name alone."""
    one = lambda v, k, w: F.struct(v.alias("value"), F.lit(k).alias("kind"), F.lit(w).alias("weight"))
    return F.array(
        one(F.concat_ws(" ", first, last), "full", 1.0),
        one(F.concat_ws(" ", last, first), "reversed", 0.95),
        one(F.concat(last, F.lit(", "), first), "comma", 0.95),
        one(F.concat(F.substring(first, 1, 1), F.lit(". "), last), "initial", 0.7),
        one(last, "family", 0.4),
    )


def middle_compatible(a: Column, b: Column) -> Column:
    """Same first and last word in names of two words or more."""
    x, y = F.split(a, " "), F.split(b, " ")
    return (F.size(x) >= 2) & (F.size(y) >= 2) & (x[0] == y[0]) & (F.element_at(x, -1) == F.element_at(y, -1))


@F.pandas_udf(NUMBER)
def indel_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """100 * 2 * LCS / (length + length), by bit-parallel longest common subsequence."""
    return pd.Series([indel(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def indel(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    state = full = (1 << len(a)) - 1
    for c in b:
        u = state & masks.get(c, 0)
        state = (state + u | state - u) & full
    return 200.0 * (len(a) - state.bit_count()) / (len(a) + len(b))


def json_payload(text: Column) -> Column:
    """What stands from the first opening to the last closing brace."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def stable_id(prefix: str, *parts: Column) -> Column:
    """The prefix and 24 hex digits of the hash of the parts, joined by a zero byte."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24))
