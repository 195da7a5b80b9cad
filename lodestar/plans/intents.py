"""What a question asks for, decided on its words (expressions on columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for kinds of documents, German, then English ones that only bound a set.
KINDS = (
    "rechnungen dokument dokumente dateien schreiben verträge vertraege e-mail e-mails email emails mail mails beleg belege angebot angebote "
    "kontoauszüge kontoauszuege protokoll protokolle bescheid bescheide brief briefe vermerk vermerke anlage anlagen"
).split()
ENGLISH_KINDS = "invoice invoices document documents file files receipt receipts offer offers statement statements minute minutes".split()
# Words that ask for all, that ask for a number, and that stand before a list.
ALL, NUMBER = "alle saemtliche sämtliche vollstaendige vollständige".split(), "zaehle zähle anzahl".split()
LIST = "liste uebersicht übersicht".split()
NEAR = 80  # characters between the number word and the kind
# Extensions of complete file names.
EXTENSIONS = "pdf odt ods odp doc docx xls xlsx ppt pptx rtf txt csv eml msg jpg jpeg png tif tiff gif webp zip 7z rar xml json yaml yml".split()
WORD = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"


def _set(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _places(words: Column, wanted: list[str]) -> Column:
    """The positions of the wanted words."""
    return F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(_set(wanted), w), i)), lambda i: i.isNotNull())


def _between(words: Column, a: Column, b: Column) -> Column:
    """Characters from the end of word a to the start of word b, single spaces taken."""
    return F.length(F.array_join(F.slice(words, a + 2, b - a - 1), " ")) + F.when(b - a > 1, 2).otherwise(1)


def words_of(question: Column) -> Column:
    return F.regexp_extract_all(F.lower(question), F.lit(WORD), F.lit(0))


def exhaustive(question: Column) -> Column:
    """Asks for all of a kind of document, for their number, or for a complete list."""
    w = words_of(question)
    kinds = _places(w, KINDS)
    last = F.coalesce(F.array_max(kinds), F.lit(-1))
    wants_all = F.coalesce(F.array_min(_places(w, ALL)) < last, F.lit(False))
    how_many = F.filter(F.transform(w, lambda x, i: F.when((x == "viele") & (F.get(w, i - 1) == "wie"), i)), lambda i: i.isNotNull())
    counted = F.exists(F.concat(how_many, _places(w, NUMBER)), lambda a: F.exists(kinds, lambda b: (b > a) & (_between(w, a, b) <= NEAR)))
    listed = F.exists(_places(w, ALL[3:]), lambda a: F.coalesce(F.array_contains(_set(LIST), F.get(w, a + 1)), F.lit(False)))
    return wants_all | counted | listed


def bounded(question: Column) -> Column:
    """A kind of document together with a year, date or identifier, without asking for all."""
    fixed = question.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])") | question.rlike(r"\b[A-Z]{2,}[-/][0-9]{2,}")
    return F.arrays_overlap(words_of(question), _set(KINDS + ENGLISH_KINDS)) & fixed & ~exhaustive(question)


def strict(query: Column) -> Column:
    """Two mandatory words or phrases at least."""
    signs = F.filter(F.regexp_extract_all(query, F.lit(r'\+?"[^"\r\n]+"|\S+'), F.lit(0)), lambda t: t.rlike(r'^\+("|[\p{L}\p{N}_])'))
    return F.size(signs) >= 2


def file_name(question: Column) -> Column:
    """The first name with a known extension that the question spells out, quotes and end marks taken off, else empty."""
    bare = F.transform(F.split(question, r"[\s\"'<>|]+"), lambda t: F.regexp_replace(t, "[,;:!?]+$", ""))
    named = F.filter(bare, lambda t: F.contains(t, F.lit(".")) & ~t.startswith(".") & F.array_contains(_set(EXTENSIONS), F.lower(F.substring_index(t, ".", -1))))
    return F.coalesce(F.get(named, F.lit(0)), F.lit(""))


def navigation(question: Column) -> Column:
    """Whether nothing but words of looking for a file is left beside the file's name."""
    # Words of requests for one file.
    ask = "öffne oeffne zeige zeig finde suche such open show find bitte please mir me die der das the datei file dokument document nach for wo where ist is".split()
    name = file_name(question)
    rest = words_of(F.replace(question, name, F.lit(" ")))
    return (name != "") & (F.size(F.array_except(rest, _set(ask))) == 0)
