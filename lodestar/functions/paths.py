"""Paths: parts, containment, names and origins (expressions on columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the archives, their scopes and the short forms of those.
MAIL_ROOT, CHAT_ROOT, WEB_ROOT = "Archive/Mail", "Archive/Chats", "Archive/Web"
SCOPE_ALIASES = {"files": "documents", "mail": "mailarchive", "chat": "chatarchive", "web": "chatarchive", "webarchive": "chatarchive"}
SCOPE_ORIGINS = {"documents": ("internal",), "mailarchive": ("mail_archive",), "chatarchive": ("chat_archive", "web_archive")}


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The suffix in lower case, without its dot; empty for hidden files without another dot."""
    return F.lower(F.regexp_extract(filename(path), r"^.+\.([^.]+)$", 1))


def is_under(path: Column, root: str) -> Column:
    """Equal to the root or below it, whatever the case."""
    low, top = F.lower(path), root.strip("/").lower()
    return (low == top) | low.startswith(top + "/")


def is_machine_file(path: Column) -> Column:
    return filename(path).startswith(".")


def in_scope(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Below any included root (all, if none are given) and below no excluded one."""
    any_of = lambda roots: F.array_contains(F.array(*(is_under(path, r) for r in roots)), True)
    keep = any_of(include) if include else F.lit(True)
    return keep & ~any_of(exclude) if exclude else keep


def origin(path: Column, registered: Column | None = None) -> Column:
    """A registered origin first, then hidden names, then the archive roots, else internal."""
    by_path = (
        F.when(is_machine_file(path), "machine_metadata")
        .when(is_under(path, WEB_ROOT), "web_archive")
        .when(is_under(path, CHAT_ROOT), "chat_archive")
        .when(is_under(path, MAIL_ROOT), "mail_archive")
        .otherwise("internal")
    )
    return by_path if registered is None else F.coalesce(registered, by_path)


def normal_scopes(values: list[str] | None) -> list[str] | None:
    """Known scope names without aliases; None if nothing is chosen; unknown names raise ValueError."""
    if values is None:
        return None
    named = [v.strip().lower() for v in values if v and v.strip()]
    found = list(dict.fromkeys(SCOPE_ALIASES.get(v, v) for v in named))
    if unknown := [v for v in found if v not in SCOPE_ORIGINS]:
        raise ValueError(f"unknown scopes: {', '.join(unknown)}")
    return found or None


def scope_allows(path: Column, source_origin: Column, scopes: list[str] | None) -> Column:
    """Hidden files never; without scopes only internal documents; else the origins of the scopes."""
    chosen = normal_scopes(scopes) or ["documents"]
    return ~is_machine_file(path) & source_origin.isin(*(o for s in chosen for o in SCOPE_ORIGINS[s]))
