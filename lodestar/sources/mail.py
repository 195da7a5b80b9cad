"""Mail and contacts: raw messages, vCards and JSON sidecars as structured rows."""

from __future__ import annotations

import re
from email import message_from_string, policy

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.types import TEXT, TEXTS, struct

MESSAGE = struct(message_id=TEXT, in_reply_to=TEXTS, references=TEXTS, subject=TEXT, sender=TEXT, date=TEXT, body=TEXT)
CARD = struct(full_name=TEXT, emails=TEXTS, phones=TEXTS, organisation=TEXT)


def raw_messages(turns: DataFrame) -> DataFrame:
    """RFC-822 texts made of conversation turns; each answers the turn before it."""
    ref = lambda back: F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("."), (F.col("turn") - back).cast("string"), F.lit("@example.org>"))
    reply = F.when(F.col("turn") > 0, F.concat(F.lit("In-Reply-To: "), ref(1), F.lit("\n"))).otherwise("")
    raw = F.concat(F.lit("Message-ID: "), ref(0), F.lit("\n"), reply, F.lit("From: "), "role", F.lit("@example.org\nSubject: Thread "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", raw.alias("raw"))


def read_message(raw: str | None) -> dict:
    m = message_from_string(raw or "", policy=policy.compat32)
    ids = lambda name: re.findall(r"<[^<>\s]+>", m.get(name, "") or "")
    part = next((p for p in m.walk() if p.get_content_type() == "text/plain"), None)
    body = part.get_payload() if part is not None else ""
    return {"message_id": next(iter(ids("Message-ID")), None), "in_reply_to": ids("In-Reply-To"), "references": ids("References"), "subject": m.get("Subject"), "sender": m.get("From"), "date": m.get("Date"), "body": body if isinstance(body, str) else ""}


@F.pandas_udf(MESSAGE)
def read_messages(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_message(r) for r in raw], columns=["message_id", "in_reply_to", "references", "subject", "sender", "date", "body"])


def parsed(messages: DataFrame) -> DataFrame:
    key = lambda c: F.concat(F.lit("mail:"), F.regexp_extract(c, "^<([^@>]+)", 1))
    m = messages.select("conv_id", "turn", read_messages("raw").alias("m")).select("conv_id", "turn", "m.*")
    parent = F.coalesce(F.try_element_at("in_reply_to", F.lit(-1)), F.try_element_at("references", F.lit(-1)))
    return m.select("conv_id", "turn", key(F.col("message_id")).alias("message_key"), F.when(parent.isNotNull(), key(parent)).alias("parent"), "subject", "sender", F.length("body").alias("n_chars"))


def threads(messages: DataFrame) -> DataFrame:
    """Each message with its parent; placeholder where the parent isn't there."""
    each = messages.select("message_key", "parent").distinct()
    known = each.select(F.col("message_key").alias("parent"), F.lit(True).alias("known")).distinct()
    return each.join(known, "parent", "left").select("message_key", "parent", (F.col("parent").isNotNull() & F.col("known").isNull()).alias("placeholder"))


def read_card(text: str | None) -> dict:
    """One vCard; folded lines are joined, parameters skipped, lines without a colon ignored."""
    found: dict[str, list[str]] = {}
    for line in re.sub(r"\r?\n[ \t]", "", text or "").splitlines():
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.split(";")[0].split(".")[-1].upper(), []).append(value.strip())
    family = next(iter(found.get("N", [])), "").split(";")
    full = next(iter(found.get("FN", [])), "") or " ".join(x for x in (*family[1:2], *family[:1]) if x)
    return {"full_name": full, "emails": [e.lower() for e in found.get("EMAIL", [])], "phones": found.get("TEL", []), "organisation": next(iter(found.get("ORG", [])), None)}


@F.pandas_udf(CARD)
def read_cards(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_card(t) for t in texts], columns=["full_name", "emails", "phones", "organisation"])


def cards(customers: DataFrame) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("BEGIN:VCARD\nFN:"), "c_name", F.lit("\nEMAIL;TYPE=work:C"), key, F.lit("@exam\n ple.com\nTEL:+49"), key, F.lit("\nbroken line\nEND:VCARD"))
    return customers.select("c_custkey", read_cards(text).alias("c")).select("c_custkey", "c.full_name", "c.emails", "c.phones")


SIDECAR = "struct<schema:string,message_id:string,references:array<string>,subject:string>"


def sidecars(turns: DataFrame) -> DataFrame:
    """JSON metadata of messages; references may be a list or one value."""
    ref = lambda back: F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("."), (F.col("turn") - back).cast("string"), F.lit("@example.org>"))
    several = F.to_json(F.struct(F.lit("mail-1").alias("schema"), ref(0).alias("message_id"), F.array(ref(1)).alias("references")))
    none = F.to_json(F.struct(F.lit("mail-1").alias("schema"), ref(0).alias("message_id")))
    read = turns.select("conv_id", "turn", F.from_json(F.when(F.col("turn") > 0, several).otherwise(none), SIDECAR).alias("s"))
    return read.select(
        "conv_id",
        (F.col("s.schema") == "mail-1").alias("known"),
        "s.message_id",
        F.size(F.coalesce("s.references", F.array().cast("array<string>"))).alias("n_references"),
        F.when(F.size(F.coalesce("s.references", F.array().cast("array<string>"))) == 0, "thread").otherwise("reply").alias("representation"),
    )
