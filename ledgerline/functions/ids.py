"""Identifiers and hashes that depend on content alone, as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(content: Column) -> Column:
    """The first 16 hex digits of the bytes' SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)


def joined_id(*parts: Column) -> Column:
    """As content_id(), of the parts joined by bars; null parts count as empty."""
    return content_id(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5)."""
    space = F.unhex(F.lit(uuid.UUID(namespace).hex))
    h = F.lower(F.substring(F.sha1(F.concat(space, F.encode(name, "UTF-8"))), 1, 32))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def rank_key(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def share_of(salt: str, key: Column) -> Column:
    """A number from 0 up to 1 that a key always gets: 32 bits of SHA-256."""
    return F.conv(F.substring(rank_key(salt, key), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def split_of(day: Column, salt: str, test_share: float = 0.2) -> Column:
    return F.when(F.coalesce(day, F.lit("")) == "", "unknown").when(share_of(salt, day) < test_share, "test").otherwise("train")


def field_id(page: Column, region: Column, name: Column, row: Column) -> Column:
    return F.concat_ws(":", page, region, name, row.cast("string"))


def page_parts(target: Column) -> Column:
    """(document_id, page_no) of "<document>-p<n>"; a bare document has a null page."""
    page = F.regexp_extract(target, "-p([0-9]+)$", 1)
    return F.struct(F.regexp_replace(target, "-p[0-9]+$", "").alias("document_id"), F.when(page != "", page.cast("int")).alias("page_no"))


def equipment_ref(equipment_id: Column, name: Column) -> Column:
    """What tells machines apart: the id, else the written name."""
    return F.when(F.coalesce(equipment_id, F.lit("")) != "", F.concat(F.lit("id:"), equipment_id)).when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("name:"), name))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of a row: values by type and length, so that null, empty, 1 and '1' differ."""
    parts = []
    for c in columns:
        t = c.cast("string")
        parts.append(F.when(c.isNull(), "~").otherwise(F.concat(F.typeof(c), F.lit(":"), F.char_length(t).cast("string"), F.lit(":"), t)))
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)
