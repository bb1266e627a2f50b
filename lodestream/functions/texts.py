"""Expressions on texts: hashes of content, keys, personal data, tags."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of personal data, in the order in which they are replaced.
PERSONAL = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"(?i)\b(?:https?://|www\.)\S+", "[url]"),
    (r"\+?\d[\d\s().-]{7,}\d", "[phone]"),
    (r"(?<![\w@])@\w{2,}", "[handle]"),
    (r"\b\d{6,}\b", "[number]"),
]
TAG = r"^[\p{L}\p{N}][\p{L}\p{N} '&-]{0,38}[\p{L}\p{N}]$"


def content_hash(*parts: Column) -> Column:
    """The SHA-256 of the parts, joined by |."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def explanation_key(domain: Column, reason: Column, seed: Column, item: Column) -> Column:
    """The first 12 bytes of the hash, in hex; a null prints as null."""
    parts = [F.coalesce(p.cast("string"), F.lit("null")) for p in (domain, reason, seed, item)]
    return F.substring(content_hash(*parts), 1, 24)


def pseudonym(text: Column, secret: bytes) -> Column:
    """The first 32 hex digits of the text's HMAC-SHA256 under the secret; null stays null."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in key)), text.cast("binary")), 256))
    return F.substring(F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in key)), inner), 256), 1, 32)


def scrubbed(text: Column) -> Column:
    for pattern, mark in PERSONAL:
        text = F.regexp_replace(text, pattern, F.lit(mark))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_tags(tags: Column, most: int) -> Column:
    """Trimmed lower-case tags that look like words, each once, in their order."""
    plain = F.transform(tags, lambda t: F.lower(F.trim(t)))
    fit = F.filter(plain, lambda t: t.rlike(TAG) & ~t.contains("://") & ~t.contains("@") & ~t.contains(".com"))
    return F.slice(F.array_distinct(fit), 1, most)


def clean_explanation(text: Column, most: int = 160) -> Column:
    """Blank runs become one space; null if too long or with a link or an address."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when((F.length(plain) <= most) & ~plain.rlike("https?://|www\\.|@"), plain)


def java_hash(text: Column) -> Column:
    """The 31-fold string hash in 32 bits with sign, as used for sampling by id."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    # beyond U+FFFF a character counts as two units of UTF-16
    high, low = lambda c: F.lit(0xD800) + F.shiftright(c - 0x10000, 10), lambda c: F.lit(0xDC00) + (c - 0x10000).bitwiseAND(F.lit(0x3FF))
    codes = F.flatten(F.transform(points, lambda c: F.when(c < 0x10000, F.array(c)).otherwise(F.array(high(c).cast("long"), low(c).cast("long")))))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31))
