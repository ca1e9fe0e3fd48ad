"""Text and hash functions of reports: value policy, reason codes, scrubbing, CSV defusing and keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a value that a report shows, and characters of a reason code.
SHOWN, REASON = 120, 64
MODES = ("locations", "redacted", "raw")


def scrub(value: Column) -> Column:
    """Without control characters, but for tab and line ends."""
    return F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: scrubbed, ' before a leading = + - @, in quotes."""
    clean = scrub(F.coalesce(value.cast("string"), F.lit("")))
    safe = F.when(clean.rlike(r"\A[\s\x{FEFF}]*[=+\-@]"), F.concat(F.lit("'"), clean)).otherwise(clean)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def reason_code(reason: Column) -> Column:
    """What stands before the first colon; 'unspecified' if nothing does, cut at 64 characters."""
    code = F.substring_index(F.coalesce(reason, F.lit("")), ":", 1)
    return F.when(code == "", "unspecified").when(F.length(code) > REASON, F.concat(F.left(code, F.lit(REASON - 1)), F.lit("~"))).otherwise(code)


POOLED_REASONS = ("no-id", "check-character", "junk", "duplicate", "count")


def reason_bits(reason: Column) -> Column:
    """The reasons of a pooled finding as bits."""
    parts = F.split(F.coalesce(reason, F.lit("")), ";")
    out = F.lit(0)
    for k, name in enumerate(POOLED_REASONS):
        out = out + F.when(F.array_contains(parts, name), 1 << k).otherwise(0)
    return out


def issue(kind: Column) -> Column:
    return F.when(kind == "required", "Missing value").when(kind == "unique", "Duplicate value").when(kind == "choices", "No longer an allowed choice").otherwise("Wrong value")


def shown_value(value: Column, mode: str, identifier: Column | bool = False) -> Column:
    """What a report may show of a value: nothing, a note in its place, or the value cut at 120 code points."""
    identifier = F.lit(identifier) if isinstance(identifier, bool) else identifier
    if mode not in ("raw", "redacted"):
        return F.lit(None).cast("string")
    cut = F.when(F.length(value) > SHOWN, F.concat(F.left(value, F.lit(SHOWN)), F.lit("… (truncated)"))).otherwise(value)
    text = F.when(F.is_valid_utf8(value), cut).otherwise(F.concat(F.lit("["), F.octet_length(value).cast("string"), F.lit(" bytes, not valid text]")))
    text = F.when(value.isNull() | (value == ""), F.lit(None)).otherwise(text)
    return text if mode == "raw" else F.when(identifier & text.isNotNull(), F.lit("[identifier withheld]")).otherwise(text)


def strictest(*modes: str) -> str:
    """The mode that shows least; an unknown one counts as that which shows nothing."""
    return MODES[min((MODES.index(m) if m in MODES else 0) for m in modes)]


def reader_ceiling(export_level: int) -> str:
    return {1: "raw", 2: "redacted", 3: "redacted"}.get(export_level, "locations")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string or binary column, lower-case hexadecimal, by the JVM's hash."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


PURPOSES = ("record", "finding", "value", "unique")


def purpose_hash(key: bytes, purpose: str, project: int, data: Column) -> Column:
    """A keyed hash that differs by what it is for and by project."""
    if purpose not in PURPOSES or not key:
        raise ValueError(f"no key, or unknown purpose {purpose!r}")
    return hmac_sha256(key, F.concat(F.lit(f"v1\0{purpose}\0{project}\0"), data))


def identifier_hash(key: bytes | None, project: int, value: Column) -> Column:
    """A project's keyed hash of an identifier, as log rows have it. Without a key there is none: an unkeyed hash of a short id can be looked up."""
    return hmac_sha256(key + f"|{project}".encode(), F.coalesce(value, F.lit(""))) if key else F.lit(None).cast("string")
