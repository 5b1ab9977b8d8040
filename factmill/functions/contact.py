"""Phones, addresses, identifiers and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factmill.functions.text import identity, left_units, name_identity, plain_text

EXTENSION = r"(?i)(?:ext\.?|extension|x)\s*(\d{1,8})\s*$"
# Words of an address and their short forms.
ADDRESS_WORDS = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "road": "rd", "drive": "dr", "lane": "ln", "highway": "hwy",
    "suite": "ste", "apartment": "apt", "north": "n", "south": "s", "east": "e", "west": "w",
}


def phone_parts(c: Column) -> Column:
    """digits (a leading 1 of eleven dropped) and extension (null without)."""
    extension = F.nullif(F.regexp_extract(c, EXTENSION, 1), F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(c, EXTENSION, ""), r"\D", "")
    local = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.struct(local.alias("digits"), extension.alias("extension"))


def phone_key(c: Column) -> Column:
    p = phone_parts(c)
    return F.concat(p["digits"], F.coalesce(F.concat(F.lit("x"), p["extension"]), F.lit("")))


def address_parts(c: Column) -> Column:
    """canonical and zip (null without)."""
    short = F.create_map(*(F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair))
    canonical = F.array_join(F.transform(F.split(plain_text(c), " "), lambda t: F.coalesce(short[t], t)), " ")
    return F.struct(canonical.alias("canonical"), F.nullif(F.substring(F.regexp_extract(canonical, r"\b(\d{5})(?: \d{4})?\b", 0), 1, 5), F.lit("")).alias("zip"))


def format_location(line1: Column, line2: Column, city: Column, state: Column, zip_: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (line1, line2, city, state, zip_)))


def requested_npi(npi: Column, provider_id: Column) -> Column:
    return F.coalesce(F.nullif(npi, F.lit("")), F.when(provider_id.rlike(r"^\d{10}$"), provider_id))


def request_key(ordinal: Column, npi: Column, provider_id: Column, name: Column) -> Column:
    named = F.coalesce(F.nullif(name_identity(name), F.lit("")), F.lit("provider"))
    by = F.coalesce(F.concat(F.lit("npi:"), F.nullif(npi, F.lit(""))), F.concat(F.lit("providerId:"), F.nullif(provider_id, F.lit(""))), F.concat(F.lit("name:"), named))
    return left_units(F.concat(ordinal.cast("string"), F.lit(":"), by), 320)


def aggregation_key(*dims: Column) -> Column:
    """SHA-256 of the dimensions as a compact JSON array."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(d.cast("string"), F.lit("")) for d in dims))), 256)


def owner_scope(owner: Column) -> Column:
    """Hash of an owner; an owner that is null or blank fails the job."""
    name = identity(owner)
    return F.sha2(F.when(name != "", name).otherwise(F.raise_error(F.lit("a job needs an owner")).cast("string")), 256)


def job_key(prefix: str, owner: Column, request_id: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), owner_scope(owner), request_id)


def hmac_sha256(c: Column, key: str) -> Column:
    """HMAC of a column under a literal key, as two hashes over fixed pads."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(c, "UTF-8")), 256))), 256)
