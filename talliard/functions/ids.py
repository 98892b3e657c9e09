"""Ids, keyed hashes and dates as column expressions."""

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_id(kind: str, provider: Column, source: Column, native_key: Column) -> Column:
    """32 hex digits that the event's content determines."""
    return F.substring(F.sha2(F.concat(F.lit(f"v1|{kind}|"), provider, F.lit("|"), source, F.lit("|"), native_key), 256), 1, 32)


def session_key(provider: Column, session: Column) -> Column:
    """s_ and 16 hex digits; empty for an empty session."""
    return F.when(F.coalesce(session, F.lit("")) == "", "").otherwise(F.concat(F.lit("s_"), F.substring(F.sha2(F.concat(provider, F.lit("|"), session), 256), 1, 16)))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex by two digests, with the key's pads made on the driver."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def account_hash(key: bytes, provider: Column, account: Column) -> Column:
    return F.concat(F.lit("a_"), F.substring(hmac_sha256(key, F.concat(provider, F.lit("|"), account)), 1, 16))


def workspace_tag(key: bytes, path: Column) -> Column:
    return F.concat(F.lit("w_"), F.substring(hmac_sha256(key, F.concat(F.lit("workspace|"), path)), 1, 16))


def local_date(ts: Column, offset_min: Column) -> Column:
    """The day on the event's own clock."""
    return F.date_format(F.timestamp_add("MINUTE", offset_min, ts), "yyyy-MM-dd")


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def utc_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def epoch(value: Column, millis_from: int) -> Column:
    """A timestamp from seconds or milliseconds; numbers from millis_from on are milliseconds."""
    return F.when(value >= millis_from, F.timestamp_millis(value)).otherwise(F.timestamp_seconds(value))
