"""Public labels, plan names, fingerprints, tokens and sealed texts as column expressions."""

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from talliard.functions.metrics import compact

# What counts as white space and as a control in a label, and how long one may be.
BLANK = r"[\t\n\x0B\f\r    -     　﻿]+"
CONTROL = r"[\x00-\x08\x0E-\x1F\x7F-\x9F‪-‮⁦-⁩�]"
MAX_LABEL = 48
RESEND_SECONDS = 300
CODEX_PLANS = ["Pro", "Plus", "Team", "Business", "Enterprise"]


def clean_label(text: Column) -> Column:
    """Without controls, runs of white space as one blank, at most 48 characters."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), BLANK, " "))
    return F.coalesce(F.rtrim(F.substring(plain, 1, MAX_LABEL)), F.lit(""))


def clean_country(text: Column) -> Column:
    code = F.upper(F.btrim(text))
    return F.when(code.rlike("^[A-Z]{2}$"), code).otherwise("")


def truncate_utf8(text: Column, most: int) -> Column:
    """At most so many bytes, cut between characters."""
    raw = F.encode(text, "UTF-8")
    inside = lambda back: F.hex(F.substring(raw, most + 1 - back, 1)).rlike("^[89AB]")
    back = F.when(~inside(0), 0)
    for k in (1, 2):
        back = back.when(~inside(k), k)
    cut = raw.substr(F.lit(1), F.lit(most) - back.otherwise(3))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(cut, "UTF-8"))


def count(n: Column) -> Column:
    """Grouped below 10,000, else as compact."""
    return F.when(F.abs(n) < 10_000, F.format_number(F.floor(n + 0.5), 0)).otherwise(compact(n))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(count(n), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def usd(value: Column) -> Column:
    """$1,234 from a hundred on, else $12.30, <$0.01, $0; a dash for none."""
    cents = F.floor(value * 100 + 0.5).cast("bigint")
    small = F.concat(F.lit("$"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(value.isNull(), "—").when(value >= 100, F.concat(F.lit("$"), F.format_number(F.floor(value + 0.5), 0))).when(value >= 0.01, small).when(value > 0, "<$0.01").otherwise("$0")


def plain_name(text: Column) -> Column:
    """A name that is no address, of one line and at most 80 bytes; else empty."""
    name = F.btrim(text)
    return F.when(name.rlike(r"[@\r\n]") | (F.octet_length(name) > 80), "").otherwise(F.coalesce(name, F.lit("")))


def plan_name(plan: Column) -> Column:
    """Codes of tiers (default_...) name no plan."""
    name = F.btrim(F.coalesce(plan, F.lit("")))
    return F.when(F.lower(name).startswith("default_"), "").otherwise(name)


def codex_plan(plan: Column) -> Column:
    name, known = F.lower(F.btrim(plan)), F.lit(None).cast("string")
    for p in CODEX_PLANS:
        known = F.when(name == p.lower(), p).otherwise(known)
    return F.coalesce(known, plain_name(plan))


def tier_plan(tier: Column) -> Column:
    """The plan that a tier's code names."""
    has = lambda part: F.contains(tier, F.lit(part))
    return F.when(has("max_20x"), "Max (20x)").when(has("max_5x"), "Max (5x)").when(has("_max"), "Max").when(has("pro"), "Pro").when(tier.startswith("default_"), "").otherwise(plain_name(tier))


def organisation_plan(kind: Column, seat: Column) -> Column:
    """The plan that an organisation's type names, with its seat."""
    kind, seat, plan = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(seat, F.lit(""))), F.lit(None).cast("string")
    for name in ("Pro", "Max", "Team", "Enterprise"):
        plan = F.when(F.contains(kind, F.lit(name.lower())), name).otherwise(plan)
    extra = F.when(F.contains(seat, F.lit("premium")), " (Premium)").when(F.contains(seat, F.lit("standard")), " (Standard)").otherwise("")
    return F.coalesce(F.concat(plan, extra), F.lit(""))


def plan_label(display: Column, tier: Column, kind: Column, seat: Column) -> Column:
    """The displayed name with the detail that tier or seat add to it; without one the tier's plan, else the organisation's."""
    name, first, second = plain_name(display), tier_plan(tier), organisation_plan(kind, seat)
    more = lambda p: F.startswith(F.lower(p), F.concat(F.lower(name), F.lit(" (")))
    return F.when(name == "", F.when(first != "", first).otherwise(second)).when(more(first), first).when(more(second), second).otherwise(name)


def key_fingerprint(key: bytes) -> Column:
    return F.lit(hashlib.sha256(key).hexdigest()[:16])


def fingerprint(*columns: str) -> Column:
    """16 hex digits of a row's content."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def sent_mark(content: Column, win: Column, observed_at: Column) -> Column:
    """What was sent: the content, with the day for plans and the second for meters, where it is known."""
    at = F.unix_seconds(observed_at)
    stamp = F.when(win == "plan", F.concat(F.lit("#d"), F.floor(at / 86400).cast("string"))).otherwise(F.concat(F.lit("@"), at.cast("string")))
    return F.concat(content, F.coalesce(stamp, F.lit("")))


def should_resend(before: Column, after: Column) -> Column:
    """Other content, or a meter read five minutes later."""
    name = lambda mark: F.regexp_extract(mark, r"(?s)^(.*?)(?:@\d+)?$", 1)
    at = lambda mark: F.nullif(F.regexp_extract(mark, r"@(\d+)$", 1), F.lit("")).cast("bigint")
    changed = F.when(before == after, False).when(name(before) != name(after), True).when(at(after).isNull(), False)
    return changed.when(at(before).isNull(), True).otherwise(at(after) - at(before) >= RESEND_SECONDS)


def token_claim(token: Column, claim: str) -> Column:
    """A claim of a JSON web token's payload, null where it has none; the signature is not looked at."""
    body = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.get_json_object(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), f"$.{claim}")


def sealed(text: Column, key: bytes, bound_to: Column) -> Column:
    """AES-GCM in base64: nonce, ciphertext and tag, bound to a row's id."""
    return F.base64(F.aes_encrypt(F.encode(text, "UTF-8"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), bound_to))


def opened(text: Column, key: bytes, bound_to: Column) -> Column:
    """The text of sealed; null where key, id or text do not fit."""
    return F.decode(F.try_aes_decrypt(F.unbase64(text), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), bound_to), "UTF-8")


def axis_step(peak: Column) -> Column:
    """The least step of 1, 2, 2.5, 4 or 5 times a power of ten that reaches the peak in at most four; 1 without a peak."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(peak / 4)))
    steps = F.array(*(power * (m * p) for p in (1, 10) for m in (1.0, 2.0, 2.5, 4.0, 5.0)))
    return F.when(peak <= 0, F.lit(1.0)).otherwise(F.array_min(F.filter(steps, lambda s: F.ceil(peak / s - 1e-9) <= 4)))
