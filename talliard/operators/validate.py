"""Validation: each row gets the first reason to reject it, or null; nothing is dropped here."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talliard.functions.labels import truncate_utf8
from talliard.operators.merge import MEASURES, RANK, acct_rank

# Sources with their providers, the forms of keys, and the greatest values accepted.
PROVIDER_OF = {
    "claude-code": "anthropic", "codex": "openai", "grok-cli": "xai", "cursor": "cursor", "gemini-cli": "google",
    "web-claude": "anthropic", "native-claude": "anthropic", "chat-claude": "anthropic", "web-chatgpt": "openai", "web-grok": "xai",
}
ORG_KINDS = ["team", "enterprise", "personal"]
HASHED = "_[0-9a-f]{16}$"
WORD = "^[a-z0-9_-]{1,32}$"
NAME = r"^[^@\r\n]{1,80}$"
EMAIL = r"^[^\s@]{1,64}@[^\s@]{1,80}$"
FIRST_DAY = "2015-01-01"
MOST = 10**13
MOST_PV = 10**6
MOST_BYTES = 256 * 1024
AHEAD_DAYS, RESET_DAYS = 2, 400
LABELLED = 3


def _first(*checks: tuple[str, Column]) -> Column:
    """The name of the first condition that holds; a null condition counts as failed.

    Of a list, as one nested choice of all checks is a method too large for the JVM to compile.
    """
    return F.get(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks))), F.lit(0))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _form(column: str, pattern: str) -> tuple[str, Column]:
    return column, (_text(column) != "") & ~_text(column).rlike(pattern)


def _longer(column: str, most: int) -> tuple[str, Column]:
    return column, F.length(_text(column)) > most


def _days(value: Column, now: str, ahead: int = AHEAD_DAYS) -> Column:
    return ~value.between(F.lit(FIRST_DAY).cast("timestamp"), F.expr(f"timestamp'{now}' + interval {ahead} days"))


def _origin() -> list[tuple[str, Column]]:
    pairs = F.create_map(*(F.lit(x) for pair in PROVIDER_OF.items() for x in pair))
    return [("id", ~F.col("id").rlike("^[0-9a-f]{32}$")), ("source", ~F.try_element_at(pairs, F.col("source")).eqNullSafe(F.col("provider")))]


def _account() -> list[tuple[str, Column]]:
    return [_form("acct", f"^a{HASHED}"), ("acct_q", ~_text("acct_q").isin("", "unknown", *RANK))]


def _common(now: str) -> list[tuple[str, Column]]:
    return [
        *_origin(), ("ts", _days(F.col("ts"), now)), ("tz_offset_min", ~F.coalesce("tz_offset_min", F.lit(0)).between(-840, 840)),
        *_account(), _form("session", f"^s{HASHED}"), _form("ws", f"^w{HASHED}"),
    ]


def _settled(rows: DataFrame) -> DataFrame:
    """No account, no quality."""
    return rows.withColumn("acct_q", F.when(_text("acct") == "", "unknown").otherwise(F.coalesce(F.nullif("acct_q", F.lit("")), F.lit("unknown"))))


def judged(usage: DataFrame, now: str) -> DataFrame:
    """usage with reason; cache_w1h at most cache_w (clamped tells where it was more), calls at least 1."""
    checks = [
        *_common(now), ("ts_q", ~_text("ts_q").isin("", "event", "session-start")), ("q", ~_text("q").isin("", "exact", "estimated")),
        ("pv", ~F.coalesce("pv", F.lit(1)).between(0, MOST_PV)), _longer("model", 200), *((m, ~F.coalesce(m, F.lit(0)).between(0, MOST)) for m in MEASURES),
    ]
    rows = _settled(usage.withColumn("reason", _first(*checks))).withColumn("clamped", F.coalesce(F.col("cache_w1h") > F.col("cache_w"), F.lit(False)))
    return rows.withColumn("cache_w1h", F.least("cache_w1h", "cache_w")).withColumn("calls", F.coalesce(F.nullif("calls", F.lit(0)), F.lit(1)))


def judged_activity(activity: DataFrame, now: str) -> DataFrame:
    return _settled(activity.withColumn("reason", _first(*_common(now)))).withColumn("has_usage", F.coalesce("has_usage", F.lit(False)))


def judged_prompts(prompts: DataFrame, now: str, most_bytes: int = MOST_BYTES, marker: str = "\n[... truncated]") -> DataFrame:
    """prompts with reason. Without acct_q a label means timeline, an account alone inferred; labels stay from bounded up; long texts are cut."""
    checks = [*_common(now), ("text", F.col("text").isNull()), _longer("label", 512), _longer("model", 200), _longer("workspace", 4096), _longer("machine", 200)]
    legacy = F.when(_text("acct_q") != "", F.col("acct_q")).when(_text("acct") == "", "unknown").when(_text("label") != "", "timeline").otherwise("inferred")
    rows = _settled(prompts.withColumn("reason", _first(*checks)).withColumn("acct_q", legacy))
    rows = rows.withColumn("label", F.when(acct_rank() >= LABELLED, _text("label")).otherwise(""))
    return rows.withColumn("text", F.when(F.octet_length("text") > most_bytes + 1024, F.concat(truncate_utf8(F.col("text"), most_bytes), F.lit(marker))).otherwise(F.col("text")))


def judged_limits(readings: DataFrame, now: str) -> DataFrame:
    """Quota readings with reason: percentages 0 to 100, resets within 400 days, a quota source only with the account it needs."""
    vouched = (_text("acct") != "") & (
        ((F.col("quota_source") == "account-api") & (_text("acct_q") == "recorded")) | ((F.col("quota_source") == "login-timeline") & (F.col("source") == "codex") & (_text("acct_q") == "timeline"))
    )
    checks = [
        *_origin(), ("win", ~F.col("win").rlike(WORD)), *_account(), _form("org", f"^a{HASHED}"), ("org_kind", ~_text("org_kind").isin("", *ORG_KINDS)),
        ("observed_at", _days(F.col("observed_at"), now)), ("used_percent", F.col("used_percent").isNotNull() & ~F.col("used_percent").between(0, 100)),
        ("resets_at", F.col("resets_at").isNotNull() & _days(F.col("resets_at"), now, RESET_DAYS)), *(_form(c, NAME) for c in ("plan", "scope", "name", "detail")),
        _form("label", EMAIL), _form("status", WORD), ("quota_source", F.col("quota_source").isNotNull() & ~vouched),
    ]
    return _settled(readings.withColumn("reason", _first(*checks)))


def judged_account_totals(totals: DataFrame, now: str) -> DataFrame:
    """A provider's totals by account and UTC day with reason; only one tool's totals count what events count."""
    day = F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd"))
    real = F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.coalesce(F.date_format(day, "yyyy-MM-dd") == F.col("date"), F.lit(False))
    late = F.col("observed_at") > F.expr(f"timestamp'{now}' + interval {AHEAD_DAYS} days")
    checks = [
        _origin()[0], ("source", (F.col("source") != "codex") | (F.col("provider") != "openai")), ("acct", ~_text("acct").rlike(f"^a{HASHED}")), ("acct_q", F.col("acct_q") != "recorded"),
        ("timezone", F.col("timezone") != "UTC"), ("date", ~real | _days(day, now)), ("observed_at", (F.col("observed_at") < day) | late), ("total_tokens", ~F.col("total_tokens").between(0, MOST)),
    ]
    return totals.withColumn("reason", _first(*checks))


def routed(usage: DataFrame, now: str) -> DataFrame:
    """judged usage with its route, accepted or rejected, in one pass; one bad row costs no other."""
    return judged(usage, now).withColumn("route", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))
