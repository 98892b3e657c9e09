"""Readings of plan windows in logs: the last of each rollout, and those of a log in which many processes write."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talliard.functions import ids
from talliard.functions.metrics import window_of_minutes
from talliard.operators.accounts import by_probe
from talliard.sources.logs import get, number, present, text

# Plan names as shown, the only period that is read, and what a shared one is called.
PLANS = {"pro": "Pro", "plus": "Plus", "team": "Team", "business": "Business", "enterprise": "Enterprise"}
WEEKLY = "USAGE_PERIOD_TYPE_WEEKLY"
SHARED = "Shared across Grok products"
MOST_TOKENS = 10**13
SOURCES = {"anthropic": "claude-code", "openai": "codex", "xai": "grok-cli", "cursor": "cursor", "google": "gemini-cli"}
KINDS, NAMES, STATUSES = ["personal", "team", "enterprise"], ["week", "session", "plan", "extra"], ["ok", "full", "disabled"]
MOST_QUOTA = 1 << 20
#: From here on a time is in milliseconds.
MILLIS = 1_000_000_000_000
_OUT = ["provider", "source", "acct", "acct_q", "plan", "window", "scope", "detail", "used_percent", "resets_at", "observed_at", "quota_source"]


def plan_name(c: Column) -> Column:
    short = F.lower(F.trim(c))
    return F.coalesce(*(F.when(short == k, v) for k, v in PLANS.items()), F.trim(c), F.lit(""))


def _moment(n: Column) -> Column:
    return F.when(n >= MILLIS, F.timestamp_millis(n.cast("long"))).when(n > 0, F.timestamp_seconds(n))


def codex_windows(rows: DataFrame, probes: DataFrame, home: str = "", quota_file: str | None = None) -> DataFrame:
    """Readings of rollouts (file, at, v): the last line with rate limits tells two windows.

    Whose they are follows the observed logins (provider, home, from_ts, to_ts, acct) at that time and nothing weaker; only in quota_file, an
    answer about the account itself, the file's first line names the owner. A second window of the same name says so in its scope.
    """
    ts = F.try_to_timestamp(get("$.timestamp"))
    limits = rows.where(present("$.payload.rate_limits") & ts.isNotNull()).groupBy("file").agg(F.max_by(F.struct(ts.alias("ts"), get("$.payload.rate_limits", "variant").alias("v")), "at").alias("r")).select("file", "r.*")
    owner = rows.where(text("$.type") == "session_meta").groupBy("file").agg(F.min_by(text("$.payload.creator_account_id"), "at").alias("owner"))
    logins = by_probe(limits.select(F.col("file").alias("id"), F.lit("openai").alias("provider"), F.lit(home).alias("home"), "ts"), probes).where("acct_q = 'timeline'")
    known = limits.join(logins.select(F.col("id").alias("file"), F.col("acct").alias("seen")), "file", "left").join(owner, "file", "left")
    own = F.col("file") == quota_file if quota_file else F.lit(False)
    known = known.withColumn("acct", F.when(own, F.coalesce("owner", F.lit(""))).otherwise(F.coalesce("seen", F.lit("")))).where("acct <> ''")
    both = known.withColumn("first", window_of_minutes(number("$.primary.window_minutes")))
    both = both.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("which"), get(f"$.{k}", "variant").alias("w")) for k in ("primary", "secondary")))).alias("e")).where(present("$", "e.w")).where(number("$.window_minutes", "e.w") > 0)
    window = window_of_minutes(number("$.window_minutes", "e.w"))
    reset = get("$.resets_in_seconds", "double", "e.w")
    name = F.coalesce(F.trim(get("$.limit_name")), F.lit(""))
    scope = F.when((F.col("e.which") == "secondary") & (F.col("window") == F.col("first")), F.trim(F.concat(name, F.lit(" secondary")))).otherwise(name)
    found = both.withColumn("window", window).withColumns({
        "provider": F.lit("openai"), "source": F.lit("codex"), "acct_q": F.when(own, "recorded").otherwise("timeline"), "plan": plan_name(get("$.plan_type")), "scope": scope, "detail": F.lit(""),
        "used_percent": F.coalesce(get("$.used_percent", "double", "e.w"), F.lit(0.0)), "observed_at": F.col("ts"), "quota_source": F.when(own, "account-api").otherwise("login-timeline"),
        "resets_at": F.coalesce(_moment(get("$.resets_at", "double", "e.w")), F.when(reset >= 0, F.timestamp_micros(F.unix_micros("ts") + (reset * 1_000_000).cast("long")))),
    })
    return found.select("file", *_OUT)


def grok_billing(rows: DataFrame) -> DataFrame:
    """Readings of a log (file, at, v) of many processes: a weekly period belongs to the user that its process said last.

    A process's user is carried from line to line until a line resets it: a start, as numbers are used again, a login by hand, or a check
    without a user. Each account's newest reading remains.
    """
    lines = rows.select("file", "at", F.try_to_timestamp(get("$.ts")).alias("ts"), F.trim(get("$.pid")).alias("pid"), text("$.msg").alias("msg"), get("$.ctx", "variant").alias("ctx"))
    lines = lines.where("ts is not null and pid <> ''")
    user, method = text("$.user_id", "ctx"), text("$.method", "ctx")
    check = F.col("msg") == "auth init user_info check"
    reset = (F.col("msg") == "agent initialized") | ((F.col("msg") == "auth started") & ~method.isin("", "cached_token")) | (check & (user == ""))
    said = F.when(check & (user != ""), F.struct(user.alias("acct"), F.col("ts").alias("since"))).when(reset, F.struct(F.lit("").alias("acct"), F.col("ts").alias("since")))
    w = Window.partitionBy("file", "pid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    known = lines.withColumn("who", F.last(said, True).over(w)).where("msg = 'billing: fetched credits config' and who.acct <> '' and ts >= who.since")
    c = lambda path, kind="string": get(f"$.config.{path}", kind, "ctx")
    unified = F.coalesce(c("isUnifiedBillingUser", "boolean"), F.lit(False))
    known = known.withColumns({"start": F.try_to_timestamp(c("currentPeriod.start")), "resets_at": F.try_to_timestamp(c("currentPeriod.end")), "used_percent": F.coalesce(c("creditUsagePercent", "double"), F.when(unified, F.lit(0.0)))})
    known = known.where(c("currentPeriod.type") == WEEKLY).where("resets_at > start and ts >= start and used_percent between 0 and 100 and not isnan(used_percent)")
    found = known.withColumns({
        "provider": F.lit("xai"), "source": F.lit("grok-cli"), "acct": F.col("who.acct"), "acct_q": F.lit("recorded"), "plan": F.trim(text("$.subscriptionTier", "ctx")), "window": F.lit("week"), "scope": F.lit(""),
        "detail": F.when(unified, SHARED).otherwise(""), "observed_at": F.col("ts"), "quota_source": F.lit(""),
    })
    return found.groupBy("acct").agg(F.max_by(F.struct("file", *_OUT), F.struct("observed_at", "file", "at")).alias("r")).select("r.*")


def kept_meters(kept: DataFrame, current: DataFrame, now: str, days: int = 14) -> DataFrame:
    """current with the readings of organisations that it says nothing of any more, until some days after their reset."""
    gone = kept.join(current.select("org").distinct(), "org", "left_anti")
    return current.unionByName(gone.where(F.col("resets_at") + F.expr(f"interval {days} days") > F.expr(f"timestamp'{now}'")).select(*current.columns))


def account_quotas(files: DataFrame, key: bytes, now: str) -> DataFrame:
    """Readings of documents (value) about one account each: its own, of one form, not of later than two minutes from now.

    A document that is too long, of another form or without a real account, kind or time is left out; of the others, each window with a known name, status
    and percentage. Accounts and organisations leave as keyed hashes.
    """
    held = files.where(F.octet_length("value") <= MOST_QUOTA).select(F.try_parse_json("value").alias("v")).where("v is not null")
    acct, org, kind = text("$.accountId"), text("$.orgId"), text("$.orgKind")
    fields = "array<struct<window:string,scope:string,usedPercent:double,resetsAt:string,status:string>>"
    held = held.select(
        text("$.provider").alias("provider"), acct.alias("own"), org.alias("of"), kind.alias("org_kind"), F.trim(text("$.name")).alias("name"), F.trim(text("$.plan")).alias("plan"), F.try_to_timestamp(get("$.observedAt")).alias("observed_at"),
        get("$.schema", "bigint").alias("form"), get("$.windows", fields).alias("windows"),
    )
    held = held.where((F.col("form") == 1) & F.col("provider").isin(*SOURCES) & (F.col("own") != "") & (F.octet_length("own") <= 512) & F.col("org_kind").isin("", *KINDS))
    held = held.where(F.col("observed_at") <= F.lit(now).cast("timestamp") + F.expr("interval 2 minutes"))
    rows = held.select("*", F.explode("windows").alias("w")).where(F.col("w.window").isin(*NAMES) & F.coalesce("w.status", F.lit("")).isin("", *STATUSES))
    rows = rows.where(F.col("w.usedPercent").isNull() | (F.col("w.usedPercent").between(0, 100) & ~F.isnan("w.usedPercent")))
    source = F.coalesce(*(F.when(F.col("provider") == p, s) for p, s in SOURCES.items()))
    hashed = lambda c: ids.account_hash(key, F.col("provider"), c)
    return rows.select(
        "provider", source.alias("source"), hashed(F.col("own")).alias("acct"), F.lit("recorded").alias("acct_q"), F.when(F.col("of") == "", "").otherwise(hashed(F.concat(F.lit("org:"), "of"))).alias("org"), "org_kind", "name", "plan",
        F.col("w.window").alias("window"), F.trim(F.coalesce("w.scope", F.lit(""))).alias("scope"), F.col("w.usedPercent").alias("used_percent"), F.try_to_timestamp("w.resetsAt").alias("resets_at"), "observed_at",
        F.coalesce("w.status", F.lit("")).alias("status"), F.lit("account-api").alias("quota_source"),
    )


def account_days(responses: DataFrame, now: str) -> DataFrame:
    """(acct, date, total_tokens, observed_at) of a provider's answers about accounts (acct, observed_at, v): the largest total of a date that comes twice.

    An answer with one bucket that has no real date, lies behind now, or no sensible count is refused as a whole, and so is one without buckets.
    """
    buckets = get("$.dailyUsageBuckets", "array<struct<startDate:string,tokens:bigint>>")
    each = responses.withColumn("answer", F.monotonically_increasing_id()).select("answer", "acct", "observed_at", F.explode(buckets).alias("b"))
    date = F.coalesce("b.startDate", F.lit(""))
    day = F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))
    real = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.coalesce(F.date_format(day, "yyyy-MM-dd") == date, F.lit(False)) & (day <= F.lit(now).cast("timestamp"))
    counts = F.coalesce("b.tokens", F.lit(0))
    each = each.withColumn("bad", ~F.coalesce(real, F.lit(False)) | ~counts.between(0, MOST_TOKENS))
    days = each.groupBy("answer", "acct", "observed_at", date.alias("date")).agg(F.max(counts).alias("total_tokens"), F.max("bad").alias("bad"))
    refused = days.where("bad").select("answer").distinct()
    return days.join(refused, "answer", "left_anti").select("acct", "date", "total_tokens", "observed_at")
