"""Which account an event belongs to: by its own record, by who was logged in, or by evidence around it.

Events: id, provider, home, ts, session, hint, hint_kind ('' or org), hint_at. Evidence tables share provider and home. Lookups in time
are as-of windows by day (asof.around); segments between logins are keys, so no range join is made. A lookup reads its rows twice (days, and
rows of a day), so what one lookup asks of another is staged between them; else the first would be done over for each reader.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talliard.functions.ids import event_id
from talliard.operators.asof import around, last_before
from talliard.operators.eras import by_era, plan_eras
from talliard.operators.merge import acct_rank
from talliard.tables import staged

KEYS = ["provider", "home"]
# Fixed values, in minutes: slack around an observed login, that of session records, and how old a process's user may be.
SLACK, RECORD_SLACK, PROCESS_AGE = 2, 1, 24 * 60


def _later(ts: Column | str, minutes: int) -> Column:
    return F.timestamp_add("MINUTE", F.lit(minutes), F.col(ts) if isinstance(ts, str) else ts)


def _micros(a: Column, b: Column) -> Column:
    return F.unix_micros(a) - F.unix_micros(b)


def _probe_samples(probes: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy("from_ts", "to_ts", "acct")
    return probes.select(*KEYS, F.col("from_ts").alias("ts"), F.struct("acct", "to_ts", F.lag("acct").over(w).alias("before"), F.lag("to_ts").over(w).alias("before_to")).alias("iv"))


def by_probe(events: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, acct, acct_q) by the observed logins (from_ts, to_ts, acct), which follow each other: the earlier one holds at a shared moment.

    Inside one, or no further than two minutes: timeline. Else the nearest, the earlier one of two: inferred. Without any: unknown.
    """
    found, t = around(events, _probe_samples(probes), KEYS, "iv", True), F.col("ts")
    back, ahead = F.col("_b.iv"), F.col("_a.iv")
    inside = F.when(back["before_to"] >= t, back["before"]).when(back["to_ts"] >= t, back["acct"])
    behind, before = _micros(t, back["to_ts"]), _micros(F.col("_a.at"), t)
    earlier = F.col("_b").isNotNull() & (F.col("_a").isNull() | (behind <= before))
    near = F.when(earlier, back["acct"]).otherwise(ahead["acct"])
    close = F.when(earlier, behind).otherwise(before) <= SLACK * 60_000_000
    quality = F.when(inside.isNotNull() | F.coalesce(close, F.lit(False)), "timeline").when(near.isNotNull(), "inferred").otherwise("unknown")
    return found.select("id", F.coalesce(inside, near, F.lit("")).alias("acct"), quality.alias("acct_q"))


def live(events: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, live): the account logged in, the later one within two minutes of a change."""
    found = around(events.withColumn("ts", _later("ts", SLACK)), _probe_samples(probes), KEYS, "iv", False)
    return found.where(_later("_b.iv.to_ts", SLACK) >= _later("ts", -SLACK)).select("id", F.col("_b.iv.acct").alias("live"))


def by_org(events: DataFrame, orgs: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, acct, certain) of events whose hint is an organisation (org, acct, rank): its only account, the one logged in, else the best ranked."""
    group = Window.partitionBy(*KEYS, "org")
    ranked = orgs.groupBy(*KEYS, "org", "acct").agg(F.max("rank").alias("rank")).withColumn("_best", F.max("rank").over(group))
    heads = ranked.groupBy(*KEYS, "org").agg(F.min(F.when(F.col("rank") == F.col("_best"), F.col("acct"))).alias("best"), F.count_if(F.col("rank") == F.col("_best")).alias("tied"), F.count("*").alias("n"))
    asked = events.where("hint_kind = 'org'").withColumnRenamed("hint", "org")
    rows = asked.select("id", *KEYS, "org").join(live(asked, probes), "id", "left").join(heads, [*KEYS, "org"])
    rows = rows.join(ranked.select(*KEYS, "org", F.col("acct").alias("live"), F.lit(True).alias("in_org")), [*KEYS, "org", "live"], "left")
    return rows.select("id", F.when(F.col("in_org") & (F.col("n") > 1), F.col("live")).otherwise(F.col("best")).alias("acct"), (F.coalesce("in_org", F.lit(False)) | (F.col("tied") == 1)).alias("certain"))


def without_login_since(candidates: DataFrame, bounds: DataFrame) -> DataFrame:
    """Candidates (id, provider, home, ts, at, ...) with no login in (at, ts]."""
    last = last_before(candidates.select("id", *KEYS, "ts").distinct(), bounds.select(*KEYS, "ts", F.lit(1).alias("_login")), KEYS, "_login").select("id", F.col("at").alias("_bound"))
    return candidates.join(last, "id", "left").where(F.col("_bound").isNull() | (F.col("_bound") <= F.col("at"))).drop("_bound")


def by_session(events: DataFrame, records: DataFrame) -> DataFrame:
    """(id, at, acct) by records of the event's session (session, ts, acct): the last up to a minute later, else the first."""
    keys = [*KEYS, "session"]
    asked = events.where("session <> ''").withColumn("ts", _later("ts", RECORD_SLACK))
    first = records.groupBy(*keys).agg(F.min(F.struct(F.col("ts").alias("at"), "acct")).alias("_first"))
    found = around(asked, records, keys, "acct", False).join(first, keys).withColumn("_r", F.coalesce("_b", "_first"))
    return found.select("id", "_r.at", "_r.acct")


def by_process(events: DataFrame, spans: DataFrame, users: DataFrame) -> DataFrame:
    """(id, at, acct) by the process that ran the session (session, proc, from_ts, to_ts) and its user (proc, ts, acct).

    The span around the event that began last, else the last before, else the first after; then its user's last record that is at most a
    day older than the span. Spans are met by session and day, those before and after and the user's records as of a time, so
    no event meets all spans of its session, nor all records of a process.
    """
    keys = [*KEYS, "session"]
    asked = events.where("session <> ''").select("id", *keys, "ts")
    whole = F.struct("proc", "from_ts", "to_ts")
    days = F.sequence(F.to_date(_later("from_ts", -SLACK)), F.to_date(_later("to_ts", SLACK)))
    by_day = spans.where("to_ts >= from_ts").select(*keys, whole.alias("span"), F.explode(days).alias("_day"))
    covers = asked.withColumn("_day", F.to_date("ts")).join(by_day, [*keys, "_day"]).where(F.col("ts").between(_later("span.from_ts", -SLACK), _later("span.to_ts", SLACK)))
    around_it = covers.groupBy("id").agg(F.max_by("span", F.struct("span.from_ts", "span.proc")).alias("_in"))
    near = around(asked, spans.select(*keys, F.col("from_ts").alias("ts"), whole.alias("span")), keys, "span", True)
    pick = staged(near.join(around_it, "id", "left").select("id", *KEYS, F.coalesce("_in", "_b.span", "_a.span").alias("p")).where("p is not null").select("id", *KEYS, "p.*"))
    seen = around(pick.select("id", *KEYS, "proc", _later("to_ts", SLACK).alias("ts")), users, [*KEYS, "proc"], "acct", False)
    found = seen.select("id", "_b.at", "_b.acct").join(pick.select("id", "from_ts"), "id")
    return found.where(F.col("at") >= _later("from_ts", -PROCESS_AGE)).select("id", "at", "acct")


def best_pieces(pieces: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """(keys, ts, best) from pieces of time (keys, begin, end, rank): from ts until the key's next row, the highest rank of the pieces around; null where there is none.

    begin and end are in microseconds, end not included. A piece is cut into blocks of 2^k microseconds that begin at their multiples,
    two of a size at most; the pieces of a block leave their highest rank. Each edge of a piece lies in one block of a size. So no
    edge, and no event, meets all pieces around it.
    """
    sizes = F.sequence(F.lit(0), F.lit(62))
    node = lambda k, n: F.struct(k.alias("size"), n.alias("block"))
    low, high = lambda k: -F.call_function("shiftright", -F.col("begin"), k), lambda k: F.call_function("shiftright", F.col("end"), k)
    left = lambda k: F.when((low(k) < high(k)) & (low(k) % 2 != 0), node(k, low(k)))
    right = lambda k: F.when((low(k) < high(k)) & (high(k) % 2 != 0), node(k, high(k) - 1))
    cut = F.array_compact(F.concat(F.transform(sizes, left), F.transform(sizes, right)))
    blocks = pieces.where("begin < end").select(*keys, rank, F.explode(cut).alias("b")).groupBy(*keys, "b.size", "b.block").agg(F.max(rank).alias(rank))
    edges = pieces.where("begin < end").select(*keys, F.explode(F.array("begin", "end")).alias("at")).distinct()
    asked = edges.select(*keys, "at", F.explode(F.transform(sizes, lambda k: node(k, F.call_function("shiftright", F.col("at"), k)))).alias("b")).select(*keys, "at", "b.*")
    best = asked.join(blocks, [*keys, "size", "block"], "left").groupBy(*keys, "at").agg(F.max(rank).alias("best"))
    return best.select(*keys, F.timestamp_micros("at").alias("ts"), "best")


def by_folder(events: DataFrame, folders: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, at, acct) by the log folder (proc, from_ts, to_ts, acct) around an event, the newest first: its only owner, else its last owner line (proc, ts, acct).

    A folder says one thing for its whole time or, without an only owner, from each of its owner lines to the next; of what overlaps, the
    newest folder's holds. That follows from folders and lines alone, so events look it up as of their time.
    """
    whole = folders.where("from_ts <= to_ts").select(*KEYS, "proc", "from_ts", "acct", F.unix_micros("from_ts").alias("begin"), (F.unix_micros("to_ts") + 1).alias("end"))
    said = lambda at: F.struct("from_ts", F.col(at).alias("at"), "acct").alias("said")
    named = whole.where("acct <> ''").select(*KEYS, "begin", "end", said("from_ts"))
    lines = owners.groupBy(*KEYS, "proc", "ts").agg(F.max("acct").alias("acct"))
    lines = lines.withColumn("next", F.lead("ts").over(Window.partitionBy(*KEYS, "proc").orderBy("ts")))
    parts = whole.where("acct = ''").drop("acct").join(lines, [*KEYS, "proc"])
    parts = parts.select(*KEYS, F.greatest("begin", F.unix_micros("ts")).alias("begin"), F.least("end", F.unix_micros("next")).alias("end"), said("ts"))
    best = staged(best_pieces(named.unionByName(parts), KEYS, "said"))
    asked = events.select("id", *KEYS, "ts").join(folders.select(*KEYS).distinct(), KEYS, "left_semi")
    return last_before(asked, best, KEYS, "best").where("best is not null").select("id", "best.at", "best.acct")


def recorded(events: DataFrame, evidence: dict[str, DataFrame]) -> DataFrame:
    """(id, acct, acct_q) of events with a record of their own and no login since: the latest record, at equal times the stronger one."""
    base = events.select("id", *KEYS, "ts")
    org = by_org(events, evidence["orgs"], evidence["probes"]).select("id", F.col("acct").alias("_acct"), "certain")
    hints = events.where("hint <> ''").join(org, "id", "left").select(
        "id", *KEYS, "ts", F.col("hint_at").alias("at"), F.coalesce("_acct", "hint").alias("acct"),
        F.when((F.col("hint_kind") == "org") & ~F.coalesce("certain", F.lit(False)), "bounded").otherwise("recorded").alias("acct_q"), F.lit(0).alias("ord"),
    )
    more = lambda df, k: df.join(base, "id").select("id", *KEYS, "ts", "at", "acct", F.lit("recorded").alias("acct_q"), F.lit(k).alias("ord"))
    held = without_login_since(staged(hints.unionByName(more(by_session(events, evidence["sessions"]), 1))), evidence["bounds"])
    own = held.unionByName(more(by_process(events, evidence["spans"], evidence["users"]), 2)).unionByName(more(by_folder(events, evidence["folders"], evidence["owners"]), 3))
    best = own.groupBy("id").agg(F.max_by(F.struct("acct", "acct_q"), F.struct("at", acct_rank().alias("r"), (-F.col("ord")).alias("o"))).alias("r"))
    return best.select("id", "r.*")


def fallback(events: DataFrame, samples: DataFrame, bounds: DataFrame, eras: DataFrame | None = None) -> DataFrame:
    """(id, acct, acct_q) by identity samples (ts, acct) around an event.

    Between two logins samples that agree, or those on both sides, bound it (anthropic); the nearest without a login between carries on
    (xai); samples of one account on both sides, or the only account ever, carry on (cursor); so does the era of a plan with one account
    (openai). Else the nearest sample: inferred.
    """
    logins = bounds.select(*KEYS, "ts", F.lit(1).alias("_login"))
    since = F.coalesce("at", F.lit("0001-01-01").cast("timestamp"))
    segment = lambda df: last_before(df, logins, KEYS, "_login").select("id", *KEYS, "ts", since.alias("seg"))
    marked = samples.select(*KEYS, "ts", "acct").distinct().withColumn("id", F.struct(*KEYS, "ts", "acct"))
    mine = staged(segment(marked).select(*KEYS, "seg", "ts", F.col("id.acct").alias("acct")))
    here = around(staged(segment(events.select("id", *KEYS, "ts"))), mine, [*KEYS, "seg"], "acct", True)
    agreed = mine.groupBy(*KEYS, "seg").agg(F.min("acct").alias("_lo"), F.max("acct").alias("_hi"))
    here = here.join(agreed, [*KEYS, "seg"], "left").join(bounds.select(*KEYS).distinct().withColumn("_bounded", F.lit(True)), KEYS, "left")
    pick = lambda a, b: F.when(F.col(b).isNull() | (_micros(F.col("ts"), F.col(f"{a}.at")) <= _micros(F.col(f"{b}.at"), F.col("ts"))), F.col(f"{a}.acct")).otherwise(F.col(f"{b}.acct"))
    near_here, same = pick("_b", "_a"), F.col("_lo") == F.col("_hi")
    sides = F.when(F.col("_b.acct") == F.col("_a.acct"), F.col("_b.acct"))
    here = here.select("id", F.when(same, F.col("_lo")).otherwise(sides).alias("bounded"), near_here.alias("near_here"), "_bounded")
    ever = mine.groupBy(*KEYS).agg(F.min("acct").alias("_e_lo"), F.max("acct").alias("_e_hi"))
    every = around(events.select("id", *KEYS, "ts"), mine.select(*KEYS, "ts", "acct"), KEYS, "acct", True).join(ever, KEYS, "left").join(here, "id")
    edge = F.col("_b").isNull() | F.col("_a").isNull()
    between = F.when(edge & (F.col("_e_lo") == F.col("_e_hi")), F.col("_e_lo")).otherwise(sides)
    p, segmented = F.col("provider"), F.coalesce("_bounded", F.lit(False))
    kept = F.when((p == "anthropic") & segmented & F.col("bounded").isNotNull(), F.struct(F.col("bounded").alias("acct"), F.lit("bounded").alias("acct_q")))
    kept = kept.when((p == "anthropic") & segmented & F.col("near_here").isNotNull(), F.struct(F.col("near_here").alias("acct"), F.lit("inferred").alias("acct_q")))
    kept = kept.when((p == "xai") & F.col("near_here").isNotNull(), F.struct(F.col("near_here").alias("acct"), F.lit("lineage").alias("acct_q")))
    kept = kept.when((p == "cursor") & between.isNotNull(), F.struct(between.alias("acct"), F.lit("lineage").alias("acct_q")))
    kept = kept.otherwise(F.struct(pick("_b", "_a").alias("acct"), F.lit("inferred").alias("acct_q")))
    found = every.select("id", "provider", kept.alias("k")).select("id", "provider", "k.*")
    if eras is not None:
        own = by_era(events.where("provider = 'openai'"), eras).select("id", F.col("acct").alias("_era"))
        held = (F.col("provider") == "openai") & F.col("_era").isNotNull()
        found = found.join(own, "id", "left").withColumns({"acct": F.when(held, F.col("_era")).otherwise(F.col("acct")), "acct_q": F.when(held, "lineage").otherwise(F.col("acct_q"))})
    return found.select("id", "acct", "acct_q").where("acct is not null")


def attributed(events: DataFrame, evidence: dict[str, DataFrame]) -> DataFrame:
    """(id, acct, acct_q) of every event: its own record, else the timeline of logins, else evidence, else the nearest login.

    evidence: probes, bounds, sessions, orgs, spans, users, folders, owners, samples, and plans where there are any; any may be empty.
    """
    plans = evidence.get("plans")
    eras = plan_eras(plans, evidence["sessions"].select(*KEYS, "ts", "acct").unionByName(evidence["samples"].select(*KEYS, "ts", "acct"))) if plans is not None else None
    own = recorded(events, evidence).select("id", F.struct("acct", "acct_q").alias("_own"))
    seen = by_probe(events, evidence["probes"]).select("id", F.struct("acct", "acct_q").alias("_seen"))
    other = fallback(events, evidence["samples"], evidence["bounds"], eras).select("id", F.struct("acct", "acct_q").alias("_other"))
    rows = events.select("id").join(own, "id", "left").join(seen, "id", "left").join(other, "id", "left")
    on_time = F.when(F.col("_seen.acct_q") == "timeline", F.col("_seen"))
    return rows.select("id", F.coalesce("_own", on_time, "_other", "_seen").alias("r")).select("id", "r.*")


def of_logs(usage: DataFrame, evidence: dict[str, DataFrame], home: str) -> DataFrame:
    """(id, acct, acct_q) of a log reader's usage (native_key, provider, source, ts, session, hint): the log's own hint with the evidence of its home.

    A transcript's hint names an organisation, a rollout's its account.
    """
    hint = F.coalesce("hint", F.lit(""))
    events = usage.select(
        event_id("usage", F.col("provider"), F.col("source"), F.col("native_key")).alias("id"), "provider", F.lit(home).alias("home"), "ts", "session", hint.alias("hint"),
        F.when((hint != "") & (F.col("provider") == "anthropic"), "org").otherwise("").alias("hint_kind"), F.col("ts").alias("hint_at"),
    )
    return attributed(events.dropDuplicates(["id"]), evidence)
