"""Queries of usage by project and period, and of names of tags."""

import hashlib
import hmac

from pyspark.sql import functions as F

from talliard.operators import projects
from talliard.plans.catalog import TOK, merged, query
from talliard.plans.oracle import MERGED, PROMPTS
from talliard.sources import adapter
from talliard.tables import staged

_NOW = "1998-06-15 12:00:00"
_KEY = b"synthetic key of the tests"
_HASHED = "/home/u/project-5"
#: What the fleet's key makes of one workspace.
_TAG = "w_" + hmac.new(_KEY, f"workspace|{_HASHED}".encode(), hashlib.sha256).hexdigest()[:16]


def _prompts(spark, sf_dir):
    """Prompts that name a project by their folder, but a few that name another one."""
    p = adapter.prompt_records(spark, sf_dir)
    turn = F.substring("seq", -6, 6).cast("int")
    return p.withColumns({"name": F.when(turn == 5, "project-0").otherwise(F.regexp_extract("workspace", "[^/]*$", 0)), "turn": turn})


def _activity(prompts):
    """What prompts do, seen by tag; one prompt in eight is not seen, and some in the folder of the last project are of the one before."""
    ws = F.concat(F.lit("w_"), F.when((F.col("turn") == 7) & F.col("workspace").endswith("3"), "2").otherwise(F.substring("workspace", -1, 1)))
    return prompts.where("turn <> 5 and turn % 8 <> 6").select("provider", "session", "ts", ws.alias("ws"))


_TAGS = f"""{PROMPTS},
pt as (select provider, session, ts, workspace, cast((epoch(ts) - 1750000000) % 3600 / 60 as int) as turn from p),
pm as (select *, case when turn = 5 then 'project-0' else regexp_extract(workspace, '[^/]*$') end as name from pt),
ag as (select provider, session, ts, min(name) as name from pm group by all having min(name) = max(name)),
of as (select concat('w_', case when turn = 7 and ends_with(workspace, '3') then '2' else right(workspace, 1) end) as ws, ag.name from pm join ag using (provider, session, ts) where turn <> 5 and turn % 8 <> 6
  union all select '{_TAG}', name from pm where workspace = '{_HASHED}'),
tg as (select ws, min(name) as name from of group by ws having min(name) = max(name))"""


@query("jn_07_tag_names", f"with {_TAGS} select ws, name from tg where ws in ('w_0', 'w_1', 'w_2', 'w_3', 'w_4', 'w_5', '{_TAG}')")
def jn_07(spark, sf_dir):
    """Tags by what prompts of the same moment say, and by the fleet's key."""
    p = _prompts(spark, sf_dir)
    found = projects.names_of_tags(_activity(p), p, "2100-01-01", _KEY)
    return found.where(F.col("ws").isin(*(f"w_{k}" for k in range(6)), _TAG))


def _usage(spark, sf_dir):
    """Usage of labelled accounts; half of one project's is under the tag that the fleet's key makes."""
    m = merged(spark, sf_dir).where("acct <> ''")
    return m.withColumn("ws", F.when((F.col("ws") == "w_5") & (F.col("tok_in") % 2 == 0), _TAG).otherwise(F.col("ws")))


def _spans(usage):
    accounts = staged(usage.select("provider", "acct").distinct())  # few rows of all usage, read many times
    n = F.regexp_extract("acct", "[0-9]+", 0).cast("int")
    weekly = accounts.where(n % 4 > 0).select("provider", "acct", F.expr("timestamp'1998-06-01 09:00:00'").alias("a"), n.alias("n"))
    told = weekly.select("provider", "acct", F.timestamp_add("DAY", F.col("n") * 3, F.col("a")).alias("resets_at"), F.col("a").alias("observed_at"))
    older = told.withColumns({"resets_at": F.timestamp_add("DAY", F.lit(1), "resets_at"), "observed_at": F.timestamp_add("DAY", F.lit(-1), "observed_at")})
    return projects.windows(accounts, told.unionByName(older), _NOW)


_W = f"""us as (select * replace (case when ws = 'w_5' and tok_in % 2 = 0 then '{_TAG}' else ws end as ws), {TOK} as tokens from m where acct <> ''),
ac as (select distinct provider, acct, cast(regexp_extract(acct, '[0-9]+') as int) as n from us),
rs as (select provider, acct, timestamp '1998-06-01 09:00:00' + to_days(n * 3) as r from ac where n % 4 > 0),
rw as (select *, case when r <= timestamp '{_NOW}' then r + to_days(cast(floor((epoch_us(timestamp '{_NOW}') - epoch_us(r)) / (7 * 86400e6)) + 1 as int) * 7) else r end as e, r <= timestamp '{_NOW}' as projected from rs),
w as (select provider, acct, range, timestamp '{_NOW}' - to_minutes(mi) as since, null::timestamp as resets_at, false as projected from ac cross join (values {', '.join(f"('{k}', {v})" for k, v in projects.PERIODS.items())}) as p(range, mi)
  union all select provider, acct, 'reset', e - interval 7 days, e, projected from rw where e - interval 7 days <= timestamp '{_NOW}'),
x as (select us.*, range, since, ts_q = 'session-start' or (source = 'cursor' and ts_q <> 'event') as loose, acct_q in ('recorded', 'session', 'timeline', 'bounded') as certain from us join w using (provider, acct) where ts >= since and ts < timestamp '{_NOW}')"""
_S = "cast(sum(tokens) as bigint) as tokens, cast(sum(case when q = 'estimated' then 0 else tokens end) as bigint) as exact_tokens, cast(sum(case when q = 'estimated' then tokens else 0 end) as bigint) as estimated_tokens, cast(sum(greatest(calls, 1)) as bigint) as calls"
_LABELS = "lb(name, label) as (values ('project-0', 'Zero'), ('project-1', 'Shared'), ('project-2', 'shared'), ('project-4', ''), ('project-5', 'Five'))"


@query("cx_15_projects", f"""with {MERGED}, {_TAGS}, {_LABELS}, {_W},
s as (select provider, acct, range, coalesce(nullif(lower(label), ''), 'unassigned') as project, {_S} from x left join tg using (ws) left join lb using (name) where not loose and certain and tokens > 0 group by all)
select *, round(100.0 * tokens / sum(tokens) over (partition by provider, acct, range), 6) as percent, row_number() over (partition by provider, acct, range order by tokens desc, project) as place from s""")
def cx_15(spark, sf_dir):
    p, usage = _prompts(spark, sf_dir), _usage(spark, sf_dir)
    labels = spark.sql("select * from values ('project-0', 'Zero'), ('project-1', 'Shared'), ('project-2', 'shared'), ('project-4', ''), ('project-5', 'Five') as t(name, label)")
    return projects.by_project(usage, _spans(usage), projects.names_of_tags(_activity(p), p, "2100-01-01", _KEY), labels, _NOW)


@query("ag_21_period_totals", f"""with {MERGED}, {_W}, a as (select provider, acct, range, {_S} from x where not loose and certain and tokens > 0 group by all),
b as (select provider, acct, range, cast(sum(case when not loose and not certain then tokens else 0 end) as bigint) as uncertain_tokens, bool_or(loose) as loose from x group by all)
select w.*, {', '.join(f'coalesce({c}, 0) as {c}' for c in ('tokens', 'exact_tokens', 'estimated_tokens', 'calls', 'uncertain_tokens'))}, provider = 'cursor' or coalesce(loose, false) as timing_limited from w left join a using (provider, acct, range) left join b using (provider, acct, range)""")
def ag_21(spark, sf_dir):
    usage = _usage(spark, sf_dir)
    return projects.totals(usage, _spans(usage), _NOW)
