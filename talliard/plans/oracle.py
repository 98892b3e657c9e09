"""SQL for the oracle: the derived events and their merge, stated once more for DuckDB."""

_PROVIDER = "case {0} % 5 when 0 then 'anthropic' when 1 then 'openai' when 2 then 'xai' when 3 then 'cursor' else 'google' end"
_SOURCE = "case {0} % 5 when 0 then 'claude-code' when 1 then 'codex' when 2 then 'grok-cli' when 3 then 'cursor' else 'gemini-cli' end"
_Q = "case {0} % 4 when 0 then 'unknown' when 1 then 'recorded' when 2 then 'timeline' else 'inferred' end"
_DAY = "strftime(ts + to_minutes(tz_offset_min), '%Y-%m-%d')"

USAGE = f"""
u0 as (select *, {_PROVIDER.format('l_suppkey')} as provider, {_SOURCE.format('l_suppkey')} as source,
    concat(l_orderkey, ':', l_partkey % 2) as native_key
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
u as (select substr(sha256(concat('v1|usage|', provider, '|', source, '|', native_key)), 1, 32) as id, provider, source, l_shipdate as ts,
    case when l_linenumber % 5 = 0 then 'session-start' else 'event' end as ts_q, cast((l_orderkey % 3 - 1) * 480 as bigint) as tz_offset_min,
    case when l_partkey % 11 = 0 then '' else concat('model-', l_partkey % 7) end as model,
    case when l_linenumber % 4 = 0 then '' else concat('a_', o_custkey % 9) end as acct, {_Q.format('l_linenumber')} as acct_q,
    case when l_returnflag = 'R' then 'estimated' else 'exact' end as q, cast(1 + l_partkey % 3 as bigint) as pv,
    concat('s_', substr(sha256(concat(provider, '|sess-', o_custkey % 50)), 1, 16)) as session,
    cast(floor(l_quantity) as bigint) as tok_in, cast(l_linenumber * 10 as bigint) as cache_w, cast(l_linenumber * 4 as bigint) as cache_w1h,
    cast(floor(l_extendedprice) as bigint) as cache_r, cast(floor(l_quantity * 2) as bigint) as tok_out, cast(floor(l_quantity) as bigint) as reasoning, cast(1 as bigint) as calls,
    concat('m_', o_custkey % 4) as machine, case when o_custkey % 4 = 3 then '' else n_name end as cc, concat('w_', o_custkey % 6) as ws,
    concat(lpad(cast(l_orderkey as varchar), 12, '0'), lpad(cast(l_linenumber as varchar), 3, '0'), lpad(cast(l_partkey as varchar), 12, '0'), lpad(cast(l_suppkey as varchar), 12, '0'), cast(epoch(l_shipdate) as bigint)) as seq
  from u0)"""

_RANK = "case acct_q when 'recorded' then 6 when 'session' then 5 when 'timeline' then 4 when 'bounded' then 3 when 'lineage' then 2 when 'inferred' then 1 else 0 end"

MERGED = f"""{USAGE},
m0 as (select *, {_RANK} as arank, case ts_q when 'event' then 2 when 'session-start' then 1 else 0 end as trank, max(pv) over (partition by id) as mpv from u),
m1 as (select *, max(case when pv = mpv then trank end) over (partition by id) as mrank, max(case when acct <> '' then arank end) over (partition by id) as marank from m0),
m as (select id, min(provider) as provider, min(source) as source, max(pv) as pv,
    {', '.join(f"max(case when pv = mpv then {c} end) as {c}" for c in ('tok_in', 'cache_w', 'cache_w1h', 'cache_r', 'tok_out', 'reasoning', 'calls'))},
    min(case when pv = mpv and trank = mrank then ts end) as ts, min(case when pv = mpv and trank = mrank then ts_q end) as ts_q,
    case when bool_or(q = 'exact' and pv = mpv) then 'exact' else 'estimated' end as q,
    coalesce(min(case when acct <> '' and arank = marank then acct end), '') as acct,
    coalesce(min(case when acct <> '' and arank = marank then acct_q end), 'unknown') as acct_q,
    coalesce(min(nullif(model, '')), '') as model, coalesce(min(nullif(session, '')), '') as session,
    coalesce(min(nullif(ws, '')) filter (where pv = mpv), min(nullif(ws, '')), '') as ws,
    coalesce(arg_min(machine, seq) filter (where machine <> ''), '') as machine, coalesce(arg_min(cc, seq) filter (where machine <> ''), '') as cc,
    arg_min(tz_offset_min, seq) filter (where pv = mpv) as tz_offset_min, arg_min({_DAY}, seq) as date
  from m1 group by id)"""

ACTIVITY = f"""
a0 as (select *, {_PROVIDER.format('user_id')} as provider, {_SOURCE.format('user_id')} as source from events),
a as (select substr(sha256(concat('v1|activity|', provider, '|', source, '|', event_id // 2)), 1, 32) as id, provider, source, ts,
    cast((user_id % 3 - 1) * 480 as bigint) as tz_offset_min, case when user_id % 4 = 0 then '' else concat('a_', user_id % 9) end as acct, {_Q.format('user_id')} as acct_q,
    concat('s_', substr(sha256(concat(provider, '|sess-', user_id % 50)), 1, 16)) as session, concat('w_', user_id % 6) as ws, event_type <> 'error' as has_usage,
    concat('m_', user_id % 4) as machine, '' as cc, lpad(cast(event_id as varchar), 12, '0') as seq from a0),
am as (select id, min(provider) as provider, min(source) as source, min(ts) as ts, bool_or(has_usage) as has_usage,
    coalesce(substr(min(case when acct <> '' then concat(9 - ({_RANK}), acct) end), 2), '') as acct,
    coalesce(arg_min(acct_q, concat(9 - ({_RANK}), acct)) filter (where acct <> ''), 'unknown') as acct_q, min(session) as session, min(ws) as ws,
    coalesce(arg_min(machine, seq), '') as machine, '' as cc, arg_min({_DAY}, seq) as date from a group by id)"""

PROMPTS = f"""
p0 as (select *, {_PROVIDER.format('conv_id')} as provider, {_SOURCE.format('conv_id')} as source from conversations where role = 'user'),
p as (select substr(sha256(concat('v1|prompt|', provider, '|', source, '|', conv_id, ':', turn)), 1, 32) as id, provider, source,
    timestamp '1970-01-01' + to_seconds(1750000000 + conv_id * 3600 + turn * 60) as ts, cast((conv_id % 3 - 1) * 480 as bigint) as tz_offset_min,
    case when turn % 3 = 0 then '' else concat('model-', conv_id % 7) end as model, concat('a_', conv_id % 9) as acct, case conv_id % 4 when 0 then 'inferred' when 1 then 'recorded' when 2 then 'timeline' else 'bounded' end as acct_q, concat('m_', conv_id % 4) as machine,
    concat('/home/u/project-', conv_id % 6) as workspace, concat('s_', substr(sha256(concat(provider, '|', conv_id)), 1, 16)) as session, text from p0)"""


def keyed(key: bytes, message: str) -> str:
    """SQL of an HMAC-SHA256 in hex, by its two digests."""
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"
