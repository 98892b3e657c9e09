"""URL filters: pattern rules indexed by their rarest literal token, and host and path rules by host.

Every url is cut into host and path by fixed text rules. Host rules are looked up by each suffix of the url's
host, so a url meets only rules that may fit; of the fitting ones the longest wins. Where none fits, pattern
rules decide: each form of one is stored under its rarest literal token (counted over all urls), the url's tokens fetch
candidates, and only candidates run their regular expression. DataFrame functions only.

Null urls and urls without '://' have an empty host and path, no rule, and the default verdict allow. Of rules
of the same length the smaller text wins, of two equal texts the verdict block. Repeated rows stay, as each row
is judged by itself. Empty tables give empty results. Columns other than id and url pass through untouched
unless they clash with a result's name; then the result replaces them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliard.tables import table

#: The contract's rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Pattern rules for urls that no host rule fits, one row for each form of what they match: the pattern, then the form's
#: literal tokens. Joined words are one token, hyphenated ones several; each match holds all tokens of one of the forms.
PATTERNS = [
    (r"(^|[./-])cheap-?pills([./-]|$)", ["cheappills"]),
    (r"(^|[./-])cheap-?pills([./-]|$)", ["cheap", "pills"]),
    (r"(^|[./-])free-?bets([./-]|$)", ["freebets"]),
    (r"(^|[./-])free-?bets([./-]|$)", ["free", "bets"]),
    (r"(^|[./-])online-?casino([./-]|$)", ["onlinecasino"]),
    (r"(^|[./-])online-?casino([./-]|$)", ["online", "casino"]),
    (r"(^|[./-])adult-?(cams?|video)([./-]|$)", ["adultcam"]),
    (r"(^|[./-])adult-?(cams?|video)([./-]|$)", ["adultcams"]),
    (r"(^|[./-])adult-?(cams?|video)([./-]|$)", ["adultvideo"]),
    (r"(^|[./-])adult-?(cams?|video)([./-]|$)", ["adult"]),
]

#: Rule tables up to this many rows are broadcast; larger ones are shuffled by their key.
BROADCAST_ROWS = 10_000

_TAIL = "case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end"
_HOST = "regexp_extract(_tail, '^[^/?#]*', 0)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def pattern_table(spark: SparkSession, patterns=PATTERNS) -> DataFrame:
    return spark.createDataFrame(patterns, "pattern string, tokens array<string>")


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    return (
        pages.drop(*({"host", "path", "_tail"} & set(pages.columns)))
        .withColumn("_tail", F.coalesce(F.expr(_TAIL.replace("url", f"`{url}`")), F.lit("")))
        .withColumn("host", F.expr(_LOWER.format(_HOST)))
        .withColumn("path", F.expr("regexp_extract(substring(_tail, length(host) + 1), '^[^?#]*', 0)"))
        .drop("_tail")
    )


def _sized(small: DataFrame) -> DataFrame:
    """Broadcast only after counting up to the limit; otherwise Spark shuffles both sides."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def index_patterns(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """(token, pattern): each form of a pattern under its literal token that the fewest urls hold, ties by the token."""
    literal = patterns.select("pattern", "tokens", F.explode("tokens").alias("token"))
    counts = (
        urls.select(F.explode(_tokens()).alias("token"))
        .join(_sized(literal.select("token").distinct()), "token", "left_semi")
        .groupBy("token").agg(F.count("*").alias("n"))
    )
    return (
        literal.join(counts, "token", "left")
        .groupBy("pattern", "tokens").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .select(F.col("rarest.token").alias("token"), "pattern").distinct()
    )


def _tokens():
    return F.array_distinct(F.filter(F.split(F.concat_ws("/", "host", "path"), "[^a-zA-Z0-9]+"), lambda t: t != ""))


def filter_urls(pages: DataFrame, rules: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and why (rule, pattern or default)."""
    pages = split_url(pages, url).drop(*({"rule", "verdict", "why"} & set(pages.columns)))
    sites = pages.select("host", "path").distinct()
    ruled = (
        sites.withColumn("rule_host", F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")))
        .join(_sized(rules), "rule_host")
        .where(F.expr("startswith(path, rule_path)"))
        .groupBy("host", "path")
        .agg(F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), F.struct(-F.length(F.concat("rule_host", "rule_path")), F.concat("rule_host", "rule_path"), F.col("rule_verdict") != "block")).alias("_r"))
    )
    blocked = (
        sites.withColumn("token", F.explode(_tokens()))
        .join(_sized(index_patterns(sites, patterns)), "token")
        .where(F.expr("concat(host, path) rlike pattern"))
        .select("host", "path").distinct().withColumn("_p", F.lit(True))
    )
    verdicts = (
        sites.join(ruled, ["host", "path"], "left").join(blocked, ["host", "path"], "left")
        .select(
            "host", "path", F.col("_r.rule").alias("rule"),
            F.coalesce(F.col("_r.rule_verdict"), F.when(F.col("_p"), "block"), F.lit("allow")).alias("verdict"),
            F.when(F.col("_r").isNotNull(), "rule").when(F.col("_p"), "pattern").otherwise("default").alias("why"),
        )
    )
    return pages.join(verdicts, ["host", "path"])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = filter_urls(pages, rule_table(spark), pattern_table(spark))
    return found.select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as tail from pages),
raw as (select page_id, tail, regexp_extract(tail, '^[^/?#]*') as rawhost from cut),
parsed as (
  select page_id, translate(rawhost, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(tail, length(rawhost) + 1), '^[^?#]*') as path from raw),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                          ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as rv
  from parsed join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select parsed.page_id, host, path, rule,
       coalesce(rv, case when regexp_matches(host || path, '(^|[./-])cheap-?pills([./-]|$)')
         or regexp_matches(host || path, '(^|[./-])free-?bets([./-]|$)')
         or regexp_matches(host || path, '(^|[./-])online-?casino([./-]|$)')
         or regexp_matches(host || path, '(^|[./-])adult-?(cams?|video)([./-]|$)') then 'block' else 'allow' end) as verdict
from parsed left join best on parsed.page_id = best.page_id
"""
