"""Calendar days as text (yyyy-MM-dd), named periods and spans of time as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd"
# Days of an average month, and English names of months as a dashboard writes them.
DAYS_A_MONTH = 30.44
SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEK_SECONDS = 7 * 86400


def add_days(date: Column, days: Column | int) -> Column:
    return F.date_format(F.date_add(F.to_date(date), days), ISO)


def weekday_index(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(F.to_date(date))


def monday_of(date: Column) -> Column:
    return F.date_format(F.date_trunc("week", F.to_date(date)), ISO)


def next_month(date: Column) -> Column:
    """The first day of the month behind."""
    return F.date_format(F.add_months(F.trunc(F.to_date(date), "month"), 1), ISO)


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def _with_year(text: Column, date: Column, today: Column) -> Column:
    return F.when(F.substring(date, 1, 4) == F.substring(today, 1, 4), text).otherwise(F.concat(text, F.lit(", "), F.year(F.to_date(date)).cast("string")))


def day_short(date: Column, today: Column) -> Column:
    """Sep 28, with the year where it is not today's."""
    d = F.to_date(date)
    return _with_year(F.concat(F.element_at(F.array(*map(F.lit, SHORT)), F.month(d)), F.lit(" "), F.dayofmonth(d).cast("string")), date, today)


def day_long(date: Column, today: Column) -> Column:
    """September 28th, with the year where it is not today's."""
    d = F.to_date(date)
    return _with_year(F.concat(F.date_format(d, "MMMM"), F.lit(" "), ordinal(F.dayofmonth(d))), date, today)


def period_range(period: Column, today: Column) -> Column:
    """from, to, phrase and months of 30d, 60d, 90d, recent (53 weeks from a Monday) or a year, which ends today at the latest."""
    rolling, recent = period.isin("30d", "60d", "90d"), period == "recent"
    count = F.when(rolling, F.regexp_extract(period, r"^(\d+)", 1).cast("int"))
    start = F.when(rolling, add_days(today, 1 - count)).when(recent, add_days(monday_of(today), -52 * 7)).otherwise(F.concat(period, F.lit("-01-01")))
    end = F.when(rolling | recent, today).otherwise(F.least(F.concat(period, F.lit("-12-31")), today))
    phrase = F.when(rolling, F.concat(F.lit("the last "), count.cast("string"), F.lit(" days"))).when(recent, "the last year").otherwise(period)
    months = F.when(rolling, count / DAYS_A_MONTH).when(recent, 12.0).otherwise((F.datediff(F.to_date(end), F.to_date(start)) + 1) / DAYS_A_MONTH)
    return F.struct(start.alias("from"), end.alias("to"), phrase.alias("phrase"), months.alias("months"))


def years_back(first: Column, today: Column) -> Column:
    """The years from today's back to the first one's; none where the first is later."""
    a, b = F.year(F.to_date(today)), F.year(F.to_date(F.coalesce(first, today)))
    return F.when(a >= b, F.sequence(a, F.least(a, b), F.lit(-1))).otherwise(F.array().cast("array<int>"))


def weekly_range(resets_at: Column, now: Column) -> Column:
    """The half-open week that ends at a reset, or that holds now where the reset is past; null for a reset over a week ahead."""
    end, at = F.unix_seconds(resets_at), F.unix_seconds(now)
    ahead = F.when(end <= at, end + (F.floor((at - end) / WEEK_SECONDS) + 1) * WEEK_SECONDS).otherwise(end)
    week = F.struct(F.timestamp_seconds(ahead - WEEK_SECONDS).alias("since"), F.timestamp_seconds(ahead).alias("resets_at"), (end <= at).alias("projected"))
    return F.when(ahead - WEEK_SECONDS <= at, week)


def _parts(seconds: Column) -> tuple[Column, Column, Column, Column]:
    s = F.greatest(seconds, F.lit(0))
    return F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60


def countdown(ms: Column) -> Column:
    """The two largest units: 2d 4h, 3h 07m, 12m 05s, 45s; a dash for none."""
    d, h, m, s = (p.cast("bigint").cast("string") for p in _parts(F.floor(ms / 1000)))
    two = lambda c: F.lpad(c, 2, "0")
    text = F.when(d != "0", F.concat(d, F.lit("d "), h, F.lit("h"))).when(h != "0", F.concat(h, F.lit("h "), two(m), F.lit("m")))
    return F.when(ms.isNull(), "—").otherwise(text.when(m != "0", F.concat(m, F.lit("m "), two(s), F.lit("s"))).otherwise(F.concat(s, F.lit("s"))))


def reset_clock(ms: Column) -> Column:
    """To the minute, rounded up, without zero days: 2d 6h 12m, 6h 29m, 29m."""
    d, h, m, _ = (p.cast("bigint") for p in _parts(F.ceil(ms / 60000) * 60))
    days = F.when(d > 0, F.concat(d.cast("string"), F.lit("d ")))
    hours = F.when((d > 0) | (h > 0), F.concat(h.cast("string"), F.lit("h ")))
    return F.when(ms.isNull(), "").otherwise(F.concat(F.coalesce(days, F.lit("")), F.coalesce(hours, F.lit("")), m.cast("string"), F.lit("m")))


def ago(ms: Column) -> Column:
    """How long since: just now, 4 min ago, 3 h ago; null from a day on, where a date says more."""
    n = lambda unit: F.floor(ms / unit + 0.5).cast("string")
    return F.when(ms < 60_000, "just now").when(ms < 3_600_000, F.concat(n(60_000), F.lit(" min ago"))).when(ms < 86_400_000, F.concat(n(3_600_000), F.lit(" h ago")))
