"""Account totals that a provider reports against what was recorded locally, over the whole history."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliard.operators.merge import newest


def reconcile(snapshots: DataFrame, ledger: DataFrame, coverage: DataFrame, today: str) -> DataFrame:
    """(date, source, acct, win, status, recovered): what each window lacks, dated by its last snapshot.

    snapshots: date, provider, source, acct, total_tokens, observed_at. ledger: date, source, acct, tokens, with an empty
    acct where it is uncertain. coverage: the dates that have a ledger. Closed days are one window an account, days from
    today on one each. Dates next to a window without a ledger make it pending; deficits beyond the sum a conflict.
    """
    latest = newest(snapshots, ["date", "source", "acct"], F.col("observed_at"), F.col("total_tokens")).withColumn("win", F.when(F.col("date") >= today, F.col("date")).otherwise("closed"))
    sums = ledger.groupBy("date", "source", "acct").agg(F.sum("tokens").alias("tokens"))
    local, uncertain = sums.where("acct <> ''"), sums.where("acct = ''").select("date", "source", F.col("tokens").alias("unsure"))
    joined = latest.join(local, ["date", "source", "acct"], "left").join(uncertain, ["date", "source"], "left").fillna(0, ["tokens", "unsure"])
    wins = joined.groupBy("source", "acct", "win").agg(
        F.min("date").alias("from_date"), F.max("date").alias("to_date"), F.sum("total_tokens").alias("reported"), F.sum(F.greatest(F.lit(0), F.expr("total_tokens - tokens - unsure"))).alias("deficits")
    )
    spine = wins.select("source", "acct", "win", F.explode(F.expr("sequence(date_sub(to_date(from_date), 1), date_add(to_date(to_date), 1))")).alias("d"), "from_date", "to_date").withColumn("date", F.date_format("d", "yyyy-MM-dd"))
    pending = spine.join(coverage.select("date"), "date", "left_anti").select("source", "acct", "win").distinct().withColumn("pending", F.lit(True))
    inside = spine.where("date between from_date and to_date").join(local, ["date", "source", "acct"], "left").join(uncertain, ["date", "source"], "left")
    matched = inside.groupBy("source", "acct", "win").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("matched"), F.coalesce(F.sum("unsure"), F.lit(0)).alias("uncertain"))
    gap = F.greatest(F.lit(0), F.expr("reported - matched - uncertain"))
    found = wins.join(matched, ["source", "acct", "win"]).join(pending, ["source", "acct", "win"], "left")
    status = F.when(F.col("pending"), "pending").when(F.col("deficits") > gap, "conflict").when(gap > 0, "recovered").otherwise("matched")
    return found.withColumn("status", status).select(
        F.col("to_date").alias("date"), "source", "acct", "win", *(F.col(c).cast("long").alias(c) for c in ("reported", "matched", "uncertain", "deficits")), "status",
        F.when(F.col("status") == "recovered", gap).otherwise(0).cast("long").alias("recovered"),
    )
