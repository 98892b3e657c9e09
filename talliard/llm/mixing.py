"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's target is its weight's share of all words, but at most EPOCHS times its size; what is cut off goes to
the others by weight. Targets are counted in blocks of equal size, sources with much smaller targets in smaller ones,
so that small sources are met and large ones are not cut into single words. Blocks of one size are dealt to their sources
by the highest quotients weight / (2 seats + 1), and each source's blocks to its shards in the same way, which gives
every shard an integer quota. A shard lays its documents end to end in a seeded order and cuts them into equal blocks; a
quota takes all blocks as often as it can, and the rest by a seeded walk through the blocks.

The apportionment never ranks all quotients: bounds on the divisor give every party the seats that it has in any
case, so only about two seats a party are left to rank. Shards hold about SHARD_WORDS words, however large a
source is, so no window sees more. Windows over the sources are of one row a source, those over a source's shards
of about two rows a shard.

Null sources are a source of their own, last in order. Null and empty texts have size 0 and nothing taken. Sources
without words have target 0. Ties in quotients go to the earlier source or shard. Repeated rows count each; rows
with equal doc_id, source and size may swap their results. An empty table gives an empty result. Other columns pass
through, those that clash with a result's name are replaced.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talliard.llm.common import WORD, hidden, n_words, shown
from talliard.tables import table

EPOCHS = 3
SEED = 17
SHARD_WORDS = 1 << 19
#: A source's blocks are of the power of two below its target's BLOCKS-th part, from one word to BLOCK_WORDS.
BLOCKS, BLOCK_WORDS = 128, 4096
WEIGHTS = (1, 2, 3)


def targets(sized: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, ord, source_size, target, block) of sources, from rows with source and size."""
    every, below, above = Window.partitionBy(), Window.orderBy("ratio", "ord").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("ratio", "ord").rowsBetween(0, Window.unboundedFollowing)
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.col("ord") - 1) % len(weights) + 1).cast("int"))
    share = F.when(F.col("level") * F.col("weight") > F.col("most"), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", cycle.cast("double"))
        .withColumn("most", epochs * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("left_over", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(below), F.lit(0.0)))
        .withColumn("rate", F.col("left_over") / F.sum("weight").over(above))
        .withColumn("level", F.coalesce(F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "ord", "rate"))).over(every)["rate"], F.lit(0.0)))
        .withColumn("target", share)
        .withColumn("block", F.expr(f"cast(least({BLOCK_WORDS}, if(target >= {2 * BLOCKS}, power(2, floor(log2(target / {BLOCKS}))), 1)) as long)"))
        .select("source", "ord", "source_size", "target", "block")
    )


def sainte_lague(parties: DataFrame, within: list[str], order: str, weight: str, seats: str, out: str) -> DataFrame:
    """parties with out, the seats that the highest quotients give each; weight and seats are columns, seats equal within a group."""
    group, ranked = Window.partitionBy(*within), Window.partitionBy(*within).orderBy(F.desc("_q"), order)
    n, total = F.count(F.when(F.col(weight) > 0, 1)).over(group), F.sum(weight).over(group)
    surely = lambda d: F.when((F.col(weight) > 0) & (F.col(d) > 0), F.floor((F.col(weight) * F.col(d) / F.col("_total") + 1) / 2)).otherwise(0).cast("long")
    bounds = (
        parties.withColumn("_total", total.cast("double"))
        .withColumn("_few", 2.0 * F.col(seats) - n)
        .withColumn("_many", 2.0 * F.col(seats) + n)
        .withColumn("_low", F.when(F.col("_few") > 0, F.greatest(surely("_few") - 1, F.lit(0))).otherwise(0).cast("long"))
        .withColumn("_high", surely("_many") + 1)
        .withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    )
    ranked_seats = (
        bounds.where(f"{weight} > 0").withColumn("_seat", F.explode(F.expr("sequence(_low, _high)")))
        .withColumn("_q", F.col(weight) / (2 * F.col("_seat") + 1))
        .withColumn("_rank", F.row_number().over(ranked))
        .where("_rank <= _open").groupBy(*within, order).agg(F.count("*").alias("_more"))
    )
    return (
        bounds.join(ranked_seats, [*within, order], "left")
        .withColumn(out, F.col("_low") + F.coalesce("_more", F.lit(0)))
        .drop("_total", "_few", "_many", "_low", "_high", "_open", "_more")
    )


def _sized(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """docs under hidden names with size, source_size, target, taken, and epochs and runs of words that are taken; and the names."""
    rows, names = hidden(docs)
    doc_id, source = F.col(names["doc_id"]), names["source"]
    rows = rows.withColumn("size", n_words(names[text]))
    goal = targets(rows.select(F.col(source).alias("source"), "size"))
    near = rows.join(goal, F.col(source).eqNullSafe(F.col("source"))).drop("source")
    near = near.withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), doc_id, names[text]), F.ceil((F.col("source_size") + 1) / SHARD_WORDS)))
    shards = near.groupBy("ord", "shard", "source_size", "target", "block").agg(F.sum("size").alias("words"))
    shards = shards.withColumn("n_blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / F.col("block")))).otherwise(0).cast("long"))
    wanted = shards.groupBy("ord", "block").agg(F.sum("n_blocks").alias("all_blocks"), F.max(F.struct("target", "source_size")).alias("t")).selectExpr("ord", "block", "all_blocks", "if(t.source_size > 0, t.target / t.source_size * all_blocks, 0D) as share")
    wanted = wanted.withColumn("_seats", F.round(F.sum("share").over(Window.partitionBy("block"))).cast("long"))
    dealt = sainte_lague(wanted, ["block"], "ord", "share", "_seats", "_blocks").selectExpr("ord", f"least(_blocks, {EPOCHS} * all_blocks) as source_blocks")
    quota = sainte_lague(shards.join(dealt, "ord"), ["ord"], "shard", "n_blocks", "source_blocks", "quota")
    quota = quota.select("ord", "shard", "words", "n_blocks", "quota").where("n_blocks > 0")
    order = Window.partitionBy("ord", "shard").orderBy(F.xxhash64(F.lit(SEED + 1), doc_id, names[text]), doc_id, "size").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        near.withColumn("first_word", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .join(quota, ["ord", "shard"], "left")
        .withColumn("epochs", F.when(F.col("size") > 0, F.expr("quota div n_blocks")).otherwise(0).cast("long"))
        .withColumn("step", F.expr("if(n_blocks % 1000003 = 0, 1000033L, 1000003L)"))
        .withColumn("walk", F.pmod(F.xxhash64(F.lit(SEED + 2), "ord", "shard"), F.col("n_blocks")))
        .withColumn("runs", F.expr("""case when size > 0 and quota % n_blocks > 0 then filter(transform(filter(
            sequence(greatest(first_word * n_blocks div words - 1, 0), least((first_word + size) * n_blocks div words + 1, n_blocks - 1)),
            i -> (i * step + walk) % n_blocks < quota % n_blocks),
            i -> struct(greatest(i * words div n_blocks, first_word) - first_word as start, least((i + 1) * words div n_blocks, first_word + size) - first_word as end)),
            r -> r.start < r.end) else array() end"""))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.expr("aggregate(runs, 0L, (a, r) -> a + r.end - r.start)"))
    )
    return found, names


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes, repeats counted)."""
    found, names = _sized(docs, text)
    results = ["size", "source_size", "target", "taken"]
    return found.select(*shown(names, *results), *results)


def mixed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself, with the columns of docs: a row for every copy of a whole text, and one for the words of a part, joined by spaces."""
    found, names = _sized(docs, text)
    whole_text = F.col(names[text])
    part = F.expr(f"array_join(flatten(transform(runs, r -> slice(regexp_extract_all({names[text]}, '{WORD.replace(chr(92), chr(92) * 2)}', 0), cast(r.start as int) + 1, cast(r.end - r.start as int)))), ' ')")
    copies = F.concat(F.expr("if(epochs > 0, array_repeat(true, cast(epochs as int)), array())"), F.expr("if(size(runs) > 0, array(false), array())"))
    whole = F.col("whole") | (F.col("taken") - F.col("epochs") * F.col("size") == F.col("size"))
    out = found.withColumn("whole", F.explode(copies)).withColumn(names[text], F.when(whole, whole_text).otherwise(part))
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.length(names[text]).cast("long"))
    return out.select(*shown(names))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
