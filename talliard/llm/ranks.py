"""Places of rows in an order, counted without any task that sees all of them."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talliard.llm.common import parts, stored


def _numbered(batches):
    """Rows with their partition and their number among the rows of their group in it."""
    import numpy as np
    from pyspark import TaskContext

    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column(batch.schema.get_field_index("grp"))
        codes = groups.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1))
        size = np.diff(np.concatenate((first, [len(codes)])))
        k = np.arange(len(codes)) - np.repeat(first, size)
        if groups[0].as_py() == last:
            k[: size[0]] += n
        last, n = groups[len(codes) - 1].as_py(), int(k[-1]) + 1
        more = [pa.array(np.full(len(codes), part), pa.int32()), pa.array(k, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "k"])


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """df, whose string column grp is never null, and pos: each row's place in its group by order, from 0.

    Rows are sorted by ranges of (group, order). A partition numbers its rows within their groups, and the counts of the
    partitions before are added for the one group that goes on from an earlier one. Rows come in runs of consecutive
    places. Equal rows are told apart by where they came from, so that they too are dealt over partitions.
    """
    spread = F.monotonically_increasing_id()
    ranged = df.withColumn("spread", spread).repartitionByRange(parts(df.sparkSession), F.asc("grp"), *order, "spread")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    numbered = stored(ranged.sortWithinPartitions("grp", *order).drop("spread").mapInArrow(_numbered, f"{fields}, part int, k long"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("grp", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before))
    carried = counts.where("before is not null").select("grp", "part", "before")  # a partition has one such group at most
    return numbered.join(F.broadcast(carried), ["grp", "part"], "left").withColumn("pos", F.col("k") + F.coalesce("before", F.lit(0))).drop("part", "k", "before")
