"""Global ranks without a task that sees all rows: a range-partitioned sort and the number of rows before each part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

_ROW_BITS = 33  # monotonically_increasing_id: number of the row within its part


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its place, from 1, in the global order; rows equal in all of ``order`` get neighbouring places.

    The rows are written once as they come, as the ranges are drawn from a sample that would compute them a second time, and
    once sorted, part by part.  Only the parts' sizes, a row each, pass through one place.
    """
    # The last key deals equal rows over several parts, however many there are.
    keys = [*order, F.col("_tie")]
    rows = stage(df).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    number = F.monotonically_increasing_id()
    rows = stage(rows.withColumn("_part", F.shiftright(number, _ROW_BITS).cast("int")).withColumn("_nth", number.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    before, sums = 0, []
    for row in sizes:
        sums.append((row["_part"], before))
        before += row["n"]
    parts = df.sparkSession.createDataFrame(sums, "_part int, _before long")
    return rows.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")
