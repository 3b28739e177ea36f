"""Row numbers of large groups without bringing a group together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_in_cells(df: DataFrame, keys: list[str], cell: Column, order: list[Column | str], out: str = "rn") -> DataFrame:
    """`out`: 1-based number of each row within `keys`, in the order of `cell` and then of `order`.

    `cell` must not fall where the order rises. Rows are sorted within (keys, cell) only;
    the numbers go on from the counts of the cells before, a row for each cell. A key of
    any size is so spread over as many tasks as it has cells. Null keys or cells are one each.
    """
    df = df.withColumn("_cell", cell)
    sizes = df.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = [*keys, "_cell"]
    sizes = sizes.select(*(F.col(k).alias(f"_{k}_") for k in names), before.alias("_before"))
    placed = df.withColumn("_at", F.row_number().over(W.partitionBy(*names).orderBy(*order)))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in names]
    return placed.join(sizes, on).withColumn(out, (F.col("_before") + F.col("_at")).cast("int")).select(*(c for c in df.columns if c != "_cell"), out)
