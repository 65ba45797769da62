"""Revenue summary of order lines by status flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pricing_summary(lineitem: DataFrame) -> DataFrame:
    """Discounted revenue and line count for each (l_returnflag, l_linestatus).

    Money is summed as decimals, so the total doesn't depend on row order. Null
    flags form their own group; lines with a null price or discount count but
    add nothing; an empty table gives no rows.
    """
    revenue = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(revenue).cast("decimal(18,4)").alias("revenue"), F.count(F.lit(1)).alias("n_lines")
    )
