"""Order over whole tables: rows dealt by range to stored partitions, with what lies before each of them.

No group has to fit a task: a group that spans partitions is worked on in each of them, and a table of one row
for each group and partition carries what its earlier parts hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlab.plans.scratch import kept


def dealt(df: DataFrame, order: list, part: str = "part", parts: int | None = None) -> DataFrame:
    """``df`` in ascending ``order`` over ``parts`` partitions, stored with the number of each row's partition.

    The bounds come from a sample, so the table is stored: all that reads it sees the same partitions. ``df`` is read twice.
    """
    n = parts or max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return kept(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on keys of which null equals null; columns of ``left``, then the others of ``right``."""
    other = right.select(*[F.col(k).alias(f"{k}__other") if k in keys else F.col(k) for k in right.columns])
    on: Column | None = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"{k}__other"))
        on = equal if on is None else on & equal
    return left.join(other, on, how).drop(*[f"{k}__other" for k in keys])


def positions(df: DataFrame, order: list, within: list[str] | None = None, name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 1) in ``order`` within its group of ``within``; without one, in the whole table.

    Rows that are equal in ``order`` get different places in no stated order, so end ``order`` with a unique column.
    """
    within = within or []
    rows = dealt(df, [*within, *order], "__part")
    counts = rows.groupBy("__part", *within).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition that a group reaches
    before = counts.select("__part", *within, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part", *within).orderBy(*order))
    return same(rows.withColumn(name, own), before, ["__part", *within]).withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


#: Rows of a group up to which a task takes it whole.
LONG_GROUP = 1_000_000


def scan(df: DataFrame, part: list[str], order: list[str], columns: list[str], flag: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], long_group: int = LONG_GROUP) -> DataFrame:
    """``df`` with what a walk through each group of ``part`` in ``order`` has met so far.

    ``flag(before, own)`` marks rows by ``columns`` of the row before (null at the start of a group) and of the row itself. Adds
    ``__before`` and ``__after`` (structs of ``columns`` of the neighbours; null at the ends), ``__flags`` (marked rows up to this one) and
    ``__since`` (rows after the last marked one; null before the first).

    Groups of up to ``long_group`` rows are windows. If there is a longer one, rows are dealt by range over stored
    partitions, each part of a group is walked through alone, and a table of one row for each part carries the
    last row, the marks and their places on to the parts behind it.
    """
    held = F.struct(*columns)
    # a partial count for each group
    largest = df.groupBy(*part).count().agg(F.max("count")).first()[0] or 0
    long = largest > long_group
    rows = dealt(df, [*part, *order], "__part") if long else df
    groups = ["__part", *part] if long else part
    own = Window.partitionBy(*groups).orderBy(*order)
    here = lambda name: F.col(name)
    back = lambda struct: (lambda name: F.col(f"{struct}.{name}"))
    rows = rows.withColumn("__before", F.lag(held).over(own)).withColumn("__after", F.lead(held).over(own)).withColumn("__n", F.row_number().over(own).cast("long"))
    rows = rows.withColumn("__flag", F.coalesce(flag(back("__before"), here), F.lit(False)))
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not long:
        rows = rows.withColumn("__flags", F.sum(F.col("__flag").cast("long")).over(so_far)).withColumn("__mark", F.max(F.when(F.col("__flag"), F.col("__n"))).over(so_far))
        return rows.withColumn("__since", F.col("__n") - F.col("__mark")).drop("__n", "__flag", "__mark")

    inner = F.col("__flag") & (F.col("__n") > 1)
    place = F.struct(*order)
    parts = rows.groupBy(*groups).agg(
        F.min_by(held, place).alias("__first"), F.max_by(held, place).alias("__last"), F.count("*").alias("__size"),
        F.count_if(inner).alias("__inner"), F.max(F.when(inner, F.col("__n"))).alias("__at"),
    )
    along = Window.partitionBy(*part).orderBy("__part")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__left", F.lag("__last").over(along)).withColumn("__right", F.lead("__first").over(along))
    parts = parts.withColumn("__opens", F.coalesce(flag(back("__left"), back("__first")), F.lit(False)))
    parts = parts.withColumn("__rows", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).withColumn("__count", F.coalesce(F.sum(F.col("__inner") + F.col("__opens").cast("long")).over(earlier), F.lit(0)))
    parts = parts.withColumn("__far", F.max(F.col("__rows") + F.coalesce("__at", F.when(F.col("__opens"), 1))).over(earlier))
    out = same(rows, parts.select(*groups, "__left", "__right", "__opens", "__rows", "__count", "__far", "__size"), groups)
    first = F.col("__n") == 1
    out = out.withColumn("__before", F.when(first, F.col("__left")).otherwise(F.col("__before"))).withColumn("__after", F.when(F.col("__n") == F.col("__size"), F.col("__right")).otherwise(F.col("__after")))
    out = out.withColumn("__flag", F.when(first, F.col("__opens")).otherwise(F.col("__flag"))).withColumn("__pos", F.col("__rows") + F.col("__n"))
    out = out.withColumn("__flags", F.col("__count") + F.sum(F.col("__flag").cast("long")).over(so_far))
    mark = F.greatest(F.max(F.when(F.col("__flag"), F.col("__pos"))).over(so_far), F.col("__far"))
    out = out.withColumn("__since", F.col("__pos") - mark)
    return out.drop("__part", "__n", "__flag", "__left", "__right", "__opens", "__rows", "__count", "__far", "__size", "__pos")
