"""Ranks, quantiles, running moments and neighbours in an order, without one task seeing a whole group.

Rows are range-partitioned by group and order; what lies before a partition (its
offsets) comes from one small row for each partition and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.scratch import Scratch


def _sorted(df: DataFrame, keys: Sequence[str], scratch: Scratch) -> DataFrame:
    """``df`` written in order, with the partition ``__pid`` and the place ``__at`` in it of each row."""
    mid = F.monotonically_increasing_id()
    return scratch.write(df.sort(*keys).withColumn("__pid", F.shiftright(mid, 33)).withColumn("__at", mid.bitwiseAND(F.lit((1 << 33) - 1))), "sorted")


def dense_ids(df: DataFrame, keys: list[str], name: str, start: Column | int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Consecutive numbers in the order of unique ``keys``, without one task seeing all rows.

    A range-partitioned sort numbers rows inside each partition; the partitions'
    counts (one row each) give the offsets.
    """
    local = _sorted(df, keys, scratch or Scratch(df.sparkSession, "ids"))
    sizes = local.groupBy("__pid").agg(F.count("*").alias("__c"))
    before = sizes.select("__pid", (F.sum("__c").over(Window.orderBy("__pid")) - F.col("__c")).alias("__before"))
    base = start if isinstance(start, Column) else F.lit(start)
    return local.join(F.broadcast(before), "__pid").withColumn(name, F.col("__before") + F.col("__at") + base).drop("__pid", "__at", "__before")  # one row a partition is broadcast


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by, n, q0, q1, ...``: exact quantiles with linear interpolation, as of ``percentile``.

    Equal values are counted first, so a value that holds a third of all rows is
    one row; counts are then summed up along the order.  Nulls are left out; a
    group of nulls alone gives no row.
    """
    tmp, by = Scratch(df.sparkSession, "quantiles"), list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    local = _sorted(counts, [*by, "__v"], tmp)
    here = local.groupBy("__pid", *by).agg(F.sum("__c").alias("__s"))
    each = Window.partitionBy(*by)  # a group's partitions, one row each
    here = here.withColumn("__before", F.sum("__s").over(each.orderBy("__pid")) - F.col("__s")).withColumn("n", F.sum("__s").over(each))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}"))
    run = F.sum("__c").over(Window.partitionBy("__pid", *by).orderBy("__v"))  # never beyond a partition
    rows = local.withColumn("__run", run).alias("l").join(here.alias("h"), same & (F.col("l.__pid") == F.col("h.__pid")))
    last = F.col("__before") + F.col("__run")  # ranks before this one
    at = lambda rank: F.max(F.when((rank >= last - F.col("__c")) & (rank < last), F.col("__v")))
    aggs = []
    for k, p in enumerate(probs):
        aggs += [at(F.floor((F.col("n") - 1) * F.lit(p))).alias(f"lo{k}"), at(F.ceil((F.col("n") - 1) * F.lit(p))).alias(f"hi{k}")]
    got = rows.groupBy(*[F.col(f"l.{c}").alias(c) for c in by], "n").agg(*aggs)
    out = []
    for k, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(p)
        out.append((F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (pos - F.floor(pos))).alias(f"q{k}"))
    return got.select(*by, "n", *out)


def running_moments(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``by, order, n, mean, var``: moments of each row's group up to it, in order; nulls of ``value`` do not count.

    A group of any size is spread over the range partitions; only its partitions'
    sums (one row each) meet in one task.
    """
    tmp = Scratch(df.sparkSession, "running")
    local = _sorted(df.select(by, order, F.col(value).cast("double").alias("__x")), [by, order], tmp)
    w = Window.partitionBy("__pid", by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    sums = lambda how: [how(F.count("__x")), how(F.coalesce(F.sum("__x"), F.lit(0.0))), how(F.coalesce(F.sum(F.col("__x") * F.col("__x")), F.lit(0.0)))]
    totals = local.groupBy("__pid", by).agg(*[c.alias(f"__t{k}") for k, c in enumerate(sums(lambda c: c))])
    ahead = Window.partitionBy(by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__pid", by, *[F.coalesce(F.sum(f"__t{k}").over(ahead), F.lit(0)).alias(f"__b{k}") for k in range(3)])
    count = lambda c, name: F.coalesce(c.over(w), F.lit(0.0)).alias(name)
    rows = local.select("__pid", by, order, count(F.count("__x"), "__r0"), count(F.sum("__x"), "__r1"), count(F.sum(F.col("__x") * F.col("__x")), "__r2"))
    j = rows.alias("l").join(before.alias("b"), (F.col("l.__pid") == F.col("b.__pid")) & F.col(f"l.{by}").eqNullSafe(F.col(f"b.{by}")))
    n, s, q = (F.col(f"__b{k}") + F.col(f"__r{k}") for k in range(3))
    mean, square = F.try_divide(s, n), F.try_divide(q, n)
    return j.select(F.col(f"l.{by}").alias(by), order, n.cast("long").alias("n"), mean.alias("mean"), F.when(n > 0, F.greatest(square - mean * mean, F.lit(0.0))).alias("var"))


def next_rows(df: DataFrame, by: str, order: Sequence[str], columns: Sequence[str], back: bool = False) -> DataFrame:
    """Each row of ``df`` with ``next_<column>`` of the following row of its group (null at the end).

    With ``back`` also ``prev_<column>`` of the one before.  Rows are numbered in
    one global order and met with their neighbours by an equi-join on unique
    numbers; ``order`` must be unique within a group for a defined result.
    """
    tmp = Scratch(df.sparkSession, "next")
    r = tmp.write(dense_ids(df, [by, *order], "__r", 0, tmp), "numbered")
    out, added = r, []
    for tag, step in (("next", 1), ("prev", -1))[: 1 + back]:
        side = r.select((F.col("__r") - step).alias("__r"), F.col(by).alias(f"__by_{tag}"), *[F.col(c).alias(f"__{tag}_{c}") for c in columns])
        out = out.join(side, "__r", "left")
        added += [F.when(F.col(f"__by_{tag}").eqNullSafe(F.col(by)), F.col(f"__{tag}_{c}")).alias(f"{tag}_{c}") for c in columns]
    return out.select(*df.columns, *added)
