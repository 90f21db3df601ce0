"""Order statistics that no single task computes alone: exact quantiles by group, and ranks and running sums over all rows.

Values of large groups are dealt to shards that keep their order. Counts by shard are small and
tell what comes before each shard; only inside a shard are rows sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.sources.written import written

#: shards for a factor of e in the value: a shard's values lie within 1.6 %
PER_E = 64
#: values up to which a group is sorted whole, by one task
WHOLE = 1 << 17
#: rows that are dealt to one task
SHARE = 1 << 20
UP_TO_BEFORE = (Window.unboundedPreceding, -1)


def shard_of(value: Column) -> Column:
    """A number that never falls as the value grows; some 900 of them for values from 1 to a million."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * PER_E)).cast("bigint")


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """left joined to right on keys, null keys being equal; one-row frames if there are no keys. A broadcast hint on right holds."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row by one row
    other = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, on, how).drop(*(f"_{k}" for k in keys))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df's rows dealt by keys to so many tasks that each gets SHARE of them, however many the session asks for."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARE)), *keys)


def exact_quantiles(df: DataFrame, keys: Sequence[str], column: str, qs: dict[str, float]) -> DataFrame:
    """(keys, a column for each of qs): exact, linearly interpolated quantiles of the column's non-null values by keys, which may be null; groups without values are left out.

    Groups of up to WHOLE values are dealt to tasks as they are and sorted there: one
    shuffle. Of larger ones, equal values of a group are counted first. From the counts by shard
    follows in which shard each quantile's two neighbours lie; the values of these
    shards alone are sorted, each shard by itself, so that a group of any size
    costs no task more than a shard of it. df is read for the groups' sizes first, so it should be cheap to read, as once() makes it.
    """
    own = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    counted = lambda rows: rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    if not keys:
        return quantiles_of_counts(counted(own), keys, qs)
    sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    told = {r["large"]: r["rows"] for r in sizes.groupBy((F.col("_m") > WHOLE).alias("large")).agg(F.sum("_m").alias("rows")).collect()}  # two rows at most
    if True not in told:
        return quantiles_of_groups(dealt(own, told.get(False, 0), *keys), keys, qs)
    if False not in told:
        return quantiles_of_counts(counted(own), keys, qs)
    large = F.broadcast(sizes.where(F.col("_m") > WHOLE).drop("_m"))  # one row for WHOLE of df's at most
    small = quantiles_of_groups(dealt(beside(own, large, keys, "left_anti"), told[False], *keys), keys, qs)
    return small.unionByName(quantiles_of_counts(counted(beside(own, large, keys, "left_semi")), keys, qs))


def quantiles_of_groups(own: DataFrame, keys: Sequence[str], qs: dict[str, float]) -> DataFrame:
    """exact_quantiles of values (keys, _v), which may come with their numbers _n, dealt by keys, each group sorted by one task."""
    group = Window.partitionBy(*keys)
    if "_n" in own.columns:
        before = F.coalesce(F.sum("_n").over(group.orderBy("_v").rowsBetween(*UP_TO_BEFORE)), F.lit(0))
        placed = own.withColumns({"_first": before, "_all": F.sum("_n").over(group)}).withColumn("_last", F.col("_first") + F.col("_n") - 1)
    else:
        placed = own.withColumns({"_first": F.row_number().over(group.orderBy("_v")) - 1, "_all": F.count(F.lit(1)).over(group)}).withColumn("_last", F.col("_first"))
    return _between(placed, keys, _places(qs))


def _places(qs: dict[str, float]) -> dict[str, Column]:
    """Where in a group of _all values each quantile lies."""
    return {name: q * (F.col("_all") - 1) for name, q in qs.items()}


def _between(placed: DataFrame, keys: Sequence[str], place: dict[str, Column]) -> DataFrame:
    """Quantiles from values (keys, _v, _all) that stand at the places _first to _last."""
    at_place = lambda p: F.max(F.when(p.between(F.col("_first"), F.col("_last")), F.col("_v")))
    ends = [c for name, at in place.items() for c in (at_place(F.floor(at)).alias(f"_lo_{name}"), at_place(F.ceil(at)).alias(f"_hi_{name}"))]
    found = placed.groupBy(*keys).agg(F.max("_all").alias("_all"), *ends)
    out = []
    for name, at in place.items():
        lo, hi, up = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.ceil(at)
        out.append(F.when(lo == hi, lo).otherwise((up - at) * lo + (at - F.floor(at)) * hi).alias(name))
    return found.select(*keys, *out)


def quantiles_of_counts(counted: DataFrame, keys: Sequence[str], qs: dict[str, float]) -> DataFrame:
    """exact_quantiles of values (keys, _v) that come with their numbers _n, each value once for its keys."""
    sized = counted.groupBy(*keys, shard_of(F.col("_v")).alias("_s")).agg(F.sum("_n").alias("_m"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_m").over(group.orderBy("_s").rowsBetween(*UP_TO_BEFORE)), F.lit(0))
    sized = sized.withColumns({"_before": before, "_all": F.sum("_m").over(group)})
    place = _places(qs)
    wanted = F.lit(False)
    for at in place.values():
        wanted = wanted | ((F.floor(at) < F.col("_before") + F.col("_m")) & (F.ceil(at) >= F.col("_before")))
    near = beside(counted.withColumn("_s", shard_of(F.col("_v"))), sized.where(wanted).drop("_m"), [*keys, "_s"], "inner")
    run = F.col("_before") + F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(*UP_TO_BEFORE)), F.lit(0))
    placed = near.withColumn("_first", run).withColumn("_last", F.col("_first") + F.col("_n") - 1)
    return _between(placed, keys, place)


def with_quantiles(stats: DataFrame, df: DataFrame, keys: Sequence[str], column: str, qs: dict[str, float]) -> DataFrame:
    """stats, one row for each of keys in df, with the quantiles; null for groups without values."""
    return beside(stats, exact_quantiles(df, keys, column, qs), keys)


def in_ranges(totals: DataFrame, group: Sequence[str]) -> DataFrame:
    """totals, written, with `_s`: numbers of ranges that keep the order by group, falling total and name. Ranges are cut by sampled rows, so that equal totals too are parted, by name."""
    spark = totals.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = totals.repartitionByRange(parts, *group, F.col("total").desc(), F.col("name"))
    return written(dealt.withColumn("_s", F.spark_partition_id()), "ranges")


def ranked(totals: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rows (group, name, total) with rank, run (sum of totals up to and with the row), n and all (rows and sum of the group): largest total first, then name.

    Sums are decimal, so they don't hang on the order of addition. Rows are dealt to ranges; what comes before
    a range follows from counts and sums by range, and only a range is sorted in one task.
    """
    t = in_ranges(totals, group).withColumn("_d", F.col("total").cast("decimal(38,2)"))
    shards = t.groupBy(*group, "_s").agg(F.count(F.lit(1)).alias("_m"), F.sum("_d").alias("_t"))
    whole, down = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("_s").rowsBetween(*UP_TO_BEFORE)
    earlier = shards.select(
        *group, "_s", F.coalesce(F.sum("_m").over(down), F.lit(0)).alias("_ranks"), F.coalesce(F.sum("_t").over(down), F.lit(0)).alias("_sums"), F.sum("_m").over(whole).alias("n"), F.sum("_t").over(whole).cast("double").alias("all")
    )
    inside = Window.partitionBy(*group, "_s").orderBy(F.col("total").desc(), "name")
    made = beside(t, earlier, [*group, "_s"])
    run = (F.col("_sums") + F.sum("_d").over(inside.rowsBetween(Window.unboundedPreceding, 0))).cast("double")
    return made.select(*group, "name", "total", (F.col("_ranks") + F.row_number().over(inside)).cast("bigint").alias("rank"), run.alias("run"), "n", "all")
