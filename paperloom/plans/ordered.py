"""Ordered computations that survive a hot key.

A window sends one key's rows to one task, which is right while no key holds much of the table. Which keys do is told by a sketch:
one row from each of a fixed number of hash buckets, a fair sample of bounded size however large the table. A key that turns up often
in it is cut into slices at its own sampled places, so a row's slice is a function of its key and order alone. Slices are windowed like
groups of their own; what the slices ahead contribute (a count, a sum, a last value) comes in as one header row ahead of each.

All of it is one lazy plan: nothing is counted or written beforehand, and where no key is hot the slicing branch is empty and drops out.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.plans.session import shuffle_width

#: Sampled rows for each shuffle partition, and at most: the bound of what is broadcast.
PER_PARTITION, MOST = 16, 65_536
#: Only one row in so many is looked at for the sample.
THIN = 64
#: A key with so many sampled rows is hot: it holds about half of an average partition, or more.
HOT = 8

_SLICE = "_slice"


def _cuts(places: Column, size: int) -> Column:
    """Sorted places in groups of about the root of *size*, with the first of each, so that a search reads two short arrays."""
    r = math.isqrt(size - 1) + 1
    ordered = F.sort_array(places)
    groups = F.filter(F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda i: F.slice(ordered, i * r + 1, r)), lambda g: F.size(g) > 0)
    return F.struct(F.transform(groups, lambda g: F.get(g, F.lit(0))).alias("heads"), groups.alias("groups"))


def _slice_of(place: Column, cuts: Column, size: int) -> Column:
    """How many of the cuts lie at or before *place*."""
    r = math.isqrt(size - 1) + 1
    group = F.size(F.filter(cuts["heads"], lambda p: p <= place))
    inside = F.size(F.filter(F.get(cuts["groups"], group - 1), lambda p: p <= place))
    return F.coalesce(F.when(group > 0, (group - 1) * r + inside), F.lit(0)).cast("int")


def _sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """(_s: key and place): of each hash bucket the row with the smallest hash."""
    mark = F.xxhash64(*keys, *order)
    row = F.struct(F.struct(F.lit(0).alias("_"), *keys).alias("key"), F.struct(*order).alias("place"))
    thin = df.select(row.alias("_s"), mark.alias("_mark")).filter(F.pmod("_mark", F.lit(THIN)) == 0)
    bucket = F.pmod(F.shiftright("_mark", THIN.bit_length() - 1), F.lit(size))
    return thin.groupBy(bucket.alias("_bucket")).agg(F.min_by("_s", "_mark").alias("_s"))


def _hot_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """(_k0, _k1, ..., _cuts) of the hot keys: at most size / HOT rows, which hold at most *size* places."""
    found = _sample(df, keys, order, size).groupBy("_s.key").agg(F.count(F.lit(1)).alias("_n"), _cuts(F.collect_list("_s.place"), size).alias("_cuts"))
    return found.filter(F.col("_n") >= HOT).select(*[F.col("key")[k].alias(f"_k{i}") for i, k in enumerate(keys)], "_cuts")


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], how: str = "left") -> DataFrame:
    """*df* with its slice number: 0 where the key is not hot. *how* = "inner" leaves only the rows of hot keys, "left_anti" the others.

    *order* must be total within a key: then no slice holds more than its share of the rows, even where one key holds a third of
    them. Without keys all rows are sliced.
    """
    size = min(PER_PARTITION * max(shuffle_width(df.sparkSession), 2), MOST)
    place = F.struct(*order)
    if not keys:
        cuts = _sample(df, keys, order, size).agg(_cuts(F.collect_list("_s.place"), size).alias("_cuts")).scalar()
        return df.withColumn("_cuts", cuts).withColumn(_SLICE, _slice_of(place, F.col("_cuts"), size)).drop("_cuts")
    hot = F.broadcast(_hot_keys(df, keys, order, size))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = df.join(hot, same, how)  # the same plan wherever it is used, so Spark works it out once
    if how == "left_anti":
        return joined.withColumn(_SLICE, F.lit(0))
    return joined.withColumn(_SLICE, _slice_of(place, F.col("_cuts"), size)).drop("_cuts", *(f"_k{i}" for i in range(len(keys))))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    rank: str | None = None,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns over *keys* in ascending *order*, which is total within a key.

    Args:
        rank: name of a 1-based position column.
        sums: inclusive running sums.
        lasts: last non-null value up to and including the row.
        lags: the row before's value, null on a key's first row.
    """
    sums, lasts, lags = dict(sums or {}), dict(lasts or {}), dict(lags or {})
    inputs = {f"_in_{name}": value for group in (sums, lasts, lags) for name, value in group.items()}
    rows = df.withColumns(inputs) if inputs else df
    headers = _headers(sliced(rows, keys, order, "inner"), keys, order, sums, lasts, lags)
    data = sliced(rows, keys, order).withColumns({"_rows": F.lit(1).cast("long"), "_head": F.lit(False)})
    both = data.unionByName(headers.withColumn("_head", F.lit(True)), allowMissingColumns=True)

    by = W.partitionBy(*keys, _SLICE).orderBy(F.col("_head").desc(), *order)
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    added = {name: F.sum(f"_in_{name}").over(so_far) for name in sums}
    added |= {name: F.last(f"_in_{name}", ignorenulls=True).over(so_far) for name in lasts}
    added |= {name: F.lag(f"_in_{name}").over(by) for name in lags}
    if rank:
        added[rank] = F.sum("_rows").over(so_far)
    kept = [c for c in df.columns if c not in added]
    return both.withColumns(added).filter(~F.col("_head")).select(*kept, *added)


def _headers(rows: DataFrame, keys, order, sums, lasts, lags) -> DataFrame:
    """One row per slice of a hot key: how many rows its earlier slices hold, their sums and their last values."""
    place = F.struct(*order)
    totals = [F.count(F.lit(1)).alias("_rows")]
    totals += [F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums]
    totals += [F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), place)).alias(f"_in_{n}") for n in lasts]
    totals += [F.max_by(F.struct(F.col(f"_in_{n}").alias("v")), place).alias(f"_in_{n}") for n in lags]
    per_slice = rows.groupBy(*keys, _SLICE).agg(*totals)
    earlier = W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    return per_slice.select(
        *keys,
        _SLICE,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
        *[F.sum(f"_in_{n}").over(earlier).alias(f"_in_{n}") for n in sums],
        *[F.last(f"_in_{n}", ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in lasts],
        *[F.last(f"_in_{n}").over(earlier)["v"].alias(f"_in_{n}") for n in lags],
    )


def top_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first *n* rows of each group with their rank.

    Spark turns the rank filter into a group limit that runs before the shuffle, so a hot group sends
    at most *n* rows per task.
    """
    by = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) <= n)
