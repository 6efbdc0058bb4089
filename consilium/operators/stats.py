"""Order statistics of groups of any size, from counts of distinct values.

The array functions in ``functions.numbers`` suit a row's handful of samples;
these suit keys that hold a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import EPSILON

#: Slices of a key's range that are summed before any of its values is ordered.
SLICES = 1024


def cells(rows: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """(keys, v, w): each distinct value of a key with its summed weight (rows, without one); nulls are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.sum(F.lit(1) if weight is None else weight).alias("w"))


def selected(counted: DataFrame, keys: Sequence[str], out: str, reached: Column) -> DataFrame:
    """(keys, out): the least ``v`` of each key at which ``reached`` holds, of ``upto`` (weights to it) and ``all``.

    Weights are summed by slices of the key's range first, and only the slice
    in which the condition comes true is ordered value by value.
    """
    span = counted.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("all"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / SLICES).otherwise(F.lit(1.0))
    placed = counted.join(span, list(keys)).withColumn("slice", F.least(F.lit(SLICES - 1), F.floor((F.col("v") - F.col("low")) / width)).cast("int"))
    by_slice = placed.groupBy(*keys, "slice", "all").agg(F.sum("w").alias("held"))
    run = by_slice.withColumn("upto", F.sum("held").over(Window.partitionBy(*keys).orderBy("slice")))
    first = run.where(reached).groupBy(*keys).agg(F.min(F.struct("slice", (F.col("upto") - F.col("held")).alias("before"))).alias("at"))
    inside = placed.join(first, list(keys)).where(F.col("slice") == F.col("at.slice"))
    ordered = inside.withColumn("upto", F.col("at.before") + F.sum("w").over(Window.partitionBy(*keys).orderBy("v")))
    return ordered.where(reached).groupBy(*keys).agg(F.min("v").alias(out))


def index_quantile(rows: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "value") -> DataFrame:
    """(keys, out): the sorted value at index min(n - 1, floor(q * n)) of each key, neither interpolated nor a discrete percentile."""
    if not 0 <= q <= 1:
        raise ValueError(f"quantile out of range: {q}")
    at = F.least(F.col("all") - 1, F.floor(F.lit(q) * F.col("all")))
    return selected(cells(rows, keys, value), keys, out, F.col("upto") > at)


def weighted_median(rows: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "value") -> DataFrame:
    """(keys, out): the first value in order at which the running weight reaches half."""
    return selected(cells(rows, keys, value, F.col(weight)), keys, out, F.col("upto") >= F.col("all") / 2)


def replicated_median(rows: DataFrame, keys: Sequence[str], value: str, times: str, out: str = "value") -> DataFrame:
    """(keys, out): the median of values that each count ``times``, with the mean of the two middle ones."""
    counted = cells(rows, keys, value, F.col(times))
    low = selected(counted, keys, "low_", F.col("upto") >= F.ceil(F.col("all") / 2))
    high = selected(counted, keys, "high_", F.col("upto") > F.floor(F.col("all") / 2))
    return low.join(high, list(keys)).select(*keys, ((F.col("low_") + F.col("high_")) / 2).alias(out))


def purity_median(rows: DataFrame, keys: Sequence[str], value: str, pure: Column, out: str = "value") -> DataFrame:
    """(keys, out, strict): the median of a key's pure values; of all of them where none is pure."""
    marked = rows.withColumn("__pure", F.coalesce(pure, F.lit(False))).withColumn("__one", F.lit(1))
    strict = replicated_median(marked.where("__pure"), keys, value, "__one", "strict_")
    loose = replicated_median(marked, keys, value, "__one", "loose_")
    return loose.join(strict, list(keys), "left").select(*keys, F.coalesce("strict_", "loose_").alias(out), F.col("strict_").isNotNull().alias("strict"))


def densest(rows: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """(keys, value, size, center): the median of the positive values within ``width`` of the centre that has most.

    Ties go to the smaller sum of log distances (to nine digits), then to the
    smaller centre.  Counts and sums of logarithms run along each key's sorted
    values once; a centre's neighbourhood is the difference of two of them.
    """
    counted = cells(rows.where(F.col(value) > 0), keys, value)
    own = counted.select(*keys, F.col("v").alias("x"), F.lit(1).alias("turn"), F.col("v").alias("c"), "w")
    edge = lambda x, turn: counted.select(*keys, x.alias("x"), F.lit(turn).alias("turn"), F.col("v").alias("c"), F.lit(0).cast("long").alias("w"))
    # at equal places a lower edge comes before the values, an upper edge after them
    every = own.unionByName(edge(F.col("v") * (1 - width), 0)).unionByName(edge(F.col("v") * (1 + width), 2))
    along = Window.partitionBy(*keys).orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = every.withColumn("count", F.sum("w").over(along)).withColumn("logs", F.sum(F.col("w") * F.ln("c")).over(along))
    at = lambda turn, c: F.max(F.when(F.col("turn") == turn, F.col(c)))
    sides = run.groupBy(*keys, "c").agg(*[at(t, c).alias(f"{c}{t}") for t in (0, 1, 2) for c in ("count", "logs")])
    log = F.ln("c")
    far = (F.col("logs2") - F.col("logs1") - (F.col("count2") - F.col("count1")) * log) + ((F.col("count1") - F.col("count0")) * log - (F.col("logs1") - F.col("logs0")))
    best = sides.groupBy(*keys).agg(F.max(F.struct((F.col("count2") - F.col("count0")).alias("size"), (-F.round(far, 9)).alias("near"), (-F.col("c")).alias("order"))).alias("b"))
    best = best.select(*keys, F.col("b.size").alias("size"), (-F.col("b.order")).alias("center"))
    members = counted.join(best, list(keys)).where((F.col("v") >= F.col("center") * (1 - width)) & (F.col("v") <= F.col("center") * (1 + width)))
    return replicated_median(members.withColumnRenamed("v", "value"), keys, "value", "w").join(best, list(keys)).select(*keys, "value", "size", "center")


def band_mean(rows: DataFrame, anchors: DataFrame, keys: Sequence[str], value: str, weight: str, tolerance: float = 0.05) -> DataFrame:
    """(keys, anchor, mean, n): the weighted geometric mean of the positive values within the tolerance of each of a key's anchors."""
    met = rows.join(anchors.select(*keys, "anchor"), list(keys)).where((F.col(value) > 0) & (F.col("anchor") > 0) & (F.abs(F.col(value) - F.col("anchor")) / F.greatest(F.col("anchor"), F.lit(EPSILON)) <= tolerance))
    return met.groupBy(*keys, "anchor").agg(F.exp(F.sum(F.col(weight) * F.ln(value)) / F.sum(weight)).alias("mean"), F.count(F.lit(1)).alias("n"))


def anchored_runs(rows: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.05) -> DataFrame:
    """(keys, v, w, run): each key's distinct values in order, in runs that stay within the tolerance of the run's own first value.

    A run's start depends on the run before, so each key is read in order; the
    read, which leaves out values that are no number, holds one batch and the open run's anchor, however large the key.
    """
    counted = cells(rows, keys, value).withColumn("v", F.col("v").cast("double")).where(~F.isnan("v"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema) + ", run long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, anchor, run = None, 0.0, -1
        for batch in batches:
            v = batch.column(len(keys)).to_numpy()
            columns = [batch.column(i) for i in range(len(keys))]
            n = batch.num_rows
            changed = np.zeros(n, dtype=bool)
            for c in columns:
                changed[1:] |= np.array(c.slice(1).to_pylist(), dtype=object) != np.array(c.slice(0, max(n - 1, 0)).to_pylist(), dtype=object)
            starts = [0, *np.flatnonzero(changed).tolist(), n] if n else []
            out = np.empty(n, dtype=np.int64)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                key = tuple(c[a].as_py() for c in columns)
                at = a
                if key != open_key:
                    open_key, anchor, run = key, v[a], 0
                while at < b:
                    # (v - anchor) / |v| grows with v, so the run ends at the first value beyond it
                    inside = (v[at:b] - anchor) / np.maximum(np.abs(v[at:b]), EPSILON) <= tolerance + EPSILON
                    stop = at + (int(np.argmin(inside)) if not inside.all() else b - at)
                    out[at:stop] = run
                    at = stop
                    if at < b:
                        # the value opens the next run, of which it is a member
                        anchor, run = v[at], run + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "run"])

    return counted.repartition(*keys).sortWithinPartitions(*keys, "v").mapInArrow(scan, schema)


def log_medoid(rows: DataFrame, keys: Sequence[str], value: str, out: str = "value") -> DataFrame:
    """(keys, out): the observed value with the least summed log distance to all, the smaller on ties.

    That is the lower median, as the logarithm keeps the order.
    """
    return selected(cells(rows.where(F.col(value) > 0), keys, value), keys, out, F.col("upto") >= F.ceil(F.col("all") / 2))
