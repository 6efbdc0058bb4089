"""Number parsing, tolerance tests, array statistics and scoring, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

EPSILON = 1e-12
_FLOAT = r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|(?i:inf|infinity|nan))\s*$"


def parse_number(value: Column) -> Column:
    """A double from text with commas removed; underscores between digits, inf and nan are allowed, else null."""
    bare = F.replace(value, F.lit(","), F.lit(""))
    plain = F.replace(F.trim(bare), F.lit("_"), F.lit(""))
    return F.when(bare.rlike(_FLOAT), plain.try_cast("double"))


def positive(value: Column) -> Column:
    """The number itself if it is finite and above 0, else null."""
    return F.when((value > 0) & (value < float("inf")), value)


# Five tolerance tests that differ in their scale; they are not interchangeable.


def within_gold(value: Column, gold: Column, tolerance: float = 0.05) -> Column:
    """Relative to the signed gold value: zero never matches, a negative gold matches all."""
    return F.coalesce(F.try_divide(F.abs(value - gold), gold) <= tolerance, F.lit(False))


def within_larger(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    scale = F.greatest(F.abs(a), F.abs(b))
    return F.when(scale == 0, a == b).otherwise(F.try_divide(F.abs(a - b), scale) <= tolerance + EPSILON)


def within_right(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """Relative to the right side, both positive."""
    return (a > 0) & (b > 0) & (F.abs(a - b) / F.greatest(F.abs(b), F.lit(EPSILON)) <= tolerance)


def within_product(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def within_target(a: Column, target: Column, tolerance: float = 0.05) -> Column:
    return F.abs(a - target) / F.greatest(F.abs(target), F.lit(EPSILON)) <= tolerance + EPSILON


def same_option(a: Column, b: Column) -> Column:
    return F.abs(F.ln(a / b)) <= 1e-10


def log_distance(a: Column, b: Column, width: float = 1.0) -> Column:
    """Clipped to 1 at ``width`` natural-log units."""
    return F.least(F.lit(1.0), F.abs(F.ln(a / b)) / width)


def spread(values: Column) -> Column:
    """Largest over smallest in units of 5 %, clipped to 1."""
    return F.least(F.lit(1.0), F.ln(F.array_max(values) / F.array_min(values)) / F.ln(F.lit(1.05)))


def clipped_deviation(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0))) / 2)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))


def standardised(x: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(x, mean, lambda v, m: v - m), scale, lambda v, s: v / s)


def softmax(scores: Column) -> Column:
    """A map's values as shares that sum to 1."""
    top = F.array_max(F.map_values(scores))
    raised = F.transform_values(scores, lambda k, v: F.exp(v - top))
    whole = total(F.map_values(raised))
    return F.transform_values(raised, lambda k, v: v / whole)


def index_quantile(values: Column, q: float) -> Column:
    """The sorted value at index min(n - 1, floor(q * n)): neither interpolated nor a discrete percentile."""
    if not 0 <= q <= 1:
        raise ValueError(f"quantile out of range: {q}")
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, F.least(F.size(values) - 1, F.floor(F.lit(q) * F.size(values))).cast("int") + 1)


def median(values: Column) -> Column:
    """The middle value, or the mean of the two middle ones; null of none."""

    def of(ordered: Column) -> Column:
        n = F.size(ordered)
        return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)

    return let(F.array_sort(values), of)


def densest_cluster(values: Column, width: float) -> Column:
    """struct<value, size, center>: the median of the relative neighbourhood with most members; null without finite values above 0, which alone count.

    Ties go to the smaller sum of log distances (to nine digits), then to the
    smaller centre, so the order of arrival does not matter.
    """

    def among(values: Column) -> Column:
        def around(c: Column) -> Column:
            near = F.filter(values, lambda v: F.abs(v - c) / F.greatest(F.abs(c), F.lit(EPSILON)) <= width)

            def key(members: Column) -> Column:
                far = F.aggregate(F.array_sort(members), F.lit(0.0), lambda acc, v: acc + F.abs(F.ln(v / c)))
                return F.struct(F.size(members).alias("size"), (-F.round(far, 9)).alias("near"), (-c).alias("order"), members.alias("members"))

            return let(near, key)

        best = F.array_max(F.transform(values, around))
        return F.when(F.size(values) > 0, let(best, lambda b: F.struct(median(b["members"]).alias("value"), b["size"].alias("size"), (-b["order"]).alias("center"))))

    return let(F.filter(values, lambda v: positive(v).isNotNull()), among)


def anchored_groups(values: Column, tolerance: float = 0.05) -> Column:
    """Sorted values in runs that stay within the tolerance of the run's own first value: complete-link, no chaining."""

    def step(acc: Column, v: Column) -> Column:
        open_ = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & ((v - F.get(open_, F.lit(0))) / F.greatest(F.abs(v), F.lit(EPSILON)) <= tolerance + EPSILON)
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(open_, F.array(v))))).otherwise(F.concat(acc, F.array(F.array(v))))

    # element_at on an empty array raises, so the first value opens the first run
    ordered = F.array_sort(values)
    start = F.array(F.array(F.get(ordered, F.lit(0))))
    return F.when(F.size(values) > 0, F.aggregate(F.slice(ordered, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step))


def log_medoid(values: Column) -> Column:
    """The observed positive value with the least summed log distance to all, the smaller on ties.

    That is the lower median: the logarithm keeps the order, and between the
    two middle values every point is as near.
    """
    return let(F.array_sort(values), lambda ordered: F.get(ordered, F.floor((F.size(ordered) - 1) / 2).cast("int")))


def set_f1(a: Column, b: Column) -> Column:
    """Two distinct arrays: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both.cast("double") / (F.size(a) + F.size(b) - both))


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; null where either side is constant."""
    return F.try_divide(n * sxy - sx * sy, F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy))
