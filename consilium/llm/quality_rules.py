"""Quality rules: fixed base rules, then robust multivariate outliers.

Each text becomes a vector of transformed statistics.  For each language and
source a minimum-covariance-determinant estimate is fitted from several starts:
each takes concentration steps (keep the rows nearest to the centre,
re-estimate) until its determinant falls no more, and the start that ends with
the least determinant wins.  The estimate is reweighted once, and rows whose
squared Mahalanobis distance exceeds a chi-square quantile are rejected.

All of it is DataFrame expressions over one slim table of integer statistics
(the texts are read once).  A step is one aggregation: counts and moments by
group, start and bin of distance, of which the nearest bins make the core.
Sums of integers make reruns agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, bounded, keep, let, load, materialize, scratch, words_of

STATS = ("mean_word", "symbols", "dup_lines", "repeats", "caps", "marks")
#: Fixed point: transformed statistics are held as integers of this resolution.
SCALE = 1024
#: Words that a text needs; what each statistic is a share of in a text of so many: characters of five a word,
#: lines of ten words, windows of three words.
LEAST_WORDS = 50
UNITS = {"symbols": 5 * LEAST_WORDS, "dup_lines": LEAST_WORDS / 10, "repeats": LEAST_WORDS / 3, "caps": 5 * LEAST_WORDS, "marks": 5 * LEAST_WORDS}
#: Least standard deviation of each statistic: the sampling error that a text of ``LEAST_WORDS`` has by itself, which is 0.5 / sqrt(units)
#: for the root of a share, and 0.5 / sqrt(words) / ln 2 for the logarithm of a mean of lengths that spread by half their mean.
FLOOR = {"mean_word": 0.5 / LEAST_WORDS**0.5 / 0.6931, **{k: 0.5 / n**0.5 for k, n in UNITS.items()}}
#: Share of rows that the estimate rests on, and rows that a group needs for an estimate of its own.
CORE, LEAST_GROUP = 0.75, 64
#: Starts from small subsets beside those from medians and from all rows, rows of such a subset, starts that go on after ``TRIAL``
#: steps, steps at most, and the fall of the determinant's logarithm that counts as one.
SUBSETS, SUBSET_ROWS, TRIAL, BEST, STEPS, FALL = 3, 14, 2, 2, 20, 1e-3
# Chi-square quantiles for six statistics, and the factors that make the covariance of the rows nearer than these consistent for a normal core.
CORE_FACTOR = 1.3616  # of the nearest 0.75
REWEIGHT, REWEIGHT_FACTOR = 14.449, 1.0493  # at 0.975
CUTOFF = 44.0  # at a tail of 1e-7
_BIN = 16  # bins an octave of distance


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that the text holds twice or more."""

    def covered(grams: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = F.filter(s, lambda e, k: (F.when(k > 0, F.get(s, k - 1)["h"] == e["h"])) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
            at = F.sort_array(F.transform(twin, lambda e: e["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))), F.lit(0), lambda acc, x: acc + x))

        ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ranked, of_sorted))

    grams = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(grams, covered)).cast("long")


def base_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The exact counts of every text, beside the columns in ``keep`` of ``docs``."""
    own = docs.select(*[docs[k].alias(k) for k in keep], F.coalesce(docs["text"], F.lit("")).alias("__t"))
    own = own.withColumn("__w", words_of(F.col("__t")))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return own.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.instr("__t", "\n") > 0, let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(F.lit(0)).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__w")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("__lines"),
        F.regexp_count("__t", F.lit(r"\p{Lu}")).cast("long").alias("__caps"),
        F.regexp_count("__t", F.lit(r"[!?]")).cast("long").alias("__marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> dict[str, Column]:
    """Fixed-point statistics; square roots spread the low shares, where most texts lie, and a logarithm bounds the mean length."""
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("word_chars", "n_words", "__lines"))
    shares = {
        "mean_word": F.log2(chars / words),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / lines),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "caps": F.sqrt(F.col("__caps") / chars),
        "marks": F.sqrt(F.col("__marks") / chars),
    }
    return {k: F.round(v * SCALE).cast("long") for k, v in shares.items()}


def _quantile(cells: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """The value at rank ceil(share * n) of each key, from (keys, v, n) counts of distinct values."""
    order = Window.partitionBy(*keys).orderBy("v")
    run = cells.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return run.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("v").alias(name))


_PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]
_MODEL = [*[f"m{i}" for i in range(len(STATS))], *[f"l{i}_{j}" for i, j in _PAIRS]]


def _factored(moments: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """Means, the Cholesky factor of the covariance (times ``factor``, floors added) and half its log determinant, from integer sums (n, s_i, s_ij)."""
    out, p = moments, len(STATS)
    for i in range(p):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n") / SCALE)
    cov = {}
    for i, j in _PAIRS:
        c = (F.col(f"s{i}_{j}") / F.col("n") / (SCALE * SCALE) - F.col(f"m{i}") * F.col(f"m{j}")) * factor
        cov[i, j] = c + FLOOR[STATS[i]] ** 2 if i == j else c
    for j in range(p):
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(cov[j, j] - sum((F.col(f"l{j}_{k}") ** 2 for k in range(j)), F.lit(0.0)), F.lit(1e-9))))
        for i in range(j + 1, p):
            out = out.withColumn(f"l{i}_{j}", (cov[i, j] - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}_{j}"))
    return out.select(*keys, *_MODEL, sum((F.log(f"l{i}_{i}") for i in range(1, p)), F.log("l0_0")).alias("det"))


def _distance(df: DataFrame) -> DataFrame:
    """``d2``, the squared Mahalanobis distance, by forward substitution."""
    out, p = df, len(STATS)
    for i in range(p):
        centred = F.col(STATS[i]) / SCALE - F.col(f"m{i}")
        out = out.withColumn(f"z{i}", (centred - sum((F.col(f"l{i}_{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in range(1, p)), F.col("z0") ** 2))


def _sums() -> list[Column]:
    """Counts and integer moments.  A statistic is below 2^16 and a group below 2^31 rows, or its sums would not fit."""
    single = [F.sum(STATS[i]).alias(f"s{i}") for i in range(len(STATS))]
    cross = [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"s{i}_{j}") for i, j in _PAIRS]
    return [F.count(F.lit(1)).alias("n"), *single, *cross]


def _medians(rows: DataFrame) -> DataFrame:
    """(g, m_i, l_ij): medians and deviations of each statistic, as a diagonal start."""
    long = rows.select("g", F.posexplode(F.array(*STATS)).alias("k", "x"))
    mid = materialize(_quantile(long.groupBy("g", "k", F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("n")), ["g", "k"], 0.5, "mid"), "mcd-medians")
    groups = mid.count() // len(STATS)
    away = long.join(bounded(mid, groups), ["g", "k"]).groupBy("g", "k", F.abs(F.col("x") - F.col("mid")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    mad = _quantile(away, ["g", "k"], 0.5, "mad")
    both = mid.join(mad, ["g", "k"]).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("mid", "mad")))).alias("x"))
    cols = [(F.col("x")[i]["mid"] / SCALE).alias(f"m{i}") for i in range(len(STATS))]
    for i, j in _PAIRS:
        sd = F.sqrt((F.col("x")[i]["mad"] * 1.4826 / SCALE) ** 2 + FLOOR[STATS[i]] ** 2) if i == j else F.lit(0.0)
        cols.append(sd.alias(f"l{i}_{j}"))
    return both.select("g", *cols)


def _starts(rows: DataFrame, groups: int) -> DataFrame:
    """(g, start, model, det, moved): start 0 from medians, 1 from all rows, the others from small subsets that hashes choose."""
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("held"))
    every = F.greatest(F.ceil(F.col("held") / SUBSET_ROWS), F.lit(1))
    chosen = [F.when(F.pmod(F.xxhash64(F.lit(k), *STATS), every) == 0, F.lit(2 + k)) for k in range(SUBSETS)]
    own = rows.join(bounded(sizes, groups), "g").withColumn("start", F.explode(F.array_compact(F.array(F.lit(1), *chosen))))
    drawn = _factored(own.groupBy("g", "start").agg(*_sums()), ["g", "start"])
    # a diagonal start has yet to be measured: any step lowers its determinant
    medians = _medians(rows).select("g", F.lit(0).alias("start"), *_MODEL, F.lit(float("inf")).alias("det"))
    return medians.unionByName(drawn.withColumn("det", F.lit(float("inf")))).withColumn("moved", F.lit(True))


def _concentrated(rows: DataFrame, model: DataFrame, models: int) -> DataFrame:
    """One concentration step of every (g, start) of ``model``: the estimate of the nearest ``CORE`` of the rows, to a bin of distance."""
    near = _distance(rows.join(bounded(model.select("g", "start", *_MODEL), models), "g"))
    near = near.withColumn("v", F.floor(F.log2(F.col("d2") + 2.0**-20) * _BIN).cast("long"))
    cells = near.groupBy("g", "start", "v").agg(*_sums())
    key = Window.partitionBy("g", "start")
    run = cells.withColumn("before", F.sum("n").over(key.orderBy("v")) - F.col("n")).withColumn("all", F.sum("n").over(key))
    core = run.where(F.col("before") < F.ceil(F.col("all") * CORE))
    names = ["n", *[f"s{i}" for i in range(len(STATS))], *[f"s{i}_{j}" for i, j in _PAIRS]]
    return _factored(core.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in names]), ["g", "start"])


def fit(rows: DataFrame, groups: int) -> DataFrame:
    """Estimates (g, start, m_i, l_ij, det, reweighted) for every group of ``rows(g, *STATS)``; det is of the winning start's core."""
    model = materialize(_starts(rows, groups), "mcd-starts")
    for step in range(STEPS):
        open_ = model.where("moved")
        models = open_.count()
        if not models:
            break
        fresh = _concentrated(rows, open_, models).join(open_.select("g", "start", F.col("det").alias("was")), ["g", "start"])
        fresh = fresh.withColumn("moved", F.col("was") - F.col("det") > FALL).drop("was")
        model = fresh.unionByName(model.where("not moved"))
        if step + 1 >= TRIAL:
            place = F.row_number().over(Window.partitionBy("g").orderBy("det", "start"))
            model = model.withColumn("place", place).where(F.col("place") <= BEST).drop("place")
        model = materialize(model, f"mcd-step{step}")
    first = F.row_number().over(Window.partitionBy("g").orderBy("det", "start"))
    best = materialize(model.withColumn("place", first).where("place = 1").drop("place", "moved"), "mcd-best")
    # distances by the core's own covariance are CORE_FACTOR times those by the consistent one
    near = _distance(rows.join(bounded(best, groups), "g")).where(F.col("d2") <= REWEIGHT * CORE_FACTOR)
    again = _factored(near.groupBy("g").agg(*_sums()), ["g"], REWEIGHT_FACTOR)
    return again.drop("det").join(best.select("g", "start", "det"), "g")


def judge(docs: DataFrame, *keep_: str) -> DataFrame:
    """``keep_`` columns of ``docs``, the base counts, base_failed, distance and kept.

    A text needs 50 words and few repeated ones; of those, one that lies too
    far from its language's and source's core is rejected.  A null language or
    source is a group of its own.  Groups under ``LEAST_GROUP`` rows are judged
    by their language's estimate, those of small languages by the whole
    corpus's; with too few rows even there nothing more is rejected.  Null and
    empty texts have no words and fail the base rules.  Rows are judged one by
    one, so repeated rows and null ids get equal verdicts; kept columns may
    have any names.  An empty table gives no rows.
    """
    # kept columns travel under names that clash with nothing
    held = [f"__k{i}" for i in range(len(keep_))]
    named = docs.select(*[docs[k].alias(h) for k, h in zip(keep_, held, strict=True)], docs["lang"].alias("__lang"), docs["source"].alias("__source"), docs["text"].alias("text"))
    slim = base_statistics(named, *held, "__lang", "__source")
    slim = slim.select(*[c for c in slim.columns if c not in ("__lines", "__caps", "__marks")], base_failed().alias("base_failed"), *[v.alias(f"__{k}") for k, v in transformed().items()])
    slim = materialize(slim, "quality-statistics")
    same = lambda a, b: a["__lang"].eqNullSafe(b["__lang"]) & a["__source"].eqNullSafe(b["__source"])
    with scratch(docs.sparkSession):
        own = slim.where(~F.col("base_failed")).select("__lang", "__source", *[F.col(f"__{k}").alias(k) for k in STATS])
        levels = F.array(F.to_json(F.struct(F.lit(2).alias("k"), "__lang", "__source")), F.to_json(F.struct(F.lit(1).alias("k"), "__lang")), F.lit("{}"))
        sizes = materialize(own.groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n")), "quality-sizes")
        total = Window.partitionBy("g")
        counted = sizes.select("__lang", "__source", "n", F.posexplode(levels).alias("depth", "g")).withColumn("held", F.sum("n").over(total))
        pick = F.min(F.when(F.col("held") >= LEAST_GROUP, F.struct("depth", "g")))
        group_of = materialize(counted.groupBy("__lang", "__source").agg(pick["g"].alias("g")), "quality-groups")
        n_groups = group_of.count()
        used = group_of.where(F.col("g").isNotNull()).select("g").distinct()
        # every level that some group is judged by is fitted on all rows under it
        feeds = materialize(sizes.select("__lang", "__source", F.explode(levels).alias("g")).join(used, "g"), "quality-feeds")
        rows = materialize(own.join(bounded(feeds, n_groups), same(own, feeds)).select("g", *STATS), "quality-rows")
        params = keep(group_of.join(fit(rows, n_groups), "g", "left"), "quality-estimates")
    judged = slim.join(bounded(params, n_groups), same(slim, params), "left").drop(params["__lang"]).drop(params["__source"])
    judged = _distance(judged.withColumns({k: F.col(f"__{k}") for k in STATS}))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("d2") > CUTOFF, F.lit(False))
    return judged.select(*[F.col(h).alias(k) for k, h in zip(keep_, held, strict=True)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), F.col("d2")).alias("distance"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(load(spark, sf_dir, "documents"), "doc_id")
    return out.drop("distance")
