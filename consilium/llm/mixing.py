"""Mixing sources to target weights by fixed-length blocks.

Each source's words form one stream, cut into blocks of ``BLOCK`` words.  A
source that is to give W words gets as many slots as cover W, and these are
drawn onto the output shards: the counts of a source's slots on the shards are
multinomial given their total, which is what keeps each source at its target.
Shards take their counts of slots one after another, so the draw decides which
slots are whose.  Slot numbers pass through a pseudorandom permutation of the
source's block numbers (swap-or-not rounds, exact for any count), a new one
each time the source is used up, and join the blocks by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, WORD, bounded, let, load, materialize

BLOCK = 64
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
ROUNDS, SEED = 12, 20_240_229
#: Documents that one running sum covers, and slots that one row unfolds.
RUN_ROWS, UNFOLD = 20_000, 4096
SHARD_WORDS = 1 << 22


def permuted(index: Column, count: Column, *salt: Column) -> Column:
    """``index`` (0 <= index < count) under a keyed permutation of that range.

    Each round reflects the index about a keyed pivot or leaves it, by a bit
    that both images share, so every round is a permutation and so is the whole.
    """

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *salt), count) - x, count)
        swap = F.pmod(F.xxhash64(F.lit(SEED + 1), r, F.greatest(x, partner), *salt), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), step)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, index, target) from ``sizes(source, size)`` rows.

    Sources in code point order, null last, weigh ``WEIGHTS`` in turn and share
    ``SHARE`` of all words; one that reaches ``MOST`` times its size stops there
    and the excess goes to the others by weight.  In order of capacity per
    weight, the level is the first that its own source does not exceed.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    named = totals.withColumn("index", F.row_number().over(order) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("index") % len(WEIGHTS) + 1).cast("int")))
    named = named.withColumn("most", F.col("source_size") * float(MOST)).withColumn("all", F.sum("source_size").over(everything) * SHARE)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "index")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("all") - (F.sum("most").over(upto) - F.col("most"))) / F.sum("weight").over(rest)
    leveled = named.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "index", "level")))
    chosen = F.min("fits").over(everything)["level"]
    return leveled.withColumn("level", chosen).select("source", "source_size", "index", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def positions(docs: DataFrame, n_rows: int) -> DataFrame:
    """``docs(index, size, ...)`` with ``start``, the words of its source before it.

    Two levels of running sums, over buckets and inside each, so a source that
    holds most rows is no task of its own.
    """
    buckets = max(1, -(-n_rows // RUN_ROWS))
    spread = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    totals = spread.groupBy("index", "bucket").agg(F.sum("size").alias("words"))
    before = totals.select("index", "bucket", (F.sum("words").over(Window.partitionBy("index").orderBy("bucket")) - F.col("words")).alias("before"))
    inside = Window.partitionBy("index", "bucket").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = spread.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    return spread.join(before, ["index", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside", "bucket")


def _demand(sources: DataFrame, block: int) -> DataFrame:
    """``sources(index, source_size, target, shards)`` with the blocks each has, its whole epochs, the words beyond them and the slots it needs (n)."""
    s = sources.where((F.col("source_size") > 0) & (F.round("target") > 0))
    s = s.withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * MOST))
    s = s.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("tail", F.col("source_size") - (F.col("blocks") - 1) * block)
    s = s.withColumn("epochs", F.expr("words div source_size")).withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
    # the short block may fall early in the last epoch, hence one slot to spare
    s = s.withColumn("last", F.least(F.col("blocks"), F.when(F.col("rest") > 0, F.expr(f"(rest + {block} - tail + {block - 1}) div {block}")).otherwise(F.lit(0))))
    return s.withColumn("n", F.col("epochs") * F.col("blocks") + F.col("last"))


def _unfolded(ranges: DataFrame, n_slots: int) -> DataFrame:
    """A row with ``slot`` for each number from ``lo`` on, ``n`` in all, of each of ``ranges``.

    ``n_slots``, about how many there are, sets the number of tasks: rows that
    unfold are small, so sizes in bytes would put all in one.
    """
    chunks = ranges.where("n > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {UNFOLD}"))))
    dealt = chunks.repartition(n_slots // (16 * UNFOLD) + 1, "index", "lo", "chunk")
    stop = F.col("lo") + F.least(F.col("n"), (F.col("chunk") + 1) * UNFOLD) - 1
    return dealt.withColumn("slot", F.explode(F.sequence(F.col("lo") + F.col("chunk") * UNFOLD, stop))).drop("chunk", "lo", "n")


def shard_counts(demand: DataFrame, n_slots: int) -> DataFrame:
    """The draw: (index, shard, drawn, lo), how many slots of each source each shard gets and where they begin.

    Each slot falls on a shard by a hash, so a source's counts are multinomial
    with equal shares; counts are summed before they move.
    """
    each = _unfolded(demand.withColumn("lo", F.lit(0).cast("long")), n_slots)
    counts = each.select("index", F.pmod(F.xxhash64(F.lit(SEED + 2), "index", "slot"), F.col("shards")).alias("shard")).groupBy("index", "shard").agg(F.count(F.lit(1)).alias("drawn"))
    return counts.withColumn("lo", F.sum("drawn").over(Window.partitionBy("index").orderBy("shard")) - F.col("drawn"))


def slots(demand: DataFrame, counts: DataFrame, n_sources: int, n_slots: int, block: int = BLOCK) -> DataFrame:
    """(shard, index, slot, epoch, block, held, take) of every slot that takes a word or more.

    Whole epochs take every block in full; in the last, each block in permuted
    order takes what is still missing, so a source misses its target by less
    than a word.
    """
    s = bounded(demand.drop("n"), n_sources)
    each = _unfolded(counts.withColumnRenamed("drawn", "n"), n_slots).join(s, "index")
    each = each.withColumn("epoch", F.expr("slot div blocks")).withColumn("at", F.col("slot") - F.col("epoch") * F.col("blocks"))
    each = each.withColumn("block", permuted(F.col("at"), F.col("blocks"), F.col("index"), F.col("epoch")))
    short = F.col("block") == F.col("blocks") - 1
    each = each.withColumn("held", F.when(short, F.col("tail")).otherwise(F.lit(block)))
    each = materialize(each.select("shard", "index", "slot", "epoch", "epochs", "at", "block", "rest", "tail", "held", F.when(short & (F.col("epoch") == F.col("epochs")), F.col("at")).alias("short_at")), "mix-slots")
    where = each.groupBy("index").agg(F.min("short_at").alias("short"))
    d = each.drop("short_at").join(bounded(where, n_sources), "index")
    before = F.col("at") * block - F.when(F.col("short") < F.col("at"), block - F.col("tail")).otherwise(F.lit(0))
    take = F.when(F.col("epoch") < F.col("epochs"), F.col("held")).otherwise(F.greatest(F.lit(0), F.least(F.col("held"), F.col("rest") - before)))
    return d.select("shard", "index", "slot", "epoch", "block", "held", take.alias("take")).where(F.col("take") > 0)


def _draw(slim: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """The targets, the slots taken and the number of sources of ``slim(source, size)``."""
    targets = materialize(source_targets(slim.select("source", "size")), "mix-sources")
    n_sources, words = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    sources = targets.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("target").over(Window.partitionBy()) / SHARD_WORDS)).cast("long"))
    demand, n_slots = materialize(_demand(sources, block), "mix-demand"), int(words / block)
    counts = materialize(shard_counts(demand, n_slots), "mix-counts")
    return targets, slots(demand, counts, n_sources, n_slots, block), n_sources


def shard_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix by output shard: (shard, source, slot, epoch, block, words), a row for each slot that takes words.

    ``block`` numbers the source's stream, of which the slot takes the first
    ``words`` words of that block.  This is the draw of ``mix`` and
    ``mixed_documents``: a source's words over all shards are what those take.
    """
    slim, _ = _numbered(docs)
    targets, taken, n_sources = _draw(slim, block)
    names = bounded(targets.select("index", "source"), n_sources)
    return taken.join(names, "index").select("shard", "source", "slot", "epoch", "block", F.col("take").cast("long").alias("words"))


def _met(slim: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """For ``slim(row, doc_id, source, size)``: what each slot takes of each row, and each row's source.

    The first has (row, shard, epoch, lo, hi): words ``lo`` to ``hi`` of the
    row's text.  The second has (row, source_size, target).
    """
    n_rows = slim.count()
    targets, taken, n_sources = _draw(slim, block)
    t = bounded(targets.withColumnRenamed("source", "name"), n_sources)
    named = slim.join(t, slim["source"].eqNullSafe(t["name"]))
    placed = positions(named.select("row", "doc_id", "size", "index").where(F.col("size") > 0), n_rows)
    spans = placed.select("row", "index", "start", (F.col("start") + F.col("size")).alias("stop"), F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    met = spans.join(taken.select("index", "block", "shard", "epoch", "take"), ["index", "block"])
    lo = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    hi = F.least(F.col("stop"), F.col("block") * block + F.col("take")) - F.col("start")
    return met.select("row", "shard", "epoch", lo.alias("lo"), hi.alias("hi")).where("lo < hi"), named.select("row", "source_size", "target")


def _numbered(docs: DataFrame, *keep: str) -> tuple[DataFrame, list[str]]:
    """``keep`` columns under names that clash with nothing, beside row, doc_id, source and size; written once."""
    held = [f"__k{i}" for i in range(len(keep))]
    size = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long")
    own = docs.select(*[docs[k].alias(h) for k, h in zip(keep, held, strict=True)], docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), size.alias("size"))
    return materialize(own.withColumn("row", F.monotonically_increasing_id()), "mix-sizes"), held


def mix(docs: DataFrame, *keep: str, block: int = BLOCK) -> DataFrame:
    """``keep`` columns of ``docs`` plus size, source_size, target, taken and shard_words, one row for each of ``docs``.

    ``shard_words`` lists, as ``shard:words`` with commas between, on which
    output shards how many of the row's words fall; they add up to ``taken``.
    Null and blank texts have size 0 and are never taken.  A null source is a
    source, the last one.  Null ids and repeated rows are rows like any other.
    An empty table, or one without a word, takes nothing.  Reruns agree: the
    draw hashes only ids, sizes and numbers.
    """
    slim, held = _numbered(docs, *keep)
    met, of_row = _met(slim.select("row", "doc_id", "source", "size"), block)
    on_shard = met.groupBy("row", "shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("words"))
    taken = on_shard.groupBy("row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    out = slim.join(of_row, "row").join(taken, "row", "left")
    shard_words = F.coalesce(F.array_join(F.transform("shards", lambda x: F.concat_ws(":", x["shard"], x["words"])), ","), F.lit(""))
    return out.select(*[F.col(h).alias(k) for k, h in zip(keep, held, strict=True)], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), shard_words.alias("shard_words"))


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each stretch of a text that one epoch takes.

    Neighbouring words that the same epoch takes are one stretch, on whatever
    shards they fall, with the text's own blanks; one that covers all words is
    the text as it was.  n_chars, where there is one, is recounted.  What the
    mix does not take is left out, so null and blank texts are.  Null ids,
    repeated rows and columns of any other name pass through; an empty table
    stays empty.
    """
    slim, held = _numbered(docs, *docs.columns)
    met, _ = _met(slim.select("row", "doc_id", "source", "size"), block)
    per_epoch = met.groupBy("row", "epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("s"))
    # a stretch begins where no other ends, and ends where no other begins
    starts = F.array_except(F.transform("s", lambda x: x["lo"]), F.transform("s", lambda x: x["hi"]))
    ends = F.array_except(F.transform("s", lambda x: x["hi"]), F.transform("s", lambda x: x["lo"]))
    stretches = per_epoch.select("row", "epoch", F.arrays_zip(F.array_sort(starts).alias("lo"), F.array_sort(ends).alias("hi")).alias("s"))
    per_row = stretches.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "s"))), lambda x: x["s"])).alias("s"))
    text = F.col(held[docs.columns.index("text")])
    tokens = F.regexp_extract_all(text, F.lit(WORD + BLANK + "*"), F.lit(0))
    whole = lambda x: (x["lo"] == 0) & (x["hi"] == F.col("size"))
    # words are cut out only where some stretch is not the whole text
    cut = lambda w: F.transform("s", lambda x: F.when(whole(x), text).otherwise(F.array_join(F.slice(w, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")), "")))
    texts = F.when(F.exists("s", lambda x: ~whole(x)), let(tokens, cut)).otherwise(F.transform("s", lambda x: text))
    rows = slim.join(per_row, "row").withColumn("__text", F.explode(texts))
    out = [F.col(h).alias(k) for k, h in zip(docs.columns, held, strict=True)]
    for i, k in enumerate(docs.columns):
        if k == "text":
            out[i] = F.col("__text").alias(k)
        elif k == "n_chars":
            out[i] = F.length("__text").cast(docs.schema[k].dataType).alias(k)
    return rows.select(*out)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"), "doc_id")
