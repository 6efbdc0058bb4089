"""Best-fit packing of token pieces into sequences.

Lengths are at most the capacity, so the whole corpus is one short histogram.
A configuration linear program over that histogram (how many sequences of each
mix of lengths) is solved by multiplicative weights: a length's price falls with
the share of it that is covered, each round prices the best mix through every
length by one knapsack dynamic program, and passes repeat, with higher prices
for lengths that were covered wastefully, until the plan is near its dual
bound.  A part of the plan is rounded, the rest is solved again, and the last
sequences are filled largest length first.  Pieces then find their place by
their rank among pieces of equal length, so no task ever holds a sequence's
worth of state, let alone a length's.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, load, materialize
from .token_counts import Encoder, batches, cached_encoder

CAPACITY = 1024
END = 2
_END = np.array([END], dtype="<u4")
#: Share of a length that one round covers at most, how sharply coverage lowers a price, and by how much less than the best a mix may be worth.
STEP, RATE, NEAR = 0.05, 0.1, 0.001
#: How much dearer than its share of a sequence a length is at first, at most: long pieces are placed while others can fill the room beside them.
LONG = 0.05
#: Passes at most, the distance from the dual bound at which they end, and rounds of a pass at most.
PASSES, GAP, ROUNDS = 4, 1e-3, 5000
#: Share of a plan that is rounded before the rest is solved again, how often at most, and the share of all tokens below which it is filled.
ROUNDED, AGAIN, TAIL = 0.6, 8, 0.02
#: Mixes that leave more tokens of a sequence empty are not rounded.
SLACK = 2
#: Pieces of one length that one window sorts.
RANK_ROWS = 20_000

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones at the end, the rest first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _whole_ids(texts: list[str | None], encoder: Encoder) -> Iterator[np.ndarray]:
    """The ids of each text in order, the end token last, from batches of pieces."""
    open_, parts = 0, []
    for owners, batch in batches(texts):
        for owner, ids in zip(owners, encoder.ids(batch), strict=True):
            if owner != open_:
                yield np.concatenate([*parts, _END])
                open_, parts = owner, []
            parts.append(np.asarray(ids, dtype="<u4"))
    if texts:
        yield np.concatenate([*parts, _END])


def token_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``PIECES`` rows of every document; the ids themselves never leave the Python worker."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached_encoder()
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in arrow:
            cols: list[list] = [[], [], [], [], [], []]
            doc_ids, texts, copies = (batch.column(c).to_pylist() for c in range(3))
            for doc, copy, ids in zip(doc_ids, copies, _whole_ids(texts, encoder), strict=True):
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for col, value in zip(cols, (doc, copy, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), F.monotonically_increasing_id().alias("copy"))
    return own.mapInArrow(run, PIECES)


Mix = tuple[tuple[int, int], ...]
Plan = list[tuple[Mix, int]]


def priced(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The worth of the best mix of each room, and its last length (0: one token of the room stays empty); an unbounded knapsack.

    ``value[l]`` is the worth of length l, -inf where there is none.
    """
    capacity = len(value) - 1
    worth = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        options = value[1 : c + 1] + worth[c - 1 :: -1] if c > 1 else value[1:2]
        k = int(options.argmax())
        if options[k] > worth[c - 1]:
            worth[c], last[c] = options[k], k + 1
        else:
            worth[c] = worth[c - 1]
    return worth, last


def mix_of(last: np.ndarray, room: int) -> dict[int, int]:
    """How often each length is in the best mix of ``room``."""
    mix: dict[int, int] = {}
    while room > 0:
        step = int(last[room])
        if step:
            mix[step] = mix.get(step, 0) + 1
        room -= step or 1
    return mix


def covered(need: np.ndarray, base: np.ndarray) -> tuple[dict[Mix, float], float]:
    """One pass of multiplicative weights: sequences of each mix that cover ``need``, and the best dual bound on the way.

    In each round, mixes nearly as good as the best are taken while none of
    their lengths gains more than ``STEP``.  Prices divided by the worth of the
    best mix are feasible for the dual program, so their sum over all pieces
    bounds every plan from below.
    """
    capacity = len(need) - 1
    share = np.zeros(capacity + 1)
    plan: dict[Mix, float] = {}
    bound = 0.0
    for _ in range(ROUNDS):
        open_ = (need > 0) & (share < 1 - 1e-9)
        if not open_.any():
            break
        price = np.where(open_, base * np.exp(-RATE * (share - share[open_].min())), -np.inf)
        worth, last = priced(price)
        bound = max(bound, float(need[open_] @ price[open_]) / worth[capacity])
        lengths = np.flatnonzero(open_)
        through = price[lengths] + worth[capacity - lengths]
        left = np.where(open_, np.minimum(STEP, 1 - share), 0.0) * need
        taken = False
        for k in np.argsort(-through, kind="stable"):
            if taken and through[k] < worth[capacity] * (1 - NEAR):
                break
            length = int(lengths[k])
            if left[length] <= 1e-12:
                continue
            mix = mix_of(last, capacity - length)
            mix[length] = mix.get(length, 0) + 1
            take = min(left[x] / a for x, a in mix.items())
            if take <= 1e-12:
                continue
            taken = True
            key = tuple(sorted(mix.items(), reverse=True))
            plan[key] = plan.get(key, 0.0) + take
            for x, a in mix.items():
                left[x] -= a * take
                share[x] += a * take / need[x]
    else:
        # never seen to happen: what the rounds left open has sequences of its own, so that the plan covers all
        for length in np.flatnonzero((need > 0) & (share < 1 - 1e-9)):
            fit = capacity // int(length)
            key = ((int(length), fit),)
            plan[key] = plan.get(key, 0.0) + float(need[length] * (1 - share[length]) / fit)
    return plan, bound


def fractional_plan(counts: dict[int, int], capacity: int = CAPACITY, passes: int = PASSES) -> tuple[dict[Mix, float], float]:
    """Sequences of each mix, a near-optimal solution of the configuration program over ``counts``, and its dual bound.

    The prices that the shares of a sequence give are feasible too, so the
    bound is at least the tokens over the capacity.
    """
    need = np.zeros(capacity + 1)
    for length, n in counts.items():
        need[length] = n
    whole, need[capacity] = need[capacity], 0
    share = np.arange(capacity + 1) / capacity
    base, bound, best = share * (1 + LONG * share), float(need @ share), {}
    for k in range(passes if need.any() else 0):
        plan, dual = covered(need, base)
        bound = max(bound, dual)
        if k == 0 or sum(plan.values()) < sum(best.values()):
            best = plan
        if sum(best.values()) <= bound * (1 + GAP):
            break
        # lengths that lead wasteful mixes are hard to place: they cost more in the next pass, and so come earlier
        waste, used = np.zeros(capacity + 1), np.zeros(capacity + 1)
        for mix, amount in plan.items():
            waste[mix[0][0]] += amount * (1 - sum(x * a for x, a in mix) / capacity)
            used[mix[0][0]] += amount
        base = base * (1 + 2 * waste / np.maximum(used, 1e-12))
    if whole:
        best = {**best, ((capacity, 1),): float(whole)}
    return best, bound + whole


def whole_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[Plan, int]:
    """Mixes and how many sequences use each, so that every piece has exactly one place; and how many sequences the program placed.

    A part of the fractional plan is rounded, fullest mixes first, with what
    rounding cuts off carried to the next mix; what is left is a smaller
    program, solved again.  The last few are filled largest length first.
    """
    left = {x: n for x, n in counts.items() if n > 0}
    out: Plan = []

    def use(mix: Mix, times: int) -> None:
        out.append((mix, times))
        for x, a in mix:
            left[x] -= a * times
            if not left[x]:
                del left[x]

    def waste(mix: Mix) -> int:
        return capacity - sum(x * a for x, a in mix)

    if capacity in left:
        use(((capacity, 1),), left[capacity])
    tokens = sum(x * n for x, n in left.items())
    for k in range(AGAIN):
        if sum(x * n for x, n in left.items()) <= TAIL * tokens:
            break
        fractional, _ = fractional_plan(left, capacity, PASSES if k == 0 else 1)
        carry, placed = 0.0, False
        for mix, amount in sorted(fractional.items(), key=lambda p: (waste(p[0]), -p[1], p[0])):
            if waste(mix) > SLACK:
                break
            carry += amount * ROUNDED
            times = min([math.floor(carry + 1e-9), *(left.get(x, 0) // a for x, a in mix)])
            carry -= math.floor(carry + 1e-9)
            if times:
                use(mix, times)
                placed = True
        if not placed:
            break
    by_program = sum(n for _, n in out)
    while left:
        mix = fill(left, capacity)
        use(mix, min(left[x] // a for x, a in mix))
    return out, by_program


def fill(left: dict[int, int], capacity: int) -> Mix:
    """The largest length left and the fullest bounded choice for the room beside it."""
    top = max(left)
    room = capacity - top
    # reach[c]: bit set of sums; each length enters as many times as it is left, in powers of two
    stock = {x: n - (x == top) for x, n in left.items() if x <= room}
    reach, trail = 1, []
    full = (1 << (room + 1)) - 1
    for x in sorted(stock, reverse=True):
        n, k = min(stock[x], room // x), 1
        while n > 0:
            k = min(k, n)
            trail.append((x, k, reach))
            reach |= (reach << (x * k)) & full
            n -= k
            k *= 2
        if reach >> room & 1:
            break
    c = reach.bit_length() - 1
    mix = {top: 1}
    for x, k, before in reversed(trail):
        if not before >> c & 1:
            mix[x] = mix.get(x, 0) + k
            c -= x * k
    return tuple(sorted(mix.items(), reverse=True))


def places(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, copies, first offset) of every mix and length."""
    rows, used, sequence = [], {}, 0
    for mix, times in plan:
        offset = 0
        for x, a in mix:
            lo = used.get(x, 0)
            used[x] = lo + a * times
            rows.append((x, lo, used[x], sequence, a, offset))
            offset += x * a
        sequence += times
    return rows


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0, without gathering a length in one task."""
    n = rows.count()
    buckets = max(1, -(-n // RANK_ROWS))
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return spread.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside")).drop("bucket", "inside", "before")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end token alone.  Null ids and
    repeated rows are packed like any other row.  Other columns are not read.
    An empty table packs into nothing.  Very long texts are tokenized in parts
    and cut into pieces.  ``copy`` numbers the rows of ``docs``: pieces of rows
    that repeat an id differ in it.  The histogram has at most ``capacity``
    entries and the plan a few thousand mixes, whatever the corpus.
    """
    spark = docs.sparkSession
    rows = materialize(token_pieces(docs, capacity), "packing-pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(whole_plan(counts, capacity)[0])
    plan = spark.createDataFrame(table or [(0, 0, 0, 0, 1, 0)], "length long, lo long, hi long, first long, copies long, base long")
    p = ranked(rows).alias("p")
    q = bounded(plan, len(table), 200_000).alias("q")
    found = p.join(q, (F.col("p.length") == F.col("q.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    within = F.col("rank") - F.col("lo")
    return found.select("doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32", F.expr("first + (rank - lo) div copies").alias("sequence_id"), (F.col("base") + F.pmod(within, F.col("copies")) * F.col("p.length")).alias("offset"), "copy")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
