"""N-gram Jaccard join: all links between texts whose shingle sets are 80 % alike.

A set's shingles are 64-bit hashes in hash order.  Two sets can only be alike
if they share one of their first few shingles (a prefix of a fifth), so sets
meet in tiles, one for each shared prefix shingle and size band.  Inside a tile
sets are compared by size and by hashed bitmaps: the bits in which two bitmaps
differ bound the overlap from above.  Only pairs that pass are compared
exactly, by intersecting sorted arrays.

Copies (equal sets) are one node from the start.  A first pass, over a few
shingles of each set, links each tile to a few leaders, and two more link each
set to its nearest in another component; what they connect needs no further
comparison, so a large group of near copies never emits its pairs.  A last pass
compares all the rest: every pair of sets in different components that shares a
tile.  No link that could join two components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, keep, load, materialize, scratch

GRAM = 5
#: Similarity as a fraction, exact in integers: 100 * intersection >= 80 * union.
TOP, BOTTOM = 4, 5
#: Leaders that the first pass tries in each tile, the shingles of a set that it looks at (to twice as many), and rows of a tile that one block compares.
LEADERS, FIRST, BLOCK = 8, 4, 4096
#: Rounds in which each set is compared with its nearest in another component only, before all that is left is compared.
NEAREST = 2
#: A prefix shingle in more sets than this goes to the end of the order (see ``common_shingles``), the most common first.
COMMON, MOST_COMMON = 1000, 50_000
#: Nodes whose texts are fetched by a broadcast of their keys; more are fetched by a shuffle.
FETCH = 500_000
#: Links that one task connects by itself; more are first contracted in rounds.
FINISH = 1_000_000
_LOWEST = -(2**63)
#: Bytes of text that are hashed at once, which bounds a worker's memory.
_CHUNK = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = mixed(np.arange(1 << 16, dtype=np.uint64)) | np.uint64(1)
_PLACE = mixed(np.arange(100, 100 + GRAM, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case.

    All texts are hashed at once: words by a sum of bytes times odd constants
    for their place, shingles the same way from words.
    """
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.empty(0, np.uint8)
    low = _LOWER[raw]
    inside = ~_BLANK[low]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8)]))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    if len(starts) == 0:
        return [np.empty(0, np.uint64) for _ in texts]
    lengths = ends - starts
    held = np.flatnonzero(inside)
    place = held - np.repeat(starts, lengths)
    step = _STEP[place] if place.max() < len(_STEP) else mixed(place.astype(np.uint64)) | np.uint64(1)
    words = mixed(np.add.reduceat((low[held].astype(np.uint64) + np.uint64(1)) * step, np.concatenate([[0], lengths.cumsum()[:-1]])) + lengths.astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate([[0], sizes.cumsum()]))
    runs = sum((words[k : len(words) - GRAM + 1 + k] * _PLACE[k] for k in range(GRAM)), np.zeros(max(0, len(words) - GRAM + 1), np.uint64))
    runs = mixed(runs + np.uint64(GRAM))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= GRAM:
            out.append(np.unique(runs[a : b - GRAM + 1]))
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def chunked(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``shingle_sets`` over texts (null: empty) in chunks of a few megabytes: (first index, sets)."""
    at, size, chunk = 0, 0, []
    for i, t in enumerate(texts):
        chunk.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(chunk[-1])
        if size >= _CHUNK:
            yield at, shingle_sets(chunk)
            at, size, chunk = i + 1, 0, []
    if chunk:
        yield at, shingle_sets(chunk)


def prefix_length(n: int) -> int:
    """Sets that are alike share at least ``ceil(n * TOP / BOTTOM)`` of ``n`` shingles, so one of the first rest + 1."""
    return n - -(-n * TOP // BOTTOM) + 1


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of ``n``: a power of two from n up, 256 to 32768."""
    return min(32768, max(256, 1 << (n - 1).bit_length()))


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity bitmap: bit (hash mod width) flips for each hash."""
    width = width_of(len(hashes))
    odd = np.bincount((hashes % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


SETS = "key long, doc_id long, th long, n int, s1 long, s2 long, prefix array<long>, bits binary"


def _set_columns(sets: list[np.ndarray], common: np.ndarray | None = None) -> list[pa.Array]:
    n = [len(s) for s in sets]
    s1 = np.array([mixed(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
    s2 = np.array([mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
    heads = []
    for s in sets:
        p = prefix_length(len(s)) if len(s) else 0
        if common is not None and len(s):
            often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
            s = np.concatenate([s[~often], s[often]])
        heads.append(s[:p])
    offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
    flat = np.concatenate(heads).view(np.int64) if heads else np.empty(0, np.int64)
    return [pa.array(n, pa.int32()), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([bitmap(s) for s in sets], pa.binary())]


def shingled(docs: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    """``SETS`` rows of ``docs(key, doc_id, th, text)``; shingles in ``common`` (sorted) come last in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in chunked(batch.column(3).to_pylist()):
                ids = [batch.column(c).slice(at, len(sets)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*ids, *_set_columns(sets, common)], names=["key", "doc_id", "th", "n", "s1", "s2", "prefix", "bits"])

    return docs.mapInArrow(run, SETS)


def overlap_needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection of sets of sizes a and b that makes them alike: o / (a + b - o) >= TOP / BOTTOM."""
    return -(-(a + b) * TOP // (TOP + BOTTOM))


class Bitmaps:
    """The bitmaps of a batch, in a matrix for each width; a wider one folds onto half its width."""

    def __init__(self, bits: list[bytes]):
        sizes = np.array([len(b) for b in bits])
        self.width, self.row = sizes, np.empty(len(bits), dtype=np.int64)
        self.full, self.half = {}, {}
        for w in np.unique(sizes):
            at = np.flatnonzero(sizes == w)
            self.row[at] = np.arange(len(at))
            m = np.frombuffer(b"".join(bits[i] for i in at), dtype=np.uint64).reshape(len(at), -1)
            self.full[w] = m
            if m.shape[1] > 1:
                self.half[w] = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the bitmaps of rows i and j differ: no more than their sets do in members."""
        out = np.zeros(len(i), dtype=np.int64)
        pair = self.width[i] * (1 << 20) + self.width[j]
        for code in np.unique(pair):
            at = np.flatnonzero(pair == code)
            a, b = int(code) >> 20, int(code) & ((1 << 20) - 1)
            if max(a, b) > 2 * min(a, b):
                continue
            w = min(a, b)
            left = (self.full if a == w else self.half)[a][self.row[i[at]]]
            right = (self.full if b == w else self.half)[b][self.row[j[at]]]
            out[at] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
        return out


def _passing(maps: Bitmaps, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    if not len(i):
        return np.empty(0, bool)
    most = (n[i] + n[j] - maps.differing(i, j)) // 2
    return most >= overlap_needed(n[i], n[j])


def leader_pairs(node: np.ndarray, token: np.ndarray, n: np.ndarray, maps: Bitmaps, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for each row j that passes against one of its tile's leaders i.

    Leaders go by a hash of the node, one of eight by tile, so that a group
    that meets in many tiles has many leaders.  The row first in that order
    leads; then the first that no leader took.  All tiles of the batch take
    their step together.
    """
    turn = mixed(node.view(np.uint64) ^ (mixed(token.view(np.uint64)) % np.uint64(8)) << np.uint64(48))
    tile = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((turn, tile))
    free = np.ones(len(n), dtype=bool)
    left, right = [], []
    for _ in range(LEADERS):
        at = order[free[order]]
        if not len(at):
            break
        first = at[np.unique(tile[at], return_index=True)[1]]
        free[first] = False
        lead = np.full(len(bounds) - 1, -1)
        lead[tile[first]] = first
        rest = np.flatnonzero(free)
        i = lead[tile[rest]]
        near = (i >= 0) & (n[rest] * TOP <= n[np.maximum(i, 0)] * BOTTOM) & (n[np.maximum(i, 0)] * TOP <= n[rest] * BOTTOM)
        i, j = i[near], rest[near]
        ok = _passing(maps, n, i, j)
        left.append(i[ok])
        right.append(j[ok])
        free[j[ok]] = False
    return np.concatenate(left or [np.empty(0, int)]), np.concatenate(right or [np.empty(0, int)])


def nearest_pairs(pairs: Iterator[tuple[np.ndarray, np.ndarray]], size: int, maps: Bitmaps) -> tuple[np.ndarray, np.ndarray]:
    """Of all (i, j), the nearest j of each i and the nearest i of each j."""
    best, who = np.full(size, np.iinfo(np.int64).max), np.full(size, -1)
    for i, j in pairs:
        far = maps.differing(i, j)
        # i and j are each without repeats, as they lie at one distance in the order
        for x, y in ((i, j), (j, i)):
            closer = far < best[x]
            best[x[closer]], who[x[closer]] = far[closer], y[closer]
    at = np.flatnonzero(who >= 0)
    return at, who[at]


def cross_pairs(n: np.ndarray, comp: np.ndarray, side: np.ndarray, maps: Bitmaps, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All passing (i, j) of a tile in different components, by distance in the tile's order of size.

    ``side`` tells the two blocks of a split tile apart (2: a whole tile or a
    block with itself); only pairs across are compared then.
    """
    stop = np.repeat(bounds[1:], np.diff(bounds))
    active = np.arange(len(n))
    d = 0
    while len(active):
        d += 1
        active = active[active + d < stop[active]]
        active = active[n[active + d] * TOP <= n[active] * BOTTOM]
        far = active[(comp[active] != comp[active + d]) & ((side[active] != side[active + d]) | (side[active] == 2))]
        ok = _passing(maps, n, far, far + d)
        if ok.any():
            yield far[ok], far[ok] + d


PAIRS = "a long, b long"
CANDIDATES = PAIRS + ", far int"


def tile_pairs(tiles: DataFrame, mode: str) -> DataFrame:
    """``CANDIDATES`` (a < b, and in how many bits they differ) from ``tiles(tile, token, node, n, comp, side, bits)``.

    ``mode`` is leaders (of any component), nearest (of each row, in another
    component) or all (in different components).  Tiles arrive whole and in
    order within a partition; each is at most two blocks of ``BLOCK`` rows.
    """

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows.column("tile").to_numpy() if rows.num_rows else np.empty(0)
        token = rows.column("token").to_numpy()
        node, n, comp, side = (rows.column(c).to_numpy() for c in ("node", "n", "comp", "side"))
        n = n.astype(np.int64)
        change = np.flatnonzero((key[1:] != key[:-1]) | (token[1:] != token[:-1])) + 1
        bounds = np.concatenate([[0], change, [len(n)]])
        maps = Bitmaps(rows.column("bits").to_pylist())
        found = iter([leader_pairs(node, token, n, maps, bounds)]) if mode == "leaders" else cross_pairs(n, comp, side, maps, bounds)
        for i, j in [nearest_pairs(found, len(n), maps)] if mode == "nearest" else found:
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(maps.differing(i, j), pa.int32())], names=["a", "b", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key, token = table.column("tile").to_numpy(), table.column("token").to_numpy()
            cut = int(np.flatnonzero((key != key[-1]) | (token != token[-1]))[-1]) + 1 if (key[0], token[0]) != (key[-1], token[-1]) else 0
            if cut:
                yield from pairs(table.slice(0, cut).combine_chunks())
            held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    columns = ["tile", "token", "node", "n", "comp", "side", "bits"]
    sorted_ = tiles.select(*columns).repartition("token", "tile").sortWithinPartitions("token", "tile", "n", "node")
    return sorted_.mapInArrow(run, CANDIDATES).where("a < b").distinct()


def token_counts(heads: DataFrame) -> DataFrame:
    """(token, sets) of prefix shingles that two sets or more have; ``heads(node, n, prefix)``.  Counts are summed before they move."""
    return heads.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")


def live_rows(heads: DataFrame) -> DataFrame:
    """(token, node, n, sets) of the shingles that ``token_counts`` finds; a frequent one's rows are split by the adaptive join."""
    rows = heads.select("node", "n", F.explode("prefix").alias("token"))
    return rows.join(token_counts(heads), "token").select("token", "node", "n", "sets")


def _banded(live: DataFrame) -> DataFrame:
    """``live`` rows in overlapping size bands: alike sets are in the same band or in neighbours, as bands grow by BOTTOM / TOP."""
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BOTTOM / TOP))).cast("long")
    return live.withColumn("own", own).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))


def _whole_tiles(live: DataFrame) -> DataFrame:
    return live.where(F.col("sets") <= BLOCK).select("token", "node", "n", "comp", F.lit(0).cast("long").alias("tile"), F.lit(2).alias("side"))


def leader_tiles(live: DataFrame) -> DataFrame:
    """A few of ``live``'s shingles of each set as tiles of about ``BLOCK`` rows at most, for the first pass.

    Shingles go by their low bits, so alike sets choose alike.  A large size
    band is dealt into blocks by a hash of node and shingle, so sets that miss
    each other in one shingle's blocks meet in another's.
    """
    step = F.expr(f"shiftleft(1L, cast(floor(log2(greatest(1.0D, n / {BOTTOM * FIRST}))) as int))")
    live = live.where(F.pmod("token", step) == 0)
    large = _banded(live.where(F.col("sets") > BLOCK))
    block = F.pmod(F.xxhash64("node", "token"), F.ceil(F.col("sets") / BLOCK).cast("long"))
    return _whole_tiles(live).unionByName(large.select("token", "node", "n", "comp", F.xxhash64(F.lit(2), F.col("band"), block).alias("tile"), F.lit(2).alias("side")))


def split_tiles(live: DataFrame) -> DataFrame:
    """``live`` as tiles of bounded size in which all pairs of different components meet.

    A frequent shingle's rows are cut into overlapping size bands, so that only
    sets of like size meet.  A band of more than ``BLOCK`` rows becomes blocks:
    those of its largest component, whose rows need not meet each other, and
    those of all others, which meet each other and the former.
    """
    large = _banded(live.where(F.col("sets") > BLOCK))
    held = large.groupBy("token", "band", "comp").agg(F.count(F.lit(1)).alias("rows"))
    size = held.groupBy("token", "band").agg(F.sum("rows").alias("all"), F.max(F.struct("rows", "comp")).alias("most"))
    large = large.join(size, ["token", "band"])
    blocks = lambda rows: F.ceil(rows / BLOCK).cast("long")
    large = large.withColumns({"ours": F.col("comp") == F.col("most.comp"), "own_blocks": blocks(F.col("most.rows")), "other_blocks": blocks(F.col("all") - F.col("most.rows"))})
    block = F.pmod(F.xxhash64("node"), F.when(F.col("ours"), F.col("own_blocks")).otherwise(F.col("other_blocks")))
    others = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    large = large.withColumn("block", block)
    # (kind, lesser block, greater block, side): kind 0 is a block of the largest component with one of the others
    mine = F.transform(others(F.col("other_blocks")), lambda x: F.struct(F.lit(0).alias("kind"), x.alias("lo"), F.col("block").alias("hi"), F.lit(1).alias("side")))
    met = F.transform(others(F.col("own_blocks")), lambda x: F.struct(F.lit(0).alias("kind"), F.col("block").alias("lo"), x.alias("hi"), F.lit(0).alias("side")))
    among = F.transform(others(F.col("other_blocks")), lambda x: F.struct(F.lit(1).alias("kind"), F.least("block", x).alias("lo"), F.greatest("block", x).alias("hi"), F.when(x == F.col("block"), 2).when(F.col("block") < x, 0).otherwise(1).alias("side")))
    large = large.withColumn("at", F.explode(F.when(F.col("ours"), mine).otherwise(F.concat(met, among))))
    return _whole_tiles(live).unionByName(large.select("token", "node", "n", "comp", F.xxhash64(F.lit(1), "band", "at.kind", "at.lo", "at.hi").alias("tile"), F.col("at.side").alias("side")))


def with_bits(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    return tiles.join(nodes.select("node", "bits"), "node")


def texts_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of every node in ``pairs``, written once."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "key", "th"), "node")
    wanted = materialize(wanted, "jaccard-wanted")
    texts = docs.join(bounded(wanted, wanted.count(), FETCH), ["key", "th"]).groupBy("node").agg(F.first("text").alias("text"))
    return materialize(texts, "jaccard-texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets are alike, by exact intersection of sorted arrays."""
    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")

    def alike(left: np.ndarray, right: np.ndarray) -> bool:
        both = len(np.intersect1d(left, right, assume_unique=True))
        return both * BOTTOM >= TOP * (len(left) + len(right) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                sides = [[s for _, sets in chunked(batch.column(c).to_pylist()) for s in sets] for c in (2, 3)]
                keep = pa.array([alike(x, y) for x, y in zip(*sides, strict=True)], pa.bool_())
                yield batch.select([0, 1]).filter(keep)

    return met.select("a", "b", "left", "right").mapInArrow(run, PAIRS)


def linked(first: DataFrame, rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Enough links to connect all that ``rest`` (CANDIDATES) connects, beyond the links ``first``.

    The nearest candidates of each node come first, eight times as many in each
    round; what a round connects drops out of the next, so a group of near
    copies is settled by few of its pairs.  Every candidate is either verified
    or lies inside a component.
    """
    links, left, most, k = first, rest, 8, 0
    while left.limit(1).count():
        label = components(links)
        for side in ("a", "b"):
            left = left.join(label.withColumnRenamed("node", side).withColumnRenamed("comp", f"c{side}"), side, "left")
        left = left.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "far")
        nearest = lambda x, y: F.row_number().over(Window.partitionBy(x).orderBy("far", y))
        left = materialize(left.withColumn("turn", F.least(nearest("a", "b"), nearest("b", "a"))), f"jaccard-left{k}")
        links = materialize(links.unionByName(verified(left.where(F.col("turn") <= most).select("a", "b"), texts)), f"jaccard-links{k}")
        left = left.where(F.col("turn") > most).select("a", "b", "far")
        most, k = most * 8, k + 1
    return links


def mixed_tiles(live: DataFrame, label: DataFrame) -> DataFrame:
    """``live`` rows with their components, of the shingles that sets of different components share."""
    held = live.drop("comp").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    shared = held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return held.join(shared, "token", "left_semi")


def connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links (u, v), and the least node of its connected component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(nodes))
    left, right = at[: len(u)], at[len(u) :]
    while True:
        a, b = parent[left], parent[right]
        open_ = a != b
        if not open_.any():
            return nodes, nodes[parent]
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        # each root hooks onto its least neighbour, which is below it; then all point to their roots
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


def components(links: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, comp) of every node in ``links(a, b)``, a != b: comp is the least node of its connected component.

    While there are more than ``finish`` links, a round hooks every node onto
    its highest neighbour (by degree, then by a hash), jumps all pointers to
    the roots and keeps the links between different roots.  A node that is
    higher than all its neighbours has at least as many of them as each of them
    has, so at most half the nodes stay roots: rounds are logarithmic in the
    nodes for every graph, and links shrink.  One task connects the bounded
    rest.  Every step is written to the shared folder.
    """
    edges = materialize(links.union(links.select(F.col("b"), F.col("a"))).toDF("u", "v").distinct(), "components-links")
    hooks: list[DataFrame] = []
    rank = lambda x: F.struct(F.col("degree").alias("degree"), F.xxhash64(x).alias("turn"), F.col(x).alias("node"))
    while edges.count() > max(0, 2 * finish):
        k = len(hooks)
        degrees = edges.groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
        best = edges.join(degrees, "v").groupBy("u").agg(F.max(rank("v")).alias("best"), F.count(F.lit(1)).alias("degree"))
        tree = materialize(best.select(F.col("u").alias("node"), F.greatest("best", rank("u"))["node"].alias("parent")), f"components-hooks{k}")
        moved = 1
        while moved:
            above = tree.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            step = tree.join(above, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
            step = materialize(step, f"components-jumps{k}")
            moved, tree = step.where("moved").limit(1).count(), step.select("node", "parent")
        hooks.append(tree)
        for side in ("u", "v"):
            edges = edges.join(tree.toDF(side, f"r{side}"), side)
        edges = materialize(edges.where("ru != rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), f"components-left{k}")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in connected(u, v)], names=["node", "root"])

    # bounded: at most ``finish`` links, each in one direction
    roots = edges.where("u < v").coalesce(1).mapInArrow(finished, "node long, root long")
    # from the last round back, so that no join is larger than its round
    for tree in reversed(hooks):
        roots = tree.join(roots.toDF("parent", "root"), "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    if not hooks:
        return materialize(roots.withColumnRenamed("root", "comp"), "components")
    named = roots.groupBy("root").agg(F.min("node").alias("comp"))
    return materialize(roots.join(named, "root").select("node", "comp"), "components")


def common_shingles(counts: DataFrame) -> np.ndarray:
    """The most common prefix shingles, sorted; at most ``MOST_COMMON`` of those in more than ``COMMON`` sets.

    Any such list keeps the join exact; it only moves shingles to the end of
    the order, where a passage that many texts share makes no tile.
    """
    found = counts.where(F.col("sets") > COMMON).orderBy(F.desc("sets"), "token").limit(MOST_COMMON)
    return np.sort(np.array([r.token for r in found.collect()], dtype=np.int64).view(np.uint64))


def _grouped(docs: DataFrame) -> DataFrame:
    """``_found``, written; all other tables of the search are deleted."""
    with scratch(docs.sparkSession):
        return keep(_found(docs), "jaccard-groups")


def _found(docs: DataFrame) -> DataFrame:
    """One row a document: key (doc_id, or the least number), doc_id, th (hash of the text), n_shingles, component_id, comp (null: no shingle)."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    own = own.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("key"), "doc_id", F.xxhash64("text").alias("th"), "text")
    sets = materialize(shingled(own), "jaccard-sets")
    by_set = sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("least"), F.min(F.struct("key", "th")).alias("rep"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    nodes = materialize(by_set.select(F.monotonically_increasing_id().alias("node"), "n", "s1", "s2", "least", "rep.key", "rep.th", "prefix", "bits"), "jaccard-nodes")
    heads = nodes.select("node", "n", "prefix")
    common = common_shingles(token_counts(heads))
    if len(common):
        tokens = F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in common.view(np.int64)], "token long"))
        touched = nodes.select("node", F.explode("prefix").alias("token")).join(tokens, "token", "left_semi").select("node").distinct()
        touched = materialize(touched.join(nodes.select("node", "key", "th", "n", "s1", "s2"), "node"), "jaccard-touched")
        keys = touched.select("key", "th").distinct()
        again = shingled(own.join(bounded(keys, keys.count(), FETCH), ["key", "th"]), common).groupBy("n", "s1", "s2").agg(F.first("prefix").alias("prefix"))
        moved = materialize(touched.join(again, ["n", "s1", "s2"]).select("node", "n", "prefix"), "jaccard-moved")
        heads = heads.join(moved.select("node"), "node", "left_anti").unionByName(moved)
    live = materialize(live_rows(heads), "jaccard-live")
    first = tile_pairs(with_bits(leader_tiles(live.withColumn("comp", F.col("node"))), nodes), "leaders")
    first = materialize(first, "jaccard-leaders").select("a", "b")
    links = materialize(verified(first, texts_of(first, nodes, own)), "jaccard-links")
    label = components(links)
    # a tile inside one component has nothing left to compare, nor has a set without a near one in another component
    for k in range(NEAREST):
        live = mixed_tiles(live, label)
        near = materialize(tile_pairs(with_bits(split_tiles(live), nodes), "nearest"), f"jaccard-near{k}").select("a", "b")
        if not near.limit(1).count():
            break
        active = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
        live = materialize(live.join(active, "node", "left_semi"), f"jaccard-live-near{k}")
        links = materialize(links.unionByName(verified(near, texts_of(near, nodes, own))), f"jaccard-links-near{k}")
        label = components(links)
    else:
        second = materialize(tile_pairs(with_bits(split_tiles(mixed_tiles(live, label)), nodes), "all"), "jaccard-rest")
        if second.limit(1).count():
            label = components(linked(links, second, texts_of(second, nodes, own)))
    named = nodes.select("node", "n", "s1", "s2", "least").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_comp = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_digest = named.join(of_comp, "comp").select("n", "s1", "s2", "component_id", "comp")
    filled = sets.where("n > 0").select("key", "doc_id", "th", "n", "s1", "s2").join(by_digest, ["n", "s1", "s2"]).select("key", "doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "component_id", "comp")
    empty = sets.where("n = 0").select("key", "doc_id", "th", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("comp"))
    return filled.unionByName(empty)


def similarity_components(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    Null and blank texts have no shingles and are their own component; texts
    of fewer words than a shingle are one shingle.  Copies are linked.  A
    document without an id takes part in links, but never names a component
    unless no member has an id (component_id is then null).  Rows that repeat
    an id are documents of their own.  Other columns are not read.
    """
    return _grouped(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of alike texts; rows keep their columns.

    The row of the least id stays, one without an id only where no member has
    one; of those, the one of the least hash of its text.  Rows that repeat an
    id are documents of their own.  A null or blank text is like no other, so
    its row always stays.
    """
    names = docs.columns
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.withColumns({"__key": F.coalesce(docs["doc_id"].cast("long"), F.lit(_LOWEST)), "__th": F.xxhash64(text)})
    members = _grouped(docs).where("comp is not null").groupBy("comp", "key", "th").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "key", "th", "copies"))
    chosen = materialize(members.groupBy("comp").agg(first.alias("first")).select(F.col("first.key").alias("__key"), F.col("first.th").alias("__th"), "first.copies"), "jaccard-chosen")
    words = keyed.where(text.rlike(WORD))
    stay = words.join(chosen.where("copies = 1"), ["__key", "__th"], "left_semi").select(*names)
    if chosen.where("copies > 1").limit(1).count():
        turn = F.row_number().over(Window.partitionBy("__key", "__th").orderBy("__key"))
        repeated = words.join(chosen.where("copies > 1"), ["__key", "__th"], "left_semi")
        stay = stay.unionByName(repeated.withColumn("__turn", turn).where("__turn = 1").select(*names))
    return stay.unionByName(docs.where(~text.rlike(WORD)))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(load(spark, sf_dir, "documents"))
