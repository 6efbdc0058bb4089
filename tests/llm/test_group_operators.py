"""Fingerprints, mixing and packing on small fixtures."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from consilium.llm import fingerprints, mixing, packing, token_counts

SMALL = "/root/testdata/sf0.001"


def texts_of(spark, texts, sources=None):
    rows = [(i, t, sources[i] if sources else "s", 5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, `key` string")


def test_winnowing_equals_brute_force(spark):
    rows = [(i, [((j * 7919 + i * 31) % 97) << 40 for j in range(i * 3)]) for i in range(1, 30)]
    for r in spark.createDataFrame(rows, "i int, h array<bigint>").select("i", "h", fingerprints.winnowed(F.col("h")).alias("w")).collect():
        windows = [r.h[k : k + 16] for k in range(max(1, len(r.h) - 15))]
        want = {k + max(q for q, v in enumerate(w) if v == min(w)) for k, w in enumerate(windows)}
        assert [x.pos for x in r.w] == sorted(want)


def brute_hash(data):
    return xxhash.xxh64_intdigest(data, seed=42)


def upper(data):
    return brute_hash(data) >> 28 << 28


def brute_fingerprint(text, gram=5, window=16):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,32}", text or "")
    hashes = [upper(" ".join(tokens).encode())] if tokens else []
    if len(tokens) >= gram:
        hashes = []
        for i in range(len(tokens) - gram + 1):
            run = 0
            for t in tokens[i : i + gram]:
                run = (run << 1 & (1 << 64) - 1) ^ brute_hash(t.encode())
            hashes.append(upper(run.to_bytes(8, "little")))
    at = set()
    for k in range(max(1, len(hashes) - window + 1) if hashes else 0):
        w = hashes[k : k + window]
        at.add(k + max(q for q, v in enumerate(w) if v == min(w)))
    return [(hashes[i], i) for i in sorted(at)]


def brute_likeness(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("gram", [1, 2, 3, 4, 5, 6, 7, 8, 11])
def test_rolled_hashes_equal_those_from_scratch(spark, gram):
    texts = ["a b c d e f g h i j k l", "a b", "", "x " * 30, "é ü " * 9 + "z" * 70]
    got = texts_of(spark, texts).orderBy("doc_id").select(fingerprints.winnowed(fingerprints.gram_hashes(F.col("text"), gram)).alias("w")).collect()
    assert [[(x.hash % 2**64, x.pos) for x in r.w] for r in got] == [brute_fingerprint(t, gram) for t in texts]


def test_whole_fingerprints_equal_brute_force(spark):
    small = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = small.unionByName(spark.createDataFrame([(901, None), (902, ""), (903, "w " * 200_000 + "é end"), (904, "x" * 100_000)], "doc_id long, text string"))
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs.withColumn("key", F.lit("clash"))).collect()}
    digest = lambda p: hashlib.sha256(",".join(f"{h:X}@{i}" for h, i in p).encode()).hexdigest()
    prints = [brute_fingerprint(t) for _, t in rows]
    for k, (doc, text) in enumerate(rows):
        m = len(text) // 4
        edited = text[: len(text) - m] + rows[(k + 1) % len(rows)][1][:m]
        other = brute_fingerprint(edited)
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digest(prints[k]), digest(other))
        assert r.near_edited == pytest.approx(brute_likeness(prints[k], other))
        assert r.near_next == pytest.approx(brute_likeness(prints[k], prints[(k + 1) % len(rows)]))


def test_shared_passage_shares_a_fingerprint(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    a, b = "x " * 37 + passage + " tail one", "other words before it " * 9 + passage
    got = texts_of(spark, [a, b]).select(fingerprints.marks(fingerprints.fingerprint(F.col("text"))).alias("m")).collect()
    assert set(got[0].m) & set(got[1].m)


def test_edited_texts_and_neighbours(spark):
    texts = ["alpha beta gamma delta", "", None, "é" * 41, "a b c d e f g h i j k l m n o p q r s t u v w", "a b c d e f g h i j k l m n o p q r s t u v w"]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(texts_of(spark, texts)).collect()}
    for i, t in enumerate(x or "" for x in texts):
        follow, m = texts[(i + 1) % len(texts)] or "", len(t) // 4
        edited = t[: len(t) - m] + follow[:m]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[4].fingerprint == got[5].fingerprint and got[4].near_next == 1.0
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.fingerprint_documents(texts_of(spark, []).limit(0)).count() == 0
    ids = spark.createDataFrame([(None, "a b"), (3, "c d"), (3, "c d"), (7, None)], "doc_id long, text string")
    assert fingerprints.fingerprint_documents(ids).count() == 4


def test_targets_share_and_stop(spark):
    sizes = {"b": 1000, "a": 100, None: 400, "c": 10, "d": 300}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    names = ["a", "b", "c", "d", None]
    weight = dict(zip(names, (5, 2, 1, 5, 2), strict=True))
    want, todo, words = {}, set(names), 1.5 * sum(sizes.values())
    while todo:
        each = {s: words * weight[s] / sum(weight[t] for t in todo) for s in todo}
        over = {s for s in todo if each[s] > 2 * sizes[s]}
        if not over:
            want |= each
            break
        for s in over:
            want[s] = 2 * sizes[s]
            words -= want[s]
        todo -= over
    assert got == pytest.approx(want)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5), F.lit(0)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mix_meets_its_targets(spark):
    texts = [None if i % 17 == 0 else "w " * (i * 37 % 400) for i in range(300)]
    sources = [["hot", "b", None, "c"][0 if i % 3 else i % 4] for i in range(300)]
    docs = texts_of(spark, texts, sources)
    out = mixing.mix(docs, "doc_id", "source").collect()
    assert len(out) == 300
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.size == len((texts[r.doc_id] or "").split())
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
        assert sum(r.size for r in rows) == rows[0].source_size
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), "doc_id").collect()}
    assert again == {r.doc_id: r.taken for r in out}
    assert mixing.mix(docs.limit(0), "doc_id").count() == 0
    assert [r.taken for r in mixing.mix(docs.where("text is null"), "doc_id").limit(1).collect()] == [0]


def test_shards_hold_the_mix_in_drawn_counts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4096)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    taken, size, target = {}, {}, {}
    for r in mixing.mix(docs, "source").collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        size[r.source], target[r.source] = r.source_size, r.target
    rows = mixing.shard_blocks(docs).collect()
    shards = math.ceil(sum(target.values()) / 4096)
    assert shards > 4 and {r.shard for r in rows} == set(range(shards))
    assert len({(r.source, r.slot) for r in rows}) == len(rows) and len({(r.source, r.epoch, r.block) for r in rows}) == len(rows)
    for source, words in taken.items():
        own = [r for r in rows if r.source == source]
        assert sum(r.words for r in own) == words
        assert all(0 < r.words <= min(64, size[source] - 64 * r.block) for r in own)
        # counts of slots on the shards are multinomial with equal shares
        counts, mean = collections.Counter(r.shard for r in own), len(own) / shards
        assert abs(sum((counts[k] - mean) ** 2 for k in range(shards)) / mean - (shards - 1)) < 5 * (2 * (shards - 1)) ** 0.5
    assert mixing.shard_blocks(docs.limit(0)).count() == 0
    # the words of each shard are those that the documents of the mix give it, and the shards' slots follow one another
    on_shard = collections.Counter()
    for r in mixing.mix(docs, "source").collect():
        parts = [tuple(map(int, x.split(":"))) for x in r.shard_words.split(",") if x]
        assert sum(w for _, w in parts) == r.taken and [k for k, _ in parts] == sorted({k for k, _ in parts})
        for k, w in parts:
            on_shard[r.source, k] += w
    want = collections.Counter()
    for r in rows:
        want[r.source, r.shard] += r.words
    assert on_shard == want
    for source in taken:
        ordered = [r.shard for r in sorted((r for r in rows if r.source == source), key=lambda r: r.slot)]
        assert ordered == sorted(ordered)


def brute_mix(rows, target):
    """Words taken of each row by a plain draw: slots in order, permuted blocks, whole epochs and then what is missing."""
    by = {}
    for i, (source, doc, size) in enumerate(rows):
        by.setdefault(source, []).append((doc, size, i))
    taken = [0] * len(rows)
    for source, own in by.items():
        total, index = sum(s for _, s, _ in own), sorted(by, key=lambda s: (s is None, s or "")).index(source)
        words = min(round(target[source]), 2 * total)
        if not words:
            continue
        stream = [i for _, s, i in sorted(own) for _ in range(s)]
        blocks = [stream[k : k + 64] for k in range(0, total, 64)]
        epoch = 0
        while words:
            for at in range(len(blocks)):
                block = blocks[plain_permuted(at, len(blocks), index, epoch)]
                for i in block[: max(0, words)]:
                    taken[i] += 1
                words -= min(words, len(block))
            epoch += 1
    return taken


def plain_permuted(x, count, index, epoch):
    """The swap-or-not rounds with the engine's hash: 32-bit and 64-bit integers in turn through xxhash64."""

    def step(value, size, seed):
        return xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), seed=seed)

    def hashed(*values):
        h = 42
        for v, size in values:
            h = step(v, size, h)
        return h - (1 << 64) if h >= 1 << 63 else h

    for r in range(1, mixing.ROUNDS + 1):
        partner = (hashed((mixing.SEED, 4), (r, 4), (index, 4), (epoch, 8)) % count - x) % count
        if hashed((mixing.SEED + 1, 4), (r, 4), (max(x, partner), 8), (index, 4), (epoch, 8)) % 2 == 1:
            x = partner
    return x


def test_mix_equals_a_plain_draw(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame([(1000 + i, None if i % 5 == 0 else "w " * (i * 91 % 700), "en", None, 0) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long"))
    out = mixing.mix(docs, "doc_id", "source").collect()
    target = {r.source: r.target for r in out}
    rows = [(r.source, r.doc_id, r.size) for r in out]
    assert [r.taken for r in out] == brute_mix(rows, target)


def test_mixed_documents_are_the_mix(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame([(None, "a b", "en", None, 3), (None, None, "en", "s", 3), (1, " lead and tail ", "en", "s", 15), (7, "w " * 200_000, "en", "s", 400_000)], "doc_id long, text string, lang string, source string, n_chars long")).withColumnsRenamed({"lang": "row"})
    taken, texts = collections.Counter(), collections.defaultdict(list)
    for r in mixing.mix(docs, "doc_id").collect():
        taken[r.doc_id] += r.taken
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    got = collections.Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len(r.text.split())
        # a stretch stands in its document as it is
        assert any(r.text in t for t in texts[r.doc_id]) and len(r.text) == r.n_chars
    assert got == +taken
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def histogram(lengths):
    return {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}


def piece_histogram(folder):
    docs = duckdb.sql(f"SELECT coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall()
    encoder = token_counts.Encoder()
    return histogram([n for (t,) in docs for _, n in packing.cut(len(encoder.ids([t])[0]) + 1)])


def test_plan_gives_every_piece_a_place():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 4000):
        counts = histogram(np.minimum(1024, rng.lognormal(6, 1.2, n).astype(int) + 1))
        plan, by_program = packing.whole_plan(counts)
        placed = {}
        for mix, times in plan:
            assert sum(x * a for x, a in mix) <= 1024 and times > 0
            for x, a in mix:
                placed[x] = placed.get(x, 0) + a * times
        assert placed == counts
        used, tokens = sum(t for _, t in plan), sum(x * k for x, k in counts.items())
        bound = max(-(-tokens // 1024), sum(k for x, k in counts.items() if x > 512))
        assert by_program <= used <= bound * 1.01 + 1


@pytest.mark.parametrize(("folder", "gap", "by_program"), [("/root/testdata/sf0.01", 0.003, 0.85), ("/root/testdata/sf0.1", 0.001, 0.95)])
def test_program_is_solved_to_its_dual_bound(folder, gap, by_program):
    counts = piece_histogram(folder)
    fractional, bound = packing.fractional_plan(counts)
    cover = collections.Counter()
    for mix, amount in fractional.items():
        assert amount > 0 and sum(x * a for x, a in mix) <= 1024
        for x, a in mix:
            cover[x] += a * amount
    assert all(cover[x] >= n * (1 - 1e-6) for x, n in counts.items())
    plan, placed = packing.whole_plan(counts)
    used, value = sum(t for _, t in plan), sum(fractional.values())
    assert bound * (1 - 1e-9) <= value <= min(used, bound * (1 + gap))
    assert used <= math.ceil(bound * (1 + gap)) and placed >= by_program * used


def test_prices_are_the_best_mixes():
    rng = np.random.default_rng(4)
    for _ in range(20):
        value = np.where(rng.random(25) < 0.4, rng.random(25), -np.inf)
        value[0] = -np.inf
        worth, last = packing.priced(value)
        best = [0.0] * 25
        for c in range(1, 25):
            best[c] = max([best[c - 1], *(value[x] + best[c - x] for x in range(1, c + 1) if np.isfinite(value[x]))])
        assert worth == pytest.approx(best)
        mix = packing.mix_of(last, 24)
        assert sum(x * a for x, a in mix.items()) <= 24 and sum(value[x] * a for x, a in mix.items()) == pytest.approx(worth[24])


def test_packed_pieces_rebuild_the_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "x y <|endoftext|>" * 3000), (902, "x y <|endoftext|>" * 3000)], "doc_id long, text string"))
    out = packing.pack(docs.withColumn("rank", F.lit(1))).collect()
    slow = token_counts.Encoder(fast=False)
    want = []
    for r in docs.collect():
        ids = np.array([*slow.ids([r.text or ""])[0], 2], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want.append((r.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
        assert sum(n for _, n in packing.cut(len(ids))) == len(ids)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    assert len({(r.doc_id, r.copy, r.piece) for r in out}) == len(out)
    nulls = packing.pack(spark.createDataFrame([(None, "a"), (None, "a"), (3, "b")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.sequence_id) for r in nulls) == [("3", 0), ("None", 0), ("None", 0)] and sorted(r.offset for r in nulls) == [0, 2, 4]
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0)).count() == 0
