"""The Jaccard join against all pairs by brute force."""

import random
import re

import numpy as np
import pytest

from consilium.llm import jaccard_join as jj

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    """(id, n_shingles, least id of its component) by comparing all pairs; ids are distinct."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j > i}:
            both = len(s & sets[j])
            if both * 100 >= 80 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def run(spark, rows, schema="doc_id long, text string"):
    return sorted(tuple(r) for r in jj.similarity_components(spark.createDataFrame(rows, schema)).collect())


def test_components_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def near_copies(seed, groups=6, most=40):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    passage, texts = [word() for _ in range(55)], []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 30, 200, 900]))]
        for _ in range(rng.randrange(1, most)):
            own = list(base)
            for _ in range(rng.randrange(0, max(1, len(own) // 40) + 2)):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own += passage
            texts.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    return list(enumerate(texts + texts[:7] + ["", None, "one two", "ONE two"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_and_shared_passages(spark, seed):
    rows = near_copies(seed)
    assert run(spark, rows) == brute(rows)


def test_common_shingles_and_split_tiles_change_nothing(spark, monkeypatch):
    rows = near_copies(3, groups=5, most=30)
    for name, value in (("COMMON", 4), ("BLOCK", 5), ("LEADERS", 1), ("FETCH", 1)):
        monkeypatch.setattr(jj, name, value)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("finish", [0, 2000, jj.FINISH])
def test_components_of_long_chains_stars_and_trees(spark, finish):
    rng = random.Random(7)
    n = 3000
    ids = rng.sample(range(10**6), 2 * n)
    chain, other = ids[:n], ids[n:]
    # a chain in random order, a star, a caterpillar, a random tree and a complete graph
    links = list(zip(chain, chain[1:]))
    groups = [chain, other[:500], other[500:1000], other[1000:2000], other[2000:2030]]
    links += [(groups[1][0], x) for x in groups[1][1:]]
    links += [(groups[2][max(0, i - 1 - i % 2)], groups[2][i]) for i in range(1, 500)]
    links += [(groups[3][rng.randrange(i)], groups[3][i]) for i in range(1, 1000)]
    links += [(x, y) for x in groups[4] for y in groups[4] if x < y]
    found = jj.components(spark.createDataFrame(links, "a long, b long"), finish).collect()
    assert sorted(map(tuple, found)) == sorted((x, min(g)) for g in groups for x in g)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (None, "x y", 1), (4, "a b c d e f", 1), (4, "q", 2), (9, "A B C D E F", 2), (9, "A B C D E F", 2), (5, None, 3)]
    got = run(spark, [r for r in rows if r[0] is not None], "doc_id long, text string, n int")
    assert got == sorted([(4, 2, 4), (4, 1, 4), (9, 2, 4), (9, 2, 4), (5, 0, 5)])
    with_null = jj.similarity_components(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in with_null) == sorted([("None", "4"), ("None", "None"), ("4", "4"), ("4", "4"), ("9", "4"), ("9", "4"), ("5", "5")])
    assert run(spark, []) == []


def test_one_of_each_with_null_and_repeated_ids(spark):
    rows = [(None, None), (None, " "), (None, "a b c d e f"), (1, "a b c d e f"), (None, "p q r s t u"), (None, "P q r s t u"), (4, "k l m n o p"), (4, "v w x y z a"), (4, "v w x y z a"), (0, "k l m n o p"), (7, ""), (7, "")]
    got = jj.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((str(r.doc_id), str(r.text).lower()) for r in got)
    assert kept == sorted([("None", "none"), ("None", " "), ("1", "a b c d e f"), ("None", "p q r s t u"), ("4", "v w x y z a"), ("0", "k l m n o p"), ("7", ""), ("7", "")])


def test_hashing_matches_the_definition_of_sets():
    texts = ["A b  c\td\x0be f", "a B c d e f", "a b", "", "é É é É é É", "x" * 70_000 + " b c d e f g", "a b c d e a b c d e a b c d e"]
    got = jj.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert np.array_equal(got[0], got[1])
    assert all(np.all(s[1:] > s[:-1]) for s in got)
    alone = [jj.shingle_sets([t.encode()])[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(got, alone, strict=True))


def test_prefixes_and_bounds_are_exact():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 2**63, 80).astype(np.uint64))
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 70))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        alike = both * 5 >= 4 * (len(a) + len(b) - both)
        maps = jj.Bitmaps([jj.bitmap(a), jj.bitmap(b)])
        bound = (len(a) + len(b) - int(maps.differing(np.array([0]), np.array([1]))[0])) // 2
        assert bound >= both
        assert alike == (both >= int(jj.overlap_needed(np.array([len(a)]), np.array([len(b)]))[0]))
        if alike:
            assert set(a[: jj.prefix_length(len(a))]) & set(b[: jj.prefix_length(len(b))])
