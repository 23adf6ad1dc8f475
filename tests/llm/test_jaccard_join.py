import random
import re

import numpy as np
import pytest

from tideline.llm.jaccard_join import SignatureTree, SizeBands, similar_components


def shingles(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)})


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    k = rng.randrange(len(words))
                    words[k : k + 1] = rng.choice([[], ["Zed"], ["x", "y"]])
        else:
            words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 11, 12, 30, 120, 400]))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("tile", [4 << 20, 300])
def test_matches_brute_force(spark, tile):
    rows = corpus(1)
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string"), tile_shingles=tile).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_lower_threshold_matches_brute_force(spark):
    rows = corpus(7)
    sets = {i: shingles(t, 5) for i, t in rows}
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, num=80).collect()}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                assert got[i] == got[j]
    assert all(got[i] == i or any(got[j] == got[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets if j != i) for i in sets)


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", None), (4, "One two", "d"), (5, "one  TWO", "e"), (6, "é é", "f"), (None, "one two", "g"), (4, "One two", "d"), (7, "x " * 30000, "h"), (8, "x", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_components(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, None), (7, 1, 7), (8, 1, 8)], key=str)
    assert similar_components(df.limit(0)).collect() == []


def test_bands_share_a_range():
    rng = np.random.default_rng(5)
    for num in (80, 90):
        check_bands(rng, num, SizeBands(num, 100, 5000))


def check_bands(rng, num, bands):
    for n in (4, 5, 9, 10, 11, 19, 37, 100, 431, 2000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for drop in range(0, n // 4 + 1, max(1, n // 40)):
            other = np.sort(rng.permutation(base)[drop:])
            if 100 * len(other) < num * n:
                continue
            a, b = (set(bands.signatures(x, np.array([len(x)]))[0].tolist()) for x in (base, other))
            assert drop == 0 or a & b


def test_tree_prunes():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64)) for _ in range(64)]
    tree = SignatureTree(sets + [s[:-3] for s in sets], 90, 100)
    assert len(set(tree.roots())) == 64 and tree.verified < 200
