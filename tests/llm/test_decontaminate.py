import random
import re

import numpy as np

from tideline.llm.decontaminate import align, find_leaks


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def local_score(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(150):
        a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 60))
        score, low, high = align(a, b)
        assert score == local_score(a.tolist(), b.tolist())
        assert score == (local_score(a.tolist(), b[low:high].tolist()) if score else 0)


def corpus():
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([3, 5, 20, 50])))) for i in range(30)]
    docs = []
    for d in range(120):
        text = rng.choices(pool, k=rng.randrange(200))
        if d % 3 == 0:
            leak = rng.choice(items)[1].upper().split()
            for _ in range(d % 5):
                leak[rng.randrange(len(leak))] = "edit"
            at = rng.randrange(len(text) + 1)
            text[at:at] = leak
        docs.append((d, " ".join(text)))
    return docs, items


def test_matches_brute_force(spark):
    docs, items = corpus()
    want = set()
    for d, t in docs:
        own = words(t)
        grams = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        for i, u in items:
            item = words(u)
            if grams & {tuple(item[k : k + 5]) for k in range(len(item) - 4)} and local_score(item, own) >= 0.5 * len(item):
                want.add((d, i, round(local_score(item, own) / len(item), 9)))
    for block in (1 << 20, 100):
        got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), common=1e9, block_grams=block).collect()
        assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in got} == want and len(got) == len(want)


def test_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(60000))
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b c d e f", "z"), (3, "a b c d e f", "z"), (3, "a b c d e f", "z"), (4, long + " a b c d e f", "q")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, "A B C D E F", "m"), (1, "A B C D E F", "m"), (2, "a b", "n"), (3, None, None)], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.start_word, r.end_word) for r in find_leaks(docs, items).collect()), key=str)
    assert got == sorted([(None, 1, 0, 6), (3, 1, 0, 6), (4, 1, 60000, 60006)], key=str)
    assert find_leaks(docs.limit(0), items).collect() == [] and find_leaks(docs, items.limit(0)).collect() == []


def test_hot_edited_copy_keeps_seeds(spark):
    """An edited copy in 200 documents and one exact copy: all leak, though every n-gram of the edited one is hot."""
    item = [f"w{i}" for i in range(40)]
    edited = [("edit" if i in (6, 13, 20, 27, 34) else w) for i, w in enumerate(item)]
    docs = [(d, " ".join([f"a{d}", f"b{d}", *edited, f"c{d}"])) for d in range(200)] + [(200, " ".join(item)), (201, "nothing of it")]
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: r.similarity for r in got} == {d: 0.75 for d in range(200)} | {200: 1.0} and len(got) == 201
