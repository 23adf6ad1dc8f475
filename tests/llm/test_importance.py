"""Weights, scores and the draw against plain Python."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm.importance import bucket_counts, feature_buckets, resample

DOCS = "doc_id long, text string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def buckets(text, longest, size):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % size for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, longest, size, percent, least):
    s, t = (Counter(b for x in texts for b in buckets(x, longest, size)[0]) for texts in ([x for _, x in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + size) / ((s[b] + 1) * (total_t + size))))
    rows = []
    for key, text in docs:
        found, words = buckets(text, longest, size)
        h = int(sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    return [(*r[:4], n if n <= drawn else None) for n, r in enumerate(able, 1)] + [(*r[:4], None) for r in rows if not r[4]]


def corpus(n=120):
    rng = np.random.default_rng(5)
    docs = [(int(i), " ".join(rng.choice(["Alpha", "beta", "Größe", "d3lta", "x_y", "中文", "a-b"], rng.integers(0, 60)))) for i in range(n)]
    return docs + [(900, None), (901, ""), (902, "!!! \x00"), (903, "beta " * 30_000), (None, "alpha " * 25), (7, docs[30][1]), (7, docs[30][1])]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_draw(spark, longest):
    docs, target = corpus(), ["alpha d3lta alpha", None, "größe, ALPHA!"]
    frame = spark.createDataFrame(docs, DOCS).select("*", F.lit(1).alias("score"), F.lit("x").alias("rank"))
    got = resample(frame.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, size=997, percent=35)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, target, longest, 997, 35, 20), key=key)


def test_empty(spark):
    docs, none = spark.createDataFrame(corpus(), DOCS), spark.createDataFrame([], "text string")
    assert resample(docs, none).count() == 127 and resample(docs.limit(0), none).count() == 0
    assert bucket_counts(none).sum() == 0 and len(feature_buckets(np.empty(0, np.uint8), np.zeros(2, np.int64), 2, 10)[0]) == 0


def test_ties_over_ranges(spark):
    """Equal keys and texts are drawn each, with ranks of their own, over several ranges."""
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("word " * 25).alias("text")).repartition(6)
    ranks = [r["rank"] for r in resample(docs, docs.limit(1)).collect() if r["rank"] is not None]
    assert sorted(ranks) == list(range(1, 301))
