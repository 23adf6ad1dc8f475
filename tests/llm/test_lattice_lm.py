import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tideline.llm.lattice_lm import Lattice, lattice_scores

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def toy():
    first = {"": 0, "a": 1, "ab": 2}
    rest = {"a": 3, "b": 4, "ba": 5}
    byte = list(range(6, 262))
    weight = np.log(np.random.default_rng(0).dirichlet(np.ones(262)))
    return Lattice(first, rest, byte, weight, 0.3)


def brute(m, word, opening=True):
    """Sum over all segmentations, by trying every first cut."""
    total = 0.0
    table = m.w_first if opening else m.w_rest
    for j in range(0 if opening else 1, len(word) + 1):
        if word[:j] in table:
            after = word[j:]
            total += math.exp(table[word[:j]]) * (brute(m, after, False) if after else m.stop)
    if not opening and word[0] not in m.rest:
        after = word[1:]
        total += math.exp(m._spelled(word[0])) * (brute(m, after, False) if after else m.stop)
    return total


@pytest.mark.parametrize("word", ["a", "ab", "aba", "bab", "é", "aéb", "abababab"])
def test_marginal_sums_all_segmentations(word):
    m = toy()
    assert math.isclose(m.log_prob(word), math.log(brute(m, word)), rel_tol=1e-9)


def test_expected_counts_and_long_words():
    m = toy()
    counts = np.zeros(262)
    pieces = m.expect("abab", 2.0, counts)
    assert math.isclose(counts.sum(), pieces) and math.isclose(counts[:3].sum(), 2.0)
    assert math.isfinite(m.log_prob("ab" * 20000))
    before = sum(m.log_prob(w) for w in ("abab", "ab"))
    counts = np.zeros(262)
    used = sum(m.expect(w, 1e6, counts) for w in ("abab", "ab"))
    m.reweigh(counts, 2e6, used)
    assert sum(m.log_prob(w) for w in ("abab", "ab")) > before


def test_base_and_held_out(spark):
    rng = np.random.default_rng(3)
    lex = ["stem" + "".join(rng.choice(list("aeiou"), 3)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(lex, rng.integers(0, 40))).title()) for i in range(300)] + [(300, None), (301, ""), (302, "zzz É")]
    got = {r.doc_id: r for r in lattice_scores(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string"), VOCABULARY).collect()}
    tokens = {i: (t or "").lower().split() + ["\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    out = [got[i] for i in tokens if held[i]]
    assert sum(r.mixed_score for r in out) > sum(r.base_score for r in out)
    assert sum(r.mixed_score for r in out) > sum(r.tuned_score for r in out) > sum(r.score for r in out)
    assert all(r.score < 0 for r in got.values())


@pytest.mark.parametrize("head", [1, 50_000])
def test_score_is_the_marginal_of_the_vocabularys_own_weights(spark, head):
    m = toy()
    rows = [(i, t) for i, t in enumerate(["ab aba", "Bab é ab", "", None, "aéb ab ab", "abab", "a\tb", "zz ab", "ab"])] + [(4, "b")]
    ends = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows)
    n = sum(len((t or "").split()) + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)
    p_end = (ends + 1) / (n + 2)

    def text_prob(t):
        return math.log10(p_end) + sum(math.log10(brute(m, w) * (1 - p_end)) for w in (t or "").lower().split())

    got = lattice_scores(spark.createDataFrame(rows, "doc_id long, text string"), m, head=head).collect()
    key = lambda x: (x[0], x[1])
    want = sorted(((i, text_prob(t)) for i, t in rows), key=key)
    for (i, p), r in zip(want, sorted(got, key=lambda r: (r.doc_id, r.score)), strict=True):
        assert r.doc_id == i and math.isclose(r.score, p, rel_tol=1e-9)


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lattice_scores(empty, VOCABULARY).collect() == []
    low = -(2**63)
    rows = spark.createDataFrame([(None, "a b", 1, 2), (5, "a", 1, 2), (5, "a", 1, 2), (low, None, 1, 2)], "doc_id long, text string, number long, train long")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in lattice_scores(rows, VOCABULARY).collect())
    assert got == [(low, 1), (0, 3), (5, 2), (5, 2)]


def test_query_scores_held_out_rows_near_the_base(spark, tmp_path):
    from tideline.llm.queries import op6_lattice_scores

    rng = np.random.default_rng(4)
    lex = ["".join(rng.choice(["an", "th", "ré", "tion", "x", "st,"], rng.integers(2, 5))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(lex, 50, p=np.arange(400, 0, -1) / 80200))) for i in range(200)] + [(200, None), (201, "zz É 漢字" * 300), (202, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_lattice_scores(spark, str(tmp_path)).collect()
    assert len(got) == 203 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    out = [r for r in got if r.held_out and r.doc_id < 200]
    assert sum(r.score for r in out) > 1.1 * sum(r.base_score for r in out)
