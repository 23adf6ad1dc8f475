import random
import zlib

import numpy as np

from tideline.llm.toxicity import Classifier, LabelModel, toxicity_scores


def corpus(n=600):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for d in range(n):
        toxic = d % 7 == 0
        text = rng.choices(plain, k=rng.randint(5, 60))
        if toxic:
            for w in rng.sample(["idiot", "pathetic!", "scum", "grumfoo", "grumbar", "Grumbaz,"], 3):
                text.insert(rng.randrange(len(text)), w)
        docs.append((d, " ".join(text)))
        labels.append((d, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = {r.doc_id: r for r in toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    truth = dict(labels)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= got[d].score <= 1 and got[d].predicted == (got[d].score >= 0.3) for d in truth)
    held = [d for d in truth if got[d].held_out]
    assert sum(got[d].predicted == truth[d] for d in held) >= 0.97 * len(held)


def test_label_model_finds_good_and_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    flip = lambda p: np.where(rng.random(4000) < p, y, rng.random(4000) < 0.2)
    good, copy, poor, mark = flip(0.9), None, flip(0.1), flip(0.95)
    copy = np.where(rng.random(4000) < 0.95, good, poor)
    votes = np.column_stack([good, copy, poor, mark]).astype(np.int64)
    rows, n = np.unique(votes, axis=0, return_counts=True)
    m = LabelModel(["good", "copy", "poor", "mark"]).fit(rows, n.astype(float), np.where(rows[:, 3] == 1, 0.9, 0.05))
    assert m.accuracies[0] > m.accuracies[2] + 0.1 and m.correlations[0, 1] > 0.3 and m.weights[0] < m.weights[2]
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.95


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "idiot scum trash", "c"), (3, "x " * 100000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == 5 and {r.predicted for r in got if r.doc_id is None} == {1} and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity_scores(docs.limit(0), labels.limit(0)).collect() == []
    assert Classifier.of_lexicons().bias < 0
