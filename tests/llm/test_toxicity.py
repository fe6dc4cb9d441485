"""Toxicity: maximal segments against brute force, and held-out accuracy."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from carelake.llm import toxicity

CLEAN = [f"word{i}" for i in range(300)]
TOXIC = ["venom", "slurry", "vilezz", "grimeo"]


def slow_segments(dense):
    """Maximal segments by their definition: the best one first, then both sides of it."""
    best = max(((sum(dense[a:b]), -(b - a), -a) for a in range(len(dense)) for b in range(a + 1, len(dense) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a = -best[2]
    b = a - best[1]
    left = slow_segments(dense[:a])
    right = [(x + b, y + b, s) for x, y, s in slow_segments(dense[b:])]
    return [*left, (a, b, best[0]), *right]


def test_segments_are_the_maximal_ones():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(0, 14)
        own = sorted(rnd.sample(range(n), rnd.randint(0, n)))
        scores = [(i, rnd.choice([-2.3, -0.7, 0.4, 1.1, 3.7]) + rnd.random() / 100) for i in own]
        dense = [-0.51] * n
        for i, s in scores:
            dense[i] = s
        got = toxicity.maximal_segments(scores, -0.51)
        want = slow_segments(dense)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for _, _, s in got] == pytest.approx([s for _, _, s in want])


def corpus(seed, n):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(CLEAN, k=rnd.randint(5, 200))
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(rnd.randint(2, 6)):
                words.insert(rnd.randrange(len(words)), rnd.choice(TOXIC) + rnd.choice(["", "", "ab", "cd", "ef", "!"]))
        docs.append((i, " ".join(words), "en" if toxic else "fr"))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus(1, 900)
    labels = [*labels, (None, 1), (5, None), (99_999, 1)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    return toxicity.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 4 != 2)


def test_held_out_accuracy(spark, model):
    docs, labels = corpus(2, 400)
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "venom " * 3, "x"), (0, docs[0][1], "y"), (1002, "word1 " * 30_000, "x")]
    got = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string, score string"), model, keep=("doc_id", "text")).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    verdicts = [(r["score"] >= 0.3, truth[r["doc_id"]]) for r in got if r["doc_id"] in truth]
    assert sum(v == bool(t) for v, t in verdicts) >= 0.97 * len(verdicts)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["score"] == by[1001]["score"] < 0.3 and by[1002]["score"] < 0.3
    assert by[None]["score"] >= 0.3
    spans = [r["text"][p["start"] : p["end"]] for r in got if r["text"] for p in r["passages"]]
    assert spans and all(any(t in s.lower() for t in TOXIC) for s in spans)


def test_without_both_classes_or_rows(spark, model):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = docs.where("doc_id < 0").select("doc_id", F.lit(1).alias("toxic"))
    plain = toxicity.fit(docs, none)
    assert [r["score"] for r in toxicity.score(docs, plain).collect()] == [0.5, 0.5]
    only = toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert {r["score"] for r in toxicity.score(docs, only).collect()} == {0.25}
    assert toxicity.score(docs.where("doc_id < 0"), model).count() == 0
