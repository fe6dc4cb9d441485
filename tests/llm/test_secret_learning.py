"""The network learns from every window, however few its first weights come from."""

from __future__ import annotations

import random

import numpy as np

from carelake.llm import secrets


def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choices("aeioulnrst", k=rnd.randint(3, 14))) for _ in range(300)]
    out = []
    for i in range(600):
        said = rnd.choices(words, k=30)
        if i % 3 == 0:
            said[9] = "".join(rnd.choices("0123456789abcdef", k=40))
        if i % 30 == 1:  # rarer than what the first weights are held to
            said[20] = "api_key=" + "".join(rnd.choices(words, k=3))[:14]
        out.append(" ".join(said))
    return out


def test_the_threshold_keeps_recall_over_the_windows_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(secrets, "TRAIN_DOCS", 120)
    monkeypatch.setattr(secrets, "TRAIN_EACH", 30)
    said = texts()
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(5, "doc_id")
    network = secrets.fit(df)
    made = [x for t in said for x in secrets.labelled(t)]
    codes, labels = (np.concatenate(x) for x in zip(*made, strict=True))
    assert (network.probabilities(codes[labels > 0]) >= network.threshold).mean() >= secrets.RECALL


def test_the_answers_counted_are_those_of_all_windows_and_copies_count(spark):
    said = [*texts()[:60], texts()[0], None, ""]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(3, "doc_id")
    learned = secrets._learned(df, "text", secrets._first_network(df, "text")).collect()
    labels = np.concatenate([y for t in said for _, y in secrets.labelled(t or "")])
    for label in (0, 1):
        assert sum(r["amount"] for r in learned if r["kind"] == "seen" and r["label"] == label) == (labels == label).sum()
    assert sum(r["kind"] == "found" for r in learned) == labels.sum()


def test_one_label_alone_gives_no_network(spark):
    df = spark.createDataFrame([(i, "plain words alone, elephants") for i in range(4)], "doc_id long, text string")
    assert secrets.fit(df) is None
