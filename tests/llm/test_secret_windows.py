"""The network sees a candidate over its whole length, and short ones too."""

from __future__ import annotations

import random

import numpy as np

from carelake.llm import secrets
from tests.llm.test_search import windows


def test_windows_are_the_single_ones_and_cover_the_candidate():
    text = "é token " + "Ab3/" * 40 + " then 日本 abcdefgh"
    for start, end in [(0, 1), (8, 168), (8, 20), *secrets.candidates_of(text)]:
        parts = secrets.blocks(start, end)
        assert {i for a, b in parts for i in range(a, b)} == set(range(start, end))
        got = secrets.windows(secrets.padded(text), parts)
        assert [r.tobytes() for r in got] == [secrets.window(text, a, b) for a, b in parts]
    assert text[slice(*secrets.candidates_of(text)[-1])] == "abcdefgh"


def test_a_key_behind_a_long_path_is_found(spark):
    network = secrets.train(*windows(1, 900))
    rnd = random.Random(2)
    word = lambda k: "".join(rnd.choices("aeioulnrst", k=k))
    path = [word(40 + i) for i in range(20)]
    key = ["".join(rnd.choices("0123456789abcdef", k=31)) for _ in path]  # too short for a base pattern
    rows = [(i, f"some words before {p}/{k} and after") for i, (p, k) in enumerate(zip(path, key, strict=True))]
    rows += [(100 + i, f"some words before {p} and after") for i, p in enumerate(path)]
    got = {r["doc_id"]: r["found"] for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string"), network).collect()}
    found = np.array([bool(got[i]) for i in range(20)])
    assert found.mean() >= 0.9 and all(f["start"] == 18 and f["kind"] == "cnn" for i in range(20) for f in got[i])
    heads = [np.frombuffer(secrets.window(t, 18, 18 + len(p) + 32), np.uint8) for (_, t), p in zip(rows, path, strict=False)]
    assert (network.probabilities(np.array(heads)) < network.threshold).mean() >= 0.9  # the head alone does not tell
