"""Sharding, M-tree search and the secret scan against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelake.llm import mtree, secrets, sharding


def slow_top(rows, k):
    vectors = {i: np.array(v) for i, v in rows}
    out = []
    for q, a in vectors.items():
        if q % 20:
            continue
        scored = sorted(((-int(a @ b), i) for i, b in vectors.items() if i != q))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("kind", ["clustered", "spread", "equal"])
def test_top_k_is_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(mtree, "PAGE", 8)
    monkeypatch.setattr(mtree, "TREE", 120)
    monkeypatch.setattr(mtree, "BLOCK", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, 6))
    points = {"clustered": centres[rng.integers(0, 5, 300)] + rng.normal(0, 0.1, (300, 6)), "spread": rng.normal(0, 2, (300, 6)), "equal": np.repeat(centres[:1], 300, 0)}[kind]
    data = [(i, [float(np.float32(x)) for x in p], i) for i, p in enumerate(points)]
    data += [(400, None, 0), (420, [1.0, None], 0), (440, [float("nan")] * 6, 0), (460, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (20, data[20][1], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, id int")
    vectors = mtree.integer_vectors(df, "vec_id", "embedding").persist()
    whole = [(i, np.floor(64 * np.array(p, np.float32).astype(float))) for i, p, _ in data[:300]]
    got = mtree.top_k(vectors, F.col("id") % 20 == 0, 20).collect()
    assert sorted(map(tuple, got)) == sorted(slow_top(whole, 20))
    assert mtree.top_k(vectors.where("id < 0"), F.col("id") % 20 == 0).count() == 0
    assert mtree.top_k(vectors.where("id = 0"), F.col("id") % 20 == 0).count() == 0
    assert mtree.top_k(vectors.where("id < 5"), F.col("id") == 0, 20).count() == 4
    vectors.unpersist()


def test_bounds_save_comparisons(monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 32)
    rng = np.random.default_rng(1)
    points = np.floor(64 * (rng.normal(0, 1, (40, 8))[rng.integers(0, 40, 4000)] + rng.normal(0, 0.02, (4000, 8))))
    builder = mtree.Builder(np.arange(4000), points)
    assert sorted(e[1] for p in builder.pages for e in p if e[5] < 0) == list(range(4000)) and max(map(len, builder.pages)) <= 32
    names = ("vector", "id", "parent", "radius", "least", "child")
    searcher = mtree.Searcher([{"page": n, "entries": [dict(zip(names, e, strict=True)) for e in p]} for n, p in enumerate(builder.pages)])
    for q in range(0, 4000, 200):
        scores = points @ points[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert searcher.search(q, points[q], 10) == [(-s, i) for s, i in want]
    assert searcher.compared < 20 * 4000 / 2


@pytest.mark.parametrize("states", [1, 500, 1 << 20])
def test_queries_together_find_what_each_finds(monkeypatch, states):
    monkeypatch.setattr(mtree, "PAGE", 16)
    monkeypatch.setattr(mtree, "STATES", states)
    rng = np.random.default_rng(2)
    points = rng.integers(-2, 3, (600, 4)).astype(float)  # many ties
    points[100:250] = points[100]
    builder = mtree.Builder(np.arange(600) - 300, points)
    names = ("vector", "id", "parent", "radius", "least", "child")
    searcher = mtree.Searcher([{"page": n, "entries": [dict(zip(names, e, strict=True)) for e in p]} for n, p in enumerate(builder.pages)])
    asked = range(0, 600, 7)
    found = dict(searcher.search_all([i - 300 for i in asked], [points[i] for i in asked], 12))
    for i in asked:
        want = sorted((-int(s), j - 300) for j, s in enumerate(points @ points[i]) if j != i)[:12]
        assert found[i - 300] == [(-s, j) for s, j in want]
    assert list(searcher.search_all([], [], 12)) == []
    assert len(searcher.search(-300, np.array([1.0]), 700)) == 599  # a shorter vector, and fewer rows than asked for


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")


def check_shards(rows, got, shards=16):
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r["shard"] for r in got)
    assert all(0 <= s < shards for s in counts)
    each = [counts.get(s, 0) for s in range(shards)]
    assert max(each) - min(each) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))


def test_shards_are_even_and_hold_copies_together(spark):
    rows = [(i, f"text {i} é") for i in range(700)] + [(1000 + i, f"copy {i // 3}") for i in range(240)]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    check_shards(rows, got)
    where: dict = {}
    for r in got:
        if r["doc_id"] >= 1000:
            where.setdefault((r["doc_id"] - 1000) // 3, set()).add(r["shard"])
    assert sum(len(s) == 1 for s in where.values()) >= 0.9 * len(where)


def test_a_group_of_a_third_is_spread_over_the_shards_it_needs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PER_BIN", 10)
    rows = [(i, f"text {i}") for i in range(400)] + [(1000 + i, "hot") for i in range(300)] + [(2000 + i, f"pair {i // 2}") for i in range(100)]
    got = sharding.shard_documents(documents(spark, rows)).collect()
    check_shards(rows, got)


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(i, "all alike") for i in range(50)], [(None, "a"), (None, None), (3, ""), (3, "b"), (3, "b"), (4, None), (5, "x" * 100_000)]])
def test_shards_of_odd_tables(spark, rows):
    check_shards(rows, sharding.shard_documents(documents(spark, rows)).collect())


def test_quotas_leave_room():
    share = sharding._allowed({(0, 1): 100, (1, 0): 10, (2, 1): 50}, [100, 20, 50], [100, 60, 70])
    come, go = share[0, 1] * 100 + share[2, 1] * 50, share[1, 0] * 10
    assert 20 + come - go <= 60 + 1e-6 and share[1, 0] == 1.0


def slow_base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def secret_texts():
    rnd = random.Random(9)
    filler = ["the", "of", "Straße", "é", "mentementementementeado", "https://example.org/some/long/path.html", "x" * 40, "ſecret", "日本"]
    makers = [
        lambda: f'{rnd.choice(["password", "API_KEY", "apikey", "Token", "secret"])}{rnd.choice([" = ", ": ", "=", chr(34) + ": " + chr(39)])}{"".join(rnd.choices("abcXYZ019+/_.=-", k=rnd.randint(5, 30)))}',
        lambda: "AKIA" + "".join(rnd.choices("ABCXYZ0189", k=rnd.randint(8, 20))),
        lambda: "".join(rnd.choices("0123456789abcdef", k=rnd.choice([20, 31, 32, 40, 64]))),
        lambda: "token: api_key=abcdefgh12 password: token : abcdefghijk",
        lambda: "G" + "".join(rnd.choices("0123456789abcdef", k=40)) + "AKIA" + "Z" * 16,
    ]
    out = [" ".join(rnd.choice(makers)() if rnd.random() < 0.1 else rnd.choice(filler) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    return [*out, None, "", "a" * 100_000, "token=" + "z" * 50_000]


def test_base_findings_stay_and_more_are_added(spark):
    rows = list(enumerate(secret_texts())) + [(None, "password=abcdefgh1"), (3, "AKIA" + "A" * 12), (3, "AKIA" + "A" * 12)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kind string")
    got = secrets.find(df, secrets.fit(df)).collect()
    base = sorted((str(r["doc_id"]), str([(f["kind"], f["start"], f["end"]) for f in r["found"] if f["kind"] != "cnn"])) for r in got)
    assert base == sorted((str(i), str(slow_base(t))) for i, t in rows)
    bare = secrets.find(df, None).collect()
    assert base == sorted((str(r["doc_id"]), str([(f["kind"], f["start"], f["end"]) for f in r["found"]])) for r in bare)
    assert secrets.fit(df.where("doc_id < 0")) is None
    assert secrets.find(df.where("doc_id < 0"), None).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def windows(seed, n):
    rnd = random.Random(seed)
    codes, labels = [], []
    for _ in range(n):
        secret = rnd.random() < 0.5
        run = "".join(rnd.choices("0123456789abcdef" if secret else "aeioulnrst", k=rnd.randint(20, 40)))
        text = "some words before " + run + " and after"
        codes.append(np.frombuffer(secrets.window(text, 18, 18 + len(run)), np.uint8))
        labels.append(int(secret))
    return np.array(codes), np.array(labels)


def test_network_learns_and_its_threshold_keeps_recall():
    network = secrets.train(*windows(1, 900))
    codes, labels = windows(2, 600)
    good = network.probabilities(codes) >= network.threshold
    assert good[labels == 1].mean() >= 0.95 and good[labels == 0].mean() <= 0.02
    again = secrets.train(*windows(1, 900))
    assert again.threshold == network.threshold


def test_windows_at_the_ends():
    text = "é" + "a1" * 10
    assert len(secrets.window(text, 1, 21)) == secrets.BEFORE + secrets.HEAD + secrets.AFTER
    assert len(secrets.window("b2" * 40, 0, 80)) == secrets.BEFORE + secrets.HEAD + secrets.AFTER
