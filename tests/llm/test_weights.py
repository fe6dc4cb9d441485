"""Whitening, importance resampling and source mixing against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from carelake.llm import mixing, resample, whitening
from carelake.llm.common import written
from carelake.llm.ranks import numbered

SF = "/root/testdata/sf0.001"


# ---- numbers ----------------------------------------------------------------------------------------------------


def test_numbered_is_a_total_order(spark):
    df = written(spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("k")), "numbers")
    got = {r["id"]: r["n"] for r in numbered(df, [F.col("k").desc(), F.col("id")], "n").collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(5000), key=lambda i: (-(i % 7), i)), 1)}
    assert numbered(df.where("id < 0"), [F.col("id")], "n").count() == 0


# ---- whitening --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["spread", "low rank", "repeated", "wide", "two values"])
def test_rank_one_updates(kind):
    rng, d = np.random.default_rng(4), 12
    x = rng.integers(-200, 200, (400, d))
    if kind == "low rank":
        x[:, 3:] = x[:, :1] * np.arange(d - 3)
    if kind == "repeated":
        x[100:] = x[:1]
    if kind == "wide":
        x = x[:5] * 10**9
    if kind == "two values":
        x = np.sign(x)
    x = x.astype(np.int64) + whitening.OFFSET
    parts = [whitening.Spectrum.empty(d) for _ in range(3)]
    for i, part in enumerate(parts):
        part.add(x[i::3])
    found = whitening.Spectrum.empty(d)
    for part in parts:
        found.merge(part)
    scatter = np.cov(x.T.astype(float), bias=True) * len(x)
    size = max(np.abs(scatter).max(), 1)
    assert found.n == len(x) and found.sums == [int(s) for s in x.astype(object).sum(axis=0)]
    assert np.abs(found.basis.T @ found.basis - np.eye(d)).max() < 1e-12
    assert np.abs(found.basis * found.values @ found.basis.T - scatter).max() < 1e-12 * size * d
    assert np.abs(np.sort(np.linalg.eigvalsh(scatter)) - found.values).max() < 1e-12 * size * d


def slow_whitening(rows, components=16):
    xs = [np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + whitening.OFFSET for _, v in rows]
    distinct = np.array(sorted({tuple(x) for x in xs}), dtype=object)
    n, sums = len(distinct), distinct.sum(axis=0)
    apart = (n * distinct - sums).astype(float) / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (i, _), x in zip(rows, xs, strict=True):
        dev = n * x.astype(object) - sums
        y = (dev.astype(float) / n) @ vectors / np.sqrt(np.maximum(values, 1e-300))
        out[i] = (int((dev**2).sum()), y[:components])
    return n, values, out


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, values, want = slow_whitening(rows)
    got = defaultdict(dict)
    for r in contract.queries()["op11_whitening"](spark, SF).collect():
        assert r["n"] == n and r["deviation"] == want[r["vec_id"]][0] and r["identity_error"] <= 1e-10
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9
        got[r["component"]][r["vec_id"]] = r["whitened"]
    assert sorted(got) == list(range(1, 17))
    for c, column in got.items():
        a, b = np.array([column[i] for i, _ in rows]), np.array([want[i][1][c - 1] for i, _ in rows])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def whitened(spark, data, schema="vec_id long, embedding array<float>, n int, id string"):
    df = spark.createDataFrame(data, schema)
    vectors = written(whitening.integer_vectors(df, "vec_id", "embedding"), "vectors")
    return whitening.whiten(vectors, whitening.fit(vectors)).collect()


def test_odd_vectors(spark):
    line = [(i, [float(i), 2.0 * i, 1.0], 0, "x") for i in range(40)]
    odd = [(50, None, 0, "x"), (51, [1.0, None, 1.0], 0, "x"), (52, [float("nan")] * 3, 0, None), (53, [float("-inf")] * 3, 0, "x"), (54, [1e30, 0.0, 0.0], 0, "x")]
    more = [(None, [3.0, 6.0, 1.0], 0, "x"), (7, [7.0, 14.0, 1.0], 0, "x"), (7, [7.0, 14.0, 1.0], 0, "x")]
    got = whitened(spark, line + odd + more)
    assert Counter(r["id"] for r in got) == Counter([i for i in range(40)] + [None, 7, 7])  # one component: rank one
    assert {r["n"] for r in got} == {40} and {r["component"] for r in got} == {1}
    assert abs(np.var([r["whitened"] for r in got if r["id"] is not None][:40]) - 1) < 0.2
    assert whitened(spark, odd) == [] and whitened(spark, [(1, [1.0, 2.0], 0, "x")] * 3) == [] and whitened(spark, []) == []
    short = whitened(spark, [*line, (60, [5.0], 0, "x"), (61, [], 0, "x")])  # padded with zeros
    assert {r["id"] for r in short} == {*range(40), 60, 61} and {r["component"] for r in short} == {1, 2, 3}


def test_many_spectra_are_combined(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (300, 4)) + whitening.OFFSET
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(7)
    found = whitening.spectrum(df, 4)
    assert found.n == 300 and np.abs(found.values - np.linalg.eigvalsh(np.cov(x.T, bias=True) * 300)).max() < 1e-6


def test_large_counts_stay_exact():
    rows = np.array([[2**50, 5], [-(2**50), 7]])
    apart = whitening.centred(rows, 10**6, [3, 12])
    assert apart.tolist() == [[10**6 * 2**50 - 3, 5 * 10**6 - 12], [-(10**6) * 2**50 - 3, 7 * 10**6 - 12]]
    assert whitening._deviation(apart) == [None, None] and whitening._deviation(np.array([[3, 4]])) == [25]


# ---- resampling -------------------------------------------------------------------------------------------------


def slow_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_crcs(text, least, most):
    w = slow_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("most", [1, 3])
def test_crcs_of_runs_from_prefixes(most):
    shift = resample.Shifts(short=8)
    for text in ["", "one", "Two words", "É ÀB à_b 3.14 — ok", "x" * 1000 + " y", "a" * 70_000 + " b c " + "d" * 9, None, "\x00 ... !", "日本語 テキスト"]:
        got = resample.feature_crcs(resample.words(text), 1, most, shift).tolist()
        assert got == slow_crcs(text, 1, most)


def slow_resample(docs, target, least=1, most=1, buckets=10_000, percent=10, least_words=20):
    s = Counter(c % buckets for _, t in docs for c in slow_crcs(t, least, most))
    t_ = Counter(c % buckets for t in target for c in slow_crcs(t, least, most))
    total, aim = sum(s.values()), sum(t_.values())
    gain = [math.floor(1000 * math.log((t_[b] + 1) * (total + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        crcs = slow_crcs(text, least, most)
        weight = sum(gain[c % buckets] for c in crcs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(slow_words(text))])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_resampling_of_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = contract.queries()["op12_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == slow_resample(docs, target)


def test_odd_texts_are_resampled(spark):
    docs = [(1, None), (2, ""), (3, "... !!"), (None, "w " * 30), (None, None), (4, "Long " * 50_000), (5, "same words " * 20), (6, "same words " * 20), (6, "same words " * 20)]
    docs += [(10 + i, f"text number {i} " * (i % 9 + 1)) for i in range(60)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, rank int, score string, id int")
    target = spark.createDataFrame([("text number 5",), (None,)], "text string")
    for most in (1, 2):
        got = resample.resample(df, target, most=most, buckets=97)
        assert sorted(map(tuple, got.collect()), key=str) == slow_resample(docs, ["text number 5", None], 1, most, 97)
    assert resample.resample(df.where("doc_id < 0"), target).count() == 0
    assert resample.resample(df, target.where("text = ''")).count() == len(docs)
    with pytest.raises(ValueError):
        resample.features(df, "text", ["n_words"], 10)


# ---- mixing -----------------------------------------------------------------------------------------------------


def slow_seats(items, quota):
    """items: {item: (weight, most)}; the quota's highest quotients, one after the other."""
    quotients = [(-w / (2 * k - 1), i) for i, (w, most) in items.items() if w > 0 for k in range(1, most + 1)]
    return Counter(i for _, i in sorted(quotients)[:quota])


def slow_targets(sizes, weights, total, repeats=2):
    fixed = set()
    while True:
        rest, shared = total - sum(repeats * sizes[i] for i in fixed), sum(weights[i] for i in sizes if i not in fixed)
        over = {i for i in sizes if i not in fixed and rest * weights[i] / shared > repeats * sizes[i]}
        if not over:
            return {i: float(repeats * sizes[i]) if i in fixed else rest * weights[i] / shared for i in sizes}
        fixed |= over
        if len(fixed) == len(sizes):
            return {i: float(repeats * sizes[i]) for i in sizes}


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_is_by_highest_quotients(spark, seed):
    rng = np.random.default_rng(seed)
    rows, want = [], {}
    for group in range(4):
        weights = rng.integers(0, [5, 1000, 2, 50][group], 40).tolist() + [100_000] * (group == 1)
        quota = int(rng.integers(0, 300))
        items = {i: (float(w), 1000 if group else 20) for i, w in enumerate(weights)}
        rows += [(group, i, w, most, quota) for i, (w, most) in items.items()]
        want |= {(group, i): n for i, n in slow_seats(items, quota).items()}
    df = spark.createDataFrame(rows, "group int, item int, weight double, most long, quota long")
    got = {(r["group"], r["item"]): r["seats"] for r in mixing.apportion(df).collect()}
    assert len(got) == len(rows) and {k: n for k, n in got.items() if n} == want


def test_mixing_keeps_targets_and_limits(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    docs += [(1000, None, None), (None, "a  b\tc\x0b d", None), (None, "", "tiny"), (1001, "word", "tiny"), (1001, "word", "tiny"), (1002, "long " * 20_000, "s1")]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, source string, size int, shard string, target int")
    got = mixing.mix(df, shard=2000).collect()
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=key) == sorted(((i, s, size(t)) for i, t, s in docs), key=key)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    want = slow_targets(dict(sizes), weights, 1.5 * sum(sizes.values()))
    taken, shards = Counter(), defaultdict(set)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) <= 1e-9 * want[r["source"]]
        taken[r["source"]] += r["taken"]
        shards[r["source"]].add(r["shard"])
    assert len(shards["hot"]) > 2
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK * len(shards[s])
    again = mixing.mix(df.repartition(5), shard=2000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.where("doc_id < 0")).count() == 0
    nothing = mixing.mix(df.where("text is null")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)]


def test_sources_beyond_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a b c " * (i % 5), f"s{i % 4}" if i % 9 else None) for i in range(300)], "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(str, mixing.mix(df).collect())) == want
