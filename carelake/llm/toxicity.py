"""Toxic passages as maximum-scoring segments, and a calibrated score per document.

Training counts, per class, the documents that hold a word or its first four or five letters. Log-odds with an
informative Dirichlet prior (the corpus' own frequencies on top of a flat one) score words; those that stand out keep
their own score, all others share the score of the pooled rest, which is below zero. A linear scan finds all maximal
segments of a text. A segment's significance follows the extreme-value law of such scores: lambda solves
sum p exp(lambda s) = 1 over the words of clean documents that took no part in the counts, K comes from their segments.
The best sum over segments, as -log p, goes through a logistic curve.

Labels: null labels and ids are passed over; of several labels of one document the highest counts. Copies of a text
count once. Without both classes every document gets the labels' smoothed rate. Null and empty texts have no passage
and get the curve's lowest score. Repeated rows get equal scores; other columns are never inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import digest, map_rows, ship, text_of

#: Labelled documents a model is fitted on at most, about: drawn by a hash of their ids.
TRAIN_ROWS = 30_000
#: The priors' strength in documents: flat for each word, and by the corpus' frequencies for all words together.
FLAT, PRIOR = 0.5, 10.0
#: A word keeps its own score from this many toxic documents on, if log-odds and log-likelihood ratio reach so much.
LEAST, ODDS, STANDS_OUT = 5, 1.5, 12.0
PREFIXES = (4, 5)
#: Tokens a training task counts before it hands them on; pieces a scoring task remembers.
HELD = 200_000
#: Largest p of a passage that is reported.
SIGNIFICANT = 0.05
#: Segments whose scores are summed at most; more add nothing to a verdict that far out.
SUMMED = 12

EDGES = re.compile(r"^\W+|\W+$")
PIECES = re.compile(r"\S+")


def token(piece: str) -> str:
    """A lower-case piece between white space, without the signs at its ends."""
    return piece if piece.isalnum() else EDGES.sub("", piece)


def levels(word: str) -> list[str]:
    """The word, then its beginnings; `*` marks a beginning."""
    return [word, *[word[:n] + "*" for n in reversed(PREFIXES) if len(word) >= n]]


@dataclass
class ToxicityModel:
    rate: float  # of toxic labels, smoothed
    scores: dict[str, float] = field(default_factory=dict)
    rest: float = -1.0
    scale: float = 1.0  # lambda of the extreme-value law
    log_size: float = 0.0  # log K
    curve: tuple[float, float] | None = None  # intercept and slope; None: one class only

    def piece_score(self, piece: str) -> float:
        word = token(piece)
        if word:
            for key in levels(word):
                if (found := self.scores.get(key)) is not None:
                    return found
        return self.rest

    def evidence(self, segments: list[tuple[int, int, float]], length: int) -> float:
        """-log p of the best sum over the highest segments, corrected for the choice of their number."""
        best, total = 0.0, 0.0
        base = self.log_size + math.log(max(length, 1))
        for r, (_, _, s) in enumerate(sorted(segments, key=lambda x: -x[2])[:SUMMED], 1):
            total += self.scale * s - base
            if total <= 0:
                break
            log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
            best = max(best, -log_p)
        return best

    def probability(self, evidence: float) -> float:
        if self.curve is None:
            return self.rate
        x = self.curve[0] + self.curve[1] * evidence
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def maximal_segments(scores: list[tuple[int, float]], rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in linear time.

    `scores`: place and score of the words that have their own; all others score `rest`, below 0.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, end, sum before it, sum at its end
    total, at = 0.0, 0
    for place, score in scores:
        total += (place - at) * rest
        at = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first, low, high = place, before, total
        while True:
            # Segments that begin higher than this one can neither be joined with it nor with a later one.
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k -= 1
            if k < 0 or stack[k][3] >= high:
                stack.append((first, place + 1, low, high))
                break
            first, low = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, high - low) for a, b, low, high in stack]


class Scanner:
    """Scores texts; remembers the scores of a bounded number of pieces."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.known = model, {}

    def scan(self, text: str) -> tuple[list[tuple[int, int, float]], int, list[tuple[int, float]]]:
        """Segments, number of words, and place and score of the words that have their own."""
        pieces = text.lower().split()
        known, score = self.known, self.model.piece_score
        if len(known) > HELD:
            known.clear()
        for piece in set(pieces):
            if piece not in known:
                known[piece] = score(piece)
        rest = self.model.rest
        own = [(i, s) for i, s in enumerate(map(known.__getitem__, pieces)) if s != rest]
        return maximal_segments(own, rest), len(pieces), own


def labelled(documents: DataFrame, labels: DataFrame, rows: Column, bound: int) -> DataFrame:
    """text, toxic and part (0 to 2) of about `bound` labelled documents at most, copies of a text once."""
    known = (
        labels.where(rows & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    share = min(1.0, bound / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("draw"), "labelled_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = documents.select(F.col("doc_id").alias("labelled_id"), text_of("text").alias("text"))
    return (  # the sample is bounded, so it is safe to broadcast
        texts.join(F.broadcast(drawn), "labelled_id")
        .groupBy(digest(F.col("text")).alias("digest"))
        .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("text", "toxic", F.pmod(F.xxhash64("digest"), F.lit(3)).cast("int").alias("part"))
    )


def _counted(sample: DataFrame) -> DataFrame:
    """token, y1 and y0: documents of each class that hold it."""
    ship(sample.sparkSession)

    def run(batches):
        import pyarrow as pa

        def rows(counts):
            keys = list({k for k, _ in counts})
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([counts[k, 1] for k in keys], pa.int64()), pa.array([counts[k, 0] for k in keys], pa.int64())],
                names=["token", "y1", "y0"],
            )

        counts: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = {token(p) for p in set(text.lower().split())} - {""}
                counts.update((key, toxic) for key in {k for w in words for k in levels(w)})
                if len(counts) > HELD:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    parts = sample.mapInArrow(run, "token string, y1 long, y0 long")
    return parts.groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def fit(documents: DataFrame, labels: DataFrame, rows: Column | None = None, bound: int = TRAIN_ROWS) -> ToxicityModel:
    """A model from the labels that `rows` chooses (all by default). It is bounded by the sample, not the corpus."""
    sample = labelled(documents, labels, F.lit(True) if rows is None else rows, bound).persist()
    try:
        sizes = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy((F.col("part") < 2).alias("fold"), "toxic").agg(F.count("*").alias("n")).collect()}
        n1, n0 = (sum(n for (_, t), n in sizes.items() if (t > 0) == c) for c in (True, False))
        model = ToxicityModel(rate=(n1 + 1) / (n1 + n0 + 2))
        if not all(sizes.get((fold, t)) for fold in (True, False) for t in (0, 1)):
            return model
        _fit_scores(model, _counted(sample.where("part < 2")), sizes[True, 1], sizes[True, 0])
        scanned = _scanned(sample.where("part = 2").select("text", "toxic"), model).collect()
        _fit_law(model, [r for r in scanned if not r["toxic"]])
        _fit_curve(model, [(model.evidence([(0, 0, s) for s in r["s"]], r["n"]), r["toxic"]) for r in scanned])
        return model
    finally:
        sample.unpersist()


def _fit_scores(model: ToxicityModel, counts: DataFrame, d1: int, d0: int) -> None:
    """Log-odds of documents of either class with the token."""
    prior = FLAT + PRIOR * (F.col("y1") + F.col("y0")) / (d1 + d0)
    odds = F.log((F.col("y1") + prior) / (d1 + PRIOR)) - F.log((F.col("y0") + prior) / (d0 + PRIOR))
    both, share = F.col("y1") + F.col("y0"), d1 / (d1 + d0)
    ratio = F.col("y1") * F.log(F.col("y1") / (both * share)) + F.when(F.col("y0") > 0, F.col("y0") * F.log(F.col("y0") / (both * (1 - share)))).otherwise(0.0)
    stands_out = (F.col("y1") >= LEAST) & (F.col("s") >= ODDS) & (F.when(F.col("y1") > 0, ratio) >= STANDS_OUT)
    scored = counts.withColumn("s", odds).withColumn("own", F.coalesce(stands_out, F.lit(False))).persist()
    try:
        model.scores = {r["token"]: r["s"] for r in scored.where("own").select("token", "s").collect()}
        starts = sorted(k for k in model.scores if k.endswith("*"))
        words = scored.where("not endswith(token, '*')")
        if starts:  # words that are clean though they begin as toxic ones do; as bounded as the sample
            begin = F.broadcast(counts.sparkSession.createDataFrame([(k,) for k in starts], "begin string"))
            clean = words.where(~F.col("own") & (F.col("y0") >= 3) & (F.col("s") < ODDS))
            clean = clean.withColumn("begin", F.explode(F.array(*[F.concat(F.left("token", F.lit(n)), F.lit("*")) for n in PREFIXES])))
            found = clean.join(begin, "begin", "left_semi").select("token", "s").distinct()
            model.scores |= {r["token"]: min(r["s"], -0.1) for r in found.collect()}
        total = words.agg(*[F.sum(F.when(c, F.col(y))).alias(f"{y}{n}") for y in ("y1", "y0") for n, c in (("all", F.lit(True)), ("rest", ~F.col("own")))]).first()
        share1, share0 = (max(total[f"{y}rest"] or 0, 1) / max(total[f"{y}all"] or 0, 1) for y in ("y1", "y0"))
        model.rest = min(math.log(share1 / share0), -0.02)
    finally:
        scored.unpersist()


def _scanned(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    """toxic, number of words, highest segments, and the words' own scores, of every text of the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def make():
        scanner = Scanner(shared.value)

        def row(text, toxic):
            segments, n, own = scanner.scan(text)
            yield toxic, n, sorted([s for _, _, s in segments], reverse=True)[:SUMMED], [s for _, s in own]

        return row

    return map_rows(sample, make, "toxic int, n int, s array<double>, own array<double>")


def _fit_law(model: ToxicityModel, clean: list) -> None:
    """lambda and K from the words and segments of clean documents."""
    words = sum(r["n"] for r in clean) + 1
    seen = Counter(round(s, 1) for r in clean for s in r["own"])
    seen[round(max([s for s in model.scores.values()], default=1.0), 1)] += 0.5  # what was not seen may still occur
    scores = np.array([model.rest, *seen])
    shares = np.array([max(words - sum(seen.values()), 1), *seen.values()]) / words
    low, high = 1e-3, 5.0
    for _ in range(60):
        model.scale = (low + high) / 2
        if float(shares @ np.exp(np.minimum(model.scale * scores, 300))) > 1:
            high = model.scale
        else:
            low = model.scale
    segments = sorted((s for r in clean for s in r["s"]), reverse=True)[:100]
    # so many segments reach the least of these: K n exp(-lambda s) are expected
    model.log_size = math.log(len(segments) / words) + model.scale * segments[-1] if segments else 0.0


def _fit_curve(model: ToxicityModel, points: list[tuple[float, int]]) -> None:
    """Logistic regression of the label on log(1 + evidence), slope not below zero; a slight ridge keeps it finite."""
    x = np.array([[1.0, e] for e, _ in points])
    y = np.array([t for _, t in points], float)
    w, ridge = np.zeros(2), np.diag([1e-3, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
    model.curve = (float(w[0]), max(float(w[1]), 0.0))


def score(df: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, `score` and `passages` (code points from start to end, score, p) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]

    def make():
        model = shared.value
        scanner = Scanner(model)

        def row(text, *kept):
            segments, n, _ = scanner.scan(text)
            value = model.probability(model.evidence(segments, n))
            found = [(a, b, s, p) for a, b, s in segments if (p := _p(model, s, n)) <= SIGNIFICANT]
            spans = [m.span() for m in PIECES.finditer(text)] if found else []
            # lower() and the two ways to cut may differ in rare signs; spans then end with the text
            place = lambda i, side: spans[min(i, len(spans) - 1)][side]
            yield *kept, value, [{"start": place(a, 0), "end": place(b - 1, 1), "score": s, "p": p} for a, b, s, p in found]

        return row

    chosen = df.select(text_of(text).alias("t"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{n} {kinds[c]}" for c, n in zip(keep, names, strict=True)] + ["score double", "passages array<struct<start:int,end:int,score:double,p:double>>"])
    return map_rows(chosen, make, schema).toDF(*keep, "score", "passages")


def _p(model: ToxicityModel, s: float, n: int) -> float:
    return -math.expm1(-math.exp(min(model.log_size + math.log(max(n, 1)) - model.scale * s, 50.0)))
