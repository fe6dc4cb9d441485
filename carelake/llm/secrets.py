"""Secrets in texts: base patterns, and a character convolutional network over every candidate in its context.

Base findings are the leftmost matches that do not overlap, per kind. Candidates are all runs of RUN or more characters
a secret may hold. The network sees a candidate in overlapping windows over its whole length, each with what stands
before and after it: characters become small vectors, filters slide over them, each filter's highest answer counts, and
a candidate has the probability of its highest window. It is trained on labelled findings: windows that a base pattern's
finding reaches into against those of candidates that none finds. It learns from every such window of every text: each task
goes once through those of its rows, and the tasks' weights are averaged by the number of windows they have seen. Only the
weights that all tasks begin with come from a bounded sample. The curve that makes its answers probabilities is fitted to
what every window was answered just before it was learned from; the threshold is the highest, in steps of 1 / STEPS, that
still finds RECALL of all windows base findings reach into, as the finished network answers them.
Candidates above it that touch no base finding are added as kind `cnn`; base findings always stay.

Null texts count as empty. Without both kinds of windows in the texts there is no network, and base findings are
all. Repeated rows count as often as they stand there and get equal results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import SLICE_ROWS, give_back, map_rows, remove, scratch_path, ship, text_of

# The base patterns and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "cnn")
NAMES = ("passw", "secret", "token", "apikey", "api_key")

RUN = 8
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{RUN},}}")

#: Documents the first weights come from, and windows of each label, at most.
TRAIN_DOCS, TRAIN_EACH = 20_000, 3_000
#: Windows that are answered before they are learned from, those within the margin a step takes, rate of a step.
LEARNED, STEP, RATE = 4096, 32, 0.003
#: Places of the counted answers in one unit, and units on each side.
STEPS, REACH = 256, 64
BEFORE, HEAD, AFTER = 24, 32, 8
#: How far a candidate's windows are apart; windows that are scored at once.
SLIDE, SCORED = 16, 256
WIDE, DEPTH, FILTERS = 5, 8, 16
RECALL = 0.98
_SIGNS = " \n\"'=:_-+/.,;()[]{}<>|&#@!?*%$"
CLASSES = 2 * (10 + 26 + 26 + len(_SIGNS) + 2)


def _classes() -> np.ndarray:
    """The class of each character below 128; others, and what lies beyond a text's ends, have the two last ones."""
    out = np.full(129, CLASSES // 2 - 2, np.uint8)
    known = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SIGNS
    for i, c in enumerate(known):
        out[ord(c)] = i
    out[128] = CLASSES // 2 - 1
    return out


CLASS = _classes()


def window(text: str, start: int, end: int) -> bytes:
    """One byte per place: the character's class; the candidate's own characters have classes of their own."""
    head = min(end, start + HEAD)
    left = text[max(0, start - BEFORE) : start]
    right = text[end : end + AFTER]

    def codes(part: str) -> np.ndarray:
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        return CLASS[np.where(points < 128, points, 0x7F)]

    beyond = CLASS[128]
    out = np.full(BEFORE + HEAD + AFTER, beyond, np.uint8)
    out[BEFORE - len(left) : BEFORE] = codes(left)
    out[BEFORE : BEFORE + head - start] = codes(text[start:head]) + CLASSES // 2
    out[BEFORE + HEAD : BEFORE + HEAD + len(right)] = codes(right)
    return out.tobytes()


def blocks(start: int, end: int) -> list[tuple[int, int]]:
    """The windows' own parts of a candidate: HEAD long, SLIDE apart, the last one at its end."""
    last = max(start, end - HEAD)
    return [(a, min(end, a + HEAD)) for a in (*range(start, last, SLIDE), last)]


def padded(text: str) -> np.ndarray:
    """The class of each character, between as many as a window that lie beyond the ends; few are held as code points."""
    out = np.full(len(text) + 2 * (BEFORE + HEAD + AFTER), CLASS[128], np.uint8)
    at = BEFORE + HEAD + AFTER
    for i in range(0, len(text), 1 << 16):
        points = np.frombuffer(text[i : i + (1 << 16)].encode("utf-32-le", "surrogatepass"), "<u4")
        out[at + i : at + i + len(points)] = CLASS[np.where(points < 128, points, 0x7F)]
    return out


def windows(codes: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """window() of each span of a padded text, a row each."""
    starts, ends = (np.array(x, np.int64)[:, None] + BEFORE + HEAD + AFTER for x in zip(*spans, strict=True))
    places = starts + np.arange(HEAD)
    head = np.where(places < ends, codes[places] + np.uint8(CLASSES // 2), CLASS[128])
    return np.concatenate([codes[starts + np.arange(-BEFORE, 0)], head, codes[ends + np.arange(AFTER)]], axis=1)


def base_findings(text: str, candidates: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns. Access keys and hex strings lie within candidates, being as long."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for start, end in candidates:
        run = text[start:end]
        if "AKIA" in run:
            found += [("access", start + m.start(), start + m.end()) for m in ACCESS.finditer(run) if len(m[0]) >= LEAST["access"]]
        if end - start >= LEAST["hex"]:
            found += [("hex", start + m.start(), start + m.end()) for m in HEX.finditer(run) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def _untouched(candidates: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    spans = sorted((a, b) for _, a, b in base)
    out, i, reach = [], 0, -1
    for start, end in candidates:
        while i < len(spans) and spans[i][0] < end:
            reach = max(reach, spans[i][1])
            i += 1
        if reach <= start:
            out.append((start, end))
    return out


@dataclass
class Network:
    """Weights of the network; `tables` holds what two neighbours, or the last place's class, add to each filter."""

    embedding: np.ndarray
    filters: np.ndarray  # WIDE x DEPTH x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float
    curve: tuple[float, float] = (0.0, 1.0)
    threshold: float = 1.0

    @cached_property
    def tables(self) -> list[np.ndarray]:
        one = np.einsum("cd,wdf->wcf", self.embedding, self.filters).astype(np.float32)
        two = [(one[w][:, None] + one[w + 1][None]).reshape(-1, one.shape[2]) for w in range(0, WIDE - 1, 2)]
        return [*two, one[WIDE - 1]]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._logits(codes[at : at + SCORED]) for at in range(0, max(len(codes), 1), SCORED)])

    def _logits(self, codes: np.ndarray) -> np.ndarray:
        places = np.ascontiguousarray(codes.T).astype(np.intp)  # a window is a column: the highest answer is taken along rows
        pairs = places[:-1] * len(self.embedding) + places[1:]
        length = len(places) - WIDE + 1
        total = np.take(self.tables[0], pairs[:length], axis=0, mode="clip")
        more = np.empty_like(total)
        for i in range(1, len(self.tables)):
            from_ = places if i == len(self.tables) - 1 else pairs
            total += np.take(self.tables[i], from_[2 * i : 2 * i + length], axis=0, mode="clip", out=more)
        return np.maximum(total.max(axis=0) + self.bias, 0) @ self.out + self.shift

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        x = self.curve[0] + self.curve[1] * self.logits(codes)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _first_weights() -> list[np.ndarray]:
    rng = np.random.default_rng(11)
    return [rng.normal(0, 0.3, (CLASSES, DEPTH)), rng.normal(0, 0.2, (WIDE, DEPTH, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS), np.zeros(1)]


def _network(parts: list[np.ndarray]) -> Network:
    return Network(*parts[:4], float(parts[4][0]))


def _parts(network: Network) -> list[np.ndarray]:
    return [network.embedding, network.filters, network.bias, network.out, np.array([network.shift])]


def _gradients(parts: list[np.ndarray], x: np.ndarray, slope: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Of a loss whose slope at each window's logit is given."""
    embedding, filters, bias, out, shift = parts
    length = x.shape[1] - WIDE + 1
    vectors = embedding[x]
    slid = np.stack([vectors[:, w : w + length] for w in range(WIDE)], axis=2).reshape(len(x) * length, WIDE * DEPTH)
    answers = (slid @ filters.reshape(WIDE * DEPTH, FILTERS)).reshape(len(x), length, FILTERS)
    top = answers.argmax(axis=1)
    highest = np.take_along_axis(answers, top[:, None], 1)[:, 0] + bias
    hidden = np.maximum(highest, 0)
    error = slope(hidden @ out + shift[0])
    to_hidden = np.outer(error, out) * (highest > 0)
    # only each filter's highest place has a gradient
    places = (np.arange(len(x))[:, None] * length + top).ravel()
    patches = slid[places].reshape(len(x), FILTERS, WIDE * DEPTH)
    to_filters = np.einsum("bf,bfk->kf", to_hidden, patches).reshape(filters.shape)
    to_embedding = np.zeros_like(embedding)
    rows = np.arange(len(x))[:, None]
    for w in range(WIDE):
        np.add.at(to_embedding, x[rows, top + w].ravel(), (to_hidden[:, :, None] * filters[w].T[None]).reshape(-1, DEPTH))
    return [to_embedding, to_filters, to_hidden.sum(axis=0), hidden.T @ error, np.array([error.sum()])]


class _Adam:
    def __init__(self, parts: list[np.ndarray], rate: float) -> None:
        self.parts, self.rate, self.step = [p.copy() for p in parts], rate, 0
        self.first, self.second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]

    def move(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for i, g in enumerate(gradients):
            self.first[i] = 0.9 * self.first[i] + 0.1 * g
            self.second[i] = 0.999 * self.second[i] + 0.001 * g * g
            far = (self.first[i] / (1 - 0.9**self.step)) / (np.sqrt(self.second[i] / (1 - 0.999**self.step)) + 1e-8)
            self.parts[i] = self.parts[i] - self.rate * far


def train(codes: np.ndarray, labels: np.ndarray, rounds: int = 8, batch: int = 64, rate: float = 0.01) -> Network:
    """Adam on the log loss; a third of the candidates is held back for the curve and the threshold."""
    rng = np.random.default_rng(11)
    order = rng.permutation(len(labels))
    held, used = order[: len(order) // 3], order[len(order) // 3 :]
    if len({*labels[held]}) < 2 or len({*labels[used]}) < 2:
        held = used = order
    adam = _Adam(_first_weights(), rate)
    for _ in range(rounds):
        rng.shuffle(used)
        for at in range(0, len(used), batch):
            chosen = used[at : at + batch]
            y = labels[chosen].astype(float)
            adam.move(_gradients(adam.parts, codes[chosen], lambda z, y=y: (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)))
    network = _network(adam.parts)
    answers, y = network.logits(codes[held]), labels[held].astype(float)
    network.curve = _curve(answers, y, np.ones(len(y)))
    positives = np.sort(network.probabilities(codes[held][y > 0]))
    network.threshold = float(positives[int((1 - RECALL) * len(positives))])
    return network


def _curve(answers: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """The logistic curve of `y` on answers that were given `n` times each."""
    x = np.column_stack([np.ones(len(y)), answers])
    w, ridge = np.array([0.0, 1.0]), np.diag([1e-2, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.clip(np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge, x.T @ (n * (y - p)) - ridge @ w), -2, 2)
    return float(w[0]), max(float(w[1]), 1e-3)


def labelled(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of a text, and 1 for those that a base finding reaches into; a bounded number at once."""
    candidates = candidates_of(text)
    base = base_findings(text, candidates)
    free = {*_untouched(candidates, base)}
    parts = [(x, int(c not in free)) for c in candidates for x in blocks(*c)]
    if len(free) < len(candidates):  # of a candidate that is found, the windows the finding reaches into
        reached = {*(x for x, _ in parts)} - {*_untouched(sorted(x for x, _ in parts), base)}
        parts = [(x, label) for x, label in parts if not label or x in reached]
    coded = padded(text) if parts else None
    for at in range(0, len(parts), LEARNED):
        some = parts[at : at + LEARNED]
        yield windows(coded, [x for x, _ in some]), np.array([label for _, label in some])


def _first_network(documents: DataFrame, text: str) -> Network:
    """Weights to begin with, from a sample of the documents drawn by a hash of their texts, copies of a window once."""
    share = min(1.0, TRAIN_DOCS / max(documents.count(), 1))
    drawn = documents.select(text_of(text).alias("t")).where(F.pmod(F.xxhash64(F.lit("train"), "t"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def make():
        def row(text):
            for codes, labels in labelled(text):
                for made, label in zip(codes, labels.tolist(), strict=True):
                    yield made.tobytes(), label

        return row

    drawn_windows = map_rows(drawn, make, "codes binary, label int").distinct().persist()
    try:
        rows = [r for label in (0, 1) for r in drawn_windows.where(F.col("label") == label).orderBy(F.xxhash64("codes"), "codes").limit(TRAIN_EACH).collect()]
    finally:
        drawn_windows.unpersist()
    if len({r["label"] for r in rows}) < 2:
        return _network(_first_weights())
    return train(np.array([np.frombuffer(r["codes"], np.uint8) for r in rows]), np.array([r["label"] for r in rows]))


def _place(answers: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(answers, -REACH, REACH) * STEPS).astype(np.int64)


class _Learner:
    """Goes through windows once, with steps down the hinge loss: windows beyond its margin have no gradient."""

    def __init__(self, network: Network) -> None:
        self.network, self.adam = network, _Adam(_parts(network), RATE)
        self.seen, self.counts = 0, Counter()
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, codes: np.ndarray, labels: np.ndarray) -> None:
        self.waiting.append((codes, labels))
        self.held += len(labels)
        if self.held >= LEARNED:
            self.learn()

    def learn(self) -> None:
        if not self.held:
            return
        codes, labels = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.held = [], 0
        answers, y = self.network.logits(codes), 2.0 * labels - 1
        kinds, n = np.unique(np.column_stack([labels, _place(answers)]), axis=0, return_counts=True)
        self.counts.update({(label, place): k for (label, place), k in zip(kinds.tolist(), n.tolist(), strict=True)})
        self.seen += len(labels)
        near = np.flatnonzero(y * answers < 1)
        if not len(near):
            return
        for at in range(0, len(near), STEP):
            some = near[at : at + STEP]
            self.adam.move(_gradients(self.adam.parts, codes[some], lambda z, y=y[some]: np.where(y * z < 1, -y, 0) / len(y)))
        self.network = _network(self.adam.parts)

    def weights(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.adam.parts])


#: Weights are added up as whole numbers of this part, so that no order of the tasks changes their sum.
_GRAIN = 1 << 20
_LEARNED = pa.schema([("kind", pa.string()), ("label", pa.int32()), ("place", pa.int64()), ("amount", pa.int64()), ("codes", pa.binary())])


def _learned(documents: DataFrame, text: str, network: Network) -> DataFrame:
    """One pass over all windows: each task's `weight`s times its windows, `seen` answers counted, and `found` windows."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = _Learner(shared.value)

        def rows(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), _LEARNED, strict=True)], schema=_LEARNED)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for one in batch.slice(at, SLICE_ROWS).column(0).to_pylist():
                    for codes, labels in labelled(one):
                        learner.add(codes, labels)
                        if found := [("found", 1, None, None, c.tobytes()) for c in codes[labels > 0]]:
                            yield rows(found)
        learner.learn()
        if learner.seen:
            sums = np.rint(learner.weights() * _GRAIN).astype(np.int64) * learner.seen
            yield rows([("weight", None, i, v, None) for i, v in enumerate(sums.tolist())])
            yield rows([("seen", label, place, n, None) for (label, place), n in sorted(learner.counts.items())])
        del learner
        give_back()

    return documents.select(text_of(text).alias("t")).mapInArrow(run, "kind string, label int, place long, amount long, codes binary")


def _finished(network: Network, learned: DataFrame) -> Network | None:
    """The tasks' mean network, with the curve and the threshold that all windows give it."""
    # a row per weight, and at most one per label and place: bounded, however many texts
    sums = learned.where("kind <> 'found'").groupBy("kind", "label", "place").agg(F.sum("amount").alias("n")).collect()
    seen = sorted((r["place"], r["label"], r["n"]) for r in sums if r["kind"] == "seen")
    if len({label for _, label, _ in seen}) < 2:
        return None
    place, y, n = np.array(seen, float).T
    flat = np.array([r["n"] for r in sorted((r for r in sums if r["kind"] == "weight"), key=lambda r: r["place"])]) / n.sum() / _GRAIN
    parts, at = [], 0
    for p in _parts(network):
        parts.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    mean = replace(_network(parts), curve=_curve((place + 0.5) / STEPS, y, n))
    shared = learned.sparkSession.sparkContext.broadcast(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = np.array([np.frombuffer(c, np.uint8) for c in batch.column(0).to_pylist()])
                places, k = np.unique(_place(shared.value.logits(codes)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(k, pa.int64())], names=["place", "n"])

    found = learned.where("kind = 'found'").select("codes").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    places, k = np.array(sorted((r["place"], r["n"]) for r in found)).T
    below = np.cumsum(k) - k  # windows an answer at this place or higher would miss
    least = places[np.flatnonzero(below <= (1 - RECALL) * k.sum())[-1]] / STEPS
    x = mean.curve[0] + mean.curve[1] * least
    return replace(mean, threshold=float(1 / (1 + np.exp(-np.clip(x, -30, 30)))))


def fit(documents: DataFrame, text: str = "text") -> Network | None:
    """A network that has learned from every window of the documents."""
    spark, path = documents.sparkSession, scratch_path(documents.sparkSession, "learned")
    first = _first_network(documents, text)
    # what the first weights were held to ends here: all that follows comes from all windows
    learned = _learned(documents, text, replace(first, curve=(0.0, 1.0), threshold=1.0))
    learned.write.parquet(path)
    try:
        return _finished(first, spark.read.schema(learned.schema).parquet(path))
    finally:
        remove(spark, path)


def find(df: DataFrame, network: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and `found`: kind, start, end (code points, end exclusive) of every secret, by start, then kind."""
    shared = df.sparkSession.sparkContext.broadcast(network)
    names = [f"k{i}" for i in range(len(keep))]

    def make():
        network = shared.value

        def row(text, *kept):
            candidates = candidates_of(text)
            found = base_findings(text, candidates)
            free = _untouched(candidates, found) if network else []
            parts = [(x, c) for c in free for x in blocks(*c)]
            coded, good = padded(text) if parts else None, set()
            for at in range(0, len(parts), SCORED):  # a bounded number of windows at once
                some = parts[at : at + SCORED]
                high = network.probabilities(windows(coded, [x for x, _ in some])) >= network.threshold
                good.update(c for (_, c), g in zip(some, high.tolist(), strict=True) if g)
            found += [("cnn", a, b) for a, b in sorted(good)]
            found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
            yield *kept, [{"kind": k, "start": a, "end": b} for k, a, b in found]

        return row

    chosen = df.select(text_of(text).alias("t"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{n} {kinds[c]}" for c, n in zip(keep, names, strict=True)] + ["found array<struct<kind:string,start:int,end:int>>"])
    return map_rows(chosen, make, schema).toDF(*keep, "found")
