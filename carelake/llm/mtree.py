"""Exact highest inner products by best-first search in paged M-trees.

Inner products become distances: with one more component sqrt(M^2 - |x|^2), M the largest norm of a tree, and 0 for a
query, |q - x|^2 = |q|^2 + M^2 - 2 qx. Rows are dealt into trees of bounded size by a hash of their ids; a task loads
each tree in bulk and stores its pages. A page's entry holds a vector, its distance to the page's own routing vector,
and, above the leaves, a covering radius, the least id below and the child's page. A search opens pages by their best
possible score. Entries whose stored distances already show, by the triangle inequality, that they cannot score enough
are passed over without a distance. Trees' results are merged by Spark.

Scores are integers and exact below 2^53. Shorter vectors count as padded with zeros. Null vectors, and those with
null or non-finite components, take no part, nor do rows without an id; of rows with one id the least vector counts.
Ties go to the smaller id: a page that can only tie is passed over if its least id is larger. An empty table, or a
query alone, has no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelake.llm.common import map_rows, written

#: Vectors of a page, and of a tree, at most; queries of a block.
PAGE, TREE, BLOCK = 256, 8_192, 4_096
#: Pairs of a query and a page whose bounds a task holds at once.
STATES = 1 << 20
_LAST = np.iinfo(np.int64).max
_ENTRY = "vector array<double>, id long, parent double, radius double, least long, child int"


def integer_vectors(df: DataFrame, id_column: str, vector: str, scale: float = 64.0) -> DataFrame:
    """id and v: floor(scale * x) of each component, for the rows that take part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    chosen = df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).where(~odd)
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    return chosen.select(F.col(id_column).cast("long").alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(vectors: list) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Builder:
    """Loads one tree in bulk; pages are lists of entries, page 0 is the root."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.ids = ids
        self.points = np.column_stack([vectors, np.sqrt(norms.max(initial=0.0) - norms)])
        self.pages: list[list[tuple]] = []
        self._load(np.arange(len(ids)), None)

    def _to(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1))

    def _load(self, rows: np.ndarray, router: np.ndarray | None) -> int:
        page = len(self.pages)
        self.pages.append(entries := [])
        if len(rows) <= PAGE:
            away = self._to(rows, router) if router is not None else np.zeros(len(rows))
            entries += [(self.points[r], int(self.ids[r]), float(d), 0.0, int(self.ids[r]), -1) for r, d in zip(rows, away, strict=True)]
            return page
        for group in self._split(rows):
            centre = self.points[group].mean(axis=0)
            radius = float(self._to(group, centre).max())
            parent = float(np.sqrt(((centre - router) ** 2).sum())) if router is not None else 0.0
            entries.append((centre, -1, parent, radius, int(self.ids[group].min()), self._load(group, centre)))
        return page

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Groups around far-apart members; equal points, which no distance tells apart, are cut into pages by id."""
        wanted = min(PAGE, max(2, math.ceil(len(rows) / (PAGE // 2))))
        near = self._to(rows, self.points[rows[0]])
        owner = np.zeros(len(rows), int)
        count = 1
        while count < wanted and near.max() > 0:
            away = self._to(rows, self.points[rows[int(near.argmax())]])
            closer = away < near
            owner[closer], near[closer] = count, away[closer]
            count += 1
        if count == 1:
            ordered = rows[np.argsort(self.ids[rows], kind="stable")]
            return np.array_split(ordered, min(PAGE, math.ceil(len(rows) / PAGE)))
        return [rows[owner == g] for g in range(count) if (owner == g).any()]


class Page:
    def __init__(self, entries: list) -> None:
        self.vectors = _matrix([e["vector"] for e in entries])
        self.plain = np.ascontiguousarray(self.vectors[:, :-1])
        self.ids, self.parent, self.radius, self.least, self.child = (np.array([e[n] for e in entries]) for n in ("id", "parent", "radius", "least", "child"))
        self.squares = (self.vectors**2).sum(axis=1)
        self.leaf = not len(entries) or self.child[0] < 0


class Searcher:
    """Best-first search for the k highest scores in one tree, for many queries at once.

    Each query opens its own most promising page next. Queries that open the same page are compared with it together,
    so a visit costs a share of one matrix product.
    """

    def __init__(self, pages: list) -> None:
        self.pages = {p["page"]: Page(p["entries"]) for p in pages}
        root = self.pages[0]
        self.largest = 0.0
        self.least = np.full(len(self.pages), np.iinfo(np.int64).min)
        for page in self.pages.values():
            if page.leaf and len(page.ids):
                self.largest = max(self.largest, float(page.squares.max()))
            elif not page.leaf:
                self.least[page.child] = page.least
        self.width = root.vectors.shape[1] - 1
        self.opened = self.compared = 0

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id), best first, without the query's own id."""
        return next(self.search_all([own], [query], k))[1]

    def search_all(self, own: list[int], queries: list, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Each query's own id with its (score, id), best first."""
        step = max(1, STATES // len(self.pages))
        for at in range(0, len(own), step):
            names = np.array(own[at : at + step], np.int64)
            scores, ids = self._block(names, queries[at : at + step], k)
            for name, line, found in zip(names.tolist(), scores, ids, strict=True):
                known = line > -np.inf
                yield name, [(int(s), int(i)) for s, i in zip(line[known], found[known], strict=True)]

    def _block(self, own: np.ndarray, queries: list, k: int) -> tuple[np.ndarray, np.ndarray]:
        asked = _matrix(queries)
        full = (asked**2).sum(axis=1)
        points = np.zeros((len(own), self.width))
        shared = min(self.width, asked.shape[1])
        points[:, :shared] = asked[:, :shared]
        base = full + self.largest  # of |q|^2 + M^2
        slack = np.maximum(0.25, 1e-9 * base)
        scores, ids = np.full((len(own), k), -np.inf), np.full((len(own), k), _LAST)
        # best possible score of each page that is known and not yet opened; distance to its routing vector
        bounds, away = np.full((len(own), len(self.pages)), -np.inf), np.zeros((len(own), len(self.pages)))
        bounds[:, 0] = np.inf
        active = np.arange(len(own))
        while len(active):
            worst = scores[active, -1:]
            open_ = bounds[active]
            lost = (open_ < worst - slack[active, None]) | ((open_ < worst + 1 - slack[active, None]) & (self.least > ids[active, -1:]))
            open_[lost] = -np.inf
            bounds[active] = open_
            going = open_.max(axis=1) > -np.inf
            active, chosen = active[going], open_[going].argmax(axis=1)
            for number in np.unique(chosen).tolist():
                group = active[chosen == number]
                bounds[group, number] = -np.inf
                page = self.pages[number]
                self.opened += len(group)
                # |d(q, router) - d(entry, router)| - radius bounds the distance from below
                reach = np.sqrt(np.maximum(base[group] - 2 * (scores[group, -1] - slack[group]), 0.0))
                near = np.abs(away[group, number][:, None] - page.parent) - page.radius <= reach[:, None]
                wanted = np.flatnonzero(near.any(axis=0))
                if not len(wanted):
                    continue
                near = near[:, wanted]
                products = points[group] @ page.plain[wanted].T
                self.compared += products.size
                if page.leaf:
                    _merge(scores, ids, group, np.where(near & (page.ids[wanted] != own[group, None]), products, -np.inf), page.ids[wanted])
                    continue
                apart = np.sqrt(np.maximum(full[group, None] + page.squares[wanted] - 2 * products, 0.0))
                best = (base[group, None] - np.maximum(apart - page.radius[wanted], 0.0) ** 2) / 2
                places = np.ix_(group, page.child[wanted])
                bounds[places], away[places] = np.where(near, best, -np.inf), apart
        return scores, ids


def _merge(scores: np.ndarray, ids: np.ndarray, group: np.ndarray, found: np.ndarray, names: np.ndarray) -> None:
    """Takes a page's products into the best scores of the queries in `group`; ties go to the smaller id."""
    k = scores.shape[1]
    floor = scores[group, -1].copy()
    if found.shape[1] > k:  # what is below the page's own k-th product is no use either
        fresh = np.flatnonzero(floor == -np.inf)
        floor[fresh] = np.partition(found[fresh], -k, axis=1)[:, -k]
    good = (found >= floor[:, None]) & (found > -np.inf)
    counts = good.sum(axis=1)
    for rows in (np.flatnonzero((counts > 0) & (counts <= k)), np.flatnonzero(counts > k)):
        if not len(rows):
            continue
        width = int(counts[rows].max())
        row, column = np.nonzero(good[rows])
        place = k + np.arange(len(row)) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows])
        at = group[rows]
        s, i = np.full((len(rows), k + width), -np.inf), np.full((len(rows), k + width), _LAST)
        s[:, :k], i[:, :k] = scores[at], ids[at]
        s[row, place], i[row, place] = found[rows][row, column], names[column]
        order = np.lexsort((i, -s))[:, :k]
        scores[at], ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _pages():
    def row(tree, rows):
        builder = Builder(np.array([r["id"] for r in rows], np.int64), _matrix([r["v"] for r in rows]))
        for number, entries in enumerate(builder.pages):
            yield tree, number, [dict(zip(("vector", "id", "parent", "radius", "least", "child"), (e[0].tolist(), *e[1:]), strict=True)) for e in entries]

    return row


def build(vectors: DataFrame, trees: int) -> DataFrame:
    """tree, page and entries of every page; every row of `vectors` (id, v) is in one leaf."""
    dealt = vectors.groupBy(F.pmod(F.xxhash64("id"), F.lit(trees)).cast("int").alias("tree"))
    return map_rows(dealt.agg(F.collect_list(F.struct("id", "v")).alias("rows")), _pages, f"tree int, page int, entries array<struct<{_ENTRY.replace(' ', ':').replace(',:', ',')}>>")


def top_k(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows of `vectors` (id, v) for each row that `queries` chooses.

    `vectors` is read several times: pass a written table. Each block of queries meets each tree once.
    """
    asked = vectors.where(queries)
    n, m = vectors.count(), asked.count()
    trees, blocks = max(1, math.ceil(n / TREE), min(16, n // 1024)), max(1, math.ceil(m / BLOCK))
    index = written(build(vectors, trees), "m-tree")
    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int").alias("block")
    each_tree, each_block = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = index.select("tree", "page", "entries", each_block).groupBy("tree", "block").agg(F.collect_list(F.struct("page", "entries")).alias("pages"))
    right = asked.groupBy(block).agg(F.collect_list(F.struct("id", "v")).alias("asked")).select("block", "asked", each_tree)

    def make():
        def row(pages, asked):
            searcher = Searcher(pages)
            for own, best in searcher.search_all([r["id"] for r in asked], [r["v"] for r in asked], k):
                for score, other in best:
                    yield own, other, score

        return row

    met = left.join(right, ["tree", "block"]).select("pages", "asked")
    found = map_rows(met, make, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
