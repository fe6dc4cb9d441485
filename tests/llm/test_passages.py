"""Repeated passages of lines against all pairs of runs, without chunks()."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from carelake.llm import linededup


def repeated(rows, least_words, least_lines):
    """Lines (row, number) in a run of lines that stands in a row before."""
    out = set()
    lines = [t.split("\n") for _, t in rows]
    for later in range(len(rows)):
        for sooner in range(later):
            a, b = lines[later], lines[sooner]
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] != b[j] or (i and j and a[i - 1] == b[j - 1]):
                        continue
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if n >= least_lines and sum(len(x.split()) for x in a[i : i + n]) >= least_words:
                        out |= {(later, k) for k in range(i, i + n)}
    return out


def test_whole_passages_go_whatever_stands_around_them(spark):
    rnd = random.Random(12)
    line = lambda k: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(k))
    shared = [[line(k) for _ in range(n)] for n, k in [(2, 30), (3, 20), (5, 12), (10, 10), (1, 60), (4, 60), (60, 1), (2, 26)] for _ in range(6)]
    shared += [[line(70), line(3), line(2)], [line(3), line(2), line(70)]]
    short = [line(49), line(8)]
    rows = []
    for i in range(150):
        parts = [[line(rnd.randint(1, 15)) for _ in range(rnd.randint(1, 3))] for _ in range(3)]
        parts.insert(1, shared[i % len(shared)])
        parts.insert(3, [rnd.choice(short)])
        rows.append((i, "\n".join(x for p in parts for x in p)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup_passages(df).collect()}
    gone = repeated(rows, 50, 1)
    may_go = gone | repeated(rows, 1, 2)
    assert len(gone) > 500
    for i, t in rows:
        lines = t.split("\n")
        left = got[i]["text"].split("\n") if got[i]["text"] else []
        assert not {x for k, x in enumerate(lines) if (i, k) in gone} & set(left)
        assert [x for k, x in enumerate(lines) if (i, k) not in may_go] == [x for x in left if x not in {y for k, y in enumerate(lines) if (i, k) in may_go}]
        assert got[i]["removed_lines"] == len(lines) - len(left)


def test_odd_rows(spark):
    same = "\n".join(["ten words " * 5] * 20)
    rows = [(1, same), (1, same), (2, None), (3, ""), (4, "\n\n"), (None, same), (5, same + "\nown")]
    got = linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    first = "\n".join(["ten words " * 5] * 5)
    assert [r["text"] for r in got] == [first, first, None, "", "\n\n", "own", ""]
    assert linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").where("doc_id < 0")).count() == 0
