"""The pipeline's stages against brute force, on a small corpus with planted cases."""

from __future__ import annotations

import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import corpus_pipeline  # noqa: E402
from carelake.llm import simhash  # noqa: E402
from tests.llm.test_copies import slow_fingerprint, slow_line_dedup, slow_shingles, unions  # noqa: E402

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    path = str(tmp_path_factory.mktemp("tables"))
    line = lambda k: " ".join(rnd.choices(WORDS, k=k))
    items = [(i, line(20)) for i in range(6)]
    shared = line(60)
    docs = []
    for i in range(160):
        lines = [line(rnd.randint(4, 20)) for _ in range(rnd.randint(1, 9))]
        if i % 8 == 1:
            lines.insert(rnd.randrange(len(lines) + 1), "venom vilezz venom grimeo vilezz")
        if i % 16 == 2:
            lines.insert(rnd.randrange(len(lines) + 1), items[i % 6][1])
        if i % 10 == 3:
            lines.append(shared)
        docs.append((i, "\n".join(lines), "en", "s", None))
    docs += [(200 + i, docs[i][1], "en", "s", None) for i in range(0, 30, 5)]
    docs += [(300, None, "en", None, None), (301, "", "en", "s", None), (None, "no id here " + line(30), "en", "s", None), (302, line(8), None, "s", None), (302, line(9), None, "s", None)]
    docs = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s, _ in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("venom" in (t or ""))) for i, t, *_ in docs if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def ordered(rows):
    return sorted(map(str, rows))


def test_every_stage_on_what_the_one_before_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = rows_of(docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "decontamination", "encode"]

    clean = corpus_pipeline.written(stages["toxicity"](spark, docs, folder), "t")
    assert clean.columns == columns
    assert ordered(rows_of(clean)) == ordered([r for r in before if "venom" not in (r[1] or "")])

    short = corpus_pipeline.written(stages["line_dedup"](spark, clean, folder), "t")
    assert short.columns == columns and ordered(rows_of(short)) == ordered(slow_line_dedup(rows_of(clean)))
    assert short.where("n_chars <> length(text)").count() == 0

    apart = corpus_pipeline.written(stages["simhash"](spark, short, folder), "t")
    rows = rows_of(short)
    prints = {r: slow_fingerprint(r[1] or "") for r in rows}
    pairs = [(a, b) for a in prints.values() for b in prints.values() if a < b and (a ^ b).bit_count() <= 2]
    root = unions(pairs, set(prints.values()))
    kept: dict = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept.setdefault(root[prints[r]], r)
    assert apart.columns == columns and {r[0] for r in rows_of(apart)} == {r[0] for r in kept.values()}
    assert apart.count() == len(kept)

    free = corpus_pipeline.written(stages["decontamination"](spark, apart, folder), "t")
    items = [slow_shingles(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    held = lambda t: any(len(s & slow_shingles(t)) >= 0.8 * len(s) for s in items)
    assert free.columns == columns and ordered(rows_of(free)) == ordered([r for r in rows_of(apart) if not held(r[1])])
    assert free.count() < apart.count()

    last = stages["encode"](spark, free, folder)
    assert last.count() == free.count() and last.where(F.size("token_ids") == 0).count() <= 2
    assert ordered(rows_of(corpus_pipeline.run(spark, folder))) == ordered(rows_of(last))


def test_stages_on_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_rows_alike_leave_one(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d", "x", "s", 7)] * 3 + [(None, "e f g h", "x", "s", 7)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert ordered(rows_of(kept)) == ordered([(1, "a b c d"), (None, "e f g h")])
    assert simhash.fingerprint("a b c d") != simhash.fingerprint("e f g h")
