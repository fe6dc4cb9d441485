"""Repeated passages of lines: content-defined chunks of lines, removed wherever they come again.

A hash rolls over the hashes of two neighbouring lines; where it ends in a zero bit a chunk of two or more lines ends.
So boundaries follow the lines' content and shift with it. A line of LONG_WORDS words or more is a chunk of its own.
Chunks of several lines, or of one long line, that occur more than once stay at their first place (smallest id, then
the place in the text) and go everywhere else, if their bytes equal those of the first place.

dedup_passages removes whole passages: beside chunks, every run of lines with LONG_WORDS words or more that stands
elsewhere before, whatever its neighbours. Each line starts and ends a shortest such run (`runs`); together these cover
every line of any longer run, so a repeated passage goes line by line without being extended. Runs are the same if
their SHA-256 is. What a run shares with its own first place in the same text stays.

Null texts stay null, empty ones empty. Rows alike in id and text are treated alike: both keep what their text keeps.
Null ids come after all others. Chunks without a word are never removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import BROADCAST_ROWS, map_rows, small, written

LONG_WORDS, LEAST_LINES = 50, 2
_MIX = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def chunks(text: str) -> list[tuple[int, int, int]]:
    """First line, end and number of words of each chunk."""
    lines = text.split("\n")
    out, first, words, before = [], 0, 0, 0
    for i, line in enumerate(lines):
        n = len(line.split())
        now = xxhash.xxh64_intdigest(line)
        rolled = (before * _MIX + now) * _MIX & _ALL
        before = now
        if n >= LONG_WORDS:
            if i > first:
                out.append((first, i, words))
            out.append((i, i + 1, n))
            first, words = i + 1, 0
            continue
        words += n
        if i + 1 - first >= LEAST_LINES and not rolled >> 63:
            out.append((first, i + 1, words))
            first, words = i + 1, 0
    if first < len(lines):
        out.append((first, len(lines), words))
    return out


def removable(first: int, end: int, words: int) -> bool:
    return words > 0 and (end - first >= LEAST_LINES or words >= LONG_WORDS)


def runs(text: str) -> set[tuple[int, int]]:
    """First line and end of the shortest runs of LONG_WORDS words or more from each line on, and up to each line."""
    counts = [len(line.split()) for line in text.split("\n")]
    out, end, words = set(), 0, 0
    for first, n in enumerate(counts):
        while words < LONG_WORDS and end < len(counts):
            words += counts[end]
            end += 1
        if words < LONG_WORDS:
            break
        out.add((first, end))
        words -= n
    first, words = 0, 0
    for last, n in enumerate(counts):
        words += n
        while words - counts[first] >= LONG_WORDS:
            words -= counts[first]
            first += 1
        if words >= LONG_WORDS:
            out.add((first, last + 1))
    return out


def passages(text: str) -> list[tuple[int, int]]:
    return sorted(runs(text) | {c[:2] for c in chunks(text) if removable(*c)})


def _passage_rows():
    def row(text, doc, key):
        lines = b"".join(xxhash.xxh3_64_digest(line) for line in text.split("\n"))
        for first, end in passages(text):
            yield doc, key, first, end, xxhash.xxh3_64_intdigest(lines[8 * first : 8 * end]) - (1 << 63)

    return row


def _passage_digests():
    def row(text, wanted, doc, key):
        lines = text.encode("utf-8", "surrogatepass").split(b"\n")
        for first, end in sorted({(r["first"], r["end"]) for r in wanted}):
            yield doc, key, first, end, hashlib.sha256(b"\n".join(lines[first:end])).digest()

    return row


def _shortened():
    def row(text, repeats, *kept):
        if not repeats:
            yield *kept, text, 0, 0
            return
        lines = text.split("\n")
        gone = bytearray(len(lines))
        for r in repeats:
            for i in range(r["first"], r["end"]):
                if not r["stays"] <= i < r["until"]:
                    gone[i] = 1
        passages = sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False))
        yield *kept, "\n".join(line for line, g in zip(lines, gone, strict=True) if not g), passages, sum(gone)

    return row


def dedup_passages(df: DataFrame, keep: tuple[str, ...] = (), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """As dedup_lines, by whole passages; `removed_chunks` counts the places where neighbouring lines went."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    doc = kinds[id_column]
    texts = df.select(F.col(text).alias("t"), F.col(id_column).alias("doc"), F.xxhash64(F.col(text)).alias("key"))
    rows = map_rows(texts.where("t is not null"), _passage_rows, f"doc {doc}, key long, first int, end int, hash long")
    placed = written(rows, "runs")
    # a short hash finds those that may be repeated, so that few are compared in full
    twice = small(written(placed.groupBy("hash").count().where("count > 1").select("hash"), "twice"))
    wanted = placed.join(twice, "hash").groupBy("doc", "key").agg(F.collect_set(F.struct("first", "end")).alias("wanted"))
    owners = _by_place(texts, wanted, "inner").select("t", "wanted", "doc", "key")
    marked = written(map_rows(owners, _passage_digests, f"doc {doc}, key long, first int, end int, digest binary"), "marked")
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "key", "first", "end")
    origin = written(marked.groupBy("digest").agg(F.min(place).alias("origin"), F.max(place).alias("other")).where("origin <> other").drop("other"), "origins")
    others = marked.join(origin, "digest").where(~place.eqNullSafe(F.col("origin")))
    same = F.col("doc").eqNullSafe(F.col("origin.doc")) & (F.col("key") == F.col("origin.key"))
    repeat = F.struct("first", "end", F.when(same, F.col("origin.first")).otherwise(0).alias("stays"), F.when(same, F.col("origin.end")).otherwise(0).alias("until"))
    repeats = others.groupBy("doc", "key").agg(F.collect_set(repeat).alias("repeats"))
    return _rewritten(df, repeats, _shortened, keep, text, id_column, kinds)


def _chunk_rows():
    def row(text, doc, key):
        lines = text.split("\n")
        for no, chunk in enumerate(chunks(text)):
            if removable(*chunk):
                yield doc, key, no, xxhash.xxh3_128_digest("\n".join(lines[chunk[0] : chunk[1]]))

    return row


def _chunk_texts():
    def row(text, wanted):
        lines, found = text.split("\n"), chunks(text)
        for no in sorted(set(wanted)):
            passage = "\n".join(lines[found[no][0] : found[no][1]])
            yield xxhash.xxh3_128_digest(passage), passage

    return row


def _rebuilt():
    def row(text, repeats, *kept):
        if not repeats:
            yield *kept, text, 0, 0
            return
        lines, found = text.split("\n"), chunks(text)
        # removed only if every byte equals the first place's
        gone = {r["no"] for r in repeats if "\n".join(lines[found[r["no"]][0] : found[r["no"]][1]]) == r["passage"]}
        left = [line for no, (a, b, _) in enumerate(found) if no not in gone for line in lines[a:b]]
        yield *kept, "\n".join(left), len(gone), len(lines) - len(left)

    return row


def dedup_lines(df: DataFrame, keep: tuple[str, ...] = (), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id, `keep`, the text without repeated chunks, `removed_chunks` and `removed_lines` of every row."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    doc = kinds[id_column]
    texts = df.select(F.col(text).alias("t"), F.col(id_column).alias("doc"), F.xxhash64(F.col(text)).alias("key"))
    placed = written(map_rows(texts.where("t is not null"), _chunk_rows, f"doc {doc}, key long, no int, digest binary"), "chunks")
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "key", "no")
    repeated = placed.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    repeated = written(repeated, "repeated")
    firsts = repeated.groupBy("first.doc", "first.key").agg(F.collect_list("first.no").alias("wanted"))
    if repeated.count() <= BROADCAST_ROWS:  # then their places are small; beyond, the texts are shuffled once more
        firsts = F.broadcast(firsts)
    owners = _by_place(texts, firsts, "inner").select("t", "wanted")
    passages = map_rows(owners, _chunk_texts, "digest binary, passage string").dropDuplicates(["digest"])
    # one row per digest, written: so the one join on a hot digest can be split at run time
    known = written(repeated.join(passages, "digest"), "passages")
    others = placed.join(known, "digest").where(~place.eqNullSafe(F.col("first")))
    repeats = others.groupBy("doc", "key").agg(F.collect_list(F.struct("no", "passage")).alias("repeats"))
    return _rewritten(df, repeats, _rebuilt, keep, text, id_column, kinds)


def _rewritten(df: DataFrame, repeats: DataFrame, make: Callable, keep: tuple[str, ...], text: str, id_column: str, kinds: dict[str, str]) -> DataFrame:
    names = [f"k{i}" for i in range(len(keep) + 1)]
    kept = (id_column, *keep)
    whole = df.select(F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("key"), F.col(id_column).alias("doc"), *[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)])
    schema = ", ".join([f"{n} {kinds[c]}" for c, n in zip(kept, names, strict=True)] + [f"`{text}` string, removed_chunks int, removed_lines int"])
    rebuilt = map_rows(_by_place(whole, repeats, "left").select("t", "repeats", *names), make, schema)
    return rebuilt.toDF(*kept, text, "removed_chunks", "removed_lines")


def _by_place(texts: DataFrame, more: DataFrame, how: str) -> DataFrame:
    other = more.withColumnsRenamed({"doc": "_doc", "key": "_key"})
    return texts.join(other, texts["doc"].eqNullSafe(other["_doc"]) & (texts["key"] == other["_key"]), how)
