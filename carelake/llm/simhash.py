"""Near duplicates by SimHash fingerprints, linked through covering locality-sensitive hashing.

Each of the 64 bits has a vector of radius + 1 bits, and each non-zero vector v makes a table: its mask keeps the bits
whose vectors have an odd product with v. Up to `radius` differing bits always leave some v whose mask holds none of
them, so such a pair meets in that table. Equal fingerprints are one node from the start.

Members of a small bucket are compared in pairs. Those of a large one are linked through all fingerprints one bit
away: two fingerprints differ in at most two bits if and only if they share one of these, and whoever shares one
differs in at most two. Work stays in proportion to the fingerprints, however they gather (for radius 2, or less).

Null texts count as empty. Texts without words have fingerprint zero and link like any other. Repeated rows get equal
results; a component of rows without ids has a null id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import map_rows, text_of, written
from carelake.llm.graph import components

BITS = 64
#: Fingerprints of a bucket that are compared in pairs at most; larger buckets are linked the other way.
PAIRED = 24
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256
#: Shingles that are counted at once.
_STEP = 1 << 16


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the shingles' XXH64, repeats included, as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    ends = [*[s - 1 for s in starts[width:]], len(joined)]
    hashed = xxhash.xxh64_digest
    counts = np.zeros((8, 256), np.int64)
    for i in range(0, len(ends), _STEP):
        digests = b"".join([hashed(joined[a:b], seed) for a, b in zip(starts[i : i + _STEP], ends[i : i + _STEP], strict=False)])
        places = np.frombuffer(digests, np.uint8).reshape(-1, 8) + _PLACES
        counts += np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """`keep` and `fp` (long) of every row."""

    def make():
        def row(text, *kept):
            yield *kept, fingerprint(text, width)

        return row

    names = [f"k{i}" for i in range(len(keep))]
    chosen = df.select(text_of(text).alias("t"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{n} {kinds[c]}" for c, n in zip(keep, names, strict=True)] + ["fp long"])
    return map_rows(chosen, make, schema).toDF(*keep, "fp")


def masks(radius: int) -> list[int]:
    """The tables' masks, as signed 64-bit integers."""
    vectors = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(BITS) if ((1 + i % vectors) & v).bit_count() % 2)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """a < b: links of the distinct fingerprints `fp`. Components over them are those of all pairs within the radius."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2: larger buckets have no exact way beyond")
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))]))
    placed = nodes.select("fp", tables.alias("t")).select("fp", "t.i", "t.key")
    sizes = placed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(placed.join(sizes, ["i", "key"]), "buckets")
    few = shared.where(F.col("n") <= PAIRED)
    pairs = few.select("i", "key", F.col("fp").alias("a")).join(few.select("i", "key", F.col("fp").alias("b")), ["i", "key"]).where("a < b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    # In large buckets: one bit away from both (radius 2), or one of the two itself (radius 1).
    crowd = shared.where(F.col("n") > PAIRED).select("fp").distinct()
    flips = [F.lit(0).cast("long"), *[F.lit(f - (1 << BITS) if f >> (BITS - 1) else f) for f in (1 << i for i in range(BITS))]]
    near = crowd.select("fp", F.explode(F.transform(F.array(*flips), lambda f: F.col("fp").bitwiseXOR(f))).alias("centre"))
    if radius == 1:  # then the centre itself must be a fingerprint
        near = near.join(crowd.select(F.col("fp").alias("centre")), "centre", "left_semi").select("fp", "centre")
        stars = near.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))
    else:
        hubs = near.groupBy("centre").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
        stars = near.join(hubs, "centre").select("a", F.col("fp").alias("b"))
    return pairs.where(close).select("a", "b").unionByName(stars.where("a <> b").select("a", "b")).distinct()


def near_duplicates(prints: DataFrame, radius: int = 2, id_column: str = "doc_id") -> DataFrame:
    """All rows of `prints` (an id and `fp`) with `root_fp` and `component_id`, the smallest id of the component.

    `prints` is read twice: pass a written table.
    """
    nodes = written(prints.groupBy("fp").agg(F.min(id_column).alias("least_id")), "fingerprints")
    roots = components(links(nodes, radius)).select(F.col("node").alias("fp"), "root")
    placed = written(nodes.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root_fp")), "placed")
    least = placed.groupBy("root_fp").agg(F.min("least_id").alias("component_id"))
    return prints.join(placed.join(least, "root_fp").select("fp", "root_fp", "component_id"), "fp")


def surplus(df: DataFrame, radius: int = 2, width: int = 3, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id and `text_key` (XXH64 of the text) of all rows but the first of each component: smallest id, ids before none.

    Rows alike in id and text are one row here.
    """
    keyed = df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_key"))
    prints = written(fingerprints(keyed, keep=("doc_id", "text_key"), width=width).distinct(), "prints")
    grouped = written(near_duplicates(prints, radius).select("doc_id", "text_key", "root_fp"), "grouped")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    firsts = grouped.groupBy("root_fp").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = grouped.join(firsts, "root_fp").where(~place.eqNullSafe(F.col("first")))
    return later.select(F.col("doc_id").alias(id_column), "text_key")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

