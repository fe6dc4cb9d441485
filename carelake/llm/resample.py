"""Importance resampling towards a target: n-grams are counted in buckets of their CRC, documents drawn by weight.

A text is lower-cased (A to Z only) and its words are joined by one space. Each such text is scanned once, which stores
the running CRC before and after every word. The CRC of any run of words follows from two of them: over GF(2) the CRC
of A followed by B is that of A shifted by B's length, plus that of B, so the part before cancels out. Shifts by short
lengths are looked up, longer ones are made of those by powers of two.

Bucket counts of all documents and of all target texts give every bucket a gain; a document weighs the sum of its
features' gains, gets a seeded Gumbel score, and the highest scores are drawn without replacement.

Null texts have no words, features, or weight; so have empty ones and an empty table has no result. A null id is hashed as no
digits and comes last among ties. Repeated rows are rows of their own. Further columns are passed over. An empty target
has no counts. Texts are scanned whole; a task holds the words of one batch of texts as numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import ship, written
from carelake.llm.ranks import numbered

#: Bytes a lookup shifts by at most.
SHORT = 64
_POLYNOMIAL = 0xEDB88320  # fixed value: the reversed polynomial of CRC-32
#: Every byte as itself in lower case if it belongs to a word (digits, letters, all beyond ASCII), else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _byte_table() -> np.ndarray:
    """What a register's low byte turns into when one zero byte is fed."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


class Shifts:
    """Registers shifted by a number of zero bytes, which is linear over GF(2): four lookups for a length."""

    def __init__(self, short: int = SHORT) -> None:
        byte = _byte_table()
        values = np.arange(256, dtype=np.uint32)
        tables = np.empty((short + 1, 4, 256), np.uint32)
        for place in range(4):
            tables[0, place] = values << np.uint32(8 * place)
        for n in range(1, short + 1):
            tables[n] = byte[tables[n - 1] & 255] ^ (tables[n - 1] >> np.uint32(8))
        self.short, self._tables, self._powers = short, tables, []

    @staticmethod
    def _apply(table: np.ndarray, registers: np.ndarray) -> np.ndarray:
        out = table[0][registers & 255]
        for place in range(1, 4):
            out = out ^ table[place][(registers >> np.uint32(8 * place)) & 255]
        return out

    def _power(self, k: int) -> np.ndarray:
        """The table for 2**k bytes: that for half of them, applied to itself."""
        while len(self._powers) <= k:
            before = self._powers[-1] if self._powers else None
            self._powers.append(self._tables[1] if before is None else self._apply(before, before))
        return self._powers[k]

    def __call__(self, registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        brief = np.minimum(lengths, self.short)
        t = self._tables
        out = t[brief, 0, registers & 255]
        for place in range(1, 4):
            out = out ^ t[brief, place, (registers >> np.uint32(8 * place)) & 255]
        rest = lengths - brief
        k = 0
        while (rest >> k).any():
            odd = np.flatnonzero((rest >> k) & 1)
            out[odd] = self._apply(self._power(k), out[odd])
            k += 1
        return out


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _scan(document: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running CRCs before each word and after it, and where words end, in one scan of the words joined by spaces."""
    pieces = [b" "] * (2 * len(document) - 1)
    pieces[::2] = document
    crc = zlib.crc32
    running = np.fromiter(accumulate(pieces, lambda c, piece: crc(piece, c), initial=0), np.uint32, len(pieces) + 1)
    ends = np.cumsum(np.fromiter(map(len, document), np.int64, len(document)) + 1) - 1
    return running[0::2], running[1::2], ends


def feature_crcs(document: list[bytes], least: int, most: int, shift: Shifts) -> np.ndarray:
    """The CRC-32 of every run of `least` to `most` consecutive words, repeats included."""
    if len(document) < least:
        return np.zeros(0, np.uint32)
    before, after, ends = _scan(document)
    starts = np.append(0, ends[:-1] + 1)
    out = []
    for n in range(least, min(most, len(document)) + 1):
        first = len(document) - n + 1
        out.append(after[n - 1 :] ^ shift(before[:first], ends[n - 1 :] - starts[:first]))
    return np.concatenate(out)


def features(df: DataFrame, text: str, keep: list[str], buckets: int, least: int = 1, most: int = 1) -> DataFrame:
    """The columns `keep` with n_words, n_features and `counted`: 32-bit pairs of bucket and count, by bucket."""
    clash = {"n_words", "n_features", "counted"} & set(keep)
    if clash:
        raise ValueError(f"columns to keep have names of the result's: {sorted(clash)}")
    spark = df.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = Shifts()
        for batch in batches:
            n_words, n_features, counted = [], [], []
            for value in batch.column(0):  # one text at a time is a Python object
                document = words(value.as_py())
                found = np.sort(feature_crcs(document, least, most, shift) % np.uint32(buckets))
                first = np.flatnonzero(np.diff(found, prepend=-1))
                pairs = np.empty((len(first), 2), "<u4")
                pairs[:, 0], pairs[:, 1] = found[first], np.diff(first, append=len(found))
                n_words.append(len(document))
                n_features.append(len(found))
                counted.append(pairs.tobytes())
            made = [pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(counted, pa.binary())]
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + made, names=[*keep, "n_words", "n_features", "counted"])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = (kept + ", " if kept else "") + "n_words long, n_features long, counted binary"
    return df.select(F.col(text).cast("string").alias("_text"), *keep).mapInArrow(run, schema)


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows are in each bucket: summed in the tasks, then by Spark; as many numbers as buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            pairs = np.frombuffer(b"".join(v.as_py() for v in batch.column(0)), "<u4").reshape(-1, 2)
            # whole numbers below 2^53 for a batch, so doubles add up exactly
            total += np.bincount(pairs[:, 0], pairs[:, 1], minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for row in found.select("counted").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed target share over the smoothed corpus share) of every bucket."""
    buckets = len(corpus)
    up = (target + 1.0) * float(corpus.sum() + buckets)
    down = (corpus + 1.0) * float(target.sum() + buckets)
    return np.floor(1000.0 * np.log(up / down)).astype(np.int64)


def _weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """`found` with weight, the sum of its features' gains, instead of what they are."""
    keep = [c for c in found.columns if c != "counted"]
    kept = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for value in batch.column(0):
                pairs = np.frombuffer(value.as_py(), "<u4").reshape(-1, 2)
                weights.append(int(gain[pairs[:, 0]] @ pairs[:, 1].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(weights, pa.int64())], names=[*keep, "weight"])

    return found.select("counted", *keep).mapInArrow(run, f"{kept}, weight long")


def resample(
    documents: DataFrame,
    target: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    buckets: int = 10_000,
    least: int = 1,
    most: int = 1,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """id, n_features, weight, score and rank of every row; rank is null for rows that are not drawn.

    Of the rows of at least `least_words` words, `percent` in a hundred (rounded down) are drawn.
    """
    found = written(features(documents, text, [id_column], buckets, least, most).withColumnRenamed(id_column, "id"), "features")
    counted = written(features(target, text, [], buckets, least, most), "target-features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(counted, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(_weighed(found, gain).withColumn("score", F.col("weight") + noise), "scored")
    takes_part = F.col("n_words") >= least_words
    drawn = scored.where(takes_part).count() * percent // 100
    ranked = numbered(scored.where(takes_part), [F.col("score").desc(), F.col("id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~takes_part).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")
