"""Token ids as ORC files, written and read back by Spark.

Rows are dealt into ranges of the id and sorted, so files, stripes and row groups hold ascending ids: minima and
maxima in footers and row indexes, and a Bloom filter on the id, let a reader pass over stripes. The ids are one list
column, which ORC stores in its integer run-length encoding. Stripes are read in parallel.

Null texts count as empty: only the end id is written. Null ids come first; of equal ids, rows come in the order of
their tokens. Repeated rows are all written. An empty table gives files without rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.llm.bpe import SETTLED
from carelake.llm.common import ship, text_of, written

#: Pieces between white space whose ids a worker remembers: the newest so many, and those used again of as many before.
REMEMBERED, LONGEST = 300_000, 40
END_ID = 1
SUFFIX = "</w>"
STRIPE_BYTES, ROW_GROUP = 64 << 20, 10_000
#: Characters of the texts that are encoded at once, but for a longer one.
BATCH_CHARACTERS = 1 << 20


class PieceEncoder:
    """The tokenizers library, asked once for each piece between white space that is not remembered.

    Right for tokenizers that drop white space, cut there, mark the ends of words, and look at no neighbour across it.
    Unknown words of a text are asked for together; the marks tell their ids apart.
    """

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(SUFFIX)]] = True
        special = self.library.get_added_tokens_decoder()
        #: A token that no piece gives, as text and number.
        self.between = next(((t.content, i) for i, t in special.items() if t.special and t.content.startswith("<|")), None)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, from the library itself."""
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _ask(self, words: list[str]) -> list[bytes]:
        """The ids of each word; one question if every word has one mark."""
        ids = array("I", self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids)
        stops = (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1).tolist()
        if len(stops) != len(words):
            return [self.whole(w) for w in words]
        packed = ids.tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip([0, *stops], stops, strict=False)]

    def _ask_apart(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces of any number of words: one question, a special token between each two of them."""
        if self.between is not None and not any("<|" in p for p in pieces):
            mark, number = self.between
            joined = self.library.encode_batch_fast([f" {mark} ".join(pieces)], add_special_tokens=False)[0].ids
            ids = np.array(joined, "<u4")
            stops = np.flatnonzero(ids == number)
            if len(stops) == len(pieces) - 1:
                return [ids[a:b].tobytes() for a, b in zip([0, *(stops + 1)], [*stops, len(ids)], strict=True)]
        coded = self.library.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in coded]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, piece by piece; what no text before had is asked for together.

        Pieces that are encoded alike are made equal first. Texts whose white space Python takes otherwise go whole.
        """
        cut: list[list[str] | None] = []
        for text in texts:
            if any(map(text.__contains__, _ODD)):
                cut.append(None)
                continue
            if "<|" not in text and "Σ" not in text and (text.isascii() or SETTLED.fullmatch(text)):
                text = text.lower()
            cut.append(STOPS.sub(r" \1", text).split())
        known, old = self.new, self.old
        # Differences with a dictionary look up the texts' pieces; updates by it would go through all that is remembered.
        asked = set().union(*[p for p in cut if p is not None]).difference(known)
        fresh = asked.difference(old)
        asked -= fresh
        known.update(zip(asked, map(old.__getitem__, asked), strict=True))
        words = [p for p in fresh if p.isalpha()]
        others = [p for p in fresh if not p.isalpha()]
        if words:
            known.update(zip(words, self._ask(words), strict=True))
        if others:
            known.update(zip(others, self._ask_apart(others), strict=True))
        find = known.__getitem__
        out = [self.whole(t) if p is None else b"".join(map(find, p)) for t, p in zip(texts, cut, strict=True)]
        for piece in fresh:
            if len(piece) > LONGEST:
                del known[piece]
        if len(known) > REMEMBERED:
            self.old, self.new = known, {}
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


#: A full stop or comma after a letter or digit at the end of a piece: the tokenizer cuts there in any case, but after a
#: letter whose lower case ends in a mark.
STOPS = re.compile(r"([.,])(?<=[^\W_İ][.,])(?=\s|\Z)")
#: Python takes these for white space, the tokenizer does not: such texts go to the library as a whole.
_ODD = "\x1c\x1d\x1e\x1f"


#: The encoder of this worker, which lives on from task to task, and the tokenizer it is for.
_KEPT: dict[str, PieceEncoder] = {}


def _encoder(content: str) -> PieceEncoder:
    if content not in _KEPT:
        _KEPT.clear()
        _KEPT[content] = PieceEncoder(content)
    return _KEPT[content]


def with_ids(df: DataFrame, spec: str, text: str = "text", id_column: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """The id and `ids` (array of integers, `end_id` last) of every row."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(spec)

    def run(batches):
        encoder = _encoder(shared.value)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("t").to_pylist()
            at = 0
            while at < len(texts):
                first, held = at, 0
                while at < len(texts) and held < BATCH_CHARACTERS:
                    held += len(texts[at])
                    at += 1
                some = texts[first:at]
                coded = encoder.encode_all(some)
                sizes = np.array([0, *[len(c) // 4 + 1 for c in coded]], np.int64).cumsum()
                values = np.frombuffer(b"".join([c + end for c in coded]), "<u4").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, at - first), lists], ["id", "ids"])

    kind = dict(df.dtypes)[id_column]
    chosen = df.select(F.col(id_column).alias("id"), text_of(text).alias("t"))
    return chosen.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def write(df: DataFrame, spec: str, path: str, files: int, text: str = "text", id_column: str = "doc_id", end_id: int = END_ID) -> None:
    """Writes `files` files in ascending order of the id, over the ranges that Spark draws from all ids."""
    dealt = df.select(id_column, text).repartitionByRange(files, id_column)
    coded = with_ids(dealt, spec, text, id_column, end_id).sortWithinPartitions(id_column, "ids")
    writer = coded.write.option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROW_GROUP)
    writer.option("orc.bloom.filter.columns", id_column).option("orc.bloom.filter.fpp", "0.01").option("orc.compress", "ZSTD").orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows; filters on the id are handed to the ORC reader."""
    return spark.read.orc(path)


def _sums(batches):
    for batch in batches:
        lists = batch.column("ids")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(lists.value_lengths().to_numpy())
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
        keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "ids"]
        names = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*keep, lists.value_lengths().cast(pa.int64()), pa.array(sums, pa.int64())], [*names, "n_tokens", "ids_crc32"])


def placed(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """The id, start (ids of all rows before), n_tokens and ids_crc32 of every row, from the files.

    Sums per file go before each file; rows are summed up within their file only.
    """
    ship(spark)
    stored = read(spark, path)
    kind = dict(stored.dtypes)[id_column]
    rows = stored.select(F.col(id_column).alias("id"), F.input_file_name().alias("file"), "ids")
    # Written, so that the ids are read once.
    rows = written(rows.mapInArrow(_sums, f"id {kind}, file string, n_tokens long, ids_crc32 long"), "token-sums")
    # all files' rows in one order: files by their least id, rows by id, crc and size where ids repeat
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("id").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", before.alias("offset"))
    within = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    out = summed.join(offsets, "file").select("id", (F.col("inner") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
    return out.withColumnRenamed("id", id_column)
