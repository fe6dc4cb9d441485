"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact shingle containment.

Only DataFrame functions. A text is its lower-case words (runs of letters and digits); its shingles are five
neighbouring words each, or all words if there are fewer. Documents are partitioned by the number of their shingles,
and each partition has a one-permutation MinHash signature with bins in proportion to its largest size: the least hash
of every bin. As the signature grows with the document, a short item's share of it does not shrink, and one equal bin
minimum makes a candidate. An item's signature is held for all partitions at once: a hash of an item counts in a
partition if the item's next smaller hash lies in another bin of it. With BINS bins a shingle, a shared shingle is its
bin's least hash in the document in at least 88 of 100 cases, and an item of SHORT shingles or more that reaches the
threshold shares seven at least: fewer than one in a million is missed. Shorter items meet through all shingles.

Candidates are held against the text: shared shingles, as strings, over the item's shingles.

Null and empty texts have no shingles and match nothing. Items with equal shingles are one class, named by its smallest
id; items without an id take no part. Rows alike in id and text give one row per class. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import small, text_of, written

WIDTH, THRESHOLD = 5, 0.8
#: Bins per shingle of a partition's largest document; items below SHORT shingles are looked up without bins.
BINS, SHORT = 4, 8


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row, however often lambdas refer to it."""
    return df.withColumn(name, F.explode(F.array(value)))


def with_words(df: DataFrame, text: str) -> DataFrame:
    found = F.filter(F.split(F.lower(text_of(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return _once(df, "words", found).where(F.size("words") > 0)


def _starts() -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size("words") - WIDTH, F.lit(0)))


def with_hashes(df: DataFrame) -> DataFrame:
    """`hashes`: the distinct hashes of the shingles in ascending order."""
    words = F.col("words")
    whole = F.transform(_starts(), lambda i: F.xxhash64(*[words[i + k] for k in range(WIDTH)]))
    short = F.array(F.xxhash64("words"))
    hashes = F.when(F.size("words") >= WIDTH, whole).otherwise(short)
    return _once(df, "hashes", F.sort_array(F.array_distinct(hashes)))


def shingles() -> Column:
    return F.array_distinct(F.transform(_starts(), lambda i: F.array_join(F.slice("words", i + 1, WIDTH), " ")))


def item_classes(items: DataFrame, text: str, id_column: str) -> DataFrame:
    """item_id (the smallest of its class), words and shingles of each class of items."""
    named = items.where(F.col(id_column).isNotNull())
    listed = with_words(named.select(F.col(id_column).alias("item_id"), F.col(text).alias("item_text")), "item_text")
    listed = _once(listed, "item_shingles", F.array_sort(shingles()))
    return listed.groupBy("item_shingles").agg(F.min_by(F.struct("item_id", "words"), F.col("item_id")).alias("first")).select("first.item_id", "first.words", "item_shingles")


def _index(classes: DataFrame) -> DataFrame:
    """A row per shingle hash of each item: hash, item_id, the next smaller hash, and whether the item is short."""
    hashed = with_hashes(classes).select("item_id", "hashes", (F.size("hashes") < SHORT).alias("short"))
    rows = hashed.select("item_id", "short", F.posexplode("hashes").alias("at", "h"), "hashes")
    return rows.select("h", "item_id", "short", F.when(F.col("at") > 0, F.get("hashes", F.col("at") - 1)).alias("below"))


def _shift(size: Column) -> Column:
    """How far a hash moves right to be its bin's number: bins are the next power of two of the size, times BINS."""
    return (F.lit(64) - F.least(F.lit(62), F.ceil(F.log2(size.cast("double"))) + (BINS - 1).bit_length())).cast("int")


def _shifted(h: Column, by: Column) -> Column:
    return F.call_function("shiftright", h, by)


def contaminated(documents: DataFrame, items: DataFrame, text: str = "text", id_column: str = "doc_id", item_text: str = "text", item_column: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """The id, `text_key`, item_id, shared_shingles, item_shingles and containment of every document and class of items in it.

    `text_key` is the text's xxhash64: with the id it names a row where ids are missing or repeated.
    """
    classes = written(item_classes(items, item_text, item_column), "items")
    index = written(_index(classes), "item-hashes")
    texts = documents.select(F.col(id_column).alias("doc"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("key"))
    signed = with_hashes(with_words(texts, "t")).withColumn("by", _shift(F.size("hashes"))).select("doc", "key", "by", "hashes")
    rows = signed.select("doc", "key", "by", F.posexplode("hashes").alias("at", "h"), F.col("hashes"))
    least = (F.col("at") == 0) | (_shifted(F.get("hashes", F.col("at") - 1), F.col("by")) != _shifted(F.col("h"), F.col("by")))
    signature = rows.select("doc", "key", "by", "h", least.alias("least"))
    meets = F.col("short") | (F.col("least") & (F.col("below").isNull() | (_shifted(F.col("below"), F.col("by")) != _shifted(F.col("h"), F.col("by")))))
    candidates = signature.join(small(index), "h").where(meets).select("doc", "key", "item_id").distinct()
    candidates = written(candidates, "candidates")
    owners = small(candidates.groupBy("doc", "key").agg(F.collect_set("item_id").alias("items")).withColumnsRenamed({"doc": "_doc", "key": "_key"}))
    found = texts.join(owners, texts["doc"].eqNullSafe(owners["_doc"]) & (texts["key"] == owners["_key"])).select("doc", "key", "t", "items")
    found = _once(with_words(found, "t"), "doc_shingles", shingles()).select("doc", "key", "doc_shingles", F.explode("items").alias("item_id"))
    checked = found.join(classes.select("item_id", "item_shingles"), "item_id").select(
        F.col("doc").alias(id_column),
        F.col("key").alias("text_key"),
        "item_id",
        F.size(F.array_intersect("doc_shingles", "item_shingles")).alias("shared_shingles"),
        F.size("item_shingles").alias("item_shingles"),
    )
    return checked.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles")).where(F.col("containment") >= threshold).distinct()
