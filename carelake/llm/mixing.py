"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Words are handed out in blocks of equal size. Targets come first: sources share the mix by weight; one that would
exceed its limit (`repeats` times its words) gets the limit, and the rest is shared anew. Blocks then go to sources by
the highest quotients target / (2k - 1), and each source's blocks to its shards in the same way by their words, so
every shard has an integer quota. A shard is a stream of documents in a seeded order, cut into blocks. Its quota takes
the whole stream as often as it fits; what is left is a run of blocks from a seeded start, going round at the end: a
random choice of documents, of which two at most are cut.

Quotients are not enumerated from the first. With m shards and q blocks, every share of q rounds to within half a
block, so blocks at a rate a little below certainly go out; only the 2m quotients or so around it are ranked.

A null text has no words and takes none, nor does an empty one. A null source is a source of its own, the last. Null
and repeated ids are rows of their own; rows alike in everything are interchangeable. Very long documents lie in one
stream, over many blocks. An empty table has no result, one without words has targets of 0. Further columns are
passed over, whatever their names. Shards hold SHARD words or so, so a hot source has many; sources are joined by
broadcast below a checked size, else through salted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import written
from carelake.llm.ranks import numbered
from carelake.operators.joins import BROADCAST_BYTES, measured_bytes

#: Words of a block, and of a shard.
BLOCK, SHARD = 16, 1 << 20
#: Parts of a hot source in a shuffled join.
SALTS = 64


def word_count(text: Column) -> Column:
    r"""The number of `[^\x20\x09-\x0D]+` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _number(text: Column) -> Column:
    """Sixty bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, total: float, repeats: int = 2) -> DataFrame:
    """`sources` (source_size, weight) with target: shares of `total` by weight, none above `repeats` times its size.

    Every round fixes sources at their limit and shares the rest; one aggregate of the sources each.
    """
    limit = F.col("source_size") * repeats
    rate, fixed = -1.0, 0
    while True:
        above = F.lit(False) if rate < 0 else F.col("weight") * F.lit(rate) > limit
        seen = sources.agg(
            F.count_if(above).alias("fixed"),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weights"),
        ).first()
        if rate >= 0 and seen["fixed"] == fixed or not seen["weights"]:
            break
        fixed = seen["fixed"]
        rest, weights = total - seen["taken"], seen["weights"]
        rate = max(rate, rest / weights)
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weights)) if rate >= 0 else F.lit(0.0)
    return sources.withColumn("target", F.when(above, limit.cast("double")).otherwise(share))


def apportion(items: DataFrame) -> DataFrame:
    """`items` (group, item, weight, most, quota) with seats: a group's quota by its highest quotients weight / (2k - 1).

    A group's rows all have its quota. No item gets more than `most`; equal quotients go to the smaller item first.
    """
    taking = items.where("weight > 0")
    groups = taking.groupBy("group").agg(
        F.sum("weight").cast("double").alias("_all"), F.count(F.lit(1)).alias("_n"), F.max("quota").alias("_quota")
    )

    def seats(blocks: Column) -> Column:
        return F.least("most", F.floor(F.col("weight") * F.greatest(F.lit(0.0), blocks) / F.col("_all") + 0.5))

    # Rounding moves m items by half a seat each at most: so many seats are sure, and so many in question.
    around = F.col("_n") / 2 + 1
    based = written(
        taking.join(groups, "group")
        .withColumn("_sure", seats(F.col("_quota") - around))
        .withColumn("_last", seats(F.col("_quota") + around))
        .select("group", "item", "weight", "_quota", "_sure", "_last"),
        "sure-seats",
    )
    asked = based.where("_last > _sure").select("group", "item", "weight", F.explode(F.sequence(F.col("_sure") + 1, F.col("_last"))).alias("_k"))
    asked = written(asked.withColumn("_quotient", F.col("weight") / (2 * F.col("_k") - 1)), "quotients")
    ranked = numbered(asked, [F.col("group"), F.col("_quotient").desc(), F.col("item")], "_rank")
    first = ranked.groupBy("group").agg(F.min("_rank").alias("_first"))
    left = based.groupBy("group").agg((F.max("_quota") - F.sum("_sure")).alias("_left"))
    won = ranked.join(first.join(left, "group"), "group").where(F.col("_rank") < F.col("_first") + F.col("_left"))
    won = won.groupBy("group", "item").agg(F.count(F.lit(1)).alias("_won"))
    got = based.join(won, ["group", "item"], "left").select(
        "group", "item", (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("_seats")
    )
    return items.join(got, ["group", "item"], "left").withColumn("seats", F.coalesce("_seats", F.lit(0)).cast("long")).drop("_seats")


def _with_source(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the columns of their source; a null source is one, too."""
    sources = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if measured_bytes(sources) <= BROADCAST_BYTES:
        return documents.join(F.broadcast(sources), same).drop("_source")
    salted = documents.withColumn("_salt", F.pmod("place", F.lit(SALTS)))
    spread = sources.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, same & (F.col("_salt") == F.col("_of"))).drop("_source", "_salt", "_of")


def _overlap(low: Column, high: Column) -> Column:
    """Words of a document (at `start`, of `size`) between two places of its shard's stream."""
    return F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), high) - F.greatest(F.col("start"), low))


def mix(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    percent: int = 150,
    repeats: int = 2,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = 2024,
) -> DataFrame:
    """id, source, size, source_size, target, shard, start (in the shard's stream) and taken, in words, of every row.

    Sources in order, null last, weigh `weights` in turn and share `percent` in a hundred of all words.
    """
    name = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    sized = written(
        documents.select(
            F.col(id_column).alias("id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            _number(F.concat(F.lit(f"{seed}:"), name)).alias("place"),
        ),
        "sized",
    )
    sources = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    ordered = written(numbered(sources, [F.col("source").asc_nulls_last()], "source_no"), "numbered-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    aimed = written(targets(ordered.withColumn("weight", weight), total * percent / 100, repeats), "targets")

    quota = F.floor(F.lit(total * percent / 100 / block) + 0.5)
    seats = apportion(
        aimed.select(
            F.lit(0).alias("group"),
            F.col("source_no").alias("item"),
            F.col("target").alias("weight"),
            (F.ceil(F.col("source_size") / block) * repeats).alias("most"),
            quota.alias("quota"),
        )
    ).select(F.col("item").alias("source_no"), F.col("seats").alias("quota"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard))
    whole = aimed.select("source", "source_no", "source_size", "target", shards.alias("shards"))
    placed = _with_source(sized, whole).withColumn("shard", F.pmod("place", "shards")).drop("shards")
    placed = written(placed, "placed")

    streams = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("weight"))
    streams = streams.withColumn("blocks", F.ceil(F.col("weight") / block)).join(seats, "source_no")
    streams = written(
        apportion(
            streams.select(
                F.col("source_no").alias("group"), F.col("shard").alias("item"), "weight", "blocks", (F.col("blocks") * repeats).alias("most"), "quota"
            )
        ),
        "shard-quotas",
    )
    # Rounds of the whole stream, then a run of blocks from a seeded one on, which goes round at the end.
    begin = F.pmod(_number(F.concat_ws(":", F.lit(str(seed)), "group", "item")), F.greatest(F.lit(1), "blocks")) * block
    of_shard = streams.select(
        F.col("group").alias("source_no"),
        F.col("item").alias("shard"),
        F.floor(F.col("seats") / F.greatest(F.lit(1), "blocks")).alias("_rounds"),
        begin.alias("_from"),
        (begin + F.pmod("seats", F.greatest(F.lit(1), "blocks")) * block).alias("_to"),
        (F.col("blocks") * block).alias("_length"),
    )
    stream = Window.partitionBy("source_no", "shard").orderBy("place", "id", "size")
    start = F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    extra = _overlap(F.col("_from"), F.least("_to", "_length")) + _overlap(F.lit(0), F.col("_to") - F.col("_length"))
    taken = F.col("_rounds") * F.col("size") + extra
    return (
        placed.withColumn("start", start)
        .join(of_shard, ["source_no", "shard"])
        .select(F.col("id").alias(id_column), "source", "size", "source_size", "target", "shard", "start", taken.cast("long").alias("taken"))
    )
