"""Even shards that keep linked documents together: balanced label propagation.

Documents with equal texts are linked. So that no document has more links than a fair share, copies are dealt into
blocks by a hash; each copy is linked with its block's leader, and leaders with the group's. Every linked document
starts in a shard of its own hash. In a round each counts its neighbours' shards and would like to move to the one
that most are in, if more are there than in its own; a coin by hash lets half of them ask, so that neighbours do not
swap places. A table of shards by shards by gain says how many may: never more than leave room. Rounds end when nobody
asks, or after ROUNDS. Then each shard keeps what it may hold, copies next to their leader first, and the documents
left over or without links fill the shards up.

Law `rows`: the counts of two shards differ by one at most. Null texts have no links and one byte of size. Rows without
an id, and repeated ids, are documents of their own: they are numbered by text and a hash. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import digest, small, written

SHARDS, ROUNDS = 16, 8
#: Blocks a group of copies is dealt into.
BLOCKS = 64
#: Documents of one bin when documents are numbered.
PER_BIN = 20_000
_ONE = 1 << 30


def _hash(salt: str, *columns: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(_ONE))


def links_of_copies(docs: DataFrame) -> DataFrame:
    """node, parent: a link for each copy, from `docs` (node, digest). Leaders of groups have none."""
    salted = docs.where("digest is not null").withColumn("block", _hash("block", "node") % BLOCKS)
    blocks = written(salted.groupBy("digest", "block").agg(F.min("node").alias("leader"), F.count("*").alias("n")), "blocks")
    groups = blocks.groupBy("digest").agg(F.min("leader").alias("head"), F.sum("n").alias("n")).where("n > 1").drop("n")
    led = written(blocks.drop("n").join(groups, "digest"), "led")
    members = salted.join(led, ["digest", "block"]).select("node", F.col("leader").alias("parent"))
    heads = led.select(F.col("leader").alias("node"), F.col("head").alias("parent"))
    return members.unionByName(heads).where("node <> parent")


def _allowed(asked: dict[tuple[int, int], int], load: list[int], room: list[int]) -> dict[tuple[int, int], float]:
    """The share of each (from, to) that may move, so that no shard grows beyond its room: shards by shards."""
    share = dict.fromkeys(asked, 1.0)
    for _ in range(60):
        steady = True
        for j in range(len(load)):
            come = sum(share[m] * n for m, n in asked.items() if m[1] == j)
            go = sum(share[m] * n for m, n in asked.items() if m[0] == j)
            free = max(room[j] - load[j] + go, 0.0)
            if come > free + 1e-9:
                steady = False
                for m in asked:
                    if m[1] == j:
                        share[m] *= free / come
        if steady:
            break
    return share


def propagate(links: DataFrame, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """node, shard, beside (whether the parent is in the same shard) of every linked node."""
    shards = len(room)
    links = written(links, "links")
    both = links.unionByName(links.select(F.col("parent").alias("node"), F.col("node").alias("parent")))
    nodes = both.select("node").distinct()
    state = written(nodes.withColumn("shard", (_hash("start", "node") % shards).cast("int")), "shards")
    for turn in range(rounds):
        seen = both.join(state.withColumnsRenamed({"node": "parent", "shard": "there"}), "parent")
        counts = seen.groupBy("node", "there").agg(F.count("*").alias("n"))
        best = counts.groupBy("node").agg(F.max(F.struct("n", (-F.col("there")).alias("low"))).alias("best"))
        mine = counts.withColumnsRenamed({"there": "shard", "n": "stay"})
        asks = state.join(best, "node").join(mine, ["node", "shard"], "left").select(
            "node", "shard", (-F.col("best.low")).alias("wish"), (F.col("best.n") - F.coalesce("stay", F.lit(0))).alias("gain")
        )
        keen = (F.col("gain") > 0) & (_hash(f"coin {turn}", "node") % 2 == 0)
        asks = written(asks.withColumn("gain", F.when(keen, F.least(F.lit(20), F.floor(F.log2(F.col("gain").cast("double"))) + 1).cast("int")).otherwise(0)), "asks")
        table = asks.groupBy("shard", "wish", "gain").agg(F.count("*").alias("n")).collect()  # shards x shards x 21 at most
        load = [sum(r["n"] for r in table if r["shard"] == j) for j in range(shards)]
        asked: dict = {}
        for r in table:
            if r["gain"]:
                asked[r["shard"], r["wish"]] = asked.get((r["shard"], r["wish"]), 0) + r["n"]
        share = _allowed(asked, load, room)
        moves = []  # the largest gains first, then a part of one gain
        for (i, j), n in asked.items():
            left = share[i, j] * n
            for r in sorted((r for r in table if (r["shard"], r["wish"]) == (i, j) and r["gain"]), key=lambda r: -r["gain"]):
                moves.append((i, j, r["gain"], int(min(1.0, left / r["n"]) * _ONE)))
                left = max(left - r["n"], 0.0)
        if not asks.where(F.expr("wish <> shard")).limit(1).count():
            break
        if not moves:
            continue
        quota = F.broadcast(links.sparkSession.createDataFrame(moves, "shard int, wish int, gain int, quota long"))
        moved = F.coalesce(_hash(f"move {turn}", "node") < F.col("quota"), F.lit(False))
        state = written(asks.join(quota, ["shard", "wish", "gain"], "left").select("node", F.when(moved, F.col("wish")).otherwise(F.col("shard")).alias("shard")), "shards")
    placed = state.join(links, "node", "left").join(state.select(F.col("node").alias("parent"), F.col("shard").alias("there")), "parent", "left")
    return placed.select("node", "shard", F.coalesce(F.col("there") == F.col("shard"), F.lit(True)).alias("beside"))


def numbered(df: DataFrame, group: list[str], order: list[Column], bins: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within each group, by `order`, then by hash bins of the node.

    Counts per bin are summed up in order; the window that numbers rows sees one bin of one group at a time. `order`
    must take few values.
    """
    from pyspark.sql import Window

    binned = df.withColumn("_at", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], (_hash("bin", "node") % bins).alias("b")))
    sizes = binned.groupBy(*group, "_at").agg(F.count("*").alias("_n"))
    above = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sizes.select(*group, "_at", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before")), "offsets")
    within = Window.partitionBy(*group, "_at").orderBy(_hash("order", "node"), "node")
    rows = binned.withColumn("_row", F.row_number().over(within) - 1)
    return rows.join(small(offsets), [*group, "_at"]).withColumn(out, (F.col("_row") + F.col("_before")).cast("long")).drop("_row", "_before", "_at")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`docs` (node: unique, digest) with shard and slot (gapless from 0)."""
    docs = written(docs, "nodes")
    total = docs.count()
    room = [total // shards + (j < total % shards) for j in range(shards)]
    bins = max(1, total // (shards * PER_BIN))
    linked = written(propagate(links_of_copies(docs.select("node", "digest")), room), "propagated")
    limits = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(room)), "shard int, room long"))
    ranked = numbered(linked, ["shard"], [~F.col("beside")], bins, "rank").join(limits, "shard")
    stay = written(ranked.where("rank < room").select("node", "shard"), "stay")
    held = {r["shard"]: r["n"] for r in stay.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    first, gaps = 0, []  # the documents left over are one queue; each shard takes the next ones it has room for
    for j in range(shards):
        if n := room[j] - held.get(j, 0):
            gaps.append((j, first, first + n))
            first += n
    queue = numbered(docs.join(stay, "node", "left_anti").select("node").withColumn("all", F.lit(0)), ["all"], [], bins * shards, "rank")
    target = F.lit(None).cast("int")
    for j, a, b in gaps:
        target = F.when((F.col("rank") >= a) & (F.col("rank") < b), F.lit(j)).otherwise(target)
    shard = stay.unionByName(queue.select("node", target.alias("shard")))
    return docs.join(numbered(written(shard, "placed"), ["shard"], [], bins, "slot"), "node")


def shard_documents(df: DataFrame, shards: int = SHARDS, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    content = F.col(text).cast("string")
    rows = df.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.coalesce(content, F.lit("")).cast("binary")).alias("crc"),
        F.when(content.isNotNull(), digest(content)).alias("digest"),
    )
    rows = written(rows, "documents")
    # ids are nodes where they are unique; missing and repeated ones get a number of their own
    odd = rows.where(F.col("id").isNull()).select("id").distinct().unionByName(rows.groupBy("id").count().where("count > 1").select("id")).distinct()
    node = F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.lit(0).cast("long").alias("copy"))
    if odd.limit(1).count():
        rows = _apart(rows, written(odd, "odd"), node)
    else:
        rows = rows.withColumn("node", node)
    placed = assign(rows.select("node", "digest", "id", "bytes", "crc"), shards)
    return placed.select(
        F.col("id").alias(id_column), (F.col("bytes") + 1).alias("size"), F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _apart(rows: DataFrame, odd: DataFrame, node: Column) -> DataFrame:
    """Nodes for rows whose id is missing or repeated: the id and a number that is drawn once and written."""
    marked = rows.join(odd.withColumnsRenamed({"id": "_odd"}).withColumn("_is", F.lit(True)), F.col("id").eqNullSafe(F.col("_odd")), "left")
    copy = F.when(F.col("_is"), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long"))
    named = marked.withColumn("node", F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), copy.alias("copy")))
    return written(named.drop("_odd", "_is"), "apart")
