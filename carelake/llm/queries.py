"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm import (
    bpe,
    decontaminate,
    linededup,
    mixing,
    mtree,
    orcids,
    resample,
    secrets,
    sharding,
    simhash,
    toxicity,
    warc,
    whitening,
)
from carelake.llm.common import scratch_path, table, written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels, ~held_out())
    return toxicity.score(documents, model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_passages(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    warc.write(pages, path, pages.rdd.getNumPartitions())
    found = warc.read(spark, path, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(simhash.fingerprints(table(spark, sf_dir, "documents")), "prints")
    return simhash.near_duplicates(prints).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(mtree.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return mtree.top_k(vectors, F.col("id") % 20 == 0)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = secrets.find(documents, secrets.fit(documents))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(joined(F.filter("found", lambda x: x["kind"] != "cnn")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.read_spec(spark, WORD_BPE))
    return coded.select(
        "doc_id",
        bpe.count_ids(F.col("packed_ids")).alias("n_tokens"),
        F.sha2("packed_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-ids")
    orcids.write(documents, bpe.read_spec(spark, WORD_BPE), path, documents.rdd.getNumPartitions())
    return orcids.placed(spark, path)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(whitening.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return whitening.whiten(vectors, whitening.fit(vectors)).withColumnRenamed("id", "vec_id")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc": op4_warc,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_mtree": op7_mtree,
    "op8_secrets": op8_secrets,
    "op9_bpe": op9_bpe,
    "op10_orc_ids": op10_orc_ids,
    "op11_whitening": op11_whitening,
    "op12_resampling": op12_resampling,
    "op13_mixing": op13_mixing,
}

_SHINGLES = """
    list_distinct(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
        else [array_to_string(w, ' ')] end)
"""

ORACLE: dict[str, str] = {
    "op4_warc": """
        with payload as (
            select page_id, url, encode(coalesce(html, '')) as body from pages
        ), sized as (
            select page_id, url, octet_length(body) as payload_bytes, sha256(body) as payload_digest from payload
        ), shared as (
            select payload_digest, min(page_id) as first from sized where payload_bytes >= 100 group by payload_digest
        )
        select page_id, payload_bytes, payload_digest,
            case when coalesce(first, page_id) = page_id then 'response' else 'revisit' end as record_type,
            case when coalesce(first, page_id) <> page_id then first end as refers_to,
            url, null::varchar as error
        from sized left join shared using (payload_digest)
    """,
    "op7_mtree": """
        with vector as (
            select vec_id, [floor(64 * x::double) for x in embedding] as v from embeddings
            where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        ), scored as (
            select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v)::bigint as score
            from vector a join vector b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
        ), ranked as (
            select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
            from scored
        )
        select * from ranked where rank <= 20
    """,
    "op6_decontamination": f"""
        with item_words as (
            select item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from benchmark where item_id is not null
        ), classes as (
            select min(item_id) as item_id, s from (
                select item_id, list_sort({_SHINGLES}) as s from item_words where len(w) > 0
            ) group by s
        ), item_shingle as (
            select item_id, len(s) as n, unnest(s) as shingle from classes
        ), doc_words as (
            select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from documents
        ), doc_shingle as (
            select doc_id, unnest({_SHINGLES}) as shingle from doc_words where len(w) > 0
        )
        select doc_id, item_id, count(*)::int as shared_shingles, any_value(n)::int as item_shingles,
            count(*) / any_value(n) as containment
        from (select distinct * from doc_shingle) join item_shingle using (shingle)
        group by doc_id, item_id
        having count(*) >= 0.8 * any_value(n)
    """,
    "op13_mixing": f"""
        with sized as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
                ('0x' || substr(md5('2024:' || coalesce(doc_id::varchar, ':' || coalesce(text, ''))), 1, 15))::bigint as place
            from documents
        ), numbered as (
            select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as source_no
            from sized group by source
        ), weighed as (
            select *, [3, 1, 2][(source_no - 1) % 3 + 1] as weight, 2 * source_size as most,
                sum(source_size) over () * 1.5::double as total
            from numbered
        ), filled as (
            select *, row_number() over by_limit as nth,
                total - coalesce(sum(most) over (order by most / weight, source_no rows between unbounded preceding and 1 preceding), 0) as rest,
                sum(weight) over (order by most / weight, source_no rows between current row and unbounded following) as weights
            from weighed window by_limit as (order by most / weight, source_no)
        ), free as (
            select arg_min(rest, nth) as rest, arg_min(weights, nth) as weights, min(nth) as nth from filled where most / weight >= rest / weights
        ), aimed as (
            select f.*, case when free.nth is null or f.nth < free.nth then f.most::double
                else free.rest::double * f.weight / free.weights::double end as target
            from filled f cross join free
        ), source_seats as (
            select source_no, count(*) as quota from (
                select source_no, row_number() over (order by target / (2 * k - 1) desc, source_no) as n, total
                from (select *, unnest(range(1, 2 * ceil(source_size / {mixing.BLOCK})::bigint + 1)) as k from aimed where target > 0)
            ) where n <= floor(total / {mixing.BLOCK} + 0.5) group by source_no
        ), placed as (
            select s.*, a.source_no, a.source_size, a.target, s.place % greatest(1, ceil(a.source_size / {mixing.SHARD})::bigint) as shard
            from sized s join aimed a on s.source is not distinct from a.source
        ), streams as (
            select source_no, shard, sum(size)::bigint as words, ceil(sum(size) / {mixing.BLOCK})::bigint as blocks
            from placed group by source_no, shard
        ), won as (
            select source_no, shard, blocks, count(*) as seats from (
                select *, row_number() over (partition by source_no order by words / (2 * k - 1) desc, shard) as n
                from (select *, unnest(range(1, 2 * blocks + 1)) as k from streams join source_seats using (source_no) where words > 0)
            ) where n <= quota group by source_no, shard, blocks
        ), runs as (
            select source_no, shard, blocks, seats // blocks as rounds, seats % blocks as more,
                ('0x' || substr(md5('2024:' || source_no || ':' || shard), 1, 15))::bigint % blocks as begin
            from won
        ), located as (
            select *, sum(size) over (partition by source_no, shard order by place, doc_id, size rows unbounded preceding) - size as low
            from placed
        )
        select doc_id, size, source_size, target, coalesce(rounds * size
            + greatest(0, least(low + size, least(begin + more, blocks) * {mixing.BLOCK}) - greatest(low, begin * {mixing.BLOCK}))
            + greatest(0, least(low + size, (begin + more - blocks) * {mixing.BLOCK}) - low), 0)::bigint as taken, source, shard
        from located left join runs using (source_no, shard)
    """,
}
