"""Queries of the training-data operators over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, langid, mixing, neardup, packing, pii, quality, tokencount, topk, urlfilter, warc, whitening
from .common import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = langid.fit(docs.filter(~held_out))
    out = langid.predict(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "family")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number its path holds; that document's label is the page's."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = F.regexp_extract(urlfilter.path(F.col("url")), r"/(\d{1,18})(?:[/.]|$)", 1)
    bad = labels.select(F.col("doc_id").alias("__doc"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.select("url", shown.try_cast("long").alias("__doc")).join(bad, "__doc").select("url", "bad")
    return urlfilter.judge(pages, urlfilter.mine(labelled))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    rows = stored(whitening.apply(vectors, model))
    k = len(model.values)
    explained = F.array(*[F.lit(v) for v in model.explained]).cast("array<double>")
    told = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    error = whitening.identity_error(rows, k)
    return told.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codes.compress(table(spark, sf_dir, "embeddings"), ["vec_id", "label"])
    told = codes.with_label_error(rows)
    return told.select("vec_id", codes.hex_code().alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"])
    told = bpe.decode(encoded, ["doc_id", "n_tokens"])
    return told.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_language_id, op3_warc, op4_quality_rules, op5_mixing, op6_packing, op7_pii, op8_topk, op9_url_filters, op10_near_dedup, op11_whitening, op12_vector_codes, op13_byte_bpe, pipeline)
}

def _codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds, each a pair of steps: every part to its nearest entry, every entry to its floored mean."""
    steps = ["""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
                   list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT r, q, e[q * (len(e) // 4) + 1 : (q + 1) * (len(e) // 4)] AS part FROM v, range(4) t(q)),
        b0 AS MATERIALIZED (SELECT q, r - 1 AS j, part AS entry FROM p WHERE r <= 256)"""]
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (SELECT r, q, min(d * 256 + j) % 256 AS j, min(d) AS d FROM (
            SELECT p.r, p.q, b.j, list_sum(list_transform(list_zip(p.part, b.entry), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d
            FROM p JOIN b{k} b ON p.q = b.q) GROUP BY r, q)""")
        if k < rounds:
            steps.append(f"""
        m{k} AS MATERIALIZED (SELECT q, j, list(m ORDER BY i) AS entry FROM (
            SELECT q, j, i, floor_div(sum(x), count(*)) AS m
            FROM (SELECT a.q, a.j, generate_subscripts(p.part, 1) AS i, unnest(p.part) AS x FROM a{k} a JOIN p ON a.r = p.r AND a.q = p.q) GROUP BY q, j, i) GROUP BY q, j),
        b{k + 1} AS MATERIALIZED (SELECT b.q, b.j, coalesce(m.entry, b.entry) AS entry FROM b{k} b LEFT JOIN m{k} m ON b.q = m.q AND b.j = m.j)""".replace("floor_div(sum(x), count(*))", "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"))
    steps.append(f"""
        s AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY q, j)) AS codebooks_sha256 FROM b{rounds}),
        c AS (SELECT r, string_agg(lower(printf('%02x', j::INTEGER)), '' ORDER BY q) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)""")
    return ",".join(steps) + """
        SELECT v.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, s.codebooks_sha256 FROM v JOIN c USING (r), s"""


ORACLES: dict[str, str] = {
    "op12_vector_codes": _codes_sql(),
    "op3_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM h WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT h.page_id, h.payload_bytes, h.payload_digest,
               CASE WHEN f.first <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> h.page_id THEN f.first END AS refers_to
        FROM h LEFT JOIN f USING (payload_digest)""",
    "op5_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                     CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS mark FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size,
                     [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
              FROM d GROUP BY source),
        r AS (SELECT *, 2.0::DOUBLE * source_size AS lim, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s),
        c AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_before,
                     (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS w_rest,
                     (sum(source_size) OVER ())::DOUBLE AS total FROM r),
        l AS (SELECT (1.5::DOUBLE * total - full_before) / w_rest AS level FROM c
              WHERE (1.5::DOUBLE * total - full_before) / w_rest * w <= lim ORDER BY k LIMIT 1),
        t AS (SELECT source, source_size, least(w * level, lim) AS target FROM c, l),
        q AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
                     ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, d.mark)), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS drawn
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM q""",
    "op8_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
        SELECT * FROM r WHERE rank <= 5""",
    "op10_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
        x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb
              FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p WHERE 100 * m >= 85 * (na + nb - m)),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT DISTINCT a AS doc_id, a AS reach FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reach = u.a),
        c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
        SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
               s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
        FROM s LEFT JOIN c USING (doc_id)""",
}
