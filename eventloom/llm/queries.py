"""The operators applied to whole tables, one query each, and their DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op8_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.exact_dedup import exact_classes

    return exact_classes(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.packing import pack

    pieces = pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.common import held_out
    from eventloom.llm.toxicity import FOLDS, predicted, score, train

    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))


@query("op7_minhash_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
s AS MATERIALIZED (SELECT doc_id, unnest(g) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.g) + len(y.g) - c)),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n, c) AS (SELECT doc_id, doc_id FROM g UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.n)
SELECT doc_id, len(g)::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM g JOIN r ON r.n = doc_id GROUP BY doc_id, g""")
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.minhash import near_classes

    return near_classes(documents(spark, sf_dir))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.sharding import shard

    plan = shard(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_vector_dedup", r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS MATERIALIZED (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n)
SELECT d.vec_id, (SELECT count(*) FROM e WHERE e.a = d.vec_id) AS n_links, min(r.c) AS component_id, d.vec_id = min(r.c) AS kept
FROM embeddings d JOIN r ON r.n = d.vec_id GROUP BY d.vec_id""")
def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.vector_dedup import vector_classes

    return vector_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op9_context_tree")
def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.common import held_out
    from eventloom.llm.ctw import FOLDS, score_texts

    out = score_texts(documents(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.license_scan import scan

    return scan(documents(spark, sf_dir)).drop("places")


@query("op2_token_file")
def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.token_file import read_tokens, write_tokens
    from eventloom.session import scratch_path

    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, scratch_path(spark, "plain"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: crc32 in SQL: the table of the reflected polynomial, then one list reduction over the bytes of a text.
CRC_TABLE = """z(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM z WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM z WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, with ``crc`` of ``CRC_TABLE`` in the FROM clause."""
    octets = f"list_transform(range(1, 2 * strlen({text}) + 1, 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295)"


def words_sql(table: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"(SELECT *, row_number() OVER () AS r, list_filter(string_split_regex({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {table})"


@query("op11_resampling", rf"""
WITH RECURSIVE {CRC_TABLE},
d AS MATERIALIZED {words_sql("documents")}, b AS MATERIALIZED {words_sql("benchmark")},
x AS MATERIALIZED (SELECT r, unnest(w) AS w FROM d), y AS (SELECT unnest(w) AS w FROM b),
v AS MATERIALIZED (SELECT w, {crc32_sql("w")} % 10000 AS k FROM (SELECT w FROM x UNION SELECT w FROM y), crc),
s AS (SELECT k, count(*) AS n FROM x JOIN v USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM y JOIN v USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s) + 10000.0::DOUBLE) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM t) + 10000.0::DOUBLE))))::BIGINT AS g FROM s LEFT JOIN t USING (k)),
m AS (SELECT r, count(*) AS n, sum(g)::DOUBLE AS g FROM x JOIN v USING (w) JOIN g USING (k) GROUP BY r),
u AS (SELECT doc_id, len(w) AS n, coalesce(floor(m.g / m.n), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
c AS MATERIALIZED (SELECT doc_id, n::BIGINT AS n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM u),
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= 20)
SELECT c.*, CASE WHEN rank <= 10 * (SELECT count(*) FROM e) // 100 THEN rank END AS rank FROM c LEFT JOIN e USING (doc_id)""")
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.resampling import draw

    return draw(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op12_spelling_variants", rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
a AS MATERIALIZED (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT w, n, {crc32_sql("(doc_id || ':' || w)")} AS h FROM a, crc),
c AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS w, sum(n)::BIGINT AS n FROM h GROUP BY 1),
v AS MATERIALIZED (SELECT w, n FROM c WHERE n >= 3 AND length(w) >= 5),
k AS MATERIALIZED (SELECT w, n, i, left(w, i - 1) AS p, substr(w, i + 1) AS s FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v)),
e AS MATERIALIZED (SELECT x.w AS a, y.w AS b, y.n AS n FROM k x JOIN k y ON x.p = y.p AND x.s = y.s AND x.w <> y.w
  UNION SELECT k.w, v.w, v.n FROM k JOIN v ON v.w = p || s UNION SELECT v.w, k.w, k.n FROM k JOIN v ON v.w = p || s),
m AS (SELECT a, count(*) AS n_near, max(n) AS top FROM e GROUP BY a),
f AS MATERIALIZED (SELECT v.w, v.n, n_near, min(e.b) FILTER (e.n = top AND top >= 2 * v.n) AS form, max(top) FILTER (top >= 2 * v.n) AS form_n
  FROM v LEFT JOIN m ON m.a = v.w LEFT JOIN e ON e.a = v.w GROUP BY ALL),
r(w, root) AS (SELECT w, w FROM f WHERE form IS NULL UNION ALL SELECT f.w, r.root FROM r JOIN f ON f.form = r.w)
SELECT f.w AS word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM f JOIN r USING (w)""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.spelling import variants

    return variants(documents(spark, sf_dir))


@query("op13_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html)::BIGINT AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS o FROM p)
SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (5 * (7 - i % 8))::BIGINT) & 31) + 1), 1)), 'string_agg', '') AS payload_digest,
CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to FROM s""")
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventloom.llm.warc import read_records, write_archive
    from eventloom.session import scratch_path

    path = scratch_path(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.col(c).cast("bigint").alias(c)
    return read_records(spark, path).select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))
