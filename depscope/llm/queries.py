"""The registered queries of the numbered operators, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.llm import balltree, decontam, exact, langid, near, packing, pii, quality, rangecode, repeats, runs, secretscan, spherical
from depscope.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.fit(docs, ~held_out)
    found = langid.predict(docs, model)
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "rejected",
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_columns(pii.find_personal_data(table(spark, sf_dir, "documents")), pii.KINDS[:4])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, quality.label_grade(), 3)
    return quality.predict(docs, model).select(F.col("id").alias("doc_id"), "expected_grade", "tail", (F.col("tail") >= quality.MIN_TAIL).alias("kept"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_columns(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.class_columns(near.near_duplicates(table(spark, sf_dir, "documents")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(table(spark, sf_dir, "documents"), keep="max")
    return found.withColumnRenamed("id", "doc_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hit_columns(decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_columns(secretscan.find_secrets(table(spark, sf_dir, "documents")), secretscan.BASE)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangecode.id_columns(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs in which texts with a tenth of the ids go on with a period of their own, as the contract of op12 asks."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.when(F.size("w") > 0, F.size("w")))  # null: the text stays
    rows = rows.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    return rows.select("doc_id", F.coalesce(F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " "), "text").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_columns(runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.link_columns(spherical.near_vectors(table(spark, sf_dir, "embeddings")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_pii,
        op3_quality,
        op4_substring_dedup,
        op5_near_dedup,
        op6_exact_dedup,
        op7_decontamination,
        op8_secret_scan,
        op9_token_ids,
        op10_packing,
        op11_centroid_clustering,
        op12_periodic_runs,
        op13_embedding_dedup,
    )
}

def _kmeans_sql(rounds: int = 5) -> str:
    """The rounds of op11 one after the other, over (vector, place, component) rows."""
    parts = [
        """k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "v AS MATERIALIZED (SELECT r, vec_id, unnest(range(64)) AS d, CAST(floor(256 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM k)",
        "first AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c FROM k ORDER BY c LIMIT 40)",
        "c0 AS MATERIALIZED (SELECT c, d, x FROM first JOIN v USING (r))",
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT r, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (
  SELECT v.r, m.c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS dist FROM v JOIN c{k} m ON m.d = v.d GROUP BY v.r, m.c) GROUP BY r)""")
        if k < rounds:
            parts.append(f"""s{k} AS (SELECT a.c, v.d, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM a{k} a JOIN v ON v.r = a.r GROUP BY a.c, v.d)""")
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT m.c, m.d, CASE WHEN n IS NULL THEN m.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} m LEFT JOIN s{k} s ON s.c = m.c AND s.d = m.d)""")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY c)")
    return f"""WITH {', '.join(parts)}
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, a.dist AS distance, CAST(sum(a.dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.dist) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256
FROM a{rounds} a JOIN k USING (r) JOIN h ON h.c = a.c"""


ORACLES = {
    "op11_centroid_clustering": _kmeans_sql(),
    "op13_embedding_dedup": """
WITH RECURSIVE k AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), c(a, b) AS (
  SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(lo, vec_id)) AS component_id, least(vec_id, coalesce(lo, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a AS i, count(*) AS n FROM e GROUP BY a) ON i = vec_id LEFT JOIN (SELECT a AS j, min(b) AS lo FROM c GROUP BY a) ON j = vec_id
""",
    "op6_exact_dedup": """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
""",
    "op4_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM w WHERE len(words) >= 20
), k AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(words[p:p + 19], ' ') ORDER BY doc_id, p) > 1 AS later FROM s
), gone AS (
  SELECT doc_id, list(DISTINCT p + o) AS gone
  FROM k, (SELECT unnest(range(20)) AS o) WHERE later GROUP BY doc_id
), r AS (
  SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
)
SELECT doc_id,
       CAST(len(words) AS BIGINT) AS n_words,
       CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM r
""",
    "op7_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[p:p + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 8, 2))) AS p FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, p, array_to_string(words[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS p FROM d, sizes WHERE len(words) >= n)
), hits AS (
  SELECT doc_id, p, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), hw AS (
  SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM (SELECT doc_id, p, unnest(range(n)) AS o FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
""",
}
