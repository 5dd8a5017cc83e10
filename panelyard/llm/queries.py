"""Registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import centroids, chat, decontaminate, jaccard_forest, languages, lengths, media, mixing, quality, shards, toxicity, urls, whitening
from panelyard.llm.tables import table

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
PROBE = "</s>[INST] ok [/INST]"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the class of near copies and the number of links."""
    found = jaccard_forest.similar_texts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copy_id", "copies", F.col("links").alias("n_links"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    placed = shards.shard_documents(table(spark, sf_dir, "documents"), 16, whole=False)
    return placed.select(
        F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"), F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), whole=False)
    return scored.select(
        F.col("_doc").alias("doc_id"), quality.held_out(F.col("_doc")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted windows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE).alias("text")) for k, role in enumerate(("user", "assistant"))]
    extra = spark.range(1).select(F.explode(F.array(*probe)).alias("r")).select("r.*")
    return chat.digests(chat.format_windows(turns.unionByName(extra)))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages"), RULES, urls.fit(urls.labelled_urls(spark)))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified overlaps of documents with benchmark items."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths per source with its suffix sums."""
    return lengths.length_table(table(spark, sf_dir, "documents")).withColumn("share_upto", F.round("share_upto", 9))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = languages.identify(docs, languages.fit(docs))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    plan = mixing.mix(table(spark, sf_dir, "documents"), whole=False)
    taken = F.col("_times") * F.col("_size") + F.col("_part")
    return plan.select(
        F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.round("_target", 6).alias("target"), taken.cast("long").alias("taken")
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every text stored as a picture and read back."""
    found = media.text_features(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", F.col("samples").alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("dhash").alias("feature"),
        F.crc32("tile").alias("tile_crc32"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four whitened coordinates of every usable embedding."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, whole=False)
    each = white.select("*", F.posexplode(F.arrays_zip("_z", "_explained")).alias("_at", "_part"))
    return each.select(
        F.col("_id").alias("vec_id"), (F.col("_at") + 1).cast("int").alias("component"), F.col("_n").alias("n"), F.expr("try_cast(_deviation AS bigint)").alias("deviation"),
        F.col("_part._z").alias("whitened"), F.col("_part._explained").alias("explained"), F.col("_identity_error").alias("identity_error"),
    )


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every usable embedding after five rounds from 40 hashed starts."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), whole=False)
    return found.select(
        F.col("_id").alias("vec_id"), F.col("_cluster").alias("cluster"), F.expr("try_cast(_distance AS bigint)").alias("distance"),
        F.expr("try_cast(_cluster_inertia AS bigint)").alias("cluster_inertia"), F.expr("try_cast(_inertia AS bigint)").alias("inertia"),
        F.col("_centroid_sha256").alias("centroid_sha256"),
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and its worst sentence."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), whole=False)
    worst = F.get("_offending", F.lit(0))
    return scored.select(
        F.col("_doc").alias("doc_id"), quality.held_out(F.col("_doc")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.col("_sentences").alias("sentences"),
        F.size("_offending").alias("offending"), worst["start"].alias("worst_start"), worst["end"].alias("worst_end"), worst["score"].alias("worst_score"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_sharding, op3_quality_classifier, op4_chat_formatting, op5_url_filters, op6_benchmark_decontamination, op7_token_counts,
        op8_language_id, op9_source_mixing, op10_media_columns, op11_embedding_whitening, op12_centroid_clustering, op13_toxicity, pipeline,
    )
}

SQL: dict[str, str] = {}

SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS body, min(doc_id) AS copy_id, count(*) AS copies, row_number() OVER (ORDER BY md5(coalesce(text, ''))) AS t
  FROM documents GROUP BY coalesce(text, '')
), worded AS (
  SELECT t, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts
), grams AS (
  SELECT t, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM worded
), sizes AS (SELECT t, count(*) AS n FROM grams GROUP BY t
), common AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.t <> b.t GROUP BY a.t, b.t
), near AS (
  SELECT a, b FROM common JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
), reach AS (
  SELECT t AS a, t AS b FROM texts UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b
), classes AS (SELECT reach.a AS t, min(copy_id) AS class_id FROM reach JOIN texts ON texts.t = reach.b GROUP BY reach.a
), links AS (SELECT near.a AS t, sum(copies) AS n FROM near JOIN texts ON texts.t = near.b GROUP BY near.a)
SELECT d.doc_id, c.class_id, x.copy_id, x.copies, CAST(x.copies - 1 + coalesce(l.n, 0) AS BIGINT) AS n_links
FROM documents d JOIN texts x ON x.body = coalesce(d.text, '') JOIN classes c ON c.t = x.t LEFT JOIN links l ON l.t = x.t
"""

SQL["op9_source_mixing"] = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS spot FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size) AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM sizes GROUP BY source
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM sources WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), open AS (SELECT level FROM levels WHERE level * w < cap ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST LIMIT 1
), targets AS (SELECT source, source_size, CAST(least(cap, coalesce((SELECT level FROM open) * w, cap)) AS DOUBLE) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY source ORDER BY spot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes JOIN targets USING (source)
), cut AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
  CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken FROM cut
"""


def lloyd_sql(clusters: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    """Lloyd's rounds written out, one pair of steps per round; all sums and products stay below 2^53."""
    parts = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda e: isfinite(e))) = {dims}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (
    SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, x FROM kept ORDER BY h, x LIMIT {clusters}) AS first
)"""
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
  SELECT r, min(CAST(list_inner_product(k.x, k.x) - 2 * list_inner_product(k.x, c.x) + list_inner_product(c.x, c.x) AS HUGEINT) * {clusters} + c.c) AS m
  FROM kept k CROSS JOIN c{k} c GROUP BY r
)""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT c, list(v ORDER BY i) AS x FROM (
      SELECT m % {clusters} AS c, i, floor(sum(x[i]) / count(*)) AS v FROM a{k} JOIN kept USING (r), range(1, {dims + 1}) AS t(i) GROUP BY ALL) AS means GROUP BY c
  ) n ON n.c = c.c
)""")
    last = f"""SELECT vec_id, CAST(m % {clusters} AS INTEGER) AS cluster, CAST(m // {clusters} AS BIGINT) AS distance,
  CAST(sum(m // {clusters}) OVER (PARTITION BY m % {clusters}) AS BIGINT) AS cluster_inertia, CAST(sum(m // {clusters}) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c ON c.c = m % {clusters}"""
    return ", ".join(parts) + "\n" + last


SQL["op12_centroid_clustering"] = lloyd_sql()
