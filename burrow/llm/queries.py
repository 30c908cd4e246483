"""The queries of this subpackage: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from burrow.llm import line_dedup, media, mincut, mixing, packing, simhash, topk, toxicity, training_order, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products for every 50th vector, against all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL["op5_exact_top_k"] = """
WITH usable AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
products AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])), 0) AS BIGINT) AS score, q.r
  FROM usable q JOIN usable x ON q.vec_id % 50 = 0 AND x.r <> q.r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM products)
WHERE rank <= 5
"""


@query
def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: 4-word shingles, links at 4 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_min_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return mincut.extract(table(spark, sf_dir, "pages"))


def held_out() -> Column:
    """The fifth of the documents whose labels are never learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, with the lexicon learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit WAVE, sniffed against a wrong declared type, and read back."""
    stored = media.store_texts(table(spark, sf_dir, "documents")).withColumn("declared", F.lit("application/octet-stream"))
    return media.read_back(media.sniff_media(stored, declared_col="declared"))


@query
def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shuffled sequences of 1024 tokens in fixed-stride shards, read back from the files."""
    folder, count = training_order.materialise(table(spark, sf_dir, "documents"), tokenizer_path())
    if not count:
        return spark.createDataFrame([], "slot long, shard long, offset long, n_bytes long, crc32 long")
    return training_order.read_shards(spark, folder, with_ids=False)


URL_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page, by the rules and over redirects and canonical links."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


ORACLE_SQL["op1_url_filter"] = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rows AS (
  SELECT *, CASE WHEN contains(url, '://') THEN host || CASE WHEN path = '' THEN '/' ELSE path END
                 || regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) END AS node
  FROM parts),
links AS (
  SELECT url AS a, unnest([regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
                           regexp_extract(html, '(?is)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*?\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS b
  FROM pages),
edges AS (SELECT r.node AS a, r2.node AS b FROM links l JOIN rows r ON l.a = r.url JOIN rows r2 ON l.b = r2.url WHERE l.b <> ''),
reach AS (
  SELECT node AS a, node AS b FROM rows
  UNION SELECT reach.a, e.b FROM reach JOIN (SELECT a, b FROM edges UNION SELECT b, a FROM edges) e ON reach.b = e.a),
rules(verdict, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
own AS (
  SELECT r.page_id, r.url, r.host, r.path, r.node,
         arg_max(u.host || u.path, length(u.host || u.path)) AS rule, arg_max(u.verdict, length(u.host || u.path)) AS own
  FROM rows r LEFT JOIN rules u ON ends_with('.' || r.host, '.' || u.host) AND starts_with(r.path, u.path)
  GROUP BY ALL),
spread AS (
  SELECT reach.a AS node, min(o.own) AS spread, min(reach.b) AS component FROM reach LEFT JOIN own o ON o.node = reach.b GROUP BY reach.a)
SELECT o.page_id, o.url, o.host, o.path, o.rule, coalesce(o.own, s.spread, 'allow') AS verdict, coalesce(s.component, o.node) AS component
FROM own o LEFT JOIN spread s ON o.node = s.node
"""


@query
def url_filter_linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of all pages when they are linked: canonical links to the page before, absolute or from the root, refreshes
    that make chains, and redirects of a quarter of the pages to page 1, a hub."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    target = F.when(F.col("page_id") % 4 == 0, F.floor(F.col("page_id") / 2)).when(F.col("page_id") % 4 == 1, F.lit(1)).when(F.col("page_id") % 4 == 3, F.col("page_id") - 1)
    linked = pages.withColumn("target", target.cast("long")).join(pages.select(F.col("page_id").alias("target"), F.col("url").alias("to_url")), "target", "left")
    href = F.regexp_replace("to_url", F.lit("&"), F.lit("&#38;"))
    kind = F.when(F.col("page_id") % 4 == 3, F.concat(F.lit('<link rel="alternate canonical" href="'), href, F.lit('">'))).when(
        F.col("page_id") % 4 == 0, F.concat(F.lit('<meta http-equiv=Refresh content="0; url='), href, F.lit('">'))
    )
    html = F.concat(F.lit('<html><!-- <link rel=canonical href="http://x.com/en/"> -->'), F.coalesce(kind, F.lit("")))
    redirects = linked.where("page_id % 4 = 1 AND to_url IS NOT NULL").select(F.col("url").alias("from_url"), "to_url")
    return url_filter.judge(linked.select("page_id", "url", html.alias("html")), URL_RULES, redirects=redirects).select("page_id", "rule", "verdict", "component")


ORACLE_SQL["url_filter_linked_pages"] = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rows AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1) AS node,
         CASE page_id % 4 WHEN 0 THEN page_id // 2 WHEN 1 THEN 1 WHEN 3 THEN page_id - 1 END AS target
  FROM parts),
edges AS (SELECT a.node AS a, b.node AS b FROM rows a JOIN rows b ON a.target = b.page_id),
ties AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT DISTINCT node AS a, node AS b FROM rows UNION SELECT reach.a, ties.b FROM reach JOIN ties ON reach.b = ties.a),
rules(verdict, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
own AS (
  SELECT r.page_id, r.node, arg_max(u.host || u.path, length(u.host || u.path)) AS rule, arg_max(u.verdict, length(u.host || u.path)) AS own
  FROM rows r LEFT JOIN rules u ON ends_with('.' || r.host, '.' || u.host) AND starts_with(r.path, u.path)
  GROUP BY ALL),
spread AS (SELECT reach.a AS node, min(o.own) AS spread, min(reach.b) AS component FROM reach LEFT JOIN own o ON o.node = reach.b GROUP BY reach.a)
SELECT o.page_id, o.rule, coalesce(o.own, s.spread, 'allow') AS verdict, s.component
FROM own o JOIN spread s ON o.node = s.node
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later copies of runs of lines of 50 words or more."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that no source is repeated more than twice and none is used less than once."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "epoch", "turn")


ORACLE_SQL["op6_source_mixing"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s, md5(coalesce(text, '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens
  FROM documents),
totals AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY s),
ends AS (SELECT CAST(max(tokens) AS DOUBLE) AS top, CAST(max(tokens) AS DOUBLE) / min(tokens) AS ratio FROM totals WHERE tokens > 0),
search(turn, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT turn + 1, low + (high - low) * greatest(hit - 1, 0) / 64, low + (high - low) * hit / 64
  FROM (SELECT turn, low, high,
               coalesce(list_min(list_filter(range(65), lambda i: pow(ratio, 1 - (low + (high - low) * i / 64)) <= 2.0)), 64) AS hit
        FROM search, ends WHERE turn < 4)),
planned AS (
  SELECT s, tokens, CAST(floor(CASE WHEN tokens > 0 THEN round(pow(top / tokens, 1 - high), 9) ELSE 1.0 END * tokens) AS BIGINT) AS budget
  FROM totals, ends, search WHERE turn = 4),
used AS (
  SELECT s, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs,
         budget - (CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END) * tokens AS rest
  FROM planned),
whole AS (SELECT d.doc_id, d.source, d.s, d.h, unnest(range(u.epochs)) AS epoch FROM docs d JOIN used u USING (s)),
part AS (
  SELECT doc_id, source, s, h, epochs AS epoch
  FROM (SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY md5(concat_ws('|', '1', s, epochs, doc_id, h))) - tokens AS before
        FROM docs JOIN used USING (s) WHERE rest > 0)
  WHERE before < rest)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, md5(concat_ws('|', '1', s, epoch, doc_id, h)) AS turn
FROM (SELECT * FROM whole UNION ALL SELECT * FROM part)
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other, over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
