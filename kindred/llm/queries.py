"""Driver queries opN_<name> and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embdedup, langid, packing, simhash, suffix, urlfilter, warc, wordpiece
from .storage import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urlfilter.judge_urls(pages.drop("html"), urlfilter.html_links(pages), urlfilter.RULES, Scratch(spark))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, Scratch(spark))


def word_bpe() -> str:
    """Place of the word-level tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), word_bpe())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), word_bpe())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"))
    found = langid.identify(docs, langid.learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = scratch.path("archive")
    warc.write_warc(table(spark, sf_dir, "pages"), path, scratch)
    records = warc.read_warc(spark, path)
    whole = F.col("record_type") == "response"
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def warc_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of records under https: the reader's predicates are on type and target, and every payload is passed over."""
    scratch = Scratch(spark)
    path = scratch.path("archive")
    warc.write_warc(table(spark, sf_dir, "pages"), path, scratch)
    records = warc.read_warc(spark, path, payload=False, types=["response", "revisit"], begins={"warc-target-uri": "https://"})
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "record_type",
        "payload_bytes",
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_spans(table(spark, sf_dir, "documents"), Scratch(spark))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe())


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "warc_headers": warc_headers,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
}

_OP1_RULES = """(VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')) r(rhost, rpath, action)"""

_OP1_LONGEST = f"""(SELECT {{column}} FROM {_OP1_RULES} WHERE (x.host = rhost OR ends_with(x.host, '.' || rhost)) AND starts_with(x.path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1)"""


def _split(url: str) -> str:
    """host and path of a URL column, as DuckDB SQL select items."""
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    return f"""translate(regexp_extract({rest}, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1, 's') AS path,
        regexp_extract({rest}, '^[^/?#]*([^#]*)', 1, 's') AS tail"""


ORACLE_SQL = {
    "op1_url_filters": f"""
WITH RECURSIVE x AS (SELECT page_id, url, html, {_split("coalesce(url, '')")} FROM pages),
n AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN translate(split_part(url, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || host || CASE WHEN tail = '' THEN '/' ELSE tail END END AS node,
  {_OP1_LONGEST.format(column="rhost || rpath")} AS rule, {_OP1_LONGEST.format(column="action")} AS act FROM x),
l AS (SELECT node AS src, url, unnest([
    regexp_extract(regexp_extract(html, '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is'), '\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is'),
    regexp_extract(regexp_extract(html, '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is'), 'url\\s*=\\s*["'']?([^"''>]*)', 1, 'is')]) AS dst, host FROM n WHERE node IS NOT NULL),
a AS (SELECT src, CASE WHEN instr(dst, '://') > 0 THEN dst WHEN starts_with(dst, '//') THEN split_part(url, '://', 1) || ':' || dst
    WHEN starts_with(dst, '/') THEN split_part(url, '://', 1) || '://' || host || dst END AS dst FROM l WHERE dst <> ''),
b AS (SELECT src, dst AS durl, {_split("dst")} FROM a WHERE dst IS NOT NULL),
e AS (SELECT src, translate(split_part(durl, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || host || CASE WHEN tail = '' THEN '/' ELSE tail END AS dst FROM b),
s AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
reach AS (SELECT src AS node, src AS other FROM s UNION SELECT reach.node, s.dst FROM reach JOIN s ON reach.other = s.src),
x2 AS (SELECT node, other, {_split("other")} FROM reach),
k AS (SELECT node, min(other) AS alias_of, bool_or(act = 'block') AS blocked, bool_or(act = 'allow') AS allowed
  FROM (SELECT x.node, x.other, {_OP1_LONGEST.format(column="action")} AS act FROM x2 x) GROUP BY node)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict, alias_of
FROM n LEFT JOIN k USING (node)""",
    "op8_warc": """
WITH x AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM x WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, x.digest AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM x LEFT JOIN f ON x.digest = f.digest AND x.n >= 100""",
    "warc_headers": """
WITH x AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM x WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, x.digest AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM x LEFT JOIN f ON x.digest = f.digest AND x.n >= 100 WHERE starts_with(url, 'https://')""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS least FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS links FROM p GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
}
