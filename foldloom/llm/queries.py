"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm import (bpe, decontamination, embedding_dedup, language_id, license_scan, line_dedup, packing, privacy_queries, secret_scan, simhash_dedup,
                          url_reputation, vector_queries)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id"])
    return bpe.decode(ids, VOCABULARY).select(
        "doc_id", F.floor(F.length("token_ids") / 4).alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 2,048 ids with all documents' tokens, in 16-bit numbers."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id"], library=True)
    return packing.pack(ids)


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by rule or reputation. A page shows the document that its path ends with; that document's labels are its outcome."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(url_reputation.url_path(F.col("url")), "^/[a-z]+/([0-9]{1,18})", 1).try_cast("long")
    judged = labels.groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    outcomes = pages.select("page_id", number.alias("doc_id")).join(judged, "doc_id").select("page_id", "bad")
    return url_reputation.filter_urls(pages, outcomes)


def _strength_sql(counts: str) -> str:
    rate = "(k / n)"
    excess = f"((spread - k * k / n) / ({rate} * (1 - {rate})) - (g - 1))"
    room = "(n - square / n - (g - 1))"
    return f"""(SELECT CASE WHEN g < 2 OR k = 0 OR k = n OR n * n <= square OR {room} <= 0 OR {excess} / {room} <= 0 THEN 1000.0
                     ELSE least(1000.0, greatest(1.0, 1 / ({excess} / {room}) - 1)) END AS a
               FROM (SELECT coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k, count(*) AS g, coalesce(sum(n::HUGEINT * n), 0)::DOUBLE AS square,
                            coalesce(sum((k::HUGEINT * k * 1000000) // n), 0)::DOUBLE / 1e6 AS spread FROM {counts} WHERE n > 0))"""


_RULES_SQL = " ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{verdict} {host}{path}'"
    for verdict, host, path in (("block", "example.org", "/en/1"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"),
                                ("block", "com", "/de/"), ("allow", "org", "/")))

OP3_SQL = rf"""
WITH judged AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NULL OR quality IS NULL THEN NULL ELSE 0 END) AS bad
                FROM labels GROUP BY doc_id),
p AS (SELECT page_id, {LOWER_SQL.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
known AS (SELECT page_id, max(bad) AS bad FROM p JOIN judged ON doc_id = try_cast(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1) AS BIGINT)
          WHERE bad IS NOT NULL GROUP BY page_id),
hosts AS (SELECT host, count(bad)::BIGINT AS n, count(CASE WHEN bad = 1 THEN 1 END)::BIGINT AS k,
                 CASE WHEN two IN {url_reputation.SUFFIXES} THEN two ELSE string_split(host, '.')[-1] END AS suffix,
                 CASE WHEN two IN {url_reputation.SUFFIXES} THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain
          FROM (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM p) LEFT JOIN known USING (page_id) GROUP BY host, two),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY ALL),
a AS (SELECT h.a AS ah, d.a AS ad, s.a AS s_a FROM {_strength_sql('hosts')} h, {_strength_sql('domains')} d, {_strength_sql('suffixes')} s),
top AS (SELECT (coalesce(sum(k), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS rate FROM suffixes),
srate AS (SELECT suffix, (k + s_a * rate) / (n + s_a) AS rate FROM suffixes, a, top),
drate AS (SELECT domain, d.suffix, (k + ad * s.rate) / (n + ad) AS rate FROM a, domains d JOIN srate s ON s.suffix = d.suffix),
hrate AS (SELECT host, n, (k + ah * d.rate) / (n + ah) AS rate, ah FROM a, hosts h JOIN drate d ON d.domain = h.domain AND d.suffix = h.suffix),
bounds AS (SELECT host, round(rate, 6) AS rate, round(rate - 1.645 * sqrt(rate * (1 - rate) / (n + ah + 1)), 6) AS bound FROM hrate),
ruled AS (SELECT page_id, host, path, CASE {_RULES_SQL} END AS found FROM p)
SELECT page_id, host, path, string_split(found, ' ')[2] AS rule,
       coalesce(string_split(found, ' ')[1], CASE WHEN bound >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, rate, bound
FROM ruled JOIN bounds USING (host)"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


_PHRASE_SQL = " UNION ALL ".join(
    f"SELECT row_id, i - 1 AS i, '{label}' AS label FROM (SELECT row_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) "
    f"WHERE w[i:i + {len(phrase.split()) - 1}] = {phrase.split()}" for phrase, label in license_scan.PHRASES.items())
_TEMPLATE_SQL = ", ".join(f"('{t.label}', {t.words}, {t.required}::VARCHAR[], {t.excluded}::VARCHAR[], {t.length}, {license_scan.need(t, 0.8)})"
                          for t in license_scan.prepared(license_scan.TEMPLATES))

OP4_SQL = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_id, {LOWER_SQL.format("coalesce(text, '')")} AS low FROM documents),
words AS (SELECT doc_id, row_id, regexp_extract_all(low, '{WORD}') AS w FROM docs),
places AS ({_PHRASE_SQL}),
base AS (SELECT row_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
         FROM places GROUP BY row_id),
blocks AS (SELECT row_id, list_distinct(regexp_extract_all(unnest(string_split(low, chr(10))), '{WORD}')) AS b FROM docs),
templates AS (SELECT * FROM (VALUES {_TEMPLATE_SQL}) v(label, t, required, excluded, length, need)),
lines AS (SELECT row_id, label, len(list_intersect(b, t)) / len(t) AS share FROM blocks, templates
          WHERE len(list_intersect(b, t)) >= need AND list_has_all(b, required) AND NOT list_has_any(b, excluded)),
near AS (SELECT row_id, w, templates.* FROM words, templates WHERE list_has_all(w, required) AND len(list_intersect(list_distinct(w), t)) >= need),
runs AS (SELECT row_id, label, len(list_intersect(list_distinct(w[i:i + length - 1]), t)) / len(t) AS share
         FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM near)
         WHERE list_contains(t, w[i]) AND len(list_intersect(list_distinct(w[i:i + length - 1]), t)) >= need
           AND list_has_all(w[i:i + length - 1], required) AND NOT list_has_any(w[greatest(i - 1, 1):i + length], excluded)),
met AS (SELECT * FROM lines UNION ALL SELECT * FROM runs),
labels AS (SELECT row_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
           FROM (SELECT row_id, label FROM met UNION ALL SELECT row_id, label FROM places) GROUP BY row_id),
best AS (SELECT row_id, max(share) AS share FROM met GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM words LEFT JOIN base USING (row_id) LEFT JOIN labels USING (row_id) LEFT JOIN best USING (row_id)"""


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM good UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
ids AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, CASE WHEN ids.a IS NULL THEN vec_id ELSE component_id END AS component_id,
       vec_id = CASE WHEN ids.a IS NULL THEN vec_id ELSE component_id END AS kept
FROM v LEFT JOIN ids ON ids.a = v.r LEFT JOIN n ON n.a = v.r"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate_by(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP6_SQL = rf"""
WITH words AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '{WORD}') AS w
               FROM documents),
items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER_SQL.format('text')}, '{WORD}') AS w
          FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
            FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT row_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
           FROM (SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                 FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
met AS (SELECT row_id, i, p.size, item FROM places p JOIN windows v ON p.win = v.win AND p.size = v.size),
hits AS (SELECT row_id, count(DISTINCT place) AS n_hit FROM (SELECT row_id, unnest(range(i, i + size)) AS place FROM met) GROUP BY row_id),
named AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT row_id, item FROM met WHERE item IS NOT NULL) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (row_id) LEFT JOIN named USING (row_id)"""


def held_out(key: str = "doc_id"):
    """Documents that no profile learns from: the remainder of their id's checksum is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def taught(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles of the documents whose id has a checksum with another remainder; documents without an id teach nothing."""
    return language_id.collect_profiles(language_id.learn_profiles(docs.where(F.col("doc_id").isNotNull() & ~held_out())))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, taught(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs)


OP8_SQL = r"""
WITH lines AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS raw, trim(string_split(text, chr(10))[i], E' \t\r\x0b\x0c') AS x
               FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
solid AS (SELECT doc_id, i, row_number() OVER w AS p, lead(i) OVER w AS i2, lead(i, 2) OVER w AS i3,
                 x || chr(10) || lead(x) OVER w || chr(10) || lead(x, 2) OVER w AS win
          FROM lines WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, i, i2, i3 FROM solid WHERE win IS NOT NULL QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1),
covered AS (SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM later),
kept AS (SELECT l.doc_id, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (c.i IS NULL), '') AS text, count(*) AS n_lines, count(c.i) AS n_removed
         FROM lines l LEFT JOIN covered c USING (doc_id, i) GROUP BY l.doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed FROM documents d LEFT JOIN kept k USING (doc_id)"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_byte_bpe": (op1_byte_bpe, None),
    "op2_token_packing": (op2_token_packing, None),
    "op3_url_reputation": (op3_url_reputation, OP3_SQL),
    "op4_license_scan": (op4_license_scan, OP4_SQL),
    "op5_embedding_dedup": (op5_embedding_dedup, OP5_SQL),
    "op6_benchmark_decontamination": (op6_benchmark_decontamination, OP6_SQL),
    "op7_language_id": (op7_language_id, None),
    "op8_line_dedup": (op8_line_dedup, OP8_SQL),
    "op9_secret_scan": (op9_secret_scan, None),
    "op10_simhash_dedup": (op10_simhash_dedup, None),
} | privacy_queries.QUERIES | vector_queries.QUERIES
