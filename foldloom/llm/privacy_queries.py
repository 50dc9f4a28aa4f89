"""The registered query on personal data and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm import privacy

# The plain patterns; the operator's own are forms of them that match the same in linear time.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that disclose it."""
    found = privacy.find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    counts = [count(n).alias(f"n_{kind}") for n, kind in enumerate(privacy.PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(privacy.written(F.col("base")), 256).alias("base_sha256"), privacy.written(privacy.all_spans()).alias("spans"))


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = (f"list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT) "
         f"ELSE (2 * CAST(reverse({_DIGITS})[i] AS INT)) % 10 + (2 * CAST(reverse({_DIGITS})[i] AS INT)) // 10 END)) % 10 = 0")
_VALID = {"email": "true", "ip": "len(list_filter(string_split(v, '.'), lambda p: len(ltrim(p, '0')) > 3 OR try_cast(right(p, 3) AS INT) > 255)) = 0",
          "card": f"CASE WHEN len({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END", "phone": f"len({_DIGITS}) BETWEEN 10 AND 15"}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FORMS = {"email": _LOWER.format("v"), "ip": "v", "card": _DIGITS, "phone": _DIGITS}


def _kind_sql(number: int, kind: str) -> str:
    pattern = _PATTERNS[kind]
    return rf"""SELECT r, {number} AS k, '{kind}' AS kind, v, spot, CASE WHEN len(before) > {privacy.NEAR} THEN regexp_replace(right(before, {privacy.NEAR}), '^{privacy.WORD}', '') ELSE before END AS before,
  CASE WHEN len(after) > {privacy.NEAR} THEN regexp_replace(left(after, {privacy.NEAR}), '{privacy.WORD}$', '') ELSE after END AS after, '{kind}:' || {_FORMS[kind]} AS entity
FROM (SELECT r, ms[i] AS v, ps[i] AS before, ps[i + 1] AS after, CAST(sum(len(ps[i]) + len(ms[i])) OVER (PARTITION BY r ORDER BY i) AS BIGINT) - len(ms[i]) AS spot
      FROM (SELECT r, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d)))
WHERE {_VALID[kind]}"""


def _terms_sql(text: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all({_LOWER.format(text)}, '{privacy.WORD}'), lambda w: len(w) >= {privacy.LEAST_LENGTH}))"


OP11_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({" UNION ALL ".join(_kind_sql(n, kind) for n, kind in enumerate(_PATTERNS))}),
near AS (SELECT DISTINCT r, entity, unnest({_terms_sql("before || ' ' || after")}) AS term FROM base),
pairs AS (SELECT entity, term, count(*) AS n_te FROM near JOIN d USING (r) GROUP BY ALL HAVING count(*) >= {privacy.LEAST_ROWS} AND count(DISTINCT t) > 1),
entities AS (SELECT entity, count(DISTINCT r) AS n_e FROM base GROUP BY entity),
words AS MATERIALIZED (SELECT r, unnest({_terms_sql("t")}) AS term FROM d),
held AS (SELECT term, count(*) AS n_t FROM words WHERE term IN (SELECT term FROM pairs) GROUP BY term),
disclosed AS (SELECT DISTINCT term FROM pairs JOIN entities USING (entity) JOIN held USING (term), (SELECT count(*) AS n FROM d)
              WHERE n_e < n AND round(1 + ln(n_te / n_t) / ln(n / n_e), 9) >= {privacy.GENERALISE}),
places AS (SELECT r, w AS term, CAST(sum(len(g) + len(w)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) - len(w) AS spot
           FROM (SELECT r, i, ws[i] AS w, gs[i] AS g FROM (SELECT r, ws, gs, unnest(range(1, len(ws) + 1)) AS i FROM (
             SELECT r, regexp_extract_all({_LOWER.format("t")}, '{privacy.WORD}') AS ws, string_split_regex({_LOWER.format("t")}, '{privacy.WORD}') AS gs
             FROM d WHERE r IN (SELECT r FROM words JOIN disclosed USING (term)))))),
found AS (SELECT r, {len(_PATTERNS)} AS k, 'term' AS kind, spot, spot + len(term) AS until FROM places p JOIN disclosed USING (term)
          WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = p.r AND b.spot < p.spot + len(p.term) AND p.spot < b.spot + len(b.v))),
every AS (SELECT r, k, kind, spot, spot + len(v) AS until FROM base UNION ALL SELECT * FROM found),
joined AS (SELECT r, {", ".join(f"count(*) FILTER (k = {n}) AS n_{kind}" for n, kind in enumerate(_PATTERNS))},
                  coalesce(string_agg(kind || ':' || spot || ':' || until, ',' ORDER BY spot, k) FILTER (k < {len(_PATTERNS)}), '') AS base,
                  string_agg(kind || ':' || spot || ':' || until, ',' ORDER BY spot, k) AS spans FROM every GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (r)"""

QUERIES = {"op11_pii": (op11_pii, OP11_SQL)}
