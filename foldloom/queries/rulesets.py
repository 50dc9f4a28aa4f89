"""The rule set on the given tables, with faults that the tables already hold or that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.functions.signal import is_finite
from foldloom.operators import profile, rules
from foldloom.plans.stage import stage
from foldloom.queries.views import VECTORS, prefixed, sql, table, vectors


def _faulty(spark, d):
    """Events with blank owners, labels outside the domain, wrong class names, owners and folders."""
    user, event = F.col("user_id"), F.col("event_id")
    label = F.when(F.col("event_type") == "purchase", F.lit("two")).when(F.col("event_type") == "error", "1").otherwise("0")
    name = F.when(F.col("event_type") == "error", "seizure").when(event % 97 == 0, "seizure").otherwise("nonseizure")
    case = F.when(user % 50 == 3, F.lit("  ")).otherwise(prefixed("u", user))
    path = F.concat_ws("/", F.when(event % 89 == 0, "elsewhere").otherwise(name), prefixed("u", user), event.cast("string"))
    stored = F.when(event % 83 == 0, "g0").otherwise(prefixed("g", F.floor(user / 2)))
    return table(spark, d, "events").select(
        event.alias("event_id"), label.alias("label"), name.alias("label_name"), case.alias("case_id"), path.alias("path"),
        stored.alias("group_id"), prefixed("g", F.floor(user / 2)).alias("mapped_group"))


FAULTY = """faulty AS (
  SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'two' WHEN 'error' THEN '1' ELSE '0' END AS label,
    CASE WHEN event_type = 'error' OR event_id % 97 = 0 THEN 'seizure' ELSE 'nonseizure' END AS label_name,
    CASE WHEN user_id % 50 = 3 THEN '  ' ELSE 'u' || user_id END AS case_id,
    CASE WHEN event_id % 83 = 0 THEN 'g0' ELSE 'g' || (user_id // 2) END AS group_id, 'g' || (user_id // 2) AS mapped_group
  FROM events),
v AS (
  SELECT 'blank_case_id' AS rule, event_id, case_id AS detail FROM faulty WHERE trim(case_id) = ''
  UNION ALL SELECT 'label_domain', event_id, label FROM faulty WHERE label NOT IN ('0', '1')
  UNION ALL SELECT 'label_name', event_id, label_name || ' <> ' || CASE label WHEN '1' THEN 'seizure' WHEN '0' THEN 'nonseizure' ELSE 'NULL' END
    FROM faulty WHERE label NOT IN ('0', '1') OR label_name <> CASE label WHEN '1' THEN 'seizure' ELSE 'nonseizure' END
  UNION ALL SELECT 'group_mapping', event_id, group_id || ' <> ' || mapped_group FROM faulty WHERE group_id <> mapped_group
  UNION ALL SELECT 'path_folders', event_id, CASE WHEN event_id % 89 = 0 THEN 'elsewhere' ELSE label_name END || '/u' || user_id || '/' || event_id
    FROM faulty WHERE event_id % 89 = 0 OR trim(case_id) = '')"""


def _found(spark, d):
    rows = _faulty(spark, d).withColumn("label_number", F.col("label").try_cast("int"))
    return rules.check_records(rows, [
        rules.not_blank("case_id"), rules.label_domain("label"), rules.label_name_agrees("label_number", "label_name"),
        rules.group_agrees(), rules.path_agrees("path", "case_id", "label_name")], "event_id")


def record_violations(spark, d):
    return _found(spark, d)


def violation_summary(spark, d):
    return rules.summarize_violations(_found(spark, d))


def duplicate_line_keys(spark, d):
    return rules.duplicate_ids(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def cross_group_texts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("group_id"),
                                               F.sha2("text", 256).alias("payload_hash"))
    return rules.cross_group_payloads(docs, "payload_hash")


def parts_of_several_suppliers(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("case_id"), F.col("l_suppkey").alias("group_id"))
    return rules.split_owner(lines)


def unexpected_counts(spark, d):
    labels = table(spark, d, "events").select((F.col("event_type") == "error").cast("int").alias("label"))
    return rules.counts_differ(labels, {"total": 1, "negative": 2, "positive": 3})


def label_disagreement(spark, d):
    """Quality labels against a label derived from the document itself."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 400).cast("int").alias("quality"))
    return rules.column_differs(docs, table(spark, d, "labels"), "doc_id", "quality", "payload_label")


def unlabelled_documents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id"))
    shifted = table(spark, d, "labels").select((F.col("doc_id") + 5).alias("doc_id"))
    return rules.key_sets_differ(docs, shifted, "doc_id", "manifest", "files", "manifest")


def _hashes(spark, d):
    """Stored hashes: as computed, exchanged between neighbouring documents, and edited."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("computed"))
    n = docs.agg(F.max("doc_id")).scalar()
    other = docs.select(F.col("doc_id").alias("other_id"), F.col("computed").alias("exchanged"))
    partner = F.when(F.col("doc_id") == n, F.lit(0)).otherwise(F.col("doc_id") + 1)
    return docs.join(other, partner == F.col("other_id")).withColumn(
        "edited", F.when(F.col("doc_id") % 10 == 0, F.sha2("computed", 256)).otherwise(F.col("computed")))


def hash_mismatch(spark, d):
    rows = stage(_hashes(spark, d))  # texts are hashed once for the three comparisons
    parts = [rules.classify_hash_mismatch(rows, stored, "computed").withColumn("stored", F.lit(stored))
             for stored in ("computed", "exchanged", "edited")]
    return rules.union_violations(parts)


HASH_MISMATCH_SQL = """
WITH h AS (
  SELECT a.doc_id, sha256(a.text) AS computed, sha256(b.text) AS exchanged,
    CASE WHEN a.doc_id % 10 = 0 THEN sha256(sha256(a.text)) ELSE sha256(a.text) END AS edited
  FROM documents a JOIN documents b ON b.doc_id = CASE WHEN a.doc_id = (SELECT max(doc_id) FROM documents) THEN 0 ELSE a.doc_id + 1 END),
u AS (
  SELECT count(*) AS n FROM (SELECT DISTINCT edited AS x FROM h) e FULL JOIN (SELECT DISTINCT computed AS y FROM h) c ON x = y
  WHERE x IS NULL OR y IS NULL)
SELECT 'computed' AS stored, 0::BIGINT AS n_mismatch, 0::BIGINT AS n_unmatched_hashes, 'match' AS status
UNION ALL SELECT 'exchanged', count(*) FILTER (exchanged <> computed), 0, 'misaligned' FROM h
UNION ALL SELECT 'edited', count(*) FILTER (edited <> computed), (SELECT n FROM u), 'changed' FROM h"""


def wrong_text_hashes(spark, d):
    rows = _hashes(spark, d).select(F.col("doc_id").alias("record_id"), F.upper("edited").alias("stored"), "computed")
    return rules.check_records(rows, [rules.hash_agrees("stored", "computed")])


def amplitude_warning(spark, d):
    stats = profile.amplitude_stats(profile.samples(vectors(spark, d), "signal"), "sample")
    return rules.implausible_amplitude(stats, 1e6)


def recording_sets(spark, d):
    rows = vectors(spark, d).select(
        "record_id", "set_id", F.sha2(F.array_join(F.col("signal").cast("array<string>"), ","), 256).alias("payload_hash"),
        F.size("signal").alias("length"), is_finite("signal").alias("finite"))
    return rules.recording_sets(rows, 100, "payload_hash", "length", "finite")


def signal_rules(spark, d):
    """Length, finite values and a declared setting of every embedding, none of which is broken, and one that is."""
    rows = vectors(spark, d).withColumn("fs", F.size("signal"))
    found = rules.check_records(rows, [rules.payload_length("signal", 64, 65), rules.finite_payload("signal"),
                                       rules.equals_constant("declared_fs", "fs", 256)])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "record_violations": (record_violations, sql(FAULTY, body="""
SELECT rule, 'error' AS severity, CAST(event_id AS VARCHAR) AS record_id, detail FROM v""")),
    "violation_summary": (violation_summary, sql(FAULTY, body="""
SELECT rule, 'error' AS severity, count(*) AS n_bad,
  array_to_string(list_sort(list(CAST(event_id AS VARCHAR)))[1:5], ', ') AS examples FROM v GROUP BY rule""")),
    "duplicate_line_keys": (duplicate_line_keys, """
SELECT 'duplicate_id' AS rule, 'error' AS severity, l_orderkey || '/' || l_linenumber AS record_id, count(*) || ' rows' AS detail
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""),
    "cross_group_texts": (cross_group_texts, """
SELECT 'payload_in_two_groups' AS rule, 'error' AS severity, CAST(doc_id AS VARCHAR) AS record_id, sha256(text) AS detail
FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT source) > 1)"""),
    "parts_of_several_suppliers": (parts_of_several_suppliers, """
SELECT 'case_in_two_groups' AS rule, 'error' AS severity, CAST(l_partkey AS VARCHAR) AS record_id,
  min(l_suppkey) || ',' || max(l_suppkey) AS detail FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1"""),
    "unexpected_counts": (unexpected_counts, """
SELECT 'class_counts' AS rule, 'error' AS severity, k AS record_id, n || ' instead of ' || w AS detail FROM (
  SELECT 'total' AS k, count(*) AS n, 1 AS w FROM events
  UNION ALL SELECT 'negative', count(*) FILTER (event_type <> 'error'), 2 FROM events
  UNION ALL SELECT 'positive', count(*) FILTER (event_type = 'error'), 3 FROM events) WHERE n <> w"""),
    "label_disagreement": (label_disagreement, """
SELECT 'payload_label' AS rule, 'error' AS severity, CAST(d.doc_id AS VARCHAR) AS record_id,
  CAST(n_chars >= 400 AS INT) || ' <> ' || quality AS detail
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE CAST(n_chars >= 400 AS INT) <> quality"""),
    "unlabelled_documents": (unlabelled_documents, """
SELECT 'manifest' AS rule, 'error' AS severity, CAST(coalesce(d.doc_id, l.k) AS VARCHAR) AS record_id,
  CASE WHEN l.k IS NULL THEN 'only in files' ELSE 'only in manifest' END AS detail
FROM documents d FULL JOIN (SELECT doc_id + 5 AS k FROM labels) l ON d.doc_id = l.k WHERE d.doc_id IS NULL OR l.k IS NULL"""),
    "hash_mismatch": (hash_mismatch, HASH_MISMATCH_SQL),
    "wrong_text_hashes": (wrong_text_hashes, """
SELECT 'payload_hash' AS rule, 'error' AS severity, CAST(doc_id AS VARCHAR) AS record_id,
  upper(sha256(sha256(text))) AS detail FROM documents WHERE doc_id % 10 = 0"""),
    "amplitude_warning": (amplitude_warning, sql(VECTORS, body="""
SELECT 'amplitude' AS rule, 'warning' AS severity, 'all' AS record_id, 'median |x| ' || printf('%.6g', m) AS detail
FROM (SELECT quantile_cont(a, 0.5) * 1e6 AS m FROM (SELECT CAST(abs(unnest(signal)) AS DOUBLE) AS a FROM vectors))
WHERE m NOT BETWEEN 1 AND 1000""")),
    "recording_sets": (recording_sets, sql(VECTORS, body="""
SELECT 'recordings_per_set' AS rule, 'error' AS severity, set_id AS record_id, count(*) || ' records, 0 not finite' AS detail
FROM vectors GROUP BY set_id HAVING count(*) <> 100
UNION ALL SELECT 'recording_copies', 'error', CAST(min(record_id) AS VARCHAR), count(*) || ' equal payloads' FROM vectors GROUP BY signal HAVING count(*) > 1""")),
    "signal_rules": (signal_rules, "SELECT 'declared_fs' AS rule, count(*) AS n FROM embeddings WHERE len(embedding) <> 256"),
}
