"""Ids, text, payload expressions and table summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.functions import scores, text as tx
from foldloom.functions import signal as sig
from foldloom.operators import profile
from foldloom.operators.folds import map_group
from foldloom.plans.ordering import positions
from foldloom.plans.stage import stage
from foldloom.queries.views import (MIN_PER_CLASS, RECORDS, TEXTS, VECTORS, prefixed, records, rounded, sql, table, texts,
                                    vectors)


def natural_order_cases(spark, d):
    cases = records(spark, d).select("case_id").distinct().withColumn("_key", tx.natural_key("case_id"))
    return positions(cases, "_key", "case_id").select("case_id", "position")


def mapped_groups(spark, d):
    events = table(spark, d, "events").select(prefixed("u", F.col("user_id")).alias("case_id"), "user_id")
    aliases = events.where(F.col("user_id") % 2 == 1).select("case_id", "user_id").distinct().select(
        "case_id", prefixed("u", F.col("user_id") - 1).alias("group_id"))
    return map_group(events.select("case_id"), aliases).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_distinct("case_id").alias("n_cases"))


def record_paths(spark, d):
    folder = F.when(F.col("user_id") % 7 == 0, prefixed("x", F.col("user_id"))).otherwise(prefixed("u", F.col("user_id")))
    name = prefixed("e", F.col("event_id"))
    label = (F.col("event_type") == "error").cast("int")
    path = F.when(F.col("event_type") == "view", F.concat(folder, F.lit("/"), name)).otherwise(
        F.concat(tx.label_name(label), F.lit("\\"), folder, F.lit("/"), name))
    index = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    rows = table(spark, d, "events").select("event_id", path.alias("path"), index.alias("index"),
                                            prefixed("u", F.col("user_id")).alias("case_id"))
    return rows.select("event_id", tx.path_class("path").alias("path_class"), tx.path_case("path").alias("path_case"),
                       F.coalesce(tx.path_case("path") == F.col("case_id"), F.lit(False)).alias("case_agrees"),
                       F.coalesce(tx.coerce_index("index"), F.lit(-1)).alias("segment_index"))


RECORD_PATHS_SQL = """
SELECT event_id,
  CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN 'seizure' ELSE 'nonseizure' END AS path_class,
  CASE WHEN event_type <> 'view' THEN (CASE WHEN user_id % 7 = 0 THEN 'x' ELSE 'u' END) || user_id END AS path_case,
  event_type <> 'view' AND user_id % 7 <> 0 AS case_agrees,
  CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id END AS segment_index
FROM events"""


def content_digests(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.content_sha256("text").alias("sha256"), tx.normalized_content_sha256("text").alias("normalized_sha256"))


CONTENT_DIGESTS_SQL = r"""
SELECT doc_id, sha256(text) AS sha256,
  sha256(coalesce(array_to_string(list_transform(list_filter(
    string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^\s*(#|$)')),
    lambda x: regexp_replace(x, '\s+$', '')), chr(10)), '')) AS normalized_sha256
FROM documents"""


def normalized_duplicates(spark, d):
    """Documents that are equal once formatting does not count, by the normalised digest."""
    # Two narrow columns are kept, so that the texts are read and normalised once.
    rows = stage(table(spark, d, "documents").select(F.col("doc_id").alias("record_id"),
                                                     tx.normalized_content_sha256("text").alias("payload_hash")))
    return profile.duplicate_payloads(rows, "payload_hash")


NORMALIZED_DUPLICATES_SQL = r"""
WITH n AS (SELECT doc_id AS record_id, sha256(coalesce(array_to_string(list_transform(list_filter(
    string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: NOT regexp_matches(x, '^\s*(#|$)')),
    lambda x: regexp_replace(x, '\s+$', '')), chr(10)), '')) AS payload_hash FROM documents)
SELECT record_id, payload_hash, c.n_copies FROM n JOIN (
  SELECT payload_hash, count(*) AS n_copies FROM n GROUP BY 1 HAVING count(*) > 1) c USING (payload_hash)"""


def signal_flags(spark, d):
    scaled = sig.scale_units("signal", 1e6)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("signal", i * 8 + 1, 8))
    probe = sig.stride_probe("signal", 8)
    out = vectors(spark, d).withColumn("rows", rows).select(
        "record_id", sig.is_finite("signal").alias("finite"), sig.has_length("signal", 64).alias("length_ok"),
        sig.has_shape("rows", 8, 8).alias("shape_ok"), sig.has_shape("rows", 8, 9).alias("other_shape_ok"),
        F.array_max(scaled).cast("double").alias("scaled_max"), F.size(probe).cast("bigint").alias("n_probe"),
        F.aggregate(probe, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("probe_sum"),
        sig.to_channel_major("rows", 8)[2][3].cast("double").alias("channel_2_time_3"))
    return rounded(out, "scaled_max", "probe_sum", "channel_2_time_3")


SIGNAL_FLAGS_SQL = sql(VECTORS, body="""
SELECT record_id, list_bool_and(list_transform(signal, lambda x: isfinite(x))) AS finite, len(signal) = 64 AS length_ok,
  true AS shape_ok, false AS other_shape_ok,
  round(CAST(list_max(list_transform(signal, lambda x: CAST(x * CAST(1e6 AS FLOAT) AS FLOAT))) AS DOUBLE), 9) AS scaled_max,
  CAST(8 AS BIGINT) AS n_probe,
  round(list_sum(list_transform(range(0, 64, 8), lambda i: CAST(signal[i + 1] AS DOUBLE))), 9) AS probe_sum,
  round(CAST(signal[3 * 8 + 2 + 1] AS DOUBLE), 9) AS channel_2_time_3
FROM vectors""")


def payload_hashes(spark, d):
    return vectors(spark, d).select("record_id", sig.payload_sha256("signal").alias("payload_sha256"))


# A float's bits as bytes come most significant first; payloads have the least significant first.
PAYLOAD_HASHES_SQL = sql(VECTORS, body="""
SELECT record_id, sha256(unhex(string_agg(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2), '' ORDER BY i))) AS payload_sha256
FROM (SELECT record_id, i, hex(CAST(CAST(CAST(signal[i] AS FLOAT) AS BIT) AS BLOB)) AS h
      FROM (SELECT record_id, signal, unnest(range(1, len(signal) + 1)) AS i FROM vectors)) GROUP BY record_id""")


def json_safe_values(spark, d):
    raw = table(spark, d, "events").select(
        F.col("event_type"), F.sqrt(F.col("value") - 50).alias("root"), (F.col("value") * 1e307).alias("huge"))
    safe = scores.json_safe(raw)
    out = safe.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("root").alias("n_root"), F.count("huge").alias("n_huge"),
        F.avg("root").alias("mean_root"))
    return rounded(out, "mean_root")


JSON_SAFE_SQL = """
SELECT event_type, count(*) AS n, count(*) FILTER (value >= 50) AS n_root,
  count(*) FILTER (value < 17.976931348623157) AS n_huge,
  round(avg(CASE WHEN value >= 50 THEN sqrt(value - 50) END), 9) AS mean_root
FROM events GROUP BY event_type"""


def class_counts(spark, d):
    return profile.class_counts(records(spark, d))


def group_table(spark, d):
    return profile.group_table(profile.case_counts(records(spark, d)), MIN_PER_CLASS)


GROUP_TABLE_SQL = sql(RECORDS, body=f"""
SELECT group_id,
  count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1) AS n_pos,
  count(DISTINCT user_id) AS n_cases,
  least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) >= {MIN_PER_CLASS} AS eligible
FROM records r GROUP BY group_id, gid""")


def group_cases(spark, d):
    return profile.group_cases(profile.case_counts(records(spark, d)))


def class_pivot(spark, d):
    named = records(spark, d).withColumn("label_name", tx.label_name("label"))
    return profile.class_pivot(named, "label_name", list(tx.LABEL_NAMES.values()))


def single_class_units(spark, d):
    return profile.single_class_units(profile.case_counts(texts(spark, d)))


SINGLE_CLASS_SQL = sql(TEXTS, body="""
SELECT 'case' AS unit_kind, case_id AS unit, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1) AS n_pos
FROM texts GROUP BY case_id HAVING count(DISTINCT label) < 2
UNION ALL
SELECT 'group', group_id, count(*) FILTER (label = 0), count(*) FILTER (label = 1)
FROM texts GROUP BY group_id HAVING count(DISTINCT label) < 2""")


def amplitude_stats(spark, d):
    values = profile.samples(vectors(spark, d), "signal", "set_id")
    return rounded(profile.amplitude_stats(values, "sample", ["set_id"]), "median_abs", "p99_abs", "max_abs")


def amplitude_overall(spark, d):
    values = profile.samples(vectors(spark, d), "signal")
    return rounded(profile.amplitude_stats(values, "sample"), "median_abs", "p99_abs", "max_abs")


AMPLITUDE_SQL = """
SELECT {key} round(quantile_cont(a, 0.5), 9) AS median_abs, round(quantile_cont(a, 0.99), 9) AS p99_abs, round(max(a), 9) AS max_abs
FROM (SELECT set_id, CAST(abs(unnest(signal)) AS DOUBLE) AS a FROM vectors) {group}"""


def duplicate_payloads(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.sha2("text", 256).alias("payload_hash"))
    return profile.duplicate_payloads(rows, "payload_hash")


def duplicate_summary(spark, d):
    return profile.duplicate_summary(table(spark, d, "documents").select(F.sha2("text", 256).alias("payload_hash")), "payload_hash")


def dataset_report(spark, d):
    return profile.dataset_report(texts(spark, d), "payload_hash")


DATASET_REPORT_SQL = sql(TEXTS, body="""
SELECT 'counts' AS section, 'total' AS key, count(*) AS n FROM texts
UNION ALL SELECT 'counts', 'negative', count(*) FILTER (label = 0) FROM texts
UNION ALL SELECT 'counts', 'positive', count(*) FILTER (label = 1) FROM texts
UNION ALL SELECT 'case', case_id, count(*) FROM texts GROUP BY case_id
UNION ALL SELECT 'group', group_id, count(*) FROM texts GROUP BY group_id
UNION ALL SELECT 'single_class_case', case_id, count(*) FROM texts GROUP BY case_id HAVING count(DISTINCT label) < 2
UNION ALL SELECT 'single_class_group', group_id, count(*) FROM texts GROUP BY group_id HAVING count(DISTINCT label) < 2
UNION ALL SELECT 'duplicate_record', CAST(record_id AS VARCHAR), n FROM (
  SELECT record_id, count(*) OVER (PARTITION BY payload_hash) AS n FROM texts) WHERE n > 1""")


QUERIES = {
    "natural_order_cases": (natural_order_cases, """
SELECT 'u' || user_id AS case_id, row_number() OVER (ORDER BY user_id) AS position
FROM (SELECT DISTINCT user_id FROM events)"""),
    "mapped_groups": (mapped_groups, """
SELECT 'u' || (user_id - user_id % 2) AS group_id, count(*) AS n_records, count(DISTINCT user_id) AS n_cases
FROM events GROUP BY 1"""),
    "record_paths": (record_paths, RECORD_PATHS_SQL),
    "content_digests": (content_digests, CONTENT_DIGESTS_SQL),
    "normalized_duplicates": (normalized_duplicates, NORMALIZED_DUPLICATES_SQL),
    "signal_flags": (signal_flags, SIGNAL_FLAGS_SQL),
    "payload_hashes": (payload_hashes, PAYLOAD_HASHES_SQL),
    "json_safe_values": (json_safe_values, JSON_SAFE_SQL),
    "class_counts": (class_counts, sql(RECORDS, body="""
SELECT count(*) AS n_total, count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (label = 1) AS n_pos FROM records""")),
    "group_table": (group_table, GROUP_TABLE_SQL),
    "group_cases": (group_cases, sql(RECORDS, body="""
SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY user_id) AS ordinal, case_id FROM (SELECT DISTINCT group_id, case_id, user_id FROM records)""")),
    "class_pivot": (class_pivot, sql(RECORDS, body="""
SELECT group_id, case_id, count(*) FILTER (label = 0) AS nonseizure, count(*) FILTER (label = 1) AS seizure
FROM records GROUP BY group_id, case_id""")),
    "single_class_units": (single_class_units, SINGLE_CLASS_SQL),
    "amplitude_stats": (amplitude_stats, sql(VECTORS, body=AMPLITUDE_SQL.format(key="set_id,", group="GROUP BY set_id"))),
    "amplitude_overall": (amplitude_overall, sql(VECTORS, body=AMPLITUDE_SQL.format(key="", group=""))),
    "duplicate_payloads": (duplicate_payloads, """
SELECT doc_id AS record_id, sha256(text) AS payload_hash, n AS n_copies
FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1"""),
    "duplicate_summary": (duplicate_summary, """
SELECT count(*) AS n_duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_duplicate_records
FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)"""),
    "dataset_report": (dataset_report, DATASET_REPORT_SQL),
}
