"""Data rules as violation rows ``(rule, severity, record_id, detail)``.

Rules about one record are boolean expressions. All of them run in one scan: each row yields the list of
the rules it breaks, and only that list is exploded, so payload columns never leave the scan stage. Rules about
several records are grouped counts. ``summarize_violations`` keeps a count and the first examples per rule;
``assert_valid`` raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions import signal as sig
from foldloom.functions import text as tx

# Plausible range of the median absolute amplitude after scaling to microvolts.
PLAUSIBLE_MEDIAN_ABS = (1.0, 1000.0)

VIOLATION_SCHEMA = "rule string, severity string, record_id string, detail string"


class DataRuleError(ValueError):
    """At least one rule of severity ``error`` is broken."""


@dataclass(frozen=True)
class Rule:
    """A rule about one record: ``broken`` is true (or NULL) when the record breaks it."""

    name: str
    broken: Column
    detail: Column
    severity: str = "error"


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that the table lacks; schema only, nothing is read."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise DataRuleError(f"missing columns: {missing}")
    return df


def shown(value: str | Column) -> Column:
    return F.coalesce(tx.as_column(value).cast("string"), F.lit("NULL"))


def not_blank(column: str) -> Rule:
    return Rule(f"blank_{column}", tx.is_blank(column), shown(column))


def label_domain(column: str = "label") -> Rule:
    value = F.col(column).cast("string").try_cast("int")
    return Rule("label_domain", ~F.coalesce(value.isin(0, 1), F.lit(False)), shown(column))


def same_value(name: str, left: str | Column, right: str | Column) -> Rule:
    """Two columns of one record agree, NULL equal to NULL."""
    a, b = tx.as_column(left), tx.as_column(right)
    return Rule(name, ~a.eqNullSafe(b), F.concat(shown(a), F.lit(" <> "), shown(b)))


def label_name_agrees(label: str = "label", name: str = "label_name", names: dict[int, str] = tx.LABEL_NAMES) -> Rule:
    return same_value("label_name", F.col(name), tx.label_name(label, names))


def group_agrees(stored: str = "group_id", mapped: str = "mapped_group") -> Rule:
    """The stored group is the one the same-person mapping gives."""
    return same_value("group_mapping", stored, mapped)


def path_agrees(path: str = "record_id", case: str = "case_id", class_name: str = "label_name") -> Rule:
    """Class and case folders of a three-part path agree with the record; other paths carry no claim."""
    claimed = tx.path_class(path).isNotNull()
    differs = (tx.path_class(path) != F.col(class_name)) | (tx.path_case(path) != F.col(case))
    return Rule("path_folders", claimed & differs, shown(path))


def finite_payload(column: str) -> Rule:
    return Rule("non_finite", ~sig.is_finite(column), F.lit("NaN, infinite or missing value"))


def payload_length(column: str, *lengths: int) -> Rule:
    return Rule("payload_length", ~sig.has_length(column, *lengths), F.concat(F.lit("length "), shown(F.size(column))))


def payload_shape(column: str, channels: int, samples: int) -> Rule:
    return Rule("payload_shape", ~sig.has_shape(column, channels, samples),
                F.lit(f"not {channels} x {samples}"))


def hash_agrees(stored: str, computed: str | Column) -> Rule:
    return Rule("payload_hash", ~tx.normalize_hash(stored).eqNullSafe(tx.as_column(computed)), shown(stored))


def valid_target(column: str = "target") -> Rule:
    return Rule("prediction_target", ~F.coalesce(F.col(column).isin(0, 1), F.lit(False)), shown(column))


def finite_score(column: str = "prob") -> Rule:
    return Rule("prediction_score", ~F.coalesce(F.abs(column) < F.lit(math.inf), F.lit(False)), shown(column))


def equals_constant(name: str, column: str, value) -> Rule:
    """A declared setting (sampling rate, number of samples) has the expected value."""
    return Rule(name, ~F.col(column).eqNullSafe(F.lit(value)), shown(column))


def channels_agree(column: str, channels: Sequence[str]) -> Rule:
    """A declared channel list equals the expected order."""
    wanted = F.array(*[F.lit(c) for c in channels])
    return Rule("channel_order", ~F.col(column).eqNullSafe(wanted), F.array_join(column, ","))


def check_records(df: DataFrame, rules: Iterable[Rule], key: str = "record_id") -> DataFrame:
    """Violations of record rules: one scan, no shuffle."""
    found = [F.when(F.coalesce(r.broken, F.lit(True)),
                    F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
                             r.detail.alias("detail"))) for r in rules]
    exploded = df.select(F.col(key).cast("string").alias("record_id"),
                         F.explode(F.array_compact(F.array(*found))).alias("v"))
    return exploded.select("v.rule", "v.severity", "record_id", "v.detail")


def _violations(df: DataFrame, rule: str, record: str | Column, detail: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                     tx.as_column(record).cast("string").alias("record_id"), detail.cast("string").alias("detail"))


def duplicate_ids(df: DataFrame, *key: str) -> DataFrame:
    """Key values that occur more than once."""
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _violations(repeated, "duplicate_id", F.concat_ws("/", *[F.col(k).cast("string") for k in key]),
                       F.concat(F.col("_n").cast("string"), F.lit(" rows")))


def split_owner(df: DataFrame, case: str = "case_id", group: str = "group_id") -> DataFrame:
    """Cases that belong to more than one group. Min and max decide it with partial aggregation."""
    mixed = df.groupBy(case).agg(F.min(group).alias("_a"), F.max(group).alias("_b")).where("_a <> _b")
    return _violations(mixed, "case_in_two_groups", case, F.concat_ws(",", F.col("_a"), F.col("_b")))


def shared_payloads(df: DataFrame, payload_hash: str, group: str = "group_id") -> DataFrame:
    """Payload hashes that occur under more than one group: they would leak across folds."""
    spread = df.groupBy(payload_hash).agg(F.min(group).alias("_a"), F.max(group).alias("_b"),
                                          F.count(F.lit(1)).alias("_n"))
    return spread.where("_a <> _b").select(payload_hash, F.col("_n").alias("n_records"))


def cross_group_payloads(df: DataFrame, payload_hash: str, group: str = "group_id", key: str = "record_id") -> DataFrame:
    """Every record whose payload also occurs under another group."""
    leaking = shared_payloads(df, payload_hash, group)
    hit = df.select(key, payload_hash).join(leaking, payload_hash)
    return _violations(hit, "payload_in_two_groups", key, F.col(payload_hash))


def counts_differ(df: DataFrame, expected: dict[str, int] | None, label: str = "label") -> DataFrame:
    """Total, negative and positive counts against the expected ones (None skips the rule)."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) == 0).alias("negative"),
                    F.count_if(F.col(label) == 1).alias("positive"))
    long = counts.unpivot([], ["total", "negative", "positive"], "what", "n")
    if expected is None:
        return _violations(long.where(F.lit(False)), "class_counts", "what", F.col("n"))
    pairs = [F.lit(x) for item in expected.items() for x in item]
    wanted = F.try_element_at(F.create_map(*pairs), F.col("what"))
    return _violations(long.where(F.col("n") != wanted), "class_counts", "what",
                       F.concat(F.col("n").cast("string"), F.lit(" instead of "), wanted.cast("string")))


def column_differs(left: DataFrame, right: DataFrame, key: str, column: str, rule: str) -> DataFrame:
    """Rows of two tables, joined by key, that disagree on a column."""
    other = right.select(F.col(key).alias("_key"), F.col(column).alias("_other"))
    joined = left.select(key, column).join(other, F.col(key) == F.col("_key"))
    return _violations(joined.where(~F.col(column).eqNullSafe(F.col("_other"))), rule, key,
                       F.concat(shown(column), F.lit(" <> "), shown("_other")))


def key_sets_differ(left: DataFrame, right: DataFrame, key: str, rule: str = "key_sets",
                    left_name: str = "left", right_name: str = "right") -> DataFrame:
    """Keys that only one of two tables has."""
    a = left.select(F.col(key).alias("_l")).distinct()
    b = right.select(F.col(key).alias("_r")).distinct()
    lonely = a.join(b, F.col("_l") == F.col("_r"), "full").where("_l IS NULL OR _r IS NULL")
    side = F.when(F.col("_r").isNull(), f"only in {left_name}").otherwise(f"only in {right_name}")
    return _violations(lonely, rule, F.coalesce("_l", "_r"), side)


def classify_hash_mismatch(df: DataFrame, stored: str, computed: str) -> DataFrame:
    """One row: how many hashes differ, and whether the same set of hashes sits on other rows.

    ``match``; ``misaligned`` (same hash set, other rows); ``changed`` (another set).
    """
    differing = df.agg(F.count_if(~F.col(stored).eqNullSafe(F.col(computed))).alias("n_mismatch"))
    both = df.select(F.explode(F.array(F.struct(F.col(stored).alias("h"), F.lit(1).alias("side")),
                                       F.struct(F.col(computed).alias("h"), F.lit(2).alias("side")))).alias("x"))
    sides = both.groupBy("x.h").agg(F.bit_or("x.side").alias("sides"))
    unmatched = sides.agg(F.count_if(F.col("sides") != 3).alias("n"))
    return differing.select(
        "n_mismatch", unmatched.scalar().alias("n_unmatched_hashes"),
        F.when(F.col("n_mismatch") == 0, "match").when(unmatched.scalar() == 0, "misaligned")
        .otherwise("changed").alias("status"))


def implausible_amplitude(stats: DataFrame, scale: float, limits: tuple[float, float] = PLAUSIBLE_MEDIAN_ABS) -> DataFrame:
    """Warning when the scaled median absolute value lies outside the plausible range."""
    scaled = F.col("median_abs") * F.lit(sig.check_scale(scale))
    return _violations(stats.where(~scaled.between(*limits)), "amplitude", F.lit("all"),
                       F.format_string("median |x| %.6g", scaled), "warning")


def recording_sets(recordings: DataFrame, per_set: int, payload_hash: str, length: str, finite: str) -> DataFrame:
    """Per set: record count, lengths, finite payloads; and over all sets: one length, distinct payloads."""
    per = recordings.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col(finite)).alias("bad"))
    broken = per.where((F.col("n") != per_set) | (F.col("bad") > 0))
    sizes = _violations(broken, "recordings_per_set", "set_id",
                        F.format_string("%d records, %d not finite", F.col("n"), F.col("bad")))
    lengths = recordings.agg(F.min(length).alias("lo"), F.max(length).alias("hi")).where("lo <> hi")
    uneven = _violations(lengths, "recording_lengths", F.lit("all"), F.format_string("%d to %d", "lo", "hi"))
    copies = recordings.groupBy(payload_hash).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))
    repeated = _violations(copies.where("n > 1"), "recording_copies", "first",
                           F.format_string("%d equal payloads", F.col("n")))
    return sizes.unionByName(uneven).unionByName(repeated)


def union_violations(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def summarize_violations(violations: DataFrame, examples: int = 5) -> DataFrame:
    """Per rule: number of violations and the first examples in id order.

    The rank filter lets Spark cut every partition to its first rows before the shuffle, so a rule that all
    records break costs no more than one that few break.
    """
    counts = violations.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n_bad"))
    order = Window.partitionBy("rule", "severity").orderBy("record_id", "detail")
    first = violations.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= examples)
    listed = first.groupBy("rule", "severity").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "record_id"))),
                                 lambda x: x["record_id"]), ", ").alias("examples"))
    return counts.join(listed, ["rule", "severity"])


def assert_valid(violations: DataFrame) -> None:
    """Raises ``DataRuleError`` with counts and examples of the first rules, and how many rules are broken, when an ``error`` row exists."""
    summary = summarize_violations(violations.where("severity = 'error'"))
    rows = summary.orderBy("rule").limit(50).collect()
    if rows:
        said = "; ".join(f"{r['rule']}: {r['n_bad']} ({r['examples']})" for r in rows)
        n = len(rows) if len(rows) < 50 else summary.count()
        raise DataRuleError(said if n <= 50 else f"{n} rules are broken, summarize_violations lists all; the first are {said}")
