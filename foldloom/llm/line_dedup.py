"""Line deduplication by overlapping windows of three lines, with built-in expressions only.

Every three consecutive lines of a document (blank lines are passed over) are hashed to 128 bits. The first occurrence of a window in the
whole corpus stays; the lines that any later occurrence covers are removed, overlapping windows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.plans.stage import stage

BLANK = " \t\r\x0b\x0c"


def row_hash(key: str, text: str) -> Column:
    """Tells rows with one key apart; rows that repeat key and text are one document."""
    return F.xxhash64(key, text)


def line_windows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, at, h, g): one row per window, ``at`` the places of its three lines, (h, g) its hash."""
    line = F.split(F.col(text), "\n", -1)
    solid = F.filter(F.transform(line, lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANK)).alias("x"))), lambda s: s["x"] != "")
    hashed = F.transform(solid, lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"), F.xxhash64(F.lit(1), s["x"]).alias("g")))
    rows = df.select(F.col(key).alias("key"), row_hash(key, text).alias("row"), hashed.alias("s")).where(F.size("s") >= 3)
    part = lambda p, name: [F.get("s", p + k)[name] for k in range(3)]
    window = F.transform(F.sequence(F.lit(0), F.size("s") - 3), lambda p: F.struct(
        F.array(*part(p, "i")).alias("at"), F.xxhash64(*part(p, "h")).alias("h"), F.xxhash64(*part(p, "g")).alias("g")))
    return rows.select("key", "row", F.explode(window).alias("w")).select("key", "row", "w.at", "w.h", "w.g")


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, covered): places of the lines that later occurrences cover, sorted, for documents that have any.

    The first occurrence of a window is that of the smallest key (null first), row hash and line. Minima are taken before the
    shuffle; the join back to the windows meets a written table, so that a very frequent window can be split over tasks.
    """
    windows = line_windows(df, key, text)
    first = F.min(F.struct("key", "row", "at"))
    repeated = stage(windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1").drop("n"))
    later = windows.join(repeated, ["h", "g"]).where(~F.struct("key", "row", "at").eqNullSafe(F.col("first")))
    return (later.groupBy("key", "row").agg(F.collect_set("at").alias("places"))
            .select("key", "row", F.array_sort(F.array_distinct(F.flatten("places"))).alias("covered")))


def remove_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``text`` freed from repeated lines, and n_lines and n_removed behind its columns.

    Null texts stay null with 0 lines; an empty text is one blank line. Documents with fewer than three lines that are not blank lose
    nothing. Repeats within a document count. Rows that repeat key and text are treated as one document and stay. A document of
    which every line goes keeps an empty text. Existing columns n_lines and n_removed are replaced.
    """
    columns = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    found = repeated_lines(df, key, text).select(F.col("key").alias("__key"), F.col("row").alias("__row"), F.col("covered").alias("__covered"))
    rows = df.select(*columns).withColumn("__id", row_hash(key, text))
    joined = rows.join(found, (F.col("__id") == F.col("__row")) & F.col(key).eqNullSafe(F.col("__key")), "left")
    split = joined.withColumn("__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    # Kept lines are the slices between the covered ones.
    edges = F.concat(F.array(F.lit(-1)), F.col("__covered"), F.array(F.size("__lines")))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("__edges") - 1), lambda j: F.slice(
        "__lines", F.get("__edges", j - 1) + 2, F.get("__edges", j) - F.get("__edges", j - 1) - 1)))
    clean = F.when(F.col("__covered").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return split.withColumn("__edges", F.when(F.col("__covered").isNotNull(), edges)).select(
        *[clean.alias(c) if c == text else F.col(c) for c in columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__covered"), F.lit(0)).cast("long").alias("n_removed"))
