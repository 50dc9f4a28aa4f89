"""Global order without a one-task window.

Rows are range-partitioned on the order once, the partition number becomes a column, and every
window runs inside one range. What earlier ranges contribute comes from a table with one row per
(range, key). So no task ever holds a whole key, however hot that key is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.plans.stage import stage

RANGE = "_range"


def _by_range(df: DataFrame, order: Sequence[str], ranges: int | None) -> DataFrame:
    """Without a number of ranges, adaptive execution merges neighbouring small ones, so their count follows the size."""
    return df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)


def in_ranges(df: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """``df`` with its range number, staged so that the number is fixed for every later use.

    Callers pass rows that are unique in ``order``; a key with many copies would not split.
    """
    return stage(_by_range(df, order, ranges).withColumn(RANGE, F.spark_partition_id()))


def _earlier(by: Sequence[str]):
    window = Window.partitionBy(*by).orderBy(RANGE) if by else Window.orderBy(RANGE)
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _with_offsets(local: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    # One row per range, so bounded by the partition count, when there is no key; with keys the
    # table grows with them and the join strategy is left to Spark.
    side = offsets if by else F.broadcast(offsets)
    on = [local[RANGE] == side[RANGE]]
    on += [local[c].eqNullSafe(side[c]) for c in by]
    condition = on[0]
    for term in on[1:]:
        condition = condition & term
    joined = local.join(side, condition)
    for name in [RANGE, *by]:
        joined = joined.drop(side[name])
    return joined


def running_totals(df: DataFrame, order: Sequence[str], sums: Sequence[str],
                   by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Adds ``before_<c>`` (sum over smaller rows of the key) and ``total_<c>`` for each ``c``.

    ``df`` must be unique in ``by + order``: aggregate equal rows first.
    """
    ranged = in_ranges(df, *by, *order, ranges=ranges)
    inside = (Window.partitionBy(RANGE, *by).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumns({f"_cum_{c}": F.sum(c).over(inside) for c in sums})
    per_range = ranged.groupBy(RANGE, *by).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    whole = Window.partitionBy(*by) if by else (
        Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    offsets = per_range.select(
        RANGE, *by,
        *[F.coalesce(F.sum(f"_sum_{c}").over(_earlier(by)), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in sums])
    joined = _with_offsets(local, offsets, by)
    out = joined.withColumns({f"before_{c}": F.col(f"_off_{c}") + F.col(f"_cum_{c}") - F.col(c) for c in sums})
    return out.drop(RANGE, *[f"_cum_{c}" for c in sums], *[f"_off_{c}" for c in sums])


def numbered(df: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """Staged rows with their range and their 1-based row number within it (``_row``).

    Rows are sorted inside their range, where ``monotonically_increasing_id`` numbers them: range in the high
    bits, row in the low 33 bits. No window is needed.
    """
    rows = stage(_by_range(df, order, ranges).sortWithinPartitions(*order)
                 .withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumns({RANGE: F.shiftright("_id", 33).cast("int"),
                             "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("_id")


def rows_before(n: str = "_n"):
    """Rows of all earlier ranges, over a table with one row per range."""
    return F.coalesce(F.sum(n).over(_earlier(())), F.lit(0))


def positions(df: DataFrame, *order: str, name: str = "position", ranges: int | None = None) -> DataFrame:
    """1-based position of every row in the global order: row number plus the sizes of earlier ranges."""
    local = numbered(df, *order, ranges=ranges)
    sizes = local.groupBy(RANGE).agg(F.max("_row").alias("_n")).select(RANGE, rows_before().alias("_off"))
    # One row per range: bounded by the number of partitions.
    return (local.join(F.broadcast(sizes), RANGE)
            .withColumn(name, F.col("_row") + F.col("_off")).drop("_row", "_off", RANGE))


def exact_percentiles(df: DataFrame, value: str, probabilities: dict[str, float],
                      by: Sequence[str] = ()) -> DataFrame:
    """Percentiles with linear interpolation, one output row per key; NULL values do not count.

    Equal values are counted first; the value at a wanted rank is then picked by its running count,
    so the work is a shuffle of distinct values and not a per-key sort in one task.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, [value], ["_n"], by)
    first, last = F.col("before__n"), F.col("before__n") + F.col("_n") - 1

    def at(rank):
        return F.max(F.when((first <= rank) & (rank <= last), F.col(value).cast("double")))

    picks, outs = [], []
    for name, q in probabilities.items():
        target = (F.col("total__n") - 1) * F.lit(float(q))
        low = F.floor(target)
        picks += [at(low).alias(f"_lo_{name}"), at(F.ceil(target)).alias(f"_hi_{name}"),
                  F.max(target - low).alias(f"_part_{name}")]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * F.col(f"_part_{name}")).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *outs)


def bracketed_percentiles(df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = (),
                          accuracy: int = 10_000) -> DataFrame:
    """The same percentiles for values that are many and hardly repeat: only those near a wanted rank are shuffled.

    A sketch with a bounded rank error brackets each rank; a second pass counts the values below each bracket and ranks the few inside.
    Keys with fewer values than ``accuracy`` are bracketed by their smallest and largest value.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    slack, names = 6 / accuracy, list(probabilities)
    edge = lambda q: F.percentile_approx("_v", min(1.0, max(0.0, q)), accuracy)
    bracket = lambda q: F.struct(
        F.when(F.count("_v") < accuracy, F.min("_v")).otherwise(edge(q - slack)).alias("lo"),
        F.when(F.count("_v") < accuracy, F.max("_v")).otherwise(edge(q + slack)).alias("hi"))
    brackets = stage(rows.groupBy(*by).agg(F.count("_v").alias("_total"), F.array(*[bracket(probabilities[n]) for n in names]).alias("_b"))
                     .withColumnsRenamed({c: f"_by_{c}" for c in by}))
    if by:
        condition = F.lit(True)
        for c in by:
            condition = condition & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        placed = rows.join(brackets, condition)
    else:
        one = brackets.first()  # a single row: no key, one bracket per percentile
        held = F.array(*[F.struct(F.lit(b["lo"]).cast("double").alias("lo"), F.lit(b["hi"]).cast("double").alias("hi")) for b in one["_b"]])
        placed = rows.withColumns({"_b": held, "_total": F.lit(one["_total"])})
    # A value counts for a percentile when it lies below its bracket (without its value) or inside it.
    near = F.filter(F.transform("_b", lambda b, i: F.struct(i.alias("i"), F.when(F.col("_v") >= b["lo"], F.col("_v")).alias("v"), b["hi"].alias("hi"))),
                    lambda x: x["v"].isNull() | (x["v"] <= x["hi"]))
    counted = (placed.select(*by, "_total", F.explode(near).alias("_x")).groupBy(*by, "_total", F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v"))
               .agg(F.count(F.lit(1)).alias("_n")))
    # Null sorts first, so the values below a bracket are the first entry of its running count.
    ranked = running_totals(counted, ["_v"], ["_n"], [*by, "_i"])
    share = F.element_at(F.array(*[F.lit(float(probabilities[n])) for n in names]), F.col("_i") + 1)
    target = (F.col("_total") - 1) * share
    first, last = F.col("before__n"), F.col("before__n") + F.col("_n") - 1
    low, high = F.floor(target), F.ceil(target)
    picks = [a for i, n in enumerate(names) for a in (
        F.max(F.when((F.col("_i") == i) & (first <= low) & (low <= last), F.col("_v"))).alias(f"_lo_{n}"),
        F.max(F.when((F.col("_i") == i) & (first <= high) & (high <= last), F.col("_v"))).alias(f"_hi_{n}"),
        F.max(F.when(F.col("_i") == i, target - low)).alias(f"_part_{n}"))]
    outs = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in names]
    return ranked.groupBy(*by).agg(*picks).select(*by, *outs)


def hash_positions(df: DataFrame, key: str, by: Sequence[str], seed, name: str = "position",
                   total: str = "n_stratum") -> DataFrame:
    """Position of every row within ``by`` in a seeded pseudo-random order, and the size of its key.

    The order is the SHA-256 of ``seed:key``. Rows get their place in the global order of (``by``, hash), from which the first place of
    their key is taken off, so a stratum that holds a third of all rows is ranked in as many ranges as its size takes.
    """
    seeded = df.withColumn("_h", F.sha2(F.concat(seed.cast("string"), F.lit(":"), F.col(key).cast("string")), 256))
    placed = positions(seeded, *by, "_h", key, name="_place").drop("_h")
    starts = placed.groupBy(*by).agg((F.min("_place") - 1).alias("_before"), F.count(F.lit(1)).alias(total))
    starts = starts.withColumnsRenamed({c: f"_by_{c}" for c in by})
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = placed.join(starts, condition)
    return joined.withColumn(name, F.col("_place") - F.col("_before")).drop("_place", "_before", *[f"_by_{c}" for c in by])


# Hex digits of a hash that are counted to find the place of a cut: 65,536 prefixes a stratum at most.
PREFIX_DIGITS = 4


def seeded_hash(seed: Column, key: str) -> Column:
    """The hash whose order stands for a seeded random order."""
    return F.sha2(F.concat(seed.cast("string"), F.lit(":"), F.col(key).cast("string")), 256)


def hash_cuts(df: DataFrame, key: str, by: Sequence[str], seed: Column, size: Callable[[Column], Column]) -> DataFrame:
    """(``by`` as ``_by_*``, ``_cut_hash``, ``_cut_key``): the last of the first ``size(n)`` rows of each key in hash order, found without sorting the rows.

    Counts of hash prefixes tell in which prefix the cut lies; only the rows of that prefix, one in 65,536, are ranked. A key whose cut is 0 has no row.
    """
    rows = df.select(*by, F.col(key).alias("_key"), seeded_hash(seed, key).alias("_hash")).withColumn("_prefix", F.substring("_hash", 1, PREFIX_DIGITS))
    counts = stage(rows.groupBy(*by, "_prefix").agg(F.count(F.lit(1)).alias("_n")))
    upto = Window.partitionBy(*by).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns({"_until": F.sum("_n").over(upto), "_want": size(F.sum("_n").over(Window.partitionBy(*by)))})
    found = stage(placed.withColumn("_before", F.col("_until") - F.col("_n")).where("_before < _want AND _want <= _until").select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_prefix").alias("_cut_prefix"), (F.col("_want") - F.col("_before")).alias("_rank")))
    near = rows.join(found, _same_key(by) & (F.col("_prefix") == F.col("_cut_prefix")))
    rank = F.row_number().over(Window.partitionBy(*[f"_by_{c}" for c in by]).orderBy("_hash", "_key"))
    return stage(near.withColumn("_at", rank).where("_at = _rank").select(*[f"_by_{c}" for c in by], F.col("_hash").alias("_cut_hash"), F.col("_key").alias("_cut_key")))


def _same_key(by: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return condition


def first_by_hash(df: DataFrame, key: str, by: Sequence[str], seed: Column, size: Callable[[Column], Column], name: str, only: Column | None = None) -> DataFrame:
    """Adds ``name``: whether a row is among the first ``size(n)`` of the n rows of its key in seeded hash order. ``key`` values are unique within ``by``.

    Rows outside ``only`` are never among them and not counted. Rows stay where they are: they meet one row per key that has a cut. The same rows are
    chosen as by ``hash_positions``.
    """
    cuts = hash_cuts(df if only is None else df.where(only), key, by, seed, size)
    joined = df.join(cuts, _same_key(by), "left")
    chosen = F.coalesce(F.struct(seeded_hash(seed, key), F.col(key)) <= F.struct("_cut_hash", "_cut_key"), F.lit(False))
    return joined.withColumn(name, chosen if only is None else chosen & F.coalesce(only, F.lit(False))).drop("_cut_hash", "_cut_key", *[f"_by_{c}" for c in by])
