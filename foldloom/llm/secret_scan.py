"""Secret scans: candidates by shape, and a random forest that takes out false positives, with DataFrame operations only.

A candidate is a long run of key characters in a word, or a run of any length right behind a name such as ``password=``. Its features are length, shares of character kinds, transitions between them, how
much of it the corpus' own dictionary covers, the path it stands in, and the words around it. The forest learns from labelled findings,
at most a bounded sample of each label, and gives every finding a probability.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.plans.stage import stage

VALUE = "[A-Za-z0-9+/_-]{16,}"
#: What a candidate's word must show besides: a digit, or a long run of capitals.
SHAPE = "[0-9]|[A-Z]{16}"
KEYS = "(?i)pass(word|wd|phrase)?|token|secret|api|key|auth|credential|bearer"
#: Behind a key name and = or :, a run of any length and shape is a candidate.
ASSIGNED = "(?i:pass(?:word|wd|phrase)?|token|secret|api|key|auth|credential|bearer)[\"']?[=:][\"']?"
CANDIDATE = f"{VALUE}|(?<={ASSIGNED})[A-Za-z0-9+/_-]+"
#: What stands between a name and what is assigned to it.
NAMED = "^[\"']?[=:][\"']?"
#: Words of their own, or parts between other characters than letters: "test_key" but not "latest".
MOCKS = "(?i)(?<![a-z])(example|sample|dummy|test|fake|mock|placeholder)(?![a-z])|x{6}"
# Labelled findings of each label that the forest learns from at most, and a word's least count in the dictionary.
SAMPLE_ROWS, DICTIONARY_COUNT = 10_000, 5
FEATURES = ("size", "digits", "capitals", "smalls", "distinct", "transitions", "slashes", "hexadecimal", "coverage", "assigned", "key_before",
            "mock_near", "path_depth", "path_mock")


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(key, at, run, value, prefix, word, before, after, path): every candidate with its place among the words and among the runs of its word (from 0).

    ``prefix`` is the text before the run back to the last run, with that run if it is the name to which this one is assigned; ``word`` goes from there to
    the next run or, where one follows, the next separator. ``before`` and ``after`` are the neighbouring words.
    """
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    words = df.select(F.col(key).alias("key"), where.alias("path"), F.split(F.col(text), r"\s+", -1).alias("words"))
    word = lambda i: F.get("words", i)
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: ((F.length(word(i)) >= 16) | word(i).rlike("[=:].")) & word(i).rlike(CANDIDATE))
    # The outer form: filters that Spark derives from an inner explode would be computed again from the text, once for every word.
    found = words.select("key", "path", "words", F.explode_outer(places).alias("at")).where("at is not null")
    parts = found.select(
        "key", F.col("at").cast("long").alias("at"), word(F.col("at")).alias("word"), F.concat_ws(" ", word(F.col("at") - 2), word(F.col("at") - 1)).alias("before"),
        F.coalesce(word(F.col("at") + 1), F.lit("")).alias("after"), "path").withColumns(
        {"runs": F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), "pieces": F.split("word", CANDIDATE, -1), "shaped": F.col("word").rlike(SHAPE)})

    def described(run: Column, i: Column) -> Column:
        piece, following, more = F.get("pieces", i), F.get("pieces", i + 1), i + 1 < F.size("runs")
        own = F.when(~piece.rlike("[A-Za-z]") & piece.rlike("[=:]"), F.concat(F.coalesce(F.get("runs", i - 1), F.lit("")), piece)).otherwise(piece)
        name = following.rlike(NAMED + "[A-Za-z0-9+/_-]") | (more & following.rlike(NAMED + "$"))
        return F.struct(i.cast("long").alias("run"), run.alias("value"), own.alias("prefix"),
                        F.when(more, F.regexp_extract(following, "^[^,&;]*", 0)).otherwise(following).alias("rest"),
                        (run.rlike(SHAPE) | (F.col("shaped") & ~name) | own.rlike(ASSIGNED + "$")).alias("taken"))

    each = F.filter(F.transform("runs", described), lambda x: x["taken"])
    rows = parts.select("key", "at", "before", "after", "path", F.explode_outer(each).alias("x")).where("x is not null")
    return rows.select("key", "at", "x.run", "x.value", "x.prefix", F.concat("x.prefix", "x.value", "x.rest").alias("word"), "before", "after", "path")


def dictionary(df: DataFrame, text: str = "text", least: int = DICTIONARY_COUNT) -> DataFrame:
    """(run): words of three letters or more, in lower case, that the corpus has at least ``least`` times."""
    words = df.select(F.explode(F.split(F.lower(F.col(text)), r"\P{L}+")).alias("run")).where(F.length("run") >= 3)
    return words.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("run")


def coverage(found: DataFrame, known: DataFrame) -> DataFrame:
    """(value, coverage): the share of each distinct value's characters that lie in runs of letters the dictionary has."""
    values = found.select("value").distinct()
    runs = values.select("value", F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("run")).where(F.length("run") >= 3)
    covered = runs.join(known, "run").groupBy("value").agg(F.sum(F.length("run")).alias("covered"))
    return values.join(covered, "value", "left").select("value", (F.coalesce("covered", F.lit(0)) / F.length("value")).alias("coverage"))


def features(found: DataFrame, covered: DataFrame) -> DataFrame:
    """The findings with one numeric column per feature."""
    size = F.length("value")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / size
    near = F.concat_ws(" ", "before", "word", "after")
    flag = lambda c: c.cast("double")
    path = F.coalesce("path", F.lit(""))
    return found.join(covered, "value").withColumns({
        "size": size.cast("double"), "digits": share("[0-9]"), "capitals": share("[A-Z]"), "smalls": share("[a-z]"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / size,
        "transitions": F.regexp_count("value", F.lit("(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])")) / size,
        "slashes": F.regexp_count("word", F.lit("/")).cast("double"), "hexadecimal": flag(F.col("value").rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "assigned": flag(F.concat_ws(" ", F.substring_index("before", " ", -1), "word").rlike("[=:]")),
        "key_before": flag(F.concat_ws(" ", "before", "prefix").rlike(KEYS)), "mock_near": flag(near.rlike(MOCKS)),
        "path_depth": F.regexp_count(path, F.lit("/")).cast("double"), "path_mock": flag(path.rlike(MOCKS))})


def rule_label() -> Column:
    """A label where the case is clear, else null: key ids of a fixed form and long assigned hexadecimal keys are secrets; numbers, plain
    words and values beside words such as "example" are not."""
    value = F.col("value")
    false = value.rlike("^[0-9/_+-]+$") | value.rlike("^[A-Za-z]+$") & ~value.rlike("^AKIA") | (F.col("mock_near") == 1)
    true = value.rlike("^AKIA[A-Z0-9]{16}$") | ((F.col("size") >= 16) & (F.col("hexadecimal") == 1) & (F.col("key_before") == 1) & value.rlike("[a-f]") & value.rlike("[0-9]"))
    return F.when(false, 0.0).when(true, 1.0)


def fit_forest(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = 20, depth: int = 6, seed: int = 7):
    """A forest over findings with features and ``label`` (0, 1); None unless both labels occur.

    Of each label the ``sample_rows`` findings with the smallest hash take part.
    """
    parts = [labelled.where(F.col("label") == label).orderBy(F.xxhash64("value", "before", "after"), "value", "at", "run").limit(sample_rows) for label in (0.0, 1.0)]
    sample = stage(parts[0].unionByName(parts[1]).select("label", *FEATURES))
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.coalesce(1).sortWithinPartitions("label", *FEATURES))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)


def judged_findings(df: DataFrame, labels: Column | None = None, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text",
                    path: str | None = "source") -> DataFrame:
    """Every candidate with its features and its ``label`` (0, 1 or null).

    ``labelled(key, at, run, label)`` are labelled findings, which count before all; ``labels`` is a label from a finding's columns and features, by default
    ``rule_label()``. Without a row in ``labelled`` that column decides.
    """
    found = stage(candidates(df, key, text, path))
    known = features(found, coverage(found, dictionary(df, text))).withColumn("label", rule_label() if labels is None else labels)
    if labelled is not None:
        given = labelled.groupBy(F.col(key).alias("_key"), F.col("at").alias("_at"), F.col("run").alias("_run")).agg(F.max(F.col("label").cast("double")).alias("_label"))
        same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("at") == F.col("_at")) & (F.col("run") == F.col("_run"))
        known = known.join(given, same, "left").withColumn("label", F.coalesce("_label", "label")).drop("_key", "_at", "_run", "_label")
    return stage(known)


def scored(known: DataFrame, taught: DataFrame) -> DataFrame:
    """``known`` with the probability by a forest that learns from the labelled rows of ``taught``."""
    model = fit_forest(taught.where("label is not null"))
    if model is None:
        one = taught.agg(F.max("label")).first()[0]
        return known.withColumn("probability", F.lit(0.5 if one is None else one))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known)
    return model.transform(vectors).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))


def held_out_quality(df: DataFrame, threshold: float = 0.5, parts: int = 3, **settings) -> DataFrame:
    """One row: ``n, true_positive, false_positive, false_negative, precision, recall`` of the labelled findings of one value in ``parts``, by a forest that learnt from
    the other values only. Without such findings counts are 0 and shares NULL."""
    known = judged_findings(df, **settings).where("label is not null")
    out = F.pmod(F.xxhash64("value"), F.lit(parts)) == 0
    rows = scored(known.where(out), known.where(~out)).select("label", (F.col("probability") >= threshold).alias("yes"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("yes") & (F.col("label") == 1)).alias("true_positive"),
                      F.count_if(F.col("yes") & (F.col("label") == 0)).alias("false_positive"), F.count_if(~F.col("yes") & (F.col("label") == 1)).alias("false_negative"))
    hits = F.col("true_positive")
    return counts.withColumns({"precision": F.try_divide(hits, hits + F.col("false_positive")), "recall": F.try_divide(hits, hits + F.col("false_negative"))})


def scan_secrets(df: DataFrame, labels: Column | None = None, threshold: float = 0.5, key: str = "doc_id", text: str = "text",
                 path: str | None = "source", labelled: DataFrame | None = None) -> DataFrame:
    """(key, at, run, value_sha256, shown, label, probability, is_secret): every candidate of every document; values are not shown whole.

    ``labels`` and ``labelled`` as in ``judged_findings``. If only one label
    occurs the probability is that label, without any it is 0.5. Null and empty texts have no candidates; null paths and keys are allowed; repeated
    rows give repeated findings. ``path`` may be None. Further columns play no part.
    """
    known = judged_findings(df, labels, labelled, key, text, path)
    return scored(known, known).select(F.col("key").alias(key), "at", "run", F.sha2("value", 256).alias("value_sha256"), F.concat(F.expr("left(value, least(4, length(value) div 4))"), F.lit("...")).alias("shown"),
                                       "label", F.round("probability", 6).alias("probability"), (F.col("probability") >= threshold).alias("is_secret"))
