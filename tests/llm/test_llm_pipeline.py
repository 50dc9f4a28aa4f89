"""Registered corpus queries beside their SQL, and the pipeline beside the plain twins run one after the other."""

import pytest

import brute
import corpus_pipeline
from foldloom.llm.queries import QUERIES
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q[1]])
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name][0](spark, SF_DIR), con, QUERIES[name][1]) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def twin(rows, items):
    """Rows (doc_id, text, lang) through all stages."""
    table = brute.profiles(rows, all_rows=True)
    rows = [r for r in rows if (found := brute.language(r[1], table))[0] != "und" and found[1] >= corpus_pipeline.LEAST_SCORE]
    clean = brute.line_dedup([r[:2] for r in rows])
    rows = [(d, text, lang) for (d, _, lang), (text, _, gone) in zip(rows, clean) if not gone or text.strip()]
    kept = set(brute.similar_kept([r[:2] for r in rows]))
    rows = [r for r in rows if r[0] in kept]
    rows = [r for r in rows if not brute.contamination(r[1], items)[4]]
    coder = brute.encoding()
    return {d: (lang, *brute.token_row(text, coder)) for d, text, lang in rows}


def check(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: (r["lang"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == twin(rows, items)
    return got


def test_pipeline_of_given_documents(spark):
    assert 100 < len(check(spark, SF_DIR)) < 200


def test_pipeline_of_odd_rows(spark, tmp_path):
    body = "\n".join(f"Line number {'abcdefghij'[i % 10]} of the tale about {'xyzuvw'[i % 6]} and more" for i in range(12))
    texts = [None, "", "123 456", body, body, body + "\nend", "the quick brown fox " * 3, "passage of the benchmark " * 4, "ordinary words that stand here once"]
    rows = [(i, t, "en", "s", 0, "x") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "passage of the benchmark " * 4), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = check(spark, str(tmp_path))
    assert 6 in got and 8 in got and not {0, 1, 2, 4, 7} & set(got)


def test_further_columns_pass_whatever_their_names(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(5)
    from pyspark.sql import functions as F
    extra = {c: F.concat(F.lit(f"{c}:"), F.col("doc_id")) for c in ("score", "lang_pred", "n_removed", "n_words", "contaminated", "simhash", "row")}
    docs = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in out.collect() for c in extra), name


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0).select("*")
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF_DIR)
        assert out.count() == 0 and (name == "byte_bpe" or out.columns == docs.columns)
