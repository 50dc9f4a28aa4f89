"""Near-duplicates of the pipeline against all pairs of shingle sets."""

import random

import pytest

import brute
import corpus_pipeline
from foldloom.llm import shingle_dedup


def edited(rng, text, n):
    own = text.split()
    for at in rng.sample(range(len(own)), n):
        own[at] = f"w{rng.randrange(10**6)}"
    return " ".join(own)


@pytest.mark.parametrize("sampled", [32, 1])
def test_stage_drops_what_is_similar_and_nothing_else(spark, monkeypatch, sampled):
    monkeypatch.setattr(shingle_dedup, "SAMPLED", sampled)
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(30))
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three four five", "one two three four five six"]
    for group in range(6):
        base = " ".join(f"{rng.choice('abcdef')}{rng.randrange(40)}" for _ in range(rng.choice([20, 60, 150]))) + (" " + common if group % 2 else "")
        texts += [edited(rng, base, rng.choice([0, 1, 1, 2, 3, 4])) for _ in range(14)] + [base.upper() + "\n"]
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, source string")
    out = corpus_pipeline.remove_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == brute.similar_kept(rows)


def test_two_edited_words_in_a_hundred_are_a_copy(spark):
    """Fingerprints of such pairs are mostly more than 3 bits apart."""
    rng = random.Random(9)
    rows = []
    for i in range(20):
        text = " ".join(f"{rng.choice('abcdef')}{rng.randrange(900)}" for _ in range(104))
        rows += [(2 * i, text), (2 * i + 1, edited(rng, text, 2))]
    assert brute.similar_kept(rows) == list(range(0, 40, 2))
    out = corpus_pipeline.remove_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(0, 40, 2))


def test_no_join_on_exploded_or_repeated_tokens_is_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    tokens = plan(shingle_dedup.with_token(spark.range(1000).toDF("token"), spark.range(100).toDF("token")))
    probes = plan(shingle_dedup.near_pairs(spark.range(1000).toDF("print"), "print"))
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in (tokens, probes))


def test_stage_takes_fingerprint_links_first(spark, monkeypatch):
    """All links of fingerprints over five words are found, by equal and near fingerprints, and reach the check on the texts."""
    from foldloom.llm.simhash_dedup import fingerprint

    rng = random.Random(10)
    texts = ["", " \n"]
    for _ in range(4):
        base = " ".join(f"{rng.choice('abcdef')}{rng.randrange(900)}" for _ in range(300))
        texts += [base, base + " ", base.upper()] + [edited(rng, base, n) for n in (1, 1, 1, 2, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    node = {r["text"]: r["node"] for r in df.select("text", shingle_dedup.node_of("text").alias("node")).collect()}
    prints = {node[t]: fingerprint(t.encode(), 5) for t in texts if t.strip()}
    linked = {frozenset((a, b)) for a in prints for b in prints if a != b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 3}
    first, near = shingle_dedup.fingerprint_pairs(df, "text")
    got = {frozenset((r["a"], r["b"])) for r in first.unionByName(near).collect()}
    hubs = {min(n for n in prints if prints[n] == prints[m]) for m in prints}
    assert got <= linked and {p for p in linked if p <= hubs or prints[min(p)] == prints[max(p)] and p & hubs} <= got and len(linked) > 16
    checked, plain = [], shingle_dedup.similar
    monkeypatch.setattr(shingle_dedup, "similar", lambda close, *rest: checked.append({frozenset((r["a"], r["b"])) for r in close.collect()}) or plain(close, *rest))
    corpus_pipeline.remove_near_duplicates(spark, df, "").collect()
    assert checked[0] <= linked and len(checked[0]) >= 8
