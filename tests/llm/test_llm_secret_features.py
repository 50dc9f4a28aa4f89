"""Features, labels and held-out quality of secret findings, against a plain twin."""

import random
import re
from collections import Counter

import pytest

from foldloom.llm import secret_scan


def test_features_against_a_plain_twin(spark):
    rng = random.Random(6)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    words = ["river", "stone", "garden", "Example", "latest", "the", "Key", "config"]
    texts = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(12)]
        own[5] = rng.choice([f"password={hexa(20)}", hexa(40), f"token:{rng.choice(words)}-{hexa(6)}", "AKIA" + "ABCDEFGHIJKLMNO2", "RiverStoneGarden12345", "x" * 20 + "7", f"a/b/c/{hexa(17)}"])
        texts.append((i, " ".join(own), rng.choice(["src/app/main.py", "tests/data.txt", None])))
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    found = secret_scan.judged_findings(df).collect()
    assert len(found) >= 60
    corpus = Counter(w for _, t, _ in texts for w in re.findall(r"[^\W\d_]{3,}", t.lower()))
    mock = re.compile(r"(?i)(?<![a-z])(example|sample|dummy|test|fake|mock|placeholder)(?![a-z])|x{6}")
    for r in found:
        v, size, path = r["value"], len(r["value"]), r["path"] or ""
        kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in v)
        ends = sum(1 for i, k in enumerate(kinds) if k in "dul" and (i + 1 == size or kinds[i + 1] != k))
        covered = sum(len(w) for w in re.findall("[a-z]{3,}", v.lower()) if corpus[w] >= secret_scan.DICTIONARY_COUNT)
        want = {"size": size, "digits": kinds.count("d") / size, "capitals": kinds.count("u") / size, "smalls": kinds.count("l") / size, "distinct": len(set(v)) / size,
                "transitions": ends / size, "slashes": r["word"].count("/"), "hexadecimal": float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", v))), "coverage": covered / size,
                "mock_near": float(bool(mock.search(" ".join((r["before"], r["word"], r["after"]))))), "path_depth": path.count("/"), "path_mock": float(bool(mock.search(path)))}
        for name, value in want.items():
            assert r[name] == pytest.approx(value), (name, v, r)


def test_labelled_findings_teach_the_forest_and_words_have_boundaries(spark):
    rng = random.Random(7)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    texts = [(i, f"the latest password={hexa(40)} here", "x") for i in range(60)] + [(100 + i, f"see commit {hexa(40)} of it", "x") for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    assert all(r["is_secret"] and r["label"] == 1 for r in secret_scan.scan_secrets(df.where("doc_id < 60")).collect())
    labelled = spark.createDataFrame([(r["key"], r["at"], r["run"], int(r["key"] < 100)) for r in secret_scan.judged_findings(df).collect() if r["key"] % 100 < 20],
                                     "doc_id long, at long, run long, label int")
    from pyspark.sql import functions as F
    got = secret_scan.scan_secrets(df, labels=F.lit(None).cast("double"), labelled=labelled).collect()
    assert sum(r["label"] is None for r in got) == 80 and all(r["is_secret"] == (r["doc_id"] < 100) for r in got)
    row = secret_scan.held_out_quality(df, labels=F.lit(None).cast("double"), labelled=labelled).first()
    assert row["n"] > 5 and row["precision"] == row["recall"] == 1.0
