"""Personal data: base spans against the plain patterns, disclosing terms against plain counts and against the SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldloom.llm import privacy, privacy_queries
from oracle import compare

PLAIN = {kind: re.compile(p.replace(r"\x20", " ")) for kind, p in privacy_queries._PATTERNS.items()}
WORD = re.compile(privacy.WORD)
LOWER = str.maketrans(privacy.CAPITALS, privacy.SMALLS)


def right(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), n, m.end()) for n, kind in enumerate(PLAIN) for m in PLAIN[kind].finditer(text or "") if right(kind, m.group()))


def written(spans):
    return ",".join(f"{privacy.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def random_texts():
    rng = random.Random(4)
    parts = ["a", "B9", "@", ".", "-", "_", "%", "+", "1", "255", "256", "007", "10.0.0.1", "x@y.z", "a.b@c-d.e.f", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1112",
             " ", "  ", "(", ")", "é", "😀", "\n", "0" * 14, "5" * 30, "@@", "..", "@a.b", "1.2.3.4.5.6.7.8.9", "+49 30 1234567890123", "000.000.000.0000255"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(600)]


def test_base_spans_against_the_plain_patterns(spark):
    texts = [None, "", *random_texts(), "a@b.c_d@e.f", "a@b.c@d.e", "a" * 50_000, "a@" * 20_000, "1." * 20_000, "+1" + "(" * 50_000, "x@y" + ".z" * 20_000, "1 " * 30_000,
             " ".join(f"u{i}@mail.example.com" for i in range(5_000))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[5], "y", 2), (3, texts[3], "y", 2)], "doc_id long, text string, spans string, kind int")
    got = privacy.find_personal_data(df).select("doc_id", "text", privacy.written(F.col("base")).alias("base")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["base"] == written(base(r["text"])), r["text"][:100]


def near_terms(text, start, end, before, after):
    left, behind = text[before:start], text[end:after]
    left = re.sub(f"^{privacy.WORD}", "", left[-privacy.NEAR:]) if len(left) > privacy.NEAR else left
    behind = re.sub(f"{privacy.WORD}$", "", behind[:privacy.NEAR]) if len(behind) > privacy.NEAR else behind
    return {w for w in WORD.findall((left + " " + behind).translate(LOWER)) if len(w) >= 3}


def disclosed(texts, least_rows, generalise):
    pairs, entities, rows, where = Counter(), Counter(), Counter(), {}
    for text in texts:
        own = set()
        for kind, pattern in PLAIN.items():
            found = [m.span() for m in pattern.finditer(text)]
            for i, (s, e) in enumerate(found):
                value = text[s:e]
                if right(kind, value):
                    name = f"{kind}:" + (value.translate(LOWER) if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value))
                    own.add((name, ""))
                    own |= {(name, t) for t in near_terms(text, s, e, found[i - 1][1] if i else 0, found[i + 1][0] if i + 1 < len(found) else len(text))}
        for pair in own:
            pairs[pair] += 1
            where.setdefault(pair, set()).add(text)
            entities[pair[0]] += pair[1] == ""
        rows.update({w for w in WORD.findall(text.translate(LOWER)) if len(w) >= 3})
    out = {}
    for (name, term), n in pairs.items():
        if term and n >= least_rows and len(where[name, term]) > 1 and entities[name] < len(texts):
            share = round(1 + math.log(n / rows[term]) / math.log(len(texts) / entities[name]), 9)
            if share >= generalise:
                out[term] = max(share, out.get(term, 0))
    return out


def corpus():
    """People with an address that stand beside their name and nickname; common words; copies; one document of everything."""
    rng = random.Random(9)
    common = ["the", "and", "Report", "meeting", "über", "data", "a", "of", "12"]
    filler = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = []
    for i in range(300):
        texts.append(filler(rng.randint(5, 60)))
    for i in range(12):
        texts.append(f"{filler(20)} Jolanda Quentz, jolanda@example.org {filler(3)} room K77 {filler(30)}")
        texts.append(f"{filler(9)}\nCall Bertil: +46 70 123 45 {60 + i % 2} or 10.20.30.40 {filler(4)}")
    texts += [f"{filler(4)} quentz {filler(4)}", f"{filler(2)} K77 {filler(2)}", "jolanda@example.org Jolanda"]
    texts += [texts[300]] * 7 + ["unique@example.org Zebulon"] * 9 + ["", None]
    rng.shuffle(texts)
    return texts


def test_disclosing_terms_against_plain_counts(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = disclosed([t or "" for t in texts], privacy.LEAST_ROWS, privacy.GENERALISE)
    got = {r["term"]: r["disclosure"] for r in privacy.disclosing_terms(df).collect()}
    assert got == pytest.approx(want) and {"jolanda", "quentz", "k77", "bertil"} <= set(got) and not {"the", "zebulon", "data"} & set(got)
    for r in privacy.find_personal_data(df).collect():
        text, own = r["text"], base(r["text"])
        assert [tuple(s) for s in r["base"]] == own
        places = [(m.start(), m.end()) for m in WORD.finditer(text.translate(LOWER)) if m.group() in want]
        apart = [(s, 4, e, want[text[s:e].translate(LOWER)] >= privacy.REMOVE) for s, e in places if not any(b < e and s < c for b, _, c in own)]
        assert [tuple(t) for t in r["terms"]] == apart


def test_sql_where_terms_disclose(spark, tmp_path):
    import duckdb

    rows = [(i, t) for i, t in enumerate(corpus())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = privacy_queries.op11_pii(spark, str(tmp_path))
    assert compare(df, con, privacy_queries.OP11_SQL) is None
    sums = {r["doc_id"]: r["base_sha256"] for r in df.collect()}
    assert all(sums[i] == hashlib.sha256(written(base(t)).encode()).hexdigest() for i, t in rows)


def test_sanitised_texts(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in privacy.sanitise(df).collect()}
    for i, text in enumerate(texts):
        out = got[i]["text"]
        assert "@" not in out and "quentz" not in out.lower() and (text or "").count("the") == out.count("the")
        if text and not base(text) and not re.search("quentz|k77|bertil|jolanda", text, re.IGNORECASE):
            assert out == text and got[i]["n_base"] == got[i]["n_generalised"] == got[i]["n_removed"] == 0
    assert privacy.sanitise(df.limit(0)).count() == 0
