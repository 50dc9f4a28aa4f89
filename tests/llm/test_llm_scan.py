"""License and secret scans, URL reputation, against plain twins."""

import random
import re

import pytest

import brute
from foldloom.llm import license_scan, secret_scan, url_reputation


def test_licenses_against_every_line_and_template(spark):
    rng = random.Random(1)
    templates = [t[1] for t in license_scan.TEMPLATES]
    texts = [None, "", "\n\n", "MIT", "mit license", "The MIT-LICENSE, mit license\nMIT\nLicense", "Apache License apache license general public license",
             "licence mit license. x", "ÉMIT license", "KIT mit license", "no mit licenses", "word " * 30_000 + "mit license", *templates]
    for _ in range(60):
        words = re.split(r"\W+", rng.choice(templates))
        rng.shuffle(words)
        keep = words[:max(1, int(len(words) * rng.choice([.5, .75, .8, .85, 1])))]
        texts.append("intro line\n" + " ".join(keep + ["other"] * rng.randint(0, 3)).upper() + "\n" + rng.choice(["", "mit license", "x"]))
    rows = [(i, t, "x", 2) for i, t in enumerate(texts)] + [(None, "MIT License", "x", 2), (5, texts[5], "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, row int")
    got = license_scan.scan_licenses(df).collect()
    plain = lambda t: tuple(round(x, 9) if isinstance(x, float) else x for x in t)
    want = [(i, *plain(brute.licenses(t, license_scan.PHRASES, license_scan.TEMPLATES))) for i, t, *_ in rows]
    assert sorted(map(str, (plain(tuple(r)) for r in got))) == sorted(map(str, want))
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
    assert {r["labels"] for r in license_scan.scan_licenses(df, templates=()).collect()} == {w[5] for w in want}


def test_each_notice_has_the_label_of_its_license_alone(spark):
    """Every notice on one line, wrapped, and inside other text; and sister notices that differ in one word."""
    sisters = {"Released under the Apache License.": "apache", "Released under the BSD License.": "bsd", "Licensed under CC BY 4.0.": "cc-by",
               "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under CC BY-NC-SA 4.0.": "", "Released under the Zlib License.": "",
               "cc 4 licensed under CC BY-SA 4.0": "cc-by-sa", "sa vie\nLicensed under CC BY 4.0.\nc'est sa vie": "cc-by"}
    whole = {t: label for label, t, *_ in license_scan.TEMPLATES}
    forms = [(t, label) for t, label in whole.items()]
    forms += [("# " + "\n#  ".join(" ".join(part) for part in (t.split()[i:i + 4] for i in range(0, len(t.split()), 4))), label) for t, label in whole.items()]
    forms += [(f"some words before. {t} And {'more ' * 40}", label) for t, label in whole.items()] + list(sisters.items())
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(forms)], "doc_id int, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(df).collect()}
    assert [(forms[i][0], got[i]) for i in sorted(got)] == forms


def test_templates_take_several_passes_and_long_texts_chunks(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["mit", "license", "under", "the", "released", "cc", "by", "x", "sa", "4", "0", "licensed"]) for _ in range(400)) for _ in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    plain = sorted(map(str, license_scan.scan_licenses(df).collect()))
    monkeypatch.setattr(license_scan, "CHUNK", 7)
    monkeypatch.setattr(license_scan, "TEMPLATES_AT_ONCE", 4)
    assert sorted(map(str, license_scan.scan_licenses(df).collect())) == plain
    want = [brute.licenses(t, license_scan.PHRASES, license_scan.TEMPLATES)[5] for t in texts]
    assert [r["labels"] for r in license_scan.scan_licenses(df).orderBy("doc_id").collect()] == want


def test_overlapping_phrases_count_each_place(spark):
    df = spark.createDataFrame([(1, "a a a b a a")], "doc_id long, text string")
    row = license_scan.scan_licenses(df, phrases={"a a": "twice"}, templates=(("other", "q r s"),)).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (3, 0, 4, "twice")


URLS = [None, "", "example.org/es/", "http://example.org/es/1", "HTTP://WWW.Example.ORG/es/x?q=/de/", "http://example.org/en/12", "http://example.org/en/2",
        "http://notexample.org/es/", "http://a.com/fr/1", "http://a.com/de/", "http://a.com", "http://a.com?x=/de/", "http://a.com#/de/", "http://org", "http://org/", "ftp://x.net/de/1://y",
        "://lone.com/de/", "http:///de/", "http://a.com:80/de/", "http://u@b.com/de/", "http://ÄB.com/de/\nx", "http://com/de/", "http://xcom/de/", "http://example.org/ES/"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(brute.LOWER), slash + path


def rule(host, path):
    fits = [(len(r), r, v) for v, r in url_reputation.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fits, default=(0, None, None))[1:]


def test_rules_and_parts(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://a.com/fr/", "", ""), (3, URLS[3], "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = url_reputation.filter_urls(df, spark.createDataFrame([], "page_id long, bad boolean")).collect()
    want = []
    for i, u, *_ in rows:
        host, path = parts(u)
        name, verdict = rule(host, path)
        want.append((i, host, path, name, verdict or "allow"))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    assert url_reputation.filter_urls(df.limit(0), spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


def twin_strength(groups):
    groups = [(n, k) for n, k in groups if n]
    n, k = sum(g[0] for g in groups), sum(g[1] for g in groups)
    return url_reputation.strength(n, k, len(groups), sum(g[0] ** 2 for g in groups), sum(g[1] ** 2 * 1_000_000 // g[0] for g in groups) / 1e6)


def test_bad_hosts_are_blocked_and_rare_ones_shrunk(spark):
    hosts = {"good.shop.net": (400, 8), "evil.spam.net": (300, 291), "new.spam.net": (2, 2), "x.good.info": (50, 1), "y.good.info": (60, 0), "one.else.info": (1, 1)}
    pages, outcomes, number = [], [], 0
    for host, (n, k) in hosts.items():
        for i in range(n):
            pages.append((number, f"http://{host}/p{i}"))
            outcomes += [(number, i < k), (number, False)] if i % 7 == 0 else [(number, i < k)]
            number += 1
    pages += [(number, "http://other.spam.net/"), (number + 1, "http://quite.new.zone/")]
    outcomes += [(number, None), (10**9, True)]
    out = url_reputation.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad boolean"))
    got = {r["host"]: (r["rate"], r["bound"], r["verdict"]) for r in out.collect()}
    counts = {**hosts, "other.spam.net": (0, 0), "quite.new.zone": (0, 0)}
    fold = lambda table, f: {g: tuple(map(sum, zip(*(v for h, v in table.items() if f(h) == g)))) for g in {f(h) for h in table}}
    domains = fold(counts, lambda h: ".".join(h.split(".")[-2:]))
    suffixes = fold(domains, lambda h: h.split(".")[-1])
    a, b, c = twin_strength(counts.values()), twin_strength(domains.values()), twin_strength(suffixes.values())
    n, k = map(sum, zip(*suffixes.values()))
    for host, (own_n, own_k) in counts.items():
        domain, suffix = ".".join(host.split(".")[-2:]), host.split(".")[-1]
        rate = (suffixes[suffix][1] + c * (k + 1) / (n + 2)) / (suffixes[suffix][0] + c)
        rate = (domains[domain][1] + b * rate) / (domains[domain][0] + b)
        rate = (own_k + a * rate) / (own_n + a)
        bound = rate - 1.645 * (rate * (1 - rate) / (own_n + a + 1)) ** .5
        assert got[host][:2] == pytest.approx((rate, bound), abs=2e-6)
    assert got["evil.spam.net"][2] == "block" and got["good.shop.net"][2] == got["quite.new.zone"][2] == got["one.else.info"][2] == "allow"


def secret_rows():
    rng = random.Random(3)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n - 2)) + "A2"
    rows = []
    for i in range(40):
        rows += [(f"some words password={hexa(18)} follow", 1), (f'here token = "{hexa(40)}" ends', 1), (f"key id AKIA{upper(16)} is set", 1),
                 (f"card {rng.randint(10**15, 10**16 - 1)} was used", 0), (f"see {'WORD' * 5}!! here", 0), (f"example password={hexa(20)} only a sample", 0), ("plain small words only", None)]
    return rows


def candidates(text):
    own = re.split(r"\s+", text or "")
    return [(i, re.search(secret_scan.VALUE, w).group()) for i, w in enumerate(own)
            if len(w) >= 16 and re.search(secret_scan.VALUE, w) and re.search(secret_scan.SHAPE, w)]


def test_secrets_found_and_false_ones_removed(spark):
    rows = secret_rows()
    texts = [t for t, _ in rows] + [None, "", "x" * 300 + "1" * 100_000]
    df = spark.createDataFrame([(i, t, None if i % 3 else "tests/a/b.py", "x") for i, t in enumerate(texts)] + [(None, rows[0][0], "", "y"), (0, rows[0][0], "", "y")],
                               "doc_id long, text string, source string, label string")
    got = secret_scan.scan_secrets(df).collect()
    want = [(d, at, brute.sha(value.encode())) for d, t in [*enumerate(texts), (None, rows[0][0]), (0, rows[0][0])] for at, value in candidates(t)]
    assert sorted(map(str, ((r["doc_id"], r["at"], r["value_sha256"]) for r in got))) == sorted(map(str, want))
    truth = {i: label for i, (_, label) in enumerate(rows)}
    judged = [(truth[r["doc_id"]], r["is_secret"]) for r in got if r["doc_id"] in truth]
    assert sum(bool(a) == b for a, b in judged) >= 0.97 * len(judged)
    assert secret_scan.scan_secrets(df.limit(0), path=None).count() == 0


def test_one_label_or_none_needs_no_forest(spark):
    df = spark.createDataFrame([(1, "card 4000038985693383 here")], "doc_id long, text string")
    assert secret_scan.scan_secrets(df, path=None).first()["probability"] == 0.0
    df = spark.createDataFrame([(1, "odd aB3dE6gH9jK2mN5pQ8 here")], "doc_id long, text string")
    assert secret_scan.scan_secrets(df, path=None).first()["probability"] == 0.5
