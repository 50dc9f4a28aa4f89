"""Every run of a word is a secret candidate, with the name it is assigned to."""

import brute
from foldloom.llm import secret_scan

KEY, OTHER = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzEXAMPL", "Zq81kdLs0293mvnQpW77"


def found(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["at"], r["run"], r["value"]) for r in secret_scan.candidates(df, path=None).orderBy("at", "run").collect()]


def test_all_runs_of_a_word(spark):
    assert found(spark, f"set AWS_SECRET_ACCESS_KEY={KEY} now") == [(1, 1, KEY)]
    assert found(spark, f'{{"access_token":"{KEY}","id":"{OTHER}"}}') == [(0, 0, KEY), (0, 1, OTHER)]
    assert found(spark, f"https://host.example/a/long/path/to/page2?token={OTHER}")[-1] == (0, 1, OTHER)
    assert [v for *_, v in found(spark, f"{KEY}.{OTHER}.{KEY}")] == [KEY, OTHER, KEY]


def test_short_and_plain_values_behind_a_key_name(spark):
    assert found(spark, 'x password=hunter2 y {"secret":"correcthorsebatterystaple"} api_key:\'a-b\' other=hunter2 keyword') == [
        (1, 0, "hunter2"), (3, 0, "correcthorsebatterystaple"), (4, 0, "a-b")]


def test_a_shaped_word_keeps_its_runs(spark):
    assert found(spark, "plainlettersofakey!9 QUITEPLAINCAPITALS") == [(0, 0, "plainlettersofakey"), (1, 0, "QUITEPLAINCAPITALS")]
    assert found(spark, "abcdefghijklmnopqrst1234==") == [(0, 0, "abcdefghijklmnopqrst1234")]


def test_the_name_left_of_a_run_tells_a_key(spark):
    hexa = "0f3a" * 6
    df = spark.createDataFrame([(1, f'{{"password":"{hexa}","colour_of_it":"{hexa[::-1]}"}}'), (2, f"MY_APP_SECRET_VALUE={hexa}")], "doc_id long, text string")
    rows = {(r["doc_id"], r["value_sha256"]): r["label"] for r in secret_scan.scan_secrets(df, path=None).collect()}
    assert rows == {(1, brute.sha(hexa.encode())): 1.0, (1, brute.sha(hexa[::-1].encode())): None, (2, brute.sha(hexa.encode())): 1.0}
