"""BPE, packing, decontamination and language ID against plain twins, on rows with every odd case."""

import random

import numpy as np
import public_tokenizers
import pytest

import brute
from foldloom.llm import bpe, decontamination, language_id, packing
from foldloom.llm.batches import words_of

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, token_ids string, decoded int, score string, lang string"


def odd_texts():
    rng = random.Random(5)
    marks = list("aab  \n\t'sdtrevelm123.,!?éß中　\x1c\x85A")
    return [None, "", " ", "\n\n \n", "a", "a" * 4000, "ab " * 3000, "The MIT License's 42  spaces", "é" * 500, "\n" * 300_000 + "x", "x\r\ny", " lead", "trail ",
            *("".join(rng.choice(marks) for _ in range(rng.randint(1, 60))) for _ in range(60))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "clash", lang) for i, t, lang in rows], SCHEMA)


def test_bpe_matches_reference_encoder_and_round_trips(spark):
    texts = odd_texts()
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "null key", None), (1, "again", None), (1, "again", None)]
    out = bpe.decode(bpe.encode(table(spark, rows), PATH, PATTERN), PATH)
    assert set(out.columns) == {"doc_id", "text", "token_ids", "decoded", "score", "lang"}  # clashing columns are replaced
    coder = brute.encoding()
    same = bpe.encode(table(spark, rows), PATH, PATTERN, library=True)
    assert sorted((bytes(r["token_ids"]) for r in same.collect())) == sorted(bytes(r["token_ids"]) for r in out.collect())
    found = sorted(((r["text"] or "", np.frombuffer(r["token_ids"], "<u4").tolist(), bytes(r["decoded"])) for r in out.collect()))
    assert found == sorted((t or "", coder.encode_ordinary(t or ""), (t or "").encode()) for _, t, _ in rows)
    assert bpe.encode(table(spark, []), PATH, PATTERN).count() == 0


def test_replay_equals_word_by_word_and_takes_lower_ranks_first():
    replay = bpe.Replay(bpe.read_ranks(PATH))
    rng = random.Random(2)
    words = ["".join(rng.choice("abtheion ") for _ in range(rng.randint(1, 25))).encode() for _ in range(3000)] + [b"a" * n for n in range(1, 40)]
    assert replay(words) == [replay.alone(w) for w in words]
    # A vocabulary in which joining "bc" brings up a lower rank than its own: the word goes on there.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"abcd": 258}
    own = bpe.Replay(ranks)
    assert own([b"abcabcd"]) == [own.alone(b"abcabcd")] == [np.array([256, 258], "<u4").tobytes()]


def test_op1_digests(spark, tmp_path):
    from foldloom.llm.queries import op1_byte_bpe

    rows = [(i, t, None) for i, t in enumerate(odd_texts())]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    coder = brute.encoding()
    got = {r[0]: tuple(r)[1:] for r in op1_byte_bpe(spark, str(tmp_path)).collect()}
    assert got == {i: brute.token_row(t, coder) for i, t, _ in rows}


def best_fit(sizes, capacity):
    rows, rooms = [], []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(rows)) if rooms[r] >= sizes[piece]]
        if fits:
            row = min(fits, key=lambda r: rooms[r])
        else:
            row = len(rows)
            rows.append([])
            rooms.append(capacity)
        rows[row].append(piece)
        rooms[row] -= sizes[piece]
    return sorted(rooms)


@pytest.mark.parametrize("capacity", [1, 7, 8, 100])
def test_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) for _ in range(400)]
    rows = packing.best_fit_decreasing(sizes, capacity)
    assert sorted(p for row in rows for p in row) == list(range(400))
    assert sorted(capacity - sum(sizes[p] for p in row) for row in rows) == best_fit(sizes, capacity)


def test_packing_is_lossless(spark):
    rng = random.Random(1)
    docs = [(i, np.array([rng.randint(1, 60000) for _ in range(rng.choice([0, 1, 5, 15, 16, 17, 100]))], "<u4").tobytes(), "clash") for i in range(80)]
    docs += [(None, np.array([7, 8], "<u4").tobytes(), ""), (200, None, ""), (3, docs[3][1], "")]
    df = spark.createDataFrame(docs, "doc_id long, token_ids binary, row string")
    out = packing.pack(df, capacity=16, block_tokens=300).collect()
    pieces = {}
    for r in out:
        ids, places, ends = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(places) == 16 and ends[0] == 0 and ends[-1] == r["n_tokens"] <= 16
        for a, b, doc, start in zip(ends, ends[1:], r["docs"], r["starts"]):
            assert places[a:b].tolist() == list(range(b - a))
            pieces.setdefault(doc, []).append((start, ids[a:b].tolist()))
        assert not ids[ends[-1]:].any()
    joined = {d: [x for _, part in sorted(p, key=lambda q: q[0]) for x in part] for d, p in pieces.items() if d != 3}
    want = {d: np.frombuffer(raw, "<u4").tolist() for d, raw, _ in docs if raw and d != 3}
    assert joined == want
    assert sum(len(x) for _, x in pieces.get(3, [])) == 2 * len(docs[3][1]) // 4
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        packing.pack(spark.createDataFrame([(1, np.array([70000], "<u4").tobytes())], "doc_id long, token_ids binary")).collect()


def test_op2_packs_every_token(spark, tmp_path):
    from foldloom.llm.queries import op2_token_packing

    rows = [(i, t, None) for i, t in enumerate(odd_texts())]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    coder, total = brute.encoding(), {}
    for r in op2_token_packing(spark, str(tmp_path)).collect():
        for a, b, doc in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["docs"]):
            total[doc] = total.get(doc, 0) + b - a
    assert total == {i: n for i, t, _ in rows if (n := len(coder.encode_ordinary(t or "")))}


def test_decontamination_against_all_windows(spark):
    rng = random.Random(3)
    few = ["un", "deux", "trois", "vier", "fünf"]
    say = lambda n: " ".join(rng.choice(few) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 8, 12, 13, 14, 30])) if i % 5 else say(40)) for i in range(3, 9)] + [(1, None), (2, ""), (None, say(20)), (4, say(13))]
    texts = [None, "", "...", *(say(rng.randint(1, 80)) for _ in range(60)), *(say(5) + ". " + (t or "") + "! " + say(3) for _, t in items),
             "Clean words " * 500 + (items[0][1] or "")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[5]])], "doc_id long, text string, n_hit string")
    out = decontamination.decontaminate(df, decontamination.item_words(bench), cleaned="clean").collect()
    for r in out:
        want = brute.contamination(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], brute.sha(",".join(r["items"]).encode()), r["contaminated"]) == want
        assert sum(s["length"] for s in r["hit_spans"]) == want[1]
        assert len(brute.words(r["clean"])) == want[0] - want[1]
    assert len(out) == len(texts) + 1
    none = decontamination.decontaminate(df, decontamination.item_words(bench.limit(0))).collect()
    assert {r["n_hit"] for r in none} == {0} and decontamination.decontaminate(df.limit(0), []).count() == 0


def test_long_windows_only(spark):
    """Without short items, runs of known words below 13 cannot hit."""
    item = " ".join(f"w{i}" for i in range(30))
    own = item.split()
    texts = [" ".join(own[:12]), " ".join(own[4:17]), " ".join(own[:12] + ["x"] + own[12:25]), item.upper() + " x " * 100, " ".join(reversed(own))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.decontaminate(df, [("1", words_of(item.encode()))]).collect()}
    assert got == {i: brute.contamination(t, [(1, item)])[:2] for i, t in enumerate(texts)}


def test_language_profiles_and_distances(spark):
    rng = random.Random(4)
    parts = {"aa": "ba ra ta mi lo".split(), "bb": "ölk üst ränz tsch".split(), "cc": "кот дом лес".split()}
    rows = []
    for i in range(150):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))).title() for _ in range(rng.randint(1, 60))), lang))
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 34 !?", "aa"), (None, "bara tami", "cc"), (503, "mita lora", None), (503, "mita lora", None), (504, "İx ß", "aa")]
    df = table(spark, rows)
    from foldloom.llm.queries import taught

    learned = taught(df)
    want = brute.profiles(rows)
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    assert learned == {lang: [number(g) for g in own] for lang, own in want.items()}
    found = language_id.identify(df, learned).collect()
    assert len(found) == len(rows)
    for r in found:
        lang, score = brute.language(r["text"], want)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-12 and 0 <= r["score"] <= 1
    held = [r for r in found if brute.held_out(r["doc_id"]) and r["lang"] and r["text"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held if len(r["text"]) > 5) > 0.95 * sum(len(r["text"]) > 5 for r in held)
    nothing = taught(df.limit(0))
    assert nothing == {} and {r["lang_pred"] for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), learned).count() == 0


def test_language_of_given_documents_held_out(spark):
    from foldloom.llm.queries import op7_language_id

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = brute.profiles(rows)
    found = {r["doc_id"]: r for r in op7_language_id(spark, sf_dir).collect()}
    held = [(d, t, lang) for d, t, lang in rows if brute.held_out(d)]
    assert all(found[d]["held_out"] for d, *_ in held) and sum(r["held_out"] for r in found.values()) == len(held)
    assert sum(found[d]["lang_pred"] == lang for d, _, lang in held) >= 0.95 * len(held)
    assert all(found[d]["lang_pred"] == brute.language(t, want)[0] for d, t, _ in held[:40])


def test_packing_refuses_positions_that_do_not_fit(spark):
    ids = spark.createDataFrame([(1, b"\x01\x00\x00\x00" * 70_000)], "doc_id short, token_ids binary")
    with pytest.raises(ValueError, match="do not fit"):
        packing.pack(ids, capacity=70_000)
    row = packing.pack(ids, capacity=70_000, width="uint32").first()
    assert row["n_tokens"] == 70_000 and row["docs"] == [1] and int.from_bytes(row["positions"][4 * 65_536:4 * 65_537], "little") == 65_536
    assert packing.pack(ids, capacity=65_536).count() == 2


def test_benchmarks_in_shards_hit_like_one_automaton(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(30)}"
    items = [(f"i{i}", " ".join(word() for _ in range(rng.choice([1, 5, 13, 20, 40])))) for i in range(25)] + [("i3", None), (None, "lone words here")]
    texts = [" ".join([*(word() for _ in range(rng.randint(0, 30))), rng.choice(items)[1] or "x", rng.choice(items)[1] or "y", *(word() for _ in range(20))]) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    one = decontamination.decontaminate_by(df, benchmark, cleaned="clean", longest=13)
    monkeypatch.setattr(decontamination, "MAX_ITEM_CHARACTERS", 700)
    many = decontamination.decontaminate_by(df, benchmark, cleaned="clean", longest=13)
    assert many.columns == one.columns
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    for r in one.collect():
        long_spans = [s for s in r["hit_spans"] if s["length"] > 13]
        gone = r["n_hit"] if r["contaminated"] else sum(s["length"] for s in long_spans)
        assert len(words_of(r["clean"].encode())) == r["n_words"] - gone
