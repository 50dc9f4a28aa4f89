"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Addresses, card and phone numbers are found by their shape; these are the protected entities. What stands around an entity can give it away too:
with p(e) the share of rows that hold entity e, its information content is log 1/p(e), and a term t near it discloses
PMI(t, e) = log p(t, e) / (p(t) p(e)) of that. Terms that disclose more than a limit are generalised to their word class, those above a higher limit
removed, wherever they occur. Counts are taken over the whole corpus: pairs of entity and near term, then the rows of every such term.

Spans are counted in code points, the end is exclusive. A text is matched and measured inside its row: matches and the pieces between them have
lengths, and starts are running sums of these, so nothing of a text is shuffled to find its base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.plans.stage import stage

# Fixed patterns in their order. A start inside a run whose start failed can only fail too, so runs are tried once, or where the last match ended;
# possessive quantifiers take what the greedy ones would end with. Both keep the time in proportion to the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
# A text without this has no match.
HINTS = {"email": "@", "ip": "[0-9][.][0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "[+][0-9]"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points on either side of an entity in which terms count as near, and a term's least length.
NEAR, LEAST_LENGTH = 80, 3
#: A pair of entity and term counts as evidence from so many rows on, and in more than one text.
LEAST_ROWS = 5
#: Shares of an entity's information above which a term is generalised, or removed.
GENERALISE, REMOVE = 0.8, 0.9
_CHUNK = 64


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often and inside whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def starts(lengths: Column) -> Column:
    """Running sums before each element: by chunks, so that a list of n costs n times the chunk, and no list is built up element by element."""
    def inside(sums: Column):
        return lambda chunk, c: bound(_total(F.slice(sums, 1, c)), lambda before: F.transform(chunk, lambda x, i: before + _total(F.slice(chunk, 1, i))))

    def chunked(values: Column) -> Column:
        count = F.floor((F.size(values) - 1) / _CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), count), lambda c: F.slice(values, c * _CHUNK + 1, _CHUNK))
        return bound(chunks, lambda parts: bound(F.transform(parts, _total), lambda sums: F.flatten(F.transform(parts, inside(sums)))))

    return bound(lengths, lambda values: F.when(F.size(values) > 0, chunked(values)).otherwise(F.array().cast("array<int>")))


def placed(values: Column, gaps: Column) -> Column:
    """Starts of the matches ``values`` of a text with pieces of the lengths ``gaps`` around them (one more than matches)."""
    def use(own: Column) -> Column:
        steps = F.transform(values, lambda v, i: F.length(v) + F.get(own, i + 1))
        return F.transform(starts(steps), lambda s: s + F.get(own, F.lit(0)))

    return bound(gaps, use)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.pmod(_total(doubled), F.lit(10)) == 0


def valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def entity(kind: str, value: Column) -> Column:
    """One form for all spellings of an entity."""
    form = {"email": F.translate(value, CAPITALS, SMALLS), "ip": value}.get(kind, _digits(value))
    return F.concat(F.lit(f"{kind}:"), form)


def _near_terms(before: Column, after: Column, cut_before: Column, cut_after: Column) -> Column:
    """Distinct terms of the text right before and behind an entity; a word that the limit cuts is none."""
    left = F.when(cut_before, F.regexp_replace(before, f"^{WORD}", "")).otherwise(before)
    right = F.when(cut_after, F.regexp_replace(after, f"{WORD}$", "")).otherwise(after)
    return terms(F.concat_ws(" ", left, right))


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    found = F.split(F.translate(text, CAPITALS, SMALLS), f"{BETWEEN}+")
    return F.array_distinct(F.filter(found, lambda w: F.length(w) >= LEAST_LENGTH))


def _described(number: int, kind: str) -> tuple[Column, Column]:
    """Spans of the valid matches of a kind, and their pairs of entity and near term."""
    values, at, gaps, pieces = (F.col(f"{kind}_{c}") for c in ("values", "starts", "gaps", "pieces"))

    def span(start: Column, i: Column) -> Column:
        value = F.get(values, i)
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + F.length(value)).alias("end"), valid(kind, value).alias("valid"))

    def near(value: Column, i: Column) -> Column:
        name = entity(kind, value)
        around = _near_terms(F.right(F.get(pieces, i), F.lit(NEAR)), F.left(F.get(pieces, i + 1), F.lit(NEAR)), F.get(gaps, i) > NEAR, F.get(gaps, i + 1) > NEAR)
        own = F.transform(around, lambda t: F.concat(name, F.lit("\t"), t))
        return F.when(valid(kind, value), F.array_append(own, F.concat(name, F.lit("\t"))))

    found = F.transform(F.filter(F.transform(at, span), lambda x: x["valid"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    pairs = F.flatten(F.filter(F.transform(values, near), lambda x: x.isNotNull()))
    return F.coalesce(found, F.array().cast("array<struct<start:int,kind:int,end:int>>")), F.coalesce(pairs, F.array().cast("array<string>"))


def base_spans(df: DataFrame, key: str, text: str, near: bool = False) -> DataFrame:
    """(key, text, spans): base spans (start, kind, end) sorted, kind being its place in ``KINDS``. With ``near`` also (pairs): the distinct
    pairs of entity and near term of the row, and its distinct entities, as strings that a tab divides (no term holds one)."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    for kind, pattern in PATTERNS.items():
        hit = F.col("text").contains("@") if kind == "email" else F.col("text").rlike(HINTS[kind])
        rows = rows.withColumns({f"{kind}_values": F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))),
                                 f"{kind}_pieces": F.when(hit, F.split("text", pattern, -1))})
        size = F.transform(f"{kind}_pieces", F.length)
        rows = rows.withColumn(f"{kind}_gaps", F.when(F.size(f"{kind}_values") > 0, size))
        rows = rows.withColumn(f"{kind}_starts", F.when(F.size(f"{kind}_values") > 0, placed(F.col(f"{kind}_values"), F.col(f"{kind}_gaps"))))
    spans, pairs = zip(*(_described(number, kind) for number, kind in enumerate(PATTERNS)), strict=True)
    out = {"spans": F.array_sort(F.concat(*spans))}
    if near:
        out["pairs"] = F.array_distinct(F.concat(*pairs))
    return rows.select("key", "text", *(c.alias(n) for n, c in out.items()))


def _text_key() -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")]


def disclosing_terms(df: DataFrame, text: str = "text", least_rows: int = LEAST_ROWS, generalise: float = GENERALISE) -> DataFrame:
    """(term, entity, rows, near_rows, entity_rows, disclosure): of each term that discloses ``generalise`` of an entity's information or more, the entity of which
    it discloses most (then the smallest). ``rows`` holds the term, ``near_rows`` has it near the entity: ``least_rows`` at least, with two texts or more.

    disclosure = PMI / information = 1 + ln(near_rows / rows) / ln(N / entity_rows). An entity that every row holds has no information to disclose.
    """
    docs = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = docs.count()
    # The outer form keeps Spark from computing the list again for a filter on it.
    met = base_spans(docs.withColumn("none", F.lit(None).cast("long")), "none", "text", near=True).select(
        F.xxhash64("text").alias("h"), F.explode_outer("pairs").alias("pair")).where("pair is not null")
    counted = met.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), (F.min("h") != F.max("h")).alias("several")).where((F.col("n") >= least_rows) & F.col("several"))
    parts = stage(counted.select(F.substring_index("pair", "\t", 1).alias("entity"), F.substring_index("pair", "\t", -1).alias("term"), "n"))
    entities = parts.where("term = ''").select("entity", F.col("n").alias("entity_rows"))
    pairs = parts.where("term <> ''").select("entity", "term", F.col("n").alias("near_rows"))
    words = docs.select(F.explode_outer(terms(F.col("text"))).alias("term")).where("term is not null")
    # Words are counted before they meet the pairs: what a task hands on is its vocabulary, however common the terms of pairs are.
    rows = words.groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    known = pairs.join(entities, "entity").join(rows, "term").where(F.col("entity_rows") < total)
    share = F.round(1 + F.log(F.col("near_rows") / F.col("rows")) / F.log(F.lit(total) / F.col("entity_rows")), 9)
    scored = known.withColumn("disclosure", share).where(F.col("disclosure") >= generalise)
    most = F.max_by(F.struct("entity", "rows", "near_rows", "entity_rows", "disclosure"), F.struct("disclosure", F.struct(-F.xxhash64("entity"), F.col("entity"))))
    return scored.groupBy("term").agg(most.alias("m")).select("term", "m.*")


def term_spans(df: DataFrame, disclosed: DataFrame, text: str = "text") -> DataFrame:
    """(h, g, terms): of each distinct text (by its hashes) the places (start, kind, end, removed) of disclosed terms (term, removed)."""
    docs = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = docs.select(*_text_key(), F.explode_outer(terms(F.col("text"))).alias("term")).where("term is not null")
    hit = stage(words.join(disclosed.select("term"), "term", "left_semi").select("h", "g").distinct())
    own = docs.select("text", *_text_key()).join(hit, ["h", "g"], "left_semi").dropDuplicates(["h", "g"])
    # One character lies between two pieces, so their lengths alone place them.
    pieces = own.select("h", "g", F.split(F.translate("text", CAPITALS, SMALLS), BETWEEN, -1).alias("pieces"))
    at = pieces.select("h", "g", "pieces", starts(F.transform("pieces", lambda p: F.length(p) + 1)).alias("at"))
    each = at.select("h", "g", F.explode_outer(F.arrays_zip("at", "pieces")).alias("x")).select("h", "g", F.col("x.at").alias("start"), F.col("x.pieces").alias("term"))
    found = each.where(F.length("term") >= LEAST_LENGTH).join(disclosed.select("term", "removed"), "term")
    return found.groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct(  # at most the words of one text
        "start", F.lit(len(PATTERNS)).alias("kind"), (F.col("start") + F.length("term")).alias("end"), "removed"))).alias("terms"))


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", least_rows: int = LEAST_ROWS, generalise: float = GENERALISE,
                       remove: float = REMOVE) -> DataFrame:
    """(key, text, base, terms) of every row: base spans (start, kind, end), and disclosed terms (start, kind, end, removed) that no base span touches; both sorted.

    Null texts are empty and have no spans; null and repeated keys are allowed, repeated rows have equal results and count as rows of the corpus; of
    ties of disclosure one entity is named. An empty table gives an empty result. Further columns play no part.
    """
    limits = stage(disclosing_terms(df, text, least_rows, generalise).select("term", (F.col("disclosure") >= remove).alias("removed")))
    found = stage(term_spans(df, limits, text))
    rows = base_spans(df, key, text).select("key", "text", "spans", *_text_key())
    apart = F.filter("terms", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return rows.join(found, ["h", "g"], "left").select(
        F.col("key").alias(key), "text", F.col("spans").alias("base"), F.coalesce(apart, F.array().cast("array<struct<start:int,kind:int,end:int,removed:boolean>>")).alias("terms"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def all_spans() -> Column:
    """Base and term spans of ``find_personal_data`` in one sorted list (start, kind, end)."""
    plain = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    return F.array_sort(F.concat("base", plain))


def sanitise(df: DataFrame, key: str = "doc_id", text: str = "text", **limits: float) -> DataFrame:
    """(key, text, n_base, n_generalised, n_removed): texts with entities replaced by ``<kind>``, generalised terms by ``<word>`` or ``<number>``, removed terms gone.

    Of overlapping spans the first names the replacement, and all they cover goes. Rows as in ``find_personal_data``.
    """
    found = find_personal_data(df, key, text, **limits)
    names = F.array(*(F.lit(f"<{k}>") for k in PATTERNS))
    own = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("mark")))
    word = lambda t: F.substring(F.col("text"), t["start"] + 1, t["end"] - t["start"])
    marked = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["removed"], "").when(word(t).rlike("^[0-9]+$"), "<number>").otherwise("<word>").alias("mark")))
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        new = F.struct(F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"]), s["mark"]).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= done["at"], new).otherwise(F.struct(done["out"].alias("out"), F.greatest(done["at"], s["end"]).alias("at")))

    rest = lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    return found.select(key, F.aggregate(F.array_sort(F.concat(own, marked)), first, step, rest).alias("text"), F.size("base").alias("n_base"),
                        F.size(F.filter("terms", lambda t: ~t["removed"])).alias("n_generalised"), F.size(F.filter("terms", lambda t: t["removed"])).alias("n_removed"))
