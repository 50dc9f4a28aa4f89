"""Plain-Python twins of the corpus operators, written for clarity: every pair and every position is looked at."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash

from foldloom.llm.bpe import read_ranks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def token_row(text, coder):
    ids = coder.encode_ordinary(text or "")
    return len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha((text or "").encode())


def components(nodes, linked):
    """Smallest node reachable from each, over all pairs."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if a != b and linked(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def simhash(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not own:
        return 0
    shingles = [" ".join(own[i:i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def simhash_components(rows):
    """{(position): component} for rows (doc_id, text); positions stand for rows."""
    prints = [simhash(text) for _, text in rows]
    distinct = sorted(set(prints))
    roots = components(distinct, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[roots[p]] = min(doc, least.get(roots[p], doc))
    return prints, [least.get(roots[p]) for p in prints]


def windows(items, size=13):
    found = {}
    for name, text in items:
        own = words(text)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            found.setdefault(tuple(own[i:i + size]), set()).add(name)
    return found


def contamination(text, items):
    own, table = words(text), windows(items)
    hit, names = set(), set()
    for size in {len(w) for w in table}:
        for i in range(len(own) - size + 1):
            if tuple(own[i:i + size]) in table:
                hit.update(range(i, i + size))
                names |= table[tuple(own[i:i + size])]
    names = sorted(str(n) for n in names if n is not None)
    return len(own), len(hit), len(names), sha(",".join(names).encode()), len(hit) > 0 and 20 * len(hit) >= len(own)


def letters(text):
    return re.sub(" +", " ", " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text or "") + " ")


def grams(text):
    own = letters(text)
    if not own.strip():
        return Counter()
    return Counter([c for c in own if c != " "] + [own[i:i + 2] for i in range(len(own) - 1)]
                   + [own[i:i + 3] for i in range(len(own) - 2) if own[i + 1] != " "])


def order(counts, size=400):
    def number(gram):
        code = 0
        for c in gram:
            code = code << 21 | ord(c)
        return code
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:size]


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1


def profiles(rows, size=400, all_rows=False):
    sums = {}
    for doc, text, lang in rows:
        if lang is not None and text is not None and (all_rows or doc is not None and not held_out(doc)):
            sums.setdefault(lang, Counter()).update(grams(text))
    return {lang: order(counts, size) for lang, counts in sums.items() if counts}


def language(text, table, size=400):
    own = order(grams(text), size)
    if not own or not table:
        return "und", 0.0
    best = None
    for lang in sorted(table):
        place = {g: i for i, g in enumerate(table[lang])}
        distance = sum(abs(i - place[g]) if g in place else size for i, g in enumerate(own))
        if best is None or distance < best[1]:
            best = lang, distance
    return best[0], 1 - best[1] / (size * len(own))


def line_dedup(rows):
    """Texts, lines and removed lines of rows (doc_id, text), which must be distinct."""
    blank = " \t\r\x0b\x0c"
    seen, removed = set(), {}
    for position in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)):
        solid = [(i, line.strip(blank)) for i, line in enumerate((rows[position][1] or "").split("\n")) if line.strip(blank)]
        for trio in zip(solid, solid[1:], solid[2:]):
            window = tuple(line for _, line in trio)
            if window in seen:
                removed.setdefault(position, set()).update(i for i, _ in trio)
            seen.add(window)
    out = []
    for position, (_, text) in enumerate(rows):
        lines = [] if text is None else text.split("\n")
        gone = removed.get(position, set())
        out.append((text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


def licenses(text, phrases, templates, threshold=0.8):
    own, places, labels, best = words(text), [], set(), 0.0
    for phrase, label in phrases.items():
        for i in range(len(own)):
            if own[i:i + len(phrase.split())] == phrase.split():
                places.append(i)
                labels.add(label)
    base = set(labels)
    for label, template, *rest in templates:
        required, excluded = [set(words(x)) for x in [*rest, "", ""][:2]]
        want, length = set(words(template)), len(words(template))
        if not want:
            continue
        blocks = [(set(words(line)), set(words(line))) for line in (text or "").split("\n")]
        blocks += [(set(own[i:i + length]), set(own[max(i - 1, 0):i + length + 1])) for i, w in enumerate(own) if w in want]
        for held, around in blocks:
            if len(want & held) >= math.ceil(round(threshold * len(want), 9)) and required <= held and not excluded & around:
                labels.add(label)
                best = max(best, len(want & held) / len(want))
    return (len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            1.0 if places else best)


def shingle_set(text):
    own = (text or "").translate(LOWER).split()
    return {tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def similar_kept(rows):
    """Smallest key of each group of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = [shingle_set(t) for _, t in rows]
    alike = lambda a, b: sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    roots = components(range(len(rows)), alike)
    return sorted(min(d for (d, _), r in zip(rows, roots.values(), strict=True) if r == root) for root in set(roots.values()))
