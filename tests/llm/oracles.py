"""Plain Python versions of what the operators return, and small awkward tables."""

import hashlib
import itertools
import operator
import re
import zlib

import pyarrow as pa

from graphsieve.llm import textblocks as tb

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, copy string, bucket string"

LONG = " ".join(f"word{i} tail{i % 31}." for i in range(40_000))
PASSAGE = " ".join(f"Copied sentence number {i} holds a few plain words here." for i in range(8))
AWKWARD = [
    (1, "the mit license was released Under The MIT License.\nRepeated line\nRepeated line\n\n ", "en", "a", 3),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (4, "   \n\t ", "en", "", 5),
    (5, LONG, "en", "b", None),
    (6, LONG + " one more", "en", "c", None),
    (7, "One two three four five six seven eight nine ten eleven twelve. " + PASSAGE + " Closing words of seven.", "en", "a", None),
    (8, "Quite another beginning stands here. " + PASSAGE + " And another end is here too.", "en", "b", None),
    (8, "Quite another beginning stands here. " + PASSAGE + " And another end is here too.", "en", "b", None),
    (9, "word", "en", "b", None),
    (10, "word", "en", "c", None),
    (None, "word of nobody", "en", "b", None),
    (None, None, None, None, None),
    (-5, "é É ß ñ \U0001f600 apache license version 2 apache-license  VERSION.2 cc-by-nc 4.0", "fr", "c", None),
    (12, "### $$$ %%% ***" * 40, "en", "a", None),
]
AWKWARD = [(*row, 0.5, "x", "y") for row in AWKWARD]


def words(text):
    return SPACED.findall(text or "")


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near_duplicates(rows, width, percent=80):
    """{doc_id: component} over links of documents with a known id."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def word_hashes(ws):
    """As the operators hash words; of spans only the equality counts, of windows of words which one is least."""
    column = pa.array(["\n".join(ws)])
    texts = tb.texts_of(column)
    return tb.hash_words(texts.data, tb.words_of(texts), lower=True).tolist()


POWERS = [pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(64)]


def window_hash(hashes):
    x = (sum(map(operator.mul, hashes, POWERS)) + len(hashes) * 0xD6E8FEB86659FD93) % (1 << 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * factor % (1 << 64)
    return x


def passage_spans(text, sentences=4, least=32, shared=50):
    """Spans (first word, word after the last one) and sentence ends of one text, word by word."""
    w = words(text)
    marked = [(x[:-1] if len(x) > 1 and x[-1] in "\"')]" else x)[-1] in ".!?" for x in w]
    ends = [i + 1 for i in range(len(w)) if marked[i] or i + 1 == len(w)]
    begins = [0, *ends][: len(ends)]
    runs = {(a, ends[i + sentences - 1]) for i, a in enumerate(begins) if i + sentences <= len(ends) and ends[i + sentences - 1] - a >= least}
    free = [(a, b) for a, b in runs if a > 0 and marked[b - 1]]
    hashes = word_hashes(w)
    memo, seeds = {}, set()
    for p in range(len(w) - shared + 1):
        if any(a > p and b <= p + shared for a, b in free):
            continue
        for i in range(p, p + shared - least + 1):
            memo.setdefault(i, window_hash(hashes[i : i + least]))
        seeds.add(min(range(p, p + shared - least + 1), key=lambda i: (memo[i], i)))
    return sorted(runs | {(i, i + least) for i in seeds}), sorted({*ends, *seeds, *(i + least for i in seeds)} - {0})


def without_passages(rows):
    """{doc_id: (kept text, parts that go)} of rows (doc_id, text) with different ids."""
    owner, found = {}, {}
    for i, text in sorted(rows):
        w = [x.translate(LOWER) for x in words(text)]
        found[i] = passage_spans(text)
        for a, b in found[i][0]:
            owner.setdefault(tuple(w[a:b]), (i, a))
    out = {}
    for i, text in rows:
        w = [x.translate(LOWER) for x in words(text)]
        spans, ends = found[i]
        gone = set()
        for a, b in spans:
            if owner[tuple(w[a:b])] != (i, a):
                gone.update(range(a, b))
        at = [m.start() for m in SPACED.finditer(text or "")] + [len(text or "")]
        begins = [0, *ends][: len(ends)]
        parts = [(a, b) for a, b in zip(begins, ends) if a in gone]
        keep, last = "", 0
        for a, b in parts:
            keep, last = keep + (text or "")[last : at[a]], at[b] if b < len(w) else len(text)
        out[i] = (None if text is None else keep + text[last:], len(parts))
    return out


def rule_counts(text):
    w = words(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for r in runs:
        seen[r] = seen.get(r, 0) + 1
    covered = {i + j for i, r in enumerate(runs) if seen[r] > 1 for j in range(5)}
    lines, dup, known = (text or "").split("\n"), 0, set()
    for line in lines:
        if words(line):
            dup += line in known
            known.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def base_licenses(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def licence_labels(rows, notices, anchors, spacing, agree, slack, least):
    """Of each (doc_id, text) its labels and score by holding every notice against every place."""
    texts = [(i, ALNUM.findall((t or "").translate(LOWER))) for i, t in rows]
    known = {w for _, words_, _ in notices for w in words_} | {w for p in ("under the mit license", "apache license version 2", "cc by nc") for w in p.split()}
    holding = {w: 0 for w in known}
    for _, text in texts:
        for w in known & set(text):
            holding[w] += 1
    out = []
    for doc_id, text in texts:
        fits = []
        for label, own, keys in notices:
            rare = sorted(set(own), key=lambda w: (holding[w], w))[: anchors + len(own) // spacing]
            if len(set(rare) & set(text)) < agree:
                continue
            places = [(q, w) for q, w in enumerate(own) if w in rare]
            for start in range(-len(own), len(text)):
                at = lambda d: {w for q, w in places if 0 <= start + d + q < len(text) and text[start + d + q] == w}  # noqa: E731, B023
                if not at(0) or len(set().union(*map(at, range(-slack, slack + 1)))) < agree:
                    continue
                window = text[max(0, start - slack) : max(0, start + len(own) + slack)]
                found = sum(min(own.count(w), window.count(w)) for w in set(own))
                if found >= least * len(own) and all(" ".join(k) in " ".join(window) and any(tuple(window[i : i + len(k)]) == k for i in range(len(window))) for k in keys):
                    fits.append((start, found, label, found / len(own)))
        best = {}
        for start, found, label, share in fits:
            if all(more <= found or abs(other - start) > slack for other, more, _, _ in fits):
                best[label] = max(best.get(label, 0.0), share)
        base = set(filter(None, base_licenses(" ".join(text))[4].split(",")))
        out.append((doc_id, ",".join(sorted(base | set(best))), 1.0 if base else max(best.values(), default=0.0)))
    return out


def warc_rows(pages):
    groups = {}
    for page_id, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100:
            groups.setdefault(data, []).append(page_id)
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        ids = [x for x in groups.get(data, []) if x is not None]
        first = min(ids) if ids and len(groups[data]) > 1 else None
        revisit = first is not None and page_id != first
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
