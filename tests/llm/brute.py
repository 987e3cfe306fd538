"""Plain Python versions of what the operators compute, and a fixture with the odd cases."""

import collections
import hashlib
import re
import zlib

LOWER = {c: c + 32 for c in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")

PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen"
COPY = " ".join(f"w{i}" for i in range(80))
ODD_DOCS = [
    (1, None, "a"),
    (2, "", "b"),
    (3, "   \n\t ", None),
    (4, "short", "c"),
    (5, "short", "d"),
    (5, "short", "d"),
    (6, COPY, "a"),
    (7, COPY, "b"),
    (8, COPY.replace("w40", "x"), "c"),
    (9, COPY.replace("w40", "y").replace("w10", "z"), "d"),
    (10, "He said: " + PASSAGE.upper() + " - so!", "e"),
    (11, "nine ten eleven twelve thirteen one two three four five six seven eight nine ten.", "f"),
    (12, "Licensed under the Apache License, Version 2.0.\nMIT license mit LICENSE\nGNU General Public License", "a"),
    (13, "x a.b@c.de.f+q@g.hi 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (555) 123-4567 é 12-34", "b"),
    (14, "same words here now\n" * 3 + "and more of it", "c"),
    (15, "\n".join(["the very same boilerplate line"] * 2 + ["own text of fifteen here"]), "c"),
    (16, " ".join(str(i % 7) for i in range(9000)), "d"),
    (17, "naïve café — 東京 words here  and   there\r\nend ", "e"),
    (18, "the very same boilerplate line\nunlike all others, this line", "a"),
    (19, "  the very same boilerplate line \t", "e"),
    (None, "a row without an id is still a row", "a"),
    (20, "a" * 3000 + "@" + "b" * 10 + " " + "9" * 40 + " " + "1" * 3000, "a"),
]
ODD_ITEMS = [(1, PASSAGE), (2, "short"), (3, None), (4, ""), (5, "nothing like it"), (None, "café"), (10, PASSAGE), (10, PASSAGE)]


def lower(text):
    return (text or "").translate(LOWER)


def contamination(docs, items, window=10):
    by_window = collections.defaultdict(set)
    sizes = set()
    for item, text in items:
        words = ALNUM.findall(lower(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_window[tuple(words[i : i + size])].add(item)
            sizes.add(size)
    out = []
    for doc, text, *_ in docs:
        words = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                own = by_window.get(tuple(words[i : i + size]))
                if own:
                    hit |= set(range(i, i + size))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text, size=5):
    words = SOLID.findall(lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def near_duplicates(docs):
    """Components over all pairs that share a shingle."""
    ids = [d[0] for d in docs]
    sets = [shingles(d[1]) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    postings = collections.defaultdict(list)
    for i, own in enumerate(sets):
        if ids[i] is not None:
            for s in own:
                postings[s].append(i)
    same_id = collections.defaultdict(list)
    for i, doc in enumerate(ids):
        if doc is not None and sets[i]:
            same_id[doc].append(i)
    for rows in same_id.values():
        for i in rows[1:]:
            root[find(i)] = find(rows[0])
    common = collections.Counter()
    for rows in postings.values():
        for x in range(len(rows)):
            for y in range(x):
                common[rows[y], rows[x]] += 1
    for (x, y), n in common.items():
        if 100 * n >= 75 * (len(sets[x]) + len(sets[y]) - n):
            root[find(x)] = find(y)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), doc), doc)
    out = []
    for i, doc in enumerate(ids):
        own = least[find(i)] if doc is not None and sets[i] else doc
        out.append((doc, len(sets[i]), own, own == doc))
    return out


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def licenses(docs):
    out = []
    for doc, text, *_ in docs:
        words = ALNUM.findall(lower(text))
        places = []
        for phrase, label in PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        labels = ",".join(sorted({label for _, label in places}))
        out.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None), labels))
    return out


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _fits(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def personal_data(docs):
    out = []
    for doc, text, *_ in docs:
        spans = [
            (kind, m.start(), m.end())
            for kind, pattern in KINDS.items()
            for m in re.finditer(pattern, text or "")
            if _fits(kind, m.group(0))
        ]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
        out.append((doc, *counts, hashlib.sha256(joined.encode()).hexdigest()))
    return out


def rules(docs):
    out = []
    for doc, text, *_ in docs:
        text = text or ""
        words = SOLID.findall(text)
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if SOLID.search(line):
                repeated += line in seen
                seen.add(line)
        count = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        cover = set()
        for i in range(len(words) - 7):
            if count[tuple(words[i : i + 8])] > 1:
                cover |= set(range(i, i + 8))
        failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
        out.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(cover), failed))
    return out


def spread(docs, min_sites=8, min_words=4):
    """Rows (doc_id, lines, dropped, text left); docs with equal ids and texts are one document."""
    space = " \t\r\n\f\v"
    sites, first = collections.defaultdict(set), {}

    def lines(text):
        return [line.strip(space) for line in (text or "").split("\n")]

    def counts(line):
        return len(re.split(r"[ \t\r\f\v]+", line)) >= min_words

    order = lambda doc, place: (doc is not None, doc or 0, place)
    for doc, text, site in docs:
        for place, line in enumerate(lines(text)):
            if counts(line):
                sites[line].add(site)
                first[line] = min(first.get(line, order(doc, place)), order(doc, place))
    out = []
    for doc, text, _ in docs:
        if text is None:
            out.append((doc, 0, 0, None))
            continue
        raw = text.split("\n")
        drop = [
            counts(line) and len(sites[line]) >= min_sites and first[line] != order(doc, place)
            for place, line in enumerate(lines(text))
        ]
        out.append((doc, len(raw), sum(drop), "\n".join(x for x, d in zip(raw, drop) if not d)))
    return out


def conversations(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), digest(whole), len(loss), digest(loss)))
    return out


def token_rows(docs, tokenizer, end_id=2):
    import numpy as np

    out, start = [], 0
    for doc, text, *_ in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
