"""Plain reference versions of what the operators compute."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A table with null, empty and odd rows, repeated rows and columns whose names operators use inside.
ODD_SCHEMA = SCHEMA + ", n long, gram string, window string, label int, score double, ids string, host string"


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def repeated_windows(docs, least=20):
    seen, out = set(), {}
    for i, text in sorted(docs):
        w = words(text)
        covered = [False] * len(w)
        for s in range(len(w) - least + 1):
            key = tuple(w[s : s + least])
            if key in seen:
                covered[s : s + least] = [True] * least
            seen.add(key)
        out[i] = (len(w), sum(covered), " ".join(x for x, c in zip(w, covered, strict=True) if not c))
    return out


def line_counts(text):
    w, text = words(text), text or ""
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
