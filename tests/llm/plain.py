"""Plain versions of what the operators compute, one document or pair at a time."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def fold(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def counts(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(texts):
    """(class, links) for each place in a list of texts: linked if equal in words or 0.8 similar."""
    sets, inverse = [shingles(t) for t in texts], defaultdict(list)
    for n, s in enumerate(sets):
        for g in s or [None]:
            inverse[g].append(n)
    common = Counter(p for ns in inverse.values() for p in itertools.combinations(ns, 2))
    up, links = list(range(len(texts))), [0] * len(texts)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in common.items():
        if not sets[a] or n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return [(root(n), links[n]) for n in range(len(texts))]


def unigram(rows):
    """(n_tokens, n_known, total, base score) for each (doc_id, text); learned from ids whose fold of 7 is not 2."""
    tokens = [[*words((t or "").translate(FOLD)), None] for _, t in rows]
    seen = Counter(w for (i, _), own in zip(rows, tokens, strict=True) if fold(i, 7) != 2 for w in own)
    total = sum(seen.values())
    return [
        (len(own), sum(seen[w] > 0 for w in own), total, sum(math.log10((seen[w] + 1) / (total + len(seen) + 1)) for w in own))
        for own in tokens
    ]


SECRETS = {
    "assign": (re.compile(
        "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
        + r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile("[0-9a-f]+"), 0, 16),
}


def secrets(text):
    spans = [
        (m.start(), k, kind, m.end())
        for k, (kind, (pattern, group, least)) in enumerate(SECRETS.items()) for m in pattern.finditer(text or "") if len(m[group]) >= least
    ]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans)]
