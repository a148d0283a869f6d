"""Plain Python versions of the operators, written from the contract."""

import hashlib
import re
from collections import Counter, defaultdict

SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
     lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m[0])


PERSONAL = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p[-9:]) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(_digits(m)) <= 15),
)


def spans(text, kinds):
    """Counts by kind and the digest of the base spans."""
    found = sorted(
        (m.start(), k, name, m.end())
        for k, (name, pattern, holds) in enumerate(kinds)
        for m in pattern.finditer(text or "")
        if holds(m)
    )
    joined = ",".join(f"{name}:{a}:{b}" for a, _, name, b in found)
    return [sum(f[2] == name for f in found) for name, _, _ in kinds] + [hashlib.sha256(joined.encode()).hexdigest()]


def quality(text):
    text = text or ""
    words = re.findall("[^ \t\n\v\f\r]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    n, repeat = len(words), len(covered)
    return (
        n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat,
        n < 20 or 100 * repeat > 30 * n,
    )


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components(docs, n, percent):
    """(size of the set, smallest linked id) by id, all pairs that share an n-gram compared."""
    sets = {i: shingles(t, n) for i, t in docs}
    holders = defaultdict(list)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for o, k in Counter(o for g in s for o in holders[g]).items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                a, b = find(i), find(o)
                root[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}
