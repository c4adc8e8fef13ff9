"""Plain versions of the operators for small fixtures."""

import hashlib
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for k, (name, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": name == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[name]
            if good:
                out.append((m.start(), k, m.end(), name))
    return [(name, a, b) for a, _, b, name in sorted(out)]


def base_sha(text):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()


def shingles(text, size=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def jaccard_components(rows):
    """[(id, n_shingles, component)] by comparing all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    kinds = sorted(set(s for s in sets if s), key=repr)
    place = {s: i for i, s in enumerate(kinds)}
    parent = list(range(len(kinds)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for j in range(i):
            b = kinds[j]
            common = len(a & b)
            if 100 * common >= 75 * (len(a) + len(b) - common):
                parent[root(i)] = root(j)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            r = root(place[s])
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(root(place[s])) if s else i) for (i, _), s in zip(rows, sets)]
