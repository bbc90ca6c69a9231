"""Plain single-process versions of the operators, to hold the real ones against."""

import hashlib
import re

LAST = 2**63 - 1  # stands for a null doc_id

def repeats(docs, width=50):
    first = {}
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    for d, t in order:
        b = (t or "").encode()
        key = 2**63 - 1 if d is None else d
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], key)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        key = 2**63 - 1 if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < key:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks(docs, bench, window=10):
    items = [(i, words(t)) for i, t in bench]
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, x in items:
            k = min(window, len(x))
            wins = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if x else set()
            for p in range(len(w) - k + 1) if wins else ():
                if tuple(w[p : p + k]) in wins:
                    hit.update(range(p, p + k))
                    found.add(str("" if i is None else i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def lines(docs, min_chars=40, min_docs=5):
    blank = " \t\n\x0b\x0c\r"

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blank))

    holders = {}
    for k, (d, t) in enumerate(docs):
        for x in {key(y) for y in (t or "").split("\n")}:
            if len(x) >= min_chars:
                holders.setdefault(x, []).append(2**63 - 1 if d is None else d)
    out = []
    for d, t in docs:
        mine = 2**63 - 1 if d is None else d
        all_ = (t or "").split("\n")
        kept = [y for y in all_ if not (len(key(y)) >= min_chars and len(holders[key(y)]) >= min_docs and max(holders[key(y)]) != mine)]
        out.append((d, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def near(docs):
    sets = []
    for _, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= 80 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(docs)]


def phrases(docs, table):
    out = []
    for d, t in docs:
        w = words(t)
        at = [(i, label) for p, label in table.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        out.append((d, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def private(docs):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for d, t in docs:
        spans, n = [], []
        for kind, pattern in kinds.items():
            found = []
            for m in re.finditer(pattern, t or ""):
                v = m.group()
                digits = re.sub("[^0-9]", "", v)
                if kind == "ip" and any(int(x) > 255 for x in v.split(".")):
                    continue
                if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                    continue
                if kind == "phone" and not 9 <= len(digits) <= 15:
                    continue
                found.append(f"{kind}:{m.start()}:{m.end()}")
            n.append(len(found))
            spans += found
        out.append((d, *n, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    return out
