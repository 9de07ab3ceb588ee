"""Plain versions of the numbered operators, quadratic and in one process, for small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def measures(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = {}
    for i in range(len(ws) - 7):
        at.setdefault(tuple(ws[i : i + 8]), []).append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    n = len(ws)
    return {
        "n_words": n, "word_chars": sum(map(len, ws)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


def kept_by_rules(text):
    m, ws, text = measures(text), words(text), text or ""
    n, chars = m["n_words"], m["word_chars"]
    return not (
        m["base_failed"] or 100 * m["n_symbols"] > 10 * chars or 100 * m["n_dup_lines"] > 60 * len(text.split("\n")) or len("".join(ws).encode()) < 2 * n or chars > 20 * n
        or 100 * sum(len(w) > 1 and w.upper() == w != w.lower() for w in ws) > 40 * n or 100 * sum(not regex.search(r"\p{L}", w) for w in ws) > 50 * n
        or 100 * sum(a == b for a, b in zip(ws, ws[1:], strict=False)) > 30 * n or 100 * sum(w[0] == "<" and w[-1] == ">" for w in ws) > 20 * n
    )


def exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(fold(t), []).append(i)
    return {(i, sha(fold(t))): (max(x for x in groups[fold(t)] if x is not None) if any(x is not None for x in groups[fold(t)]) else None, len(groups[fold(t)])) for i, t in docs}


def cut_windows(docs, window):
    """{(id, text): (n_words, n_removed, kept)}"""
    first = {}
    for i, t in docs:
        if i is not None:
            ws = words(t)
            for k in range(len(ws) - window + 1):
                key = tuple(ws[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in docs:
        ws, gone = words(t), set()
        for k in range(len(ws) - window + 1) if i is not None else ():
            if first[tuple(ws[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i, t] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


def cut_strings(docs, length):
    """{(id, text): (n_bytes, n_removed, n_spans, kept)} of rows in corpus order."""
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if (i, t) in out:
            continue
        for k in range(len(b) - length + 1) if i is not None else ():
            if b[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out[i, t] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def fingerprint(text):
    ws = words(fold(text))
    grams = [" ".join(ws[k : k + 4]) for k in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def join(n, linked):
    """Roots of the groups of 0..n-1 under linked(i) -> indices."""
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(n):
        for b in linked(a):
            x, y = find(a), find(int(b))
            up[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def near_roots(texts, threshold=4):
    prints = np.array([fingerprint(t) for t in texts], np.uint64)
    return join(len(texts), lambda a: np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= threshold))


def near(docs, threshold=4):
    """[(id, fingerprint, component)]"""
    prints = np.array([fingerprint(t) for _, t in docs], np.uint64)
    roots = near_roots([t for _, t in docs], threshold)
    least = {}
    for (i, _), r in zip(docs, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, f"{int(p):016x}", least.get(r)) for (i, _), p, r in zip(docs, prints, roots, strict=True)]


def normal_line(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def fuzzy_lines(docs, similarity=0.8):
    """{(id, text): kept text}"""
    order = sorted({(i is not None, i or 0, t or "") for i, t in docs})
    at = {}
    for d in order:
        for k, line in enumerate(d[2].split("\n")):
            if normal_line(line):
                at.setdefault(normal_line(line), []).append((*d, k))
    keys = sorted(at)
    bags = [Counter(x[i : i + 2] for i in range(len(x) - 1)) for x in keys]

    def linked(a):
        for b in range(a):
            x, y = keys[a], keys[b]
            most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
            # an edit changes two pairs of letters at most
            if abs(len(x) - len(y)) <= most and (bags[a] & bags[b]).total() >= max(len(x), len(y)) - 1 - 2 * most and distance(x, y) <= most:
                yield b

    groups = {}
    for k, r in zip(keys, join(len(keys), linked), strict=True):
        groups.setdefault(r, []).extend(at[k])
    gone = {x for g in groups.values() for x in g if x != min(g)}
    return {(i, t): "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i is not None, i or 0, t or "", k) not in gone) for i, t in docs}
