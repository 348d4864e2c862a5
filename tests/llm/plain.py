"""The contracts of the queries in plain Python, over whole tables held in memory."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

import xxhash


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def mix_targets(docs, weights=(1, 2, 3), cap=3):
    """source -> (size, target), the excess handed on round by round."""
    size = defaultdict(int)
    for _, source, text in docs:
        size[source] += len(WORD.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        heavy = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / heavy > cap * size[s] + 1e-9}
        for s in over or open_:
            target[s] = float(cap * size[s]) if over else left * weight[s] / heavy
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    return {s: (size[s], target[s]) for s in names}


def edited(docs):
    """doc_id -> (text, edited text, next text)."""
    rows = sorted(docs, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        out[doc] = text, text[: len(text) - k] + after[:k], after
    return out


def exact(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[text or ""].append(doc)
    return {doc: (max(g), len(g), doc == max(g), sha(t)) for t, g in groups.items() for doc in g}


def shingle_set(text: str, k: int = 5) -> frozenset:
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def near_classes(docs, threshold=0.8):
    """doc_id -> smallest doc_id of its class, by all pairs."""
    texts = sorted({t or "" for _, t in docs})
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by_shingle[g].append(i)
    for i, s in enumerate(sets):
        for j, common in Counter(j for g in s for j in by_shingle[g] if j < i).items():
            if common >= threshold * (len(s) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    number = {t: i for i, t in enumerate(texts)}
    low = {}
    for doc, text in docs:
        root = find(number[text or ""])
        low[root] = min(low.get(root, doc), doc)
    return {doc: low[find(number[text or ""])] for doc, text in docs}


def licenses(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        found += at
        labels |= {label} if at else set()
    return len(words), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


def chats(rows):
    """conv_id -> (turns, hash of turns, learned characters, their hash)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role, text or ""))
    done = {}
    for conv, turns in out.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        done[conv] = len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)
    return done


def warc(pages):
    first = {}
    for page, html in sorted(pages):
        first.setdefault(html or "", page)
    out = {}
    for page, html in pages:
        body = (html or "").encode()
        lead = first[html or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out[page] = len(body), digest, "response" if lead == page else "revisit", None if lead == page else lead
    return out


def pieces(docs, encode, capacity=2048):
    out = {}
    for doc, text in docs:
        ids = [*encode(text or ""), 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[doc, i] = a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))
    return out


LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {i: i + 32 for i in range(65, 91)}


def counted_words(docs, slip_every=97, letters=5, times=3):
    """word -> n."""
    count = Counter()
    for doc, text in docs:
        for run in LETTERS.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= letters and n >= times}


def variants(words):
    """word -> (form, root, n, n_near, form_n), by joining on what is left without one letter."""
    less = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less[w[:i] + w[i + 1 :]].add(w)
    near = {}
    for w, n in words.items():
        found = set(less.get(w, ()))
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            found |= {rest} & words.keys()
            found |= {v for v in less[rest] if v != w and v[:i] == w[:i] and v[i + 1 :] == w[i + 1 :]}
        near[w] = found
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = form[w], root, n, len(near[w]), words[form[w]] if form[w] else None
    return out


PLAIN_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        words = PLAIN_WORD.findall((text or "").translate(SMALL))
        k = min(size, len(words))
        for i in range(len(words) - k + 1) if k else ():
            windows[tuple(words[i : i + k])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = PLAIN_WORD.findall((text or "").translate(SMALL))
        hit, which = set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                if found := windows.get(tuple(words[i : i + k])):
                    hit |= set(range(i, i + k))
                    which |= found
        out.append((doc, len(words), len(hit), len(which), sha(",".join(sorted(which))), bool(hit)))
    return out


def runs(words, least=24, periods=3):
    """(start, length, period) of all maximal stretches, lag by lag; a stretch goes to its smallest period."""
    seen, out = set(), []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q) and j > i and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def periodic(doc, text):
    """(n_runs, start, length, period, exponent_milli, hash of the runs, hash of the kept words)."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs(words) if n < 900 else runs_by_lag(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *top, sha("".join(f"{s},{z},{q}\n" for s, z, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def runs_by_lag(words, least=24, periods=3):
    """As ``runs`` for long texts: every lag compared at once."""
    number = {}
    x = np.array([number.setdefault(w, len(number)) for w in words])
    seen, out = set(), []
    for q in range(1, len(x) // periods + 1):
        equal = x[:-q] == x[q:]
        if equal.sum() < max(least, periods * q) - q:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], equal, [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b + q - a >= max(least, periods * q) and (a, b + q) not in seen:
                seen.add((a, b + q))
                out.append((a, b + q - a, q))
    return sorted(out)


def _long(digest):
    return digest - (1 << 64) if digest >> 63 else digest


def leaves(text):
    """{leaf digest: words}: runs of words up to a line's end or a word whose hash is not above its neighbours'."""
    out = {}
    hashes = [
        (_long(xxhash.xxh64_intdigest(m.encode(), seed=42)) & -2) | m.endswith("\n")
        for m in re.findall(r"[^ \t\n\x0b\f\r]+(?:[ \t\x0b\f\r]*\n)?", text)
    ]
    start = 0
    for i, h in enumerate(hashes):
        near = hashes[max(0, i - 1) : i] + hashes[i + 1 : i + 2]
        if h & 1 or i + 1 == len(hashes) or all(h <= x for x in near):
            digest = 42
            for x in hashes[start : i + 1]:
                digest = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=digest)
            out[_long(digest) >> 12] = i + 1 - start
            start = i + 1
    return out


def likeness(a, b):
    if a == b:
        return 1.0
    a, b = leaves(a), leaves(b)
    both = sum(a.values()) + sum(b.values())
    return 2 * sum(n for leaf, n in a.items() if leaf in b) / both if both else 0.0
