"""Plain versions of the operators, for small tables: (doc_id, text) rows."""

from __future__ import annotations

import hashlib
import re

import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(rng, n, many=400):
    return [f"w{rng.randrange(many)}" for _ in range(n)]


def low(text: str | None) -> bytes:
    return (text or "").encode().translate(LOWER)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def contamination(docs, items, width=10):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict = {}
    for item, text in items:
        w = word.findall(low(text))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, names = word.findall(low(text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), sha(",".join(sorted(names)).encode()), bool(hit)))
    return out


def lines(docs, run=2, long_words=None):
    """(doc_id, n_lines, n_removed, kept text) by the first place of every run of lines."""
    first: dict = {}
    held = []

    def runs(all_, filled):
        for k in range(len(filled) - run + 1):
            yield k, run, tuple(all_[i] for i in filled[k : k + run])
        for k, i in enumerate(filled):
            if long_words is not None and len(re.findall(r"[^ \t\n\x0b\f\r]+", all_[i])) > long_words:
                yield k, 1, (all_[i],)

    for doc, text in sorted(docs, key=lambda r: r[0]):
        all_ = (text or "").split("\n")
        filled = [k for k, x in enumerate(all_) if not re.fullmatch(r"[ \t\n\x0b\f\r]*", x)]
        held.append((doc, all_, filled))
        for k, _, what in runs(all_, filled):
            first.setdefault(what, (doc, k))
    out = []
    for doc, all_, filled in held:
        gone = set()
        for k, n, what in runs(all_, filled):
            if first[what] < (doc, k):
                gone |= set(filled[k : k + n])
        out.append((doc, len(all_), len(gone), "\n".join(x for k, x in enumerate(all_) if k not in gone)))
    return out


def earlier_prefixes(docs, run=2):
    """{(doc_id, place): lines of the longest run from there that also stands earlier}, of those of `run` or more."""
    places = []
    for doc, text in sorted(docs, key=lambda r: r[0]):
        filled = [x for x in (text or "").split("\n") if not re.fullmatch(r"[ \t\n\x0b\f\r]*", x)]
        places += [(doc, k, filled) for k in range(len(filled))]
    out = {}
    for i, (doc, k, mine) in enumerate(places):
        best = 0
        for _, j, other in places[:i]:
            n = 0
            while k + n < len(mine) and j + n < len(other) and mine[k + n] == other[j + n]:
                n += 1
            best = max(best, n)
        if best >= run:
            out[doc, k] = best
    return out


def repeats(docs, width=100):
    seen: set = set()
    out = []
    for doc, text in sorted(docs, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            if s in seen:
                gone[k : k + width] = [True] * width
            seen.add(s)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", low(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(docs, k=5, share=75):
    sets = {doc: shingles(text, k) for doc, text in docs}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            both = len(x & y)
            if x and y and 100 * both >= share * (len(x) + len(y) - both):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return [(i, len(sets[i]), root(i)) for i in ids]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values, seed=42):
    """xxhash64 of whole numbers in turn."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def anchors(text, k=5):
    """(hash, place) of the k-mers whose least unit hash stands at an edge."""
    units = []
    for w in re.split(r"[ \t\n\x0b\f\r]+", text or ""):
        units += list(w) if len(w) > 32 else [w] if w else []
    h = [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in units]
    found = [(chained(h[i : i + k]), i) for i in range(len(h) - k + 1) if min(h[i], h[i + k - 1]) <= min(h[i + 1 : i + k - 1])]
    return found or ([(chained(h), 0)] if h else [])


def likeness(a, b):
    u, v = {h for h, _ in anchors(a)}, {h for h, _ in anchors(b)}
    return len(u & v) / len(u | v) if u | v else 1.0


def kneser_ney(rows, held, order):
    """{row number: (n_tokens, n_known, N, base, score)} by an interpolated modified Kneser-Ney model over dictionaries."""
    import math
    import re
    from collections import Counter, defaultdict

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), "</s>"] for _, t in rows]
    train = [x for (i, _), x in zip(rows, texts, strict=True) if not held(i)]
    raw = Counter(w for x in train for w in x)
    n, v = sum(raw.values()), len(raw)

    def gram(x, i, k):
        return None if i - k + 1 < -1 else tuple(["<s>", *x][i - k + 2 : i + 2])

    counts = {order: Counter(g for x in train for i in range(len(x)) if (g := gram(x, i, order)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
        if k > 1:
            counts[k].update(gram(x, k - 2, k) for x in train if len(x) > k - 2)
    discounts, context = {}, {}
    for k, c in counts.items():
        of = Counter(min(x, 5) for x in c.values())
        d = (0.5, 1.0, 1.5)
        if all(of[i] for i in (1, 2, 3, 4)):
            y = of[1] / (of[1] + 2 * of[2])
            found = tuple(i - (i + 1) * y * of[i + 1] / of[i] for i in (1, 2, 3))
            if min(found) > 0:
                d = tuple(min(x, i) for i, x in enumerate(found, 1))
        discounts[k] = (0.0, *d)
        context[k] = defaultdict(lambda: [0, 0.0])
        for g, x in c.items():
            context[k][g[:-1]][0] += x
            context[k][g[:-1]][1] += discounts[k][min(x, 3)]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / (v + 1)
        if g[:-1] not in context[k]:
            return below
        total, left = context[k][g[:-1]]
        c = counts[k].get(g, 0)
        return (max(c - discounts[k][min(c, 3)], 0) + left * below) / total

    out = {}
    for i, x in enumerate(texts):
        score = sum(math.log10(p(gram(x, j, min(order, j + 2)))) for j in range(len(x)))
        out[i] = (len(x), sum(w in raw for w in x), n, sum(math.log10((raw[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), score)
    return out


def conversations(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)} by a search over all edits, turn by turn."""
    import hashlib
    import re
    import sys
    import zlib
    from functools import cache

    sys.setrecursionlimit(100_000)
    held = {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        by = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if by == 1 else re.sub(r"[.!?]", "", text) if by == 2 else text
        role = "user" if by == 4 else role
        mine += [(turn, role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    out = {}
    for conv, mine in held.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in mine:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        goes = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

        @cache
        def best(i, state, inserted, mine=mine, faults=faults, goes=goes):
            found = []
            if i == len(mine) and state in ("", "a"):
                found.append((0, "", ()))
            for full in ("user", "assistant"):
                if inserted < 3 and full[0] in goes[state]:
                    c, e, t = best(i, full[0], inserted + 1)
                    found.append((c + 3, "I" + e, (f"{full}:", *t)))
            if i < len(mine):
                _, role, text = mine[i]
                c, e, t = best(i + 1, state, 0)
                found.append((c + 4, "D" + e, t))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    if role[:1] in goes[state]:
                        c, e, t = best(i + 1, role[:1], 0)
                        found.append((c + more, "K" + e, (f"{role}:{text}", *t)))
                    for full in ("user", "assistant"):
                        if full[0] in goes[state]:
                            c, e, t = best(i + 1, full[0], 0)
                            found.append((c + 3 + more, "R" + e, (f"{full}:{text}", *t)))
            return min(found, default=(1 << 40, "", ()))

        cost, audit, lines = best(0, "", 0)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        heads = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out
