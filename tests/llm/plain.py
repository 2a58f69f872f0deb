"""Brute-force versions of the corpus operators, over lists of rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(text):
    return SPACED.findall((text or "").translate(LOWER))


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def covered(texts, depth):
    """For each sequence, which symbols lie in a window of depth that also starts elsewhere."""
    seen = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        out.append(gone)
    return out


def repeats(rows, depth=400, n_words=51):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc, _), t, gone, passages in zip(rows, texts, covered(texts, depth), covered([tuple(spaced(t)) for _, t in rows], n_words), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), sum(passages)))
    return out


def without_repeats(texts, depth=400, n_words=51):
    """Texts without the bytes of repeated windows of depth bytes and of repeated passages of n_words words."""
    raw = [(t or "").encode() for t in texts]
    out = []
    for t, gone, words_gone in zip(raw, covered(raw, depth), covered([tuple(spaced(t)) for t in texts], n_words), strict=True):
        ends = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        edge = 0
        for k, g in enumerate(words_gone):
            # A run of words goes with the white space in it.
            begin = edge if k and words_gone[k - 1] and g else ends[k][0]
            edge = ends[k][1]
            if g:
                gone[begin:edge] = b"\1" * (edge - begin)
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def shingles(text):
    w = spaced(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[max(top(a), top(b))] = min(top(a), top(b))
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[top(i)].append(doc)
    return [(doc, len(sets[i]), min((d for d in least[top(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)]


def contamination(rows, items, window=13):
    patterns = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            patterns[tuple(w[i : i + n])].add("" if item is None else str(item))
    lengths = sorted({len(p) for p in patterns})
    out = []
    for doc, text in rows:
        w = alnum(text)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := patterns.get(tuple(w[i : i + n])):
                    found |= own
                    hit[i : i + n] = [True] * n
        ids = ",".join(sorted(found))
        out.append((doc, len(w), sum(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def crc(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode())


def base_scores(rows):
    tokens = [[*spaced(t), None] for _, t in rows]
    count = Counter(t for (doc, _), own in zip(rows, tokens, strict=True) if crc(doc) % 7 != 2 for t in own)
    n, v = sum(count.values()), len(count)
    return [(doc, crc(doc) % 7 == 2, len(own), sum(count[t] > 0 for t in own), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)) for (doc, _), own in zip(rows, tokens, strict=True)]


def nearest(rows, k=5, every=50):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]

    def cosine(a, b):
        dot = na = nb = 0.0
        for x, y in zip(a, b, strict=True):
            dot, na, nb = dot + x * y, na + x * x, nb + y * y
        return dot / (math.sqrt(na) * math.sqrt(nb))

    out = []
    for i, v in good:
        if i % every == 0:
            best = sorted((-cosine(v, w), j) for j, w in good if j != i and len(v) == len(w))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def bigram_scores(rows, mu=20.0):
    """Scores from exact bigram counts, quantised as the model does it."""
    tokens = [[*spaced(t), None] for _, t in rows]
    train = [own for (doc, _), own in zip(rows, tokens, strict=True) if crc(doc) % 7 != 2]
    count = Counter(t for own in train for t in own)
    pairs = Counter(p for own in train for p in zip(["<begin>", *own[:-1]], own, strict=True))
    n, v = sum(count.values()), len(count)
    middle = lambda c: 0 if not c else 1 if c == 1 else 0.75 * 2 ** (1 + int(math.log2(c)))
    follow = Counter()
    for (a, _), c in pairs.items():
        follow[a] += middle(c)
    out = []
    for (doc, _), own in zip(rows, tokens, strict=True):
        total = 0.0
        for a, b in zip(["<begin>", *own[:-1]], own, strict=True):
            p = (count[b] + 1) / (n + v + 1)
            total += math.log10((middle(pairs[a, b]) + mu * p) / (follow[a] + mu))
        out.append((doc, total))
    return out


def statistics(text):
    """The quality classifier's statistics of one text, by its characters and words."""
    raw = (text or "").encode()
    lowered = raw.translate(bytes(b + 32 if 65 <= b < 91 else b for b in range(256)))
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    words = [lowered[a:b] for a, b in spans]
    n, size = len(words), max(len(raw), 1)
    share = lambda kind: sum(b in kind for b in raw) / size
    again = lambda gap: sum(a == b for a, b in zip(words, words[gap:], strict=False)) / max(n, 1)
    lines = lowered.split(b"\n") if raw else []
    ended = [x + b"\n" for x in lines[:-1]] + [x for x in lines[-1:] if x]
    loud = sum(b - a > 1 and 65 <= raw[a] < 91 and (65 <= raw[b - 1] < 91 or raw[b - 1] == 33) for a, b in spans)
    some = max(n, 1)
    return [
        math.log1p(len(raw)), math.log1p(n), sum(map(len, words)) / some, share(range(65, 91)), share(range(48, 58)), share(b".,;:'\"-()?!"), share(b"#$%&*@^~|<>{}[]\\/=+_`"), share(b"!"), share(range(128, 256)), again(1), len(set(words)) / some, again(2),
        max(len(ended), 1) / some, 1 - len(set(ended)) / max(len(ended), 1) if raw else 0.0, max(map(len, words), default=0), loud / some,
    ]


def ftrl(examples, epochs=6, alpha=1.0, beta=1.0, l1=6.0, l2=0.01):
    """Weights after learning examples (features, label) one by one, feature by feature."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for features, label in examples:
            w = {f: weight(f) for f in [*features, "bias"]}
            error = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
            for f in w:
                step = (math.sqrt(n[f] + error * error) - math.sqrt(n[f])) / alpha
                z[f] += error - step * w[f]
                n[f] += error * error
    return {f: weight(f) for f in list(z) if weight(f)}
