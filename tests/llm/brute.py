"""Plain versions of the operators: slow, short and independent of them."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def simhash(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(rows):
    """{id: smallest id reachable} of (id, fingerprint) rows at up to 3 bits."""
    label = {i: i for i, _ in rows}
    changed = True
    links = [(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def jaccard_components(texts):
    """{id: smallest id reachable} over five-word Jaccard similarities of at least 0.8."""

    def cut(text):
        w = (text or "").lower().encode().split()
        return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, label = {i: cut(t) for i, t in texts.items()}, {i: i for i in texts}
    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in {(a, b) for ids in at.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}:
        n = len(sets[a] & sets[b])
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            label[high] = low
    return {i: find(i) for i in texts}


def repeats(texts, width=35):
    """(n_words, n_removed, kept) per text."""
    seqs = [words(t) for t in texts]
    seen = Counter(tuple(w[p : p + width]) for w in seqs for p in range(len(w) - width + 1))
    out = []
    for w in seqs:
        gone = set()
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] > 1:
                gone.update(range(p, p + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((len(w), len(gone), " ".join(kept)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def secrets(text):
    """(counts, base digest) of the three base kinds."""
    text = text or ""
    found = [("assign", m) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [("access", m) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [("hex", m) for m in HEX.finditer(text) if len(m.group()) >= 32]
    kinds = ["assign", "access", "hex"]
    spans = sorted((m.start(), kinds.index(k), m.end()) for k, m in found)
    joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
    count = Counter(k for k, _ in found)
    return tuple(count[k] for k in kinds), hashlib.sha256(joined.encode()).hexdigest(), joined


def overlaps(text, item):
    """(start, n_tokens, matches) of the stretches of text, by every alignment of both lists of tokens."""
    width = min(13, len(item))
    spans, same = set(), set()
    for p in range(len(text) - width + 1):
        for q in range(len(item) - width + 1):
            agree = [k for k in range(width) if text[p + k] == item[q + k]]
            if 5 * len(agree) >= 4 * width:
                spans.add((p, p + width))
                same.update(p + k for k in agree)
    out = []
    for lo, hi in sorted(spans):
        if out and lo < out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi - lo, sum(lo <= k < hi for k in same)) for lo, hi in out]


def audio_feature(payload, rate=16_000):
    """The feature text by zero stuffing, plain convolution, a DFT matrix and a loop."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    up = np.zeros(2 * len(x))
    up[::2] = x
    t = np.arange(-40, 41)
    y = np.convolve(up, np.sinc(t / 5) / 5 * np.hamming(81) * 2)[40 : 40 + len(up) : 5]
    n = max(1, -(-max(0, len(y) - 256) // 128) + 1)
    y = np.r_[y, np.zeros(max(0, (n - 1) * 128 + 256 - len(y)))]
    low = rate * 2 / 5
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + low / 2 / 700), 18)]
    f = np.arange(129) * low / 256
    bank = np.array([[max(0, min((v - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - v) / (edges[b + 2] - edges[b + 1]))) for b in range(16)] for v in f])
    dft = np.exp(-2j * np.pi * np.outer(np.arange(256), np.arange(129)) / 256)
    mel = np.array([np.log(np.abs((y[k * 128 : k * 128 + 256] * np.hanning(256)) @ dft) ** 2 @ bank + 1e-6) for k in range(n)])
    level = mel.mean(axis=1)
    mid, on, count, active = np.median(level), False, 0, 0
    for v in level:
        was, on = on, v > mid + 0.5 or (on and v >= mid - 0.5)
        count += on and not was
        active += on
    return rate, n, count, active, mel.mean(axis=0)


def ftrl(rows, size, epochs=3, alpha=0.5, beta=1.0, l1=0.02, l2=0.01, threshold=0.7, scale=8.0, others=None):
    """Scores of rows (n-grams, counts, label), or of others, by a scalar loop over coordinates; the last one is the bias."""
    z, n = defaultdict(float), defaultdict(float)
    share = [len(rows) / (2 * sum(r[2] == k for r in rows)) for k in (0, 1)]
    featured = lambda rows: [[(int(i), scale * int(c) / max(1, int(sum(r[1])))) for i, c in zip(r[0], r[1])] + [(size, 1.0)] for r in rows]
    feats = featured(rows)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for f, r in zip(feats, rows):
            w = {i: weight(i) for i, _ in f}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in f)))
            for i, v in f:
                g = (p - r[2]) * v * share[r[2]]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    logits = [sum(weight(i) * v for i, v in f) for f in feats]
    order = sorted(range(len(rows)), key=lambda k: logits[k])
    s = [logits[k] for k in order]
    edges = [s[0] - 1, *((a + b) / 2 for a, b in zip(s, s[1:])), s[-1] + 1]
    errors = [sum(share[1] * (rows[k][2] == 1) for k in order[:c]) + sum(share[0] * (rows[k][2] == 0) for k in order[c:]) for c in range(len(rows) + 1)]
    best = [c for c, e in enumerate(errors) if abs(e - min(errors)) < 1e-6]
    cut = edges[best[len(best) // 2]]
    if others is not None:
        logits = [sum(weight(i) * v for i, v in f) for f in featured(others)]
    return [1 / (1 + math.exp(-(x - cut + math.log(threshold / (1 - threshold))))) for x in logits]


def quality_features(text, bits=18):
    """{hashed n-gram: count} of a text's words and of their shapes, word by word."""
    raw = (text or "").encode()

    def mix(x):
        x %= 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def shape(b):
        c = chr(b)
        return b"a" if b >= 128 or c in "abcdefghijklmnopqrstuvwxyz" else b"A" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b"0" if c in "0123456789" else c.encode()

    shapes = b"".join(k for k, _ in itertools.groupby(map(shape, raw)))
    out = Counter()
    for seed, parts in ((1, raw.lower().split()), (2, shapes.split())):
        h = [mix(zlib.crc32(w) + seed * 2**32) for w in parts]
        out.update(x >> 64 - bits for x in h)
        out.update(mix(3 * a + b) >> 64 - bits for a, b in zip(h, h[1:]))
    return out


def quality_scores(texts, labels, bits=18):
    """{id: score} of {id: text} after a fit on all of (id, label): each text and label of an id once, in hash order."""
    rows = {}
    for i, label in labels:
        if i in texts and label in (0, 1):
            h = xxhash.xxh64_intdigest(str(i).encode(), 42)
            h = xxhash.xxh64_intdigest((texts[i] or "").encode(), h)
            h = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), h)
            rows[h - 2**64 if h >= 2**63 else h, label] = quality_features(texts[i], bits)
    kept = sorted(rows, key=lambda k: k)
    sets = {i: quality_features(t, bits) for i, t in texts.items()}
    train = [(list(rows[k]), list(rows[k].values()), k[1]) for k in kept]
    ids = list(sets)
    scores = ftrl(train, 1 << bits, others=[(list(sets[i]), list(sets[i].values())) for i in ids])
    return dict(zip(ids, scores))


def language(train, texts, bits=16):
    """(language, score) of texts by naive Bayes over hashed 1- to 3-grams, counted one by one."""

    def grams(text):
        c = [ord(x) if x.isalpha() else 32 for x in text.lower()] + [32] * 5
        for at in range(len(c) - 2):
            for order in (1, 2, 3):
                h = (c[at] * 0x9E3779B1 + order) % 2**32
                for k in range(1, order):
                    h = ((h ^ h >> 15) * 0x85EBCA6B + c[at + k] * 0xC2B2AE35) % 2**32
                yield ((h ^ h >> 13) * 0x27D4EB2F % 2**32) >> 32 - bits

    counts, rows = defaultdict(Counter), Counter()
    for text, lang in train:
        counts[lang].update(grams(text))
        rows[lang] += 1
    total = {x: sum(c.values()) + 0.5 * 2**bits for x, c in counts.items()}
    out = []
    for text in texts:
        if not any(x.isalpha() for x in text):
            out.append(("und", 0.0))
            continue
        seen = Counter(grams(text))
        joint = {x: math.log(rows[x] / sum(rows.values())) + sum(n * math.log((counts[x][g] + 0.5) / total[x]) for g, n in seen.items()) for x in sorted(counts)}
        best = max(joint, key=lambda x: joint[x])
        out.append((best, 1 / sum(math.exp(v - joint[best]) for v in joint.values())))
    return out
