"""Plain versions of the operators' contracts, and texts to try them on."""

import hashlib
import math
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def places(ws, phrase):
    n = len(phrase)
    return [k for k in range(len(ws) - n + 1) if ws[k : k + n] == phrase]


def licenses(text, templates, otherwise, denials, slack, within):
    """labels, score: every template at every place."""
    ws = words(text)

    def at(phrase, s):
        return s >= 0 and tuple(ws[s : s + len(phrase)]) == tuple(phrase)

    def found(t):
        (a, n), rest = t.keys[0], t.keys[1:]
        for s in range(-len(t.words), len(ws)):
            if at(t.words[a : a + n], s + a) and all(any(at(t.words[b : b + m], s + b + d) for d in range(-slack, slack + 1)) for b, m in rest):
                yield s

    def counts(t, s):
        begin = s + t.keys[0][0]
        if any(w in denials for w in ws[max(0, begin - within) : begin]):
            return False
        if t.phrases:
            return True
        longer = [x.main for x in (*templates, *otherwise) if x.label != t.label and len(x.main) > len(t.words)]
        return not any(m[d : d + len(t.words)] == t.words and at(m, s - d) for m in longer for d in range(len(m)))

    shares = {}
    for t in (*templates, *otherwise):
        for s in found(t):
            if t.base or counts(t, s):
                same = sum(s + k >= 0 and ws[s + k : s + k + 1] == [w] for k, w in enumerate(t.words)) / len(t.words)
                shares.setdefault((t in otherwise, t.label), []).append(same)
    own = sorted({label for other, label in shares if not other}) or sorted({label for _, label in shares})
    return ",".join(own), max((x for v in shares.values() for x in v), default=0.0)


def fingerprint(text, size=3):
    ws = (text or "").translate(LOWER).encode().split()
    shingles = [b" ".join(ws[k : k + size]) for k in range(len(ws) - size + 1)] if len(ws) >= size else [b" ".join(ws)] if ws else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, seed=42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def components(ids, fps, distance=3):
    """For each row: the smallest id reachable."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(fps))]


def contamination(docs, items, width=10):
    """docs, items: (id, text). Rows as the contract has them."""
    windows = defaultdict(set)
    for item, text in items:
        ws = words(text)
        for k in range(max(1, len(ws) - width + 1)) if ws else []:
            windows[tuple(ws[k : k + width])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        ws, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[w]
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def repeats(docs, width=100, order=None):
    """docs: (id, text); null ids sort last. id, n_bytes, n_removed, n_spans, kept_sha256 of each.

    Rows that repeat an id and a text are one document. order: what texts that share an id, or have none, are sorted by.
    """
    seen, out, done = set(), [], {}
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, order(d[1]) if order else 0)):
        data = (text or "").encode()
        if (i, data) not in done:
            gone = [False] * len(data)
            for k in range(len(data) - width + 1):
                piece = data[k : k + width]
                if piece in seen:
                    gone[k : k + width] = [True] * width
                seen.add(piece)
            spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
            kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            done[i, data] = (i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        out.append(done[i, data])
    return out


def targets(sizes, epochs=3):
    """sizes: source -> size. The excess over what a source can give goes to the others, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    out, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share, left = left / total, 0.0
        for s in sorted(open_, key=order.index):
            out[s] += share * weight[s]
            if out[s] >= epochs * sizes[s]:
                left += out[s] - epochs * sizes[s]
                out[s] = float(epochs * sizes[s])
                open_.discard(s)
    return out


#: Null, empty, blank, short, long, repeated and odd texts.
TEXTS = [
    None,
    "",
    " \t\n ",
    "Hello",
    "hello world",
    "A b c. A b c. A b c.",
    "É Ñ ß Under The MIT License. under the mit license! CC BY-NC cc by nc cc-by-nc, Apache License, Version 2.0",
    "Under\x00the\x7fMIT`license @under the mit",
    "the cat sat on the mat and then the dog came by to see what the cat was doing there at night " * 3,
    "x" * 700,
    "ab" * 400,
    "<|endoftext|> it's   <|endoftext|><|endof    we'll 123 ½ ²  \r\n\x1c\x1d don't́",
    "日本語のテキスト。これは試験です。" * 20,
    "one two three four five six seven eight nine ten eleven twelve " * 2000,
]


def ordinal_fit(rows, grades, features, passes, order, rate=0.5, shrink=1e-6):
    """The classifier's descent word for word, with sparse dictionaries and plain numbers; derivatives by differences. rows: {feature: value}."""
    w, squares = dict.fromkeys(range(features), 0.0), dict.fromkeys(range(features), 1e-3)
    first, gap, g_first, g_gap = -1.0, 0.0, 1.0, 1.0

    def loss(s, a, b, y):
        f = lambda z: 1 / (1 + math.exp(-z))
        return -math.log((1 - f(s - a), f(s - a) - f(s - b), f(s - b))[y])

    def slope(f, x):
        return (f(x + 1e-6) - f(x - 1e-6)) / 2e-6

    for k in range(passes):
        for i in order[k]:
            x, y = rows[i], grades[i]
            a, b = first, first + math.exp(gap)
            s = sum(w[f] * v for f, v in x.items())
            ds, da, db = slope(lambda z: loss(z, a, b, y), s), slope(lambda z: loss(s, z, b, y), a), slope(lambda z: loss(s, a, z, y), b)
            for f, v in x.items():
                g = ds * v + shrink * w[f]
                squares[f] += g * g
                w[f] -= rate * g / math.sqrt(squares[f])
            g = da + db
            g_first += g * g
            first -= 0.1 * g / math.sqrt(g_first)
            g = db * math.exp(gap)
            g_gap += g * g
            gap -= 0.1 * g / math.sqrt(g_gap)
    return w, first, first + math.exp(gap)
