"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(ids, links):
    """id: smallest id reached."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 10 or 100 * r > 20 * n


def substring(docs, k=13):
    """doc_id: (n_words, n_removed, sha256) for unique ids."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def jaccard(a, b, k=5):
    grams = lambda t: {tuple(w[i : i + k]) for w in [WORD.findall(lower(t))] for i in range(max(1, len(w) - k + 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


class Ctw:
    """Context trees as nested dicts, mixed by recursion; no node is pooled."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = defaultdict(lambda: [0, 0])
        self.below = defaultdict(set)
        for t in texts:
            data = b"\0" * depth + t
            for i in range(depth, len(data)):
                for j in range(8):
                    prefix, bit = 1 << j | data[i] >> (8 - j), data[i] >> (7 - j) & 1
                    for k in range(depth + 1):
                        self.counts[(data[i - k : i], prefix)][bit] += 1
                        if k:
                            self.below[(data[i - k + 1 : i], prefix)].add(data[i - k : i])
        self.memo = {}

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, ctx, prefix):
        key = (ctx, prefix)
        if key not in self.memo:
            own = self.kt(*self.counts[key])
            kids = self.below.get(key)
            self.memo[key] = own if not kids or len(ctx) == self.depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(self.weighted(c, prefix) for c in kids))
        return self.memo[key]

    def one(self, ctx, prefix, k=0):
        """P(1) from the node of the last k bytes on."""
        node = (ctx[len(ctx) - k :], prefix)
        if node not in self.counts:
            return 0.5
        a, b = self.counts[node]
        estimate = (b + 0.5) / (a + b + 1)
        if k == self.depth or node not in self.below:
            return estimate
        stop = math.exp(math.log(0.5) + self.kt(a, b) - self.weighted(*node))
        return stop * estimate + (1 - stop) * self.one(ctx, prefix, k + 1)

    def log10(self, text):
        data, total = b"\0" * self.depth + text, 0.0
        for i in range(self.depth, len(data)):
            for j in range(8):
                p = self.one(data[i - self.depth : i], 1 << j | data[i] >> (8 - j))
                total += math.log10(p if data[i] >> (7 - j) & 1 else 1 - p)
        return total


def best_score(a, b):
    """Most points of an alignment of (label, digest) lists, by trying all: two for equal pairs, one for equal labels."""
    if not a or not b:
        return 0
    met = (2 if a[0] == b[0] else 1) + best_score(a[1:], b[1:]) if a[0][0] == b[0][0] else 0
    return max(met, best_score(a[1:], b), best_score(a, b[1:]))


def expression(node, top=True):
    """A wrapper as a regular expression over ``<label> ... </label>`` and ``{text}``; elements of a bag go by their tag."""
    if node.label == "#":
        return r"(?:\{[^{}]*\})" + "+" * node.plus
    kids = [f"(?:{expression(k, False)})" + "?" * k.maybe for k in node.kids]
    inner = f"(?:{'|'.join(kids) or 'x{0}'})*" if node.bag else "".join(kids)
    if top:
        return inner
    tag = re.escape(node.label) + r"[^>]*"
    return f"(?:<{tag}>{inner}</{tag}>)" + "+" * node.plus


def element_text(html_root):
    """A nested tuple (label, children or text) as the text that ``expression`` is about."""
    label, inner = html_root
    if label == "#":
        return "{" + inner + "}"
    return f"<{label}>" + "".join(map(element_text, inner)) + f"</{label}>"


def element_html(root):
    label, inner = root
    if label == "#":
        return inner
    tag, *classes = label.split(".")
    return f"<{tag}" + (f" class='{' '.join(classes)}'" if classes else "") + ">" + "".join(map(element_html, inner)) + f"</{tag}>"
