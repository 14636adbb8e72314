"""Brute-force versions of the operators, on Python objects."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text, fold=True):
    return WORD.findall((text or "").translate(FOLD) if fold else (text or ""))


def shingles(text, width=3):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard_groups(docs, width=3, num=90, den=100):
    """``{id: (n_shingles, component)}`` of ``{id: text}``."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    top = {i: i for i in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def jaccard_links(docs, width=3, num=90, den=100):
    """``{id: n_links}``: with how many other different sets each of ``{id: text}`` links."""
    sets = {i: frozenset(shingles(t, width)) for i, t in docs.items()}

    def links(a, b):
        both = len(a & b)
        return a != b and both and both * den >= num * (len(a) + len(b) - both)

    return {i: sum(bool(links(x, y)) for y in set(sets.values())) for i, x in sets.items()}


def substring_dedup(docs, window=50):
    """``{id: kept words}`` of ``{id: text}``."""
    first, out = {}, {}
    for i in sorted(docs):
        w = words(docs[i], fold=False)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        out[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out


def contaminated(docs, items, width=5, least=0.8):
    """``{(doc, item)}`` where some window as long as the item is similar enough."""
    out = set()
    for i, text in docs.items():
        w = words(text)
        for j, item in items.items():
            v = words(item)
            if not v or not w:
                continue
            k = min(width, len(v))
            span, want = min(len(v), len(w)), Counter(tuple(v[p : p + k]) for p in range(len(v) - k + 1))
            for start in range(len(w) - span + 1):
                have = Counter(tuple(w[p : p + k]) for p in range(start, start + span - k + 1))
                union = sum((have | want).values())
                if union and sum((have & want).values()) / union >= least:
                    out.add((i, j))
                    break
    return out


class SuffixTree:
    """A probabilistic suffix tree of ``texts``, lists of tokens that end in None."""

    def __init__(self, texts, depth, least_context, least_next, prior):
        self.words = Counter(x for t in texts for x in t)
        self.total, self.size, self.states = sum(self.words.values()), len(self.words), {}
        for d in range(1, depth + 1):
            follow = {}
            for t in texts:
                for k in range(d, len(t)):
                    follow.setdefault(tuple(t[k - d : k]), Counter())[t[k]] += 1
            new = {}
            for context, seen in follow.items():
                n = sum(seen.values())
                if n < least_context:
                    continue
                usual = {w: self.probability(context[1:], w) for w, c in seen.items() if c >= least_next}
                ratio = lambda c, e: 2 * (c * math.log(c / e) - (c - e))
                kept = {w for w, p in usual.items() if ratio(seen[w], n * p) >= 2 * math.log(self.total)}
                if kept:
                    share = {w: (seen[w] + prior * usual[w]) / (n + prior) for w in kept}
                    new[context] = share, max(1 - sum(share.values()), 1e-12) / max(1 - sum(usual[w] for w in kept), 1e-12)
            self.states |= new

    def probability(self, context, word):
        """Of ``word`` after the longest suffix of ``context`` that is a state."""
        if not context:
            return (self.words[word] + 1) / (self.total + self.size + 1)
        if context not in self.states:
            return self.probability(context[1:], word)
        share, scale = self.states[context]
        return share[word] if word in share else scale * self.probability(context[1:], word)

    def score(self, tokens, depth):
        return sum(math.log10(self.probability(tuple(tokens[max(0, k - depth) : k]), w)) for k, w in enumerate(tokens))


_TOKENIZER = None


def ids(text, end):
    global _TOKENIZER
    _TOKENIZER = _TOKENIZER or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*_TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def crc(numbers):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in numbers))


def sha(kept):
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()
