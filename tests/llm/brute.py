"""Brute-force models of the operators, on Python lists of (doc_id, text)."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def covered(sequences, length):
    """Flags of the symbols covered by a window of the length that starts twice."""
    count = collections.Counter()
    for s in sequences:
        for k in range(len(s) - length + 1):
            count[bytes(s[k : k + length]) if isinstance(s, bytes) else tuple(s[k : k + length])] += 1
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for k in range(len(s) - length + 1):
            if count[bytes(s[k : k + length]) if isinstance(s, bytes) else tuple(s[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append(gone)
    return out


def bytes_dedup(docs, length=400):
    texts = [(t or "").encode() for _, t in docs]
    out = []
    for (i, _), b, gone in zip(docs, texts, covered(texts, length), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words_dedup(docs, length=35):
    texts = [words(t) for _, t in docs]
    out = []
    for (i, _), b, gone in zip(docs, texts, covered(texts, length), strict=True):
        kept = " ".join(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k=5):
    w = words(low(text))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return set(zip(*[w[j:] for j in range(k)], strict=False))


def jaccard(docs, k=5, percent=75):
    """Rows (doc_id, n_shingles, component_id)."""
    sets = [shingles(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k_, (i, _) in enumerate(docs):
        r = find(k_)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, len(s), least.get(find(k_)) if s else i) for k_, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)
