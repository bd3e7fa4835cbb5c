"""Plain Python statements of what the operators compute, for small tables."""

import hashlib
import re

CODE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def white_words(text):
    return WHITE.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = white_words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similarity_components(docs, percent=80):
    """docs: {doc_id: text} -> {doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def contamination(texts, items, window=13):
    """texts: [text], items: [(item_id, text)] -> [(n_words, n_hit, sorted item ids)]"""
    found = {}
    for item, text in items:
        w = CODE.findall((text or "").translate(LOWER))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            found.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w = CODE.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for k in {len(f) for f in found}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in found:
                    hit.update(range(i, i + k))
                    ids |= found[tuple(w[i : i + k])]
        out.append((len(w), len(hit), sorted(ids)))
    return out


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


def unit_bytes(text):
    """The units of a text: spaces with the word after them, a space put in front."""
    return [m.encode() for m in re.findall(r" +[^ ]*", " " + text)] if text else []


def greedy(unit, entries):
    count, i, longest = 0, 0, max(map(len, entries))
    while i < len(unit):
        size = next(k for k in range(min(longest, len(unit) - i), 0, -1) if unit[i : i + k] in entries)
        i, count = i + size, count + 1
    return count


def best_score(unit, entries, scores):
    best = [0.0] + [float("-inf")] * len(unit)
    for i in range(1, len(unit) + 1):
        for j in range(i):
            if unit[j:i] in entries:
                best[i] = max(best[i], best[j] + scores[entries[unit[j:i]]])
    return best[-1]


def summed(unit, entries, share):
    """Probability of a unit over all segmentations."""
    total = [1.0] + [0.0] * len(unit)
    for i in range(1, len(unit) + 1):
        for j in range(i):
            if unit[j:i] in entries:
                total[i] += total[j] * share[entries[unit[j:i]]]
    return total[-1]
