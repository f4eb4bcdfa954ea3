"""Small fixtures and brute-force versions for the pipeline operators' tests."""

import collections
import hashlib
import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def rows_of(name, *columns):
    return list(zip(*(pq.read_table(f"{SF}/{name}.parquet")[c].to_pylist() for c in columns)))


def documents():
    return rows_of("documents", "doc_id", "text")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {k + i for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for i in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def components(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(range(len(docs)), key=lambda k: docs[k][0])
    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]) and find(i) != find(j):
                x, y = sorted((find(i), find(j)), key=lambda k: docs[k][0])
                root[y] = x
    return {docs[k][0]: (len(sets[k]), docs[find(k)][0]) for k in range(len(docs))}


def hits(docs, items):
    windows = collections.defaultdict(set)
    for name, text in items:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        for k in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[k : k + 10])].add(str(name))
    out = {}
    for i, text in docs:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in set(map(len, windows)):
            for k in range(len(words) - n + 1):
                if own := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(words), len(hit), sorted(found))
    return out


def removed(docs):
    """doc_id -> (bytes, removed, spans, sha of the rest), documents in order of id."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            w = data[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone) if not g)))
    return out


def targets(sizes):
    """Water-filled targets of {source: words}, sources in order with null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        out = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        more = {s for s in order if s not in capped and out[s] > 2 * sizes[s]}
        if not more:
            return out
        capped |= more
