"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def near_duplicates(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text)."""
    sets = {}
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
        words = SPACE.findall(low)
        if len(words) >= 5:
            sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        else:
            sets[doc] = {tuple(words)} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    common = Counter()
    for ds in by_shingle.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def remove_words(rows, n=20):
    """{doc_id: (n_words, n_removed, sha)} of (doc_id, text); a window that starts earlier goes."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = SPACE.findall((text or "").encode())
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            w = tuple(words[i : i + n])
            if w in seen:
                gone[i : i + n] = [True] * n
            seen.add(w)
        out[doc] = (len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def remove_bytes(rows, n=400):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)}; bytes under a string that starts elsewhere too go."""
    data = {d: (t or "").encode() for d, t in rows}
    count = Counter(b[i : i + n] for b in data.values() for i in range(len(b) - n + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """Sorted (start, rank, end) of the base findings."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)
