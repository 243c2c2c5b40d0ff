"""Queries that no SQL engine at hand can express, against plain versions on whole tables."""

import hashlib
import re
import unicodedata
from collections import Counter

from scriptorium.functions import text as T
from scriptorium.operators import masking
from scriptorium.plans import registry
from scriptorium.plans.jobs import TERMINAL
from scriptorium.runtime import table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def run(spark, sf, name):
    return registry.queries()[name](spark, sf).collect()


def texts(spark, sf):
    return {r.doc_id: r for r in table(spark, sf, "documents").collect()}


def test_every_query_without_sql_is_tested_here_or_with_the_layouts():
    here = {"protected_all", "pii_masked", "pii_job_tokens", "sentence_chunks", "stream_task_decisions", "line_clusters", "reading_places", "char_lines", "unicode_forms"}
    assert registry.queries().keys() - registry.oracle_sql().keys() == here | {"overlap_resolution"}


def test_protected_all(spark, sf):
    docs = texts(spark, sf)
    got = {r.doc_id: r for r in run(spark, sf, "protected_all")}
    assert got.keys() == {d for d in docs if d + 1 in docs}
    for d, r in got.items():
        source, target = docs[d].text or "", docs[d + 1].text or ""
        for name, pattern in T.PROTECTED.items():
            found = {m[0] for m in re.finditer(pattern, source, re.ASCII)}
            assert r[name] == (sum(t not in target for t in found) if source and target else 0), (d, name)


def test_pii_masked(spark, sf):
    docs = texts(spark, sf)
    want = []
    by_job = {}
    for d in sorted(docs):
        by_job.setdefault(docs[d].source, []).append(d)
    for job, ids in by_job.items():
        n = 0
        for d in ids:
            hits = [(m.start(), i, m[0], kind) for i, (kind, p) in enumerate(masking.PATTERNS) for m in re.finditer(p, docs[d].text or "")]
            kept, end = [], 0
            for start, _, value, kind in sorted(hits):
                if start >= end:
                    kept.append((value, kind))
                    end = start + len(value)
            for value, kind in reversed(kept):
                n += 1
                want.append((job, d, f"__DLP_TOKEN_{n:04d}__", sha(value), kind))
    assert sorted(map(tuple, run(spark, sf, "pii_masked"))) == sorted(want)
    assert [tuple(r) for r in run(spark, sf, "pii_job_tokens")] == sorted((w for w in want if w[0] == "src1"), key=lambda w: w[1:3])


def test_sentence_chunks(spark, sf):
    def size(t):
        return max(1, len(t) // 4)

    def packed(parts):
        out, now = [], None
        for p in parts:
            if now is None:
                now = p
            elif size((now + " " + p).strip()) <= 120:
                now = (now + " " + p).strip()
            else:
                out.append(now)
                now = p
        return out + ([now] if now is not None else [])

    got = {r.doc_id: (r.n_chunks, r.longest) for r in run(spark, sf, "sentence_chunks")}
    for d, r in texts(spark, sf).items():
        text = r.text or ""
        ends = [m.end() for m in re.finditer(r"[.!?。！？]\s+", text)]
        sentences = [s for s in (re.sub(r"(?<=[.!?。！？])\s+\Z", "", text[a:b]) for a, b in zip([0, *ends], [*ends, len(text)], strict=True)) if s]
        chunks = [p for c in packed(sentences) for p in (packed(c.split(" ")) if size(c) > 120 else [c])] or [text]
        assert got[d] == (len(chunks), max(map(len, chunks))), d


def test_stream_task_decisions(spark, sf):
    rows = sorted(table(spark, sf, "events").collect(), key=lambda r: (r.ts, r.event_id))
    states, want = {}, Counter()
    for r in rows:
        status, owner = ("completed" if r.event_id % 11 == 0 else "processing"), f"w{r.event_id % 2}"
        seconds = int(r.ts.timestamp())
        now = states.get(r.user_id, {"status": "queued", "owner": None, "until": 0})
        if now["status"] in TERMINAL:
            want["noop"] += 1
            continue
        if now["owner"] not in (None, owner) and seconds < now["until"]:
            want["defer"] += 1
            continue
        want["retry" if now["status"] == "processing" and now["owner"] != owner else "run"] += 1
        ended = status in TERMINAL
        states[r.user_id] = {"status": status, "owner": None if ended else owner, "until": 0 if ended else seconds + 86_400}
    assert {r.decision: r.n for r in run(spark, sf, "stream_task_decisions")} == dict(want)


def test_unicode_forms(spark, sf):
    want = {(r.conv_id, r.turn): sha(unicodedata.normalize("NFKC", (r.text or "") + "ﬁ²")) for r in table(spark, sf, "conversations").collect()}
    assert {(r.conv_id, r.turn): r.sha256 for r in run(spark, sf, "unicode_forms")} == want


def test_line_clusters(spark, sf):
    """Boxes share a line if their bands overlap in height and no wide gap lies between them."""
    from scriptorium.plans import layout

    pages = {}
    for r in layout.chars(spark, sf).collect():
        pages.setdefault(r.page, []).append((r.a.y, r.char_id, r.a.y2, r.a.x, r.a.x2))
    want = set()
    for page, boxes in pages.items():
        bands = []
        for y, c, y2, x, x2 in sorted(boxes):
            fit = [b for b in bands if min(b["y2"], y2) - max(b["y"], y) > 0.5 * min(b["y2"] - b["y"], y2 - y)]
            band = fit[-1] if fit else {"y": y, "y2": y2, "in": []}
            if not fit:
                bands.append(band)
            band["in"].append((x, c, x2, y2 - y))
        for band in bands:
            line, end = [], None
            for x, c, x2, height in sorted(band["in"]):
                if end is not None and x - end > 3.5 * height:
                    want.add((page, frozenset(line)))
                    line, end = [], None
                line.append(c)
                end = x2 if end is None else max(end, x2)
            want.add((page, frozenset(line)))
    got = {}
    for r in run(spark, sf, "line_clusters"):
        got.setdefault((r.page, r.line), []).append(r.char_id)
    assert {(p, frozenset(v)) for (p, _), v in got.items()} == want


def test_reading_places(spark, sf):
    """Against a table of all pairs, searched anew for each step."""
    import numpy as np

    from scriptorium.plans import layout

    pages = {}
    for r in layout.layouts(spark, sf).collect():
        pages.setdefault(r.page, []).append((r.layout_id, (r.b.x, r.b.y, r.b.x2, r.b.y2)))
    want = {}
    for page in pages.values():
        ids, first = zip(*sorted(page))
        n = len(ids)
        box = np.zeros((2 * n, 4))
        box[:n] = first
        size = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
        cost, late, alive, made = np.full((2 * n, 2 * n), np.inf), np.zeros((2 * n, 2 * n), bool), np.zeros(2 * n, bool), {}
        common = lambda i, j: np.concatenate((np.minimum(box[i, :2], box[j, :2]), np.maximum(box[i, 2:], box[j, 2:])))

        def enter(i):
            for j in np.flatnonzero(alive):
                cost[i, j] = size(common(i, j)) - size(box[i]) - size(box[j])
            alive[i] = True

        for i in range(n):
            enter(i)
        count = n
        while alive.sum() > 1:
            free = np.where(late, np.inf, cost)
            table = free if np.isfinite(free).any() else cost
            i, j = np.unravel_index(table.argmin(), table.shape)
            c = common(i, j)
            others = alive.copy()
            others[[i, j]] = False
            between = (box[others, 0] < c[2]) & (c[0] < box[others, 2]) & (box[others, 1] < c[3]) & (c[1] < box[others, 3])
            if not late[i, j] and between.any():
                late[i, j] = True
                continue
            alive[[i, j]] = False
            cost[[i, j]] = np.inf
            cost[:, [i, j]] = np.inf
            box[count], made[count] = c, (i, j)
            enter(count)
            count += 1

        def walk(i):
            if i < n:
                return [i]
            return [x for k in sorted(made[i], key=lambda k: (0.5 * box[k, 0] - 1.5 * (box[k, 1] + box[k, 3]), k)) for x in walk(k)]

        want |= {ids[i]: p for p, i in enumerate(walk(int(np.flatnonzero(alive)[0])))}
    assert {r.id: r.place for r in run(spark, sf, "reading_places")} == want


def test_lines_by_example():
    from scriptorium.plans.typeset import lines_of

    row = lambda y, xs, w=5, h=10: [(x, y, x + w, y + h) for x in xs]
    assert lines_of([]) == []
    assert lines_of(row(0, [0, 6, 12])) == [[0, 1, 2]]
    assert lines_of([*row(0, [6, 0]), *row(30, [0])]) == [[1, 0], [2]]  # by left edge, from the top
    assert lines_of(row(0, [0, 6, 60])) == [[0, 1], [2]]  # out of reach
    assert lines_of([*row(0, [0]), (6, 3, 9, 7)]) == [[0, 1]]  # a small box inside the band
    assert lines_of([*row(0, [0]), *row(4, [6]), *row(8, [12]), *row(12, [18])]) == [[0, 1, 2, 3]]  # the band grows with each
    assert lines_of([*row(0, [0]), *row(6, [6]), *row(12, [12])]) == [[0], [1], [2]]
    assert lines_of([(0, 0, 100, 20), (40, 14, 44, 19)]) == [[0, 1]]  # one inside the other


def test_char_lines(spark, sf):
    """Every box has one place; lines are runs from 0, and no two of a page could still be joined or lie apart inside."""
    from scriptorium.plans import layout

    boxes = {(r.page, r.char_id): (r.a.x, r.a.y, r.a.x2, r.a.y2) for r in layout.chars(spark, sf).collect()}
    got = run(spark, sf, "char_lines")
    assert {(r.page, r.id) for r in got} == boxes.keys() and len(got) == len(boxes)
    lines = {}
    for r in sorted(got, key=lambda r: (r.page, r.line, r.place)):
        assert r.place == len(lines.setdefault((r.page, r.line), []))
        lines[r.page, r.line].append(boxes[r.page, r.id])
    for page in {p for p, _ in lines}:
        assert sorted(n for p, n in lines if p == page) == list(range(sum(p == page for p, _ in lines)))
    outline = lambda line: (min(b[0] for b in line), min(b[1] for b in line), max(b[2] for b in line), max(b[3] for b in line))
    for (p, n), line in lines.items():
        assert [b[0] for b in line] == sorted(b[0] for b in line)
        for (q, m), other in lines.items():
            if p == q and n < m:
                a, b = outline(line), outline(other)
                across, down = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                least = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
                assert not (across > 0 and down > 0 and across * down > 0.6 * least)
