"""Row-at-a-time model of the search, for comparison."""

import math


def similarity(a, b):
    return 1.0 / (1.0 + sum((x - y) ** 2 for x, y in zip(a, b)))


def search(queries, items, spec, term_scoring="bm25", exclude_self=False):
    """queries, items: {id: {column: value}}. Returns ({id: [(item, score, names)]}, {id: (total, max)})."""
    counts = {}
    for row in items.values():
        for c in spec.clauses:
            if c.kind == "exact":
                counts[c.field, row[c.field]] = counts.get((c.field, row[c.field]), 0) + 1
    hits, summary = {}, {}
    for qid, q in queries.items():
        active = [c for c in dict.fromkeys(spec.clauses) if q.get(c.field, "x") != "" and q[c.column] not in (None, "")]
        found = []
        for iid, item in items.items():
            if exclude_self and iid == qid:
                continue
            score, names, optional, fits = 0.0, [], 0, True
            for c in active:
                if c.kind == "vector":
                    base = similarity(q[c.column], item[c.column]) if item[c.column] is not None else -1
                    hit = base >= c.min_score
                else:
                    hit = q[c.field] == item[c.field]
                    n = counts.get((c.field, q[c.field]), 0)
                    base = math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) if term_scoring == "bm25" else 1.0
                if hit:
                    score += base * c.weight
                    names.append(c.name)
                    optional += c.occur == "should"
                elif c.occur == "must":
                    fits = False
            if not active:
                found.append((iid, 1.0, []))
            elif fits and optional >= spec.min_should and names:
                found.append((iid, round(score, 6), names))
        found.sort(key=lambda f: (-f[1], f[0]))
        hits[qid] = found[: spec.size]
        summary[qid] = (len(found), found[0][1] if found else None)
    return hits, summary
