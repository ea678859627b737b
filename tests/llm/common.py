"""Small tables and brute-force versions for the training-data operators."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row long, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), "x", 1, "y") for d, t, s in rows], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width=5):
    words = WORD.findall(lowered(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def components(rows, percent):
    """doc_id -> smallest id reachable, by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = top(a), top(b)
                parent[max(u, v)] = min(u, v)
    return {d: top(d) for d in sets}
