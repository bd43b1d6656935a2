"""Plain versions that the operators are held against, and tables with every awkward case."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: More columns, with names that the operators use themselves.
CLASHING = DOCUMENTS + ", size long, shard int, slot long, label string, kept boolean, _h long, _score double, whole long, ids array<int>, cluster long, hash long, word string"


def text(n, seed=0, words=("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu")):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(n))


def awkward(spark, clashing=False):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, a hot source."""
    base, long_ = text(300, 1), text(20_000, 2)
    rows = [
        (0, base, "en", "hot", 1), (1, base, "en", "hot", 1), (1, base, "en", "hot", 1), (2, base + " tail", None, "hot", None), (3, "", "de", "b", 0), (4, None, "fr", None, None),
        (5, " \t\n ", "en", "b", 3), (6, long_, "en", "hot", 9), (7, long_ + " x", "en", "hot", 9), (None, base, "en", "hot", 1), (None, None, None, None, None), (8, "one", "en", "c", 3),
        (9, "one two", "en", "c", 7), (10, "one two", "en", "c", 7), (11, "ÀÉ 日本語 🎉 ÀÉ", "ja", "", 5), (-3, text(300, 1).upper(), "en", "hot", 1), (12, "a" * 5000, "en", "b", 5000), (13, "mail me@x.org +1 (212) 555-0101", "en", "b", 30),
    ]
    if not clashing:
        return spark.createDataFrame(rows, DOCUMENTS)
    return spark.createDataFrame([(*r, 1, 2, 3, "l", True, 4, 0.5, 6, [7], 8, 9, "w") for r in rows], CLASHING)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def shingles(t, n):
    w = WORDS.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_groups(docs, n, num, den):
    """{doc_id: (set size, smallest id reachable)} by all pairs."""
    sets = {i: shingles(t, n) for i, t in docs if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y:
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    p, q = sorted((root(a), root(b)))
                    up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}
