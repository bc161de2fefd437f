"""Small tables with the awkward cases every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, items string"

WORDS = "amber birch cedar dune ember fjord grove haze iris jade kelp loam moss north oak pine quartz reed slate thorn".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward_documents(seed=3, n=60):
    """Nulls in any column, empty and long texts, ties, repeated rows, near copies, and columns called like results."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = prose(rng, rng.randrange(1, 120))
        rows.append([i, t])
    base = prose(rng, 80)
    for i in range(n, n + 40):  # a group of near copies, each with a word or two changed
        w = base.split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"odd{rng.randrange(1000)}"
        rows.append([i, " ".join(w)])
    for i in range(n + 40, n + 55):
        rows.append([i, rows[i % 5][1].upper() if i % 2 else rows[i % 5][1]])
    rows += [[1000, None], [1001, ""], [1002, " \n\t "], [1003, prose(rng, 6000)], [1004, "one"], [1005, "ONE"], [1006, "a b c d"], [None, base], [1007, "é ü   ß\x00x\x1cy 日本語 😀"]]
    rows.append(list(rows[3]))  # a repeated row
    return [(d, t, None if k % 7 == 0 else "en", None if k % 11 == 0 else "web", None if t is None or k % 13 == 0 else len(t), "clash", None) for k, (d, t) in enumerate(rows)]


def awkward(spark, **options):
    return spark.createDataFrame(awkward_documents(**options), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
