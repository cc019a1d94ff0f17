import random

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r st lt sk m".split()]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, score double, row long, n_hit long, times int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def docs(spark, rows, parts=3):
    """Documents from (doc_id, text[, source[, lang]]), with extra columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, 2, 0.5, 3, 4, 5) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def odd_rows(rng: random.Random):
    """Nulls, empty, blank and very long texts, repeated rows, a row without an id."""
    long_ = prose(rng, 30_000)
    same = prose(rng, 40)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long_), (5, same), (5, same), (6, same), (None, same), (None, None), (7, "one two"), (8, "Ünïcödé çà 漢字 " * 5)]
