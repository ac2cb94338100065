"""Documents with what real tables hold: nulls in any column, empty and very long texts, ties and
repeated rows, and columns named as the operators name theirs."""

import random

WORDS = "the of and erth thing shand tion ble ander with from that onre hent estion was for are inth ore".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


LONG = prose(6000, 99)
DOCS = [
    (1, "That it.", "en", "a", 8),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, " \t\n ", "en", None, 4),
    (None, "No id here, but words enough to make shingles.", "en", "a", 40),
    (None, None, None, None, None),
    (5, LONG, "en", "a", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (7, prose(200, 7), "en", "b", 1),
    (7, prose(200, 7), "en", "b", 1),
    (7, prose(200, 8), "de", "c", 1),
    (8, prose(200, 7) + " end", "de", "c", 1),
    (9, "日本語のテキスト 🎉 text", None, "ü", 15),
    (10, "ONE two", "en", "a", 7),
    (11, "one TWO", "en", "b", 7),
    (-5, prose(40, 3), "fr", "c", 1),
    (2**60, prose(40, 4), "fr", None, 1),
]
#: Names that operators use inside.
CLASH = ("id", "tie", "bucket", "size", "h", "n", "key", "text2", "x", "evidence", "kept", "score", "component", "u", "v")


def documents(spark, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS if rows is None else rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(3).withColumns({c: F.lit("clash") for c in CLASH})
