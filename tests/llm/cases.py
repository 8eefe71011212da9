"""Awkward rows that every operator on documents must take, with columns named as operators' own."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} runs on." for i in range(20_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.\nOne more line here.", "en", "a", 5),
    (2, "Alpha beta gamma delta epsilon zeta eta theta.\nOne more line here.", "en", "a", 5),
    (2, "Alpha beta gamma delta epsilon zeta eta theta.\nOne more line here.", "en", "a", 5),
    (3, "Alpha  beta gamma delta epsilon zeta eta theta.\nOne more line here.", None, "a", None),
    (4, None, "en", None, 0),
    (5, "", "fr", "b", 0),
    (6, " \t\n", None, "b", 3),
    (None, "Ein Satz ohne Nummer, aber mit Wörtern und ß.", "de", "c", 1),
    (None, None, None, None, None),
    (7, "12345 !!! ***", "es", "c", 9),
    (8, LONG, "en", "c", 9),
    (-9, "日本語 と emoji 🎉 und e\u0301", "de", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("row", "mark", "sha", "node", "bucket", "score", "ids", "rank", "body", "n", "a", "b", "tokens", "text_hash", "keep_id", "key_id",
           "__score", "__sha", "__chars", "__id", "__own", "__keep", "__nth")


def awkward(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({c: F.lit(f"x{c}") for c in CLASHES})


def nothing(spark):
    return awkward(spark).filter("false")


def texts_of(rows):
    return [(r[0], r[1] or "") for r in rows]
