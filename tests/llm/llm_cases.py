"""Rows that every operator has to take: NULLs, empty and long texts, ties, repeated rows, columns named like results."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, licence string, spans string, __range int"
LONG = "word%d " * 9000 % tuple(range(9000))


def hard_rows(spark):
    rows = [
        (1, "one two three four five six seven", "en", "s", 1),
        (2, "one  two\tthree four five six seven", "en", None, None),
        (2, "one  two\tthree four five six seven", "en", None, None),
        (3, None, None, None, None),
        (4, "", "en", "s", 0),
        (None, "one two three four five six seven", "de", "s", 3),
        (None, None, None, None, None),
        (5, LONG, "en", "s", 4),
        (6, "a" * 50_000, "fr", "s", 5),
        (7, "é à 日本 🙂", "fr", "s", 6),
        (8, "mail a@b.co and 10.1.2.3 now", "en", "s", 7),
        (9, "   ", "en", "s", 3),
        (10, "two words", "es", "s", 9),
        (11, "two words", "es", "s", 9),
    ]
    return spark.createDataFrame([(*r, True, 0.5, "x", "y", 3) for r in rows], COLUMNS)


def no_rows(spark):
    return hard_rows(spark).filter("false")


def tuples(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda t: tuple((v is None, v) for v in t))
