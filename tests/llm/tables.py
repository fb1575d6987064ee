"""Small tables with the awkward cases that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "and", "ersh", "thon", "ingle", "weht", "oné", "ndly", "bleas", "tion"]) + r.choice(["", "", "a", "eb", "ot", "ui", ".", ","]) for _ in range(n))


def awkward():
    """Nulls, empty and long texts, ties, repeated rows, near copies, many bytes a character."""
    long = prose(1, 30_000)
    rows = [(None, None), (None, "x"), (1, None), (2, ""), (3, "   "), (4, long), (5, long), (5, long), (6, long + " z"), (7, "é漢字👍 " * 30), (8, "a" * 3000), (9, "ab" * 700)]
    rows += [(10 + i, prose(i % 9, 60 + i % 4)) for i in range(40)]
    return rows + rows[-1:]


def as_set(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))
