"""Documents with nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, kept string, name string, pos int, h int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(*texts, ids=None):
    ids = ids or range(len(texts))
    return [(i, t, "en", f"src{k % 3}" if k % 4 else None, len(t or ""), 7, "x", "y", "z", 1, 2) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


def awkward(spark):
    texts = ["a b c d", "a b c d", None, "", "  \n ", "a b c d", "é ü ß – 漢字 🙂", "word " * 9000, ("x" * 20000) + "y", ("x" * 20000) + "z", "one", "a b c d"]
    return spark.createDataFrame(rows(*texts, ids=[5, 3, 8, 9, None, 5, 11, 12, 13, 14, 15, None]), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
