"""Small tables that hold what operators must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, bucket int, ghost boolean, k1 long, sig binary, spans string"


def awkward(spark, empty=False):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with the operators' own names."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9)))
    body = " ".join(word() for _ in range(300))
    texts = [None, "", " ", "\n", "a", "é", "1234", "!!! ...", body, body, body + " end", " ".join([word()] * 400), "x" * 70_000, "日本語 " * 50, "password = hunter22 and AKIA" + "Z" * 16, " ".join(word() for _ in range(20_000))]
    rows = [(i, t, ["en", None, "fr"][i % 3], None, None, 0.5, 1, 2, True, 9, b"x", "s") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "a text without an id", "en", "s", 20, None, None, None, None, None, None, None)]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def clashing(spark):
    """Rows with columns that the operators use themselves, of other types."""
    texts = [None, "...", "one two three password = hunter22", "one two three", "a plain text that is here twice", "another text, of another row"]
    rows = [(i, t, "en", i + 0.5, "x", [i], "12 chars", i, "p", "i", True) for i, t in enumerate(texts)]
    rows += [(11, texts[4], "en", 1.5, "y", [], None, None, "q", "j", False), (None, "a text without an id", None, None, None, None, None, None, None, None, None), (None, "and another one", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, _hits array<int>, n_chars string, id1 long, p string, _gone1 string, _score boolean")


LABELS = "doc_id long, quality int, toxic int"
BENCHMARK = "item_id long, text string"
