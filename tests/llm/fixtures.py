"""Small awkward tables: nulls, empty and long texts, repeats, clashing columns."""

import random


def words(n, seed=0, letters="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, fp string, key string, size string, `a.b` string, `q'x y` int, M0 int, Row int"


def odd_documents(spark):
    base = words(60, 1)
    texts = [base, base, base + " x", None, "", "  \n ", "Ärger, ÉTÉ niño 12345!", words(20_000, 2), "a", base.upper(), "mail me@x.org or +49 30 1234567", "é ü\t\tz   q", "<|endoftext|> \U0001f600"]
    rows = [(n, t, "en" if n % 2 else None, ["a", None, "b"][n % 3], None if t is None else len(t), 1, "x", "k", "s", "dot", 1, None, 2) for n, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, "no id", None, None, 5, *[None] * 8)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
