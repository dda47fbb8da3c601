"""A small corpus for the tests of the text operators."""

import random

import pytest


def texts():
    """Small corpus: exact, near and spaced copies, shared passages, nulls, empties, a long text, repeated rows."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))
    passage = prose(90)
    rows = [(i, prose(r.randint(5, 160))) for i in range(30)]
    rows += [(30 + i, f"{prose(20)} {passage} {prose(15)}") for i in range(5)]
    base = prose(200).split()
    for i in range(6):
        other = list(base)
        other[20 + 25 * i] = f"zz{i}"
        rows.append((40 + i, " ".join(other)))
    rows += [(50, rows[3][1]), (51, "  " + rows[3][1].replace(" ", "\n")), (52, rows[4][1]), (53, rows[4][1]), (53, rows[4][1])]
    rows += [(60, None), (61, ""), (62, " \n\t"), (63, "one two"), (64, "one two"), (65, "la " * 400), (66, "é" * 900),
             (67, "a\nb\nc\nd"), (68, "x\na\nb\nc\ny"), (None, rows[5][1]), (70, prose(6000))]
    return rows


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows, DataFrame with extra columns whose names the operators use themselves)."""
    rows = texts()
    df = spark.createDataFrame(
        [(i, t, "en", None if n % 11 == 0 else f"s{n % 3}", n, "x", -1) for n, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long, text_key string, score int")
    return rows, df
