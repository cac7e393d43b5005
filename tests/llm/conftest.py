import random

import pytest

#: Rows of every awkward kind; the extra columns have names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, start long, component_id long, rank string"
SYLLABLES = {"en": ["the", "ing", "and", "er", "th", "ed", "ou", "sh"], "de": ["sch", "ung", "ein", "pf", "keit", "ü", "ä", "ge"], "es": ["ción", "que", "ñ", "el", "ado", "ll", "ez", "os"]}


def prose(rng, lang, n):
    word = lambda: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
    return " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(90):
        lang = ("en", "de", "es")[i % 3]
        text = prose(rng, lang, rng.randint(30, 160))
        if i % 10 == 4:
            text = " ".join([prose(rng, lang, 6).upper() + "!!"] * 12)
        if i % 8 == 1:
            text += " you idiot scum"
        rows.append([i, text, lang, "a" if i % 3 else "b"])
    base = rows[2][1]
    rows += [[100 + k, base, "es", "a"] for k in range(5)]  # copies
    rows += [[110 + k, base + f" z{k}", "es", "c"] for k in range(5)]  # near copies
    rows += [[120, None, "en", "a"], [121, "", "en", None], [122, " \n\t ", None, None], [123, "12 34 !!", "en", "c"], [124, prose(rng, "de", 40_000), "de", "c"], [125, "x" * 50_000, None, "c"]]
    rows += [rows[0][:], rows[0][:]]  # repeated rows
    rows += [[126, "odd\x0bspace here \x1c <|endoftext|> tail <|startoftext|>x", "en", "c"], [127, "é日本 ́a ΑΣ it's\r\n\r\n  I'LL  ", "en", "c"], [None, "no id here at all", "en", "a"]]
    return [(*r, 1, 0.5, 7, 3, 9, "r") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.cache()
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
