"""Fixture tables and brute-force helpers for the numbered operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
             for _ in range(vocabulary)]
    out = []
    for i in range(n):
        out.append(rng.choice(names))
        if rng.random() < 0.08:
            out[-1] += ".\n" if rng.random() < 0.5 else "."
    return " ".join(out).replace("\n ", "\n")


def fixture_rows(seed=3):
    """Documents with nulls, empties, long texts, exact and near copies, shared
    passages, repeated rows, other white space and other scripts."""
    rng = random.Random(seed)
    shared = prose(rng, 70)
    base = prose(rng, 300)
    rows = []
    for i in range(60):
        rows.append((i, prose(rng, rng.randint(1, 400)), rng.choice(["en", "de"]), f"src{min(i % 7, 3)}"))
    for i in range(60, 75):  # a passage that many documents share, at different places
        rows.append((i, prose(rng, rng.randint(0, 60)) + " " + shared + " " + prose(rng, 20), "en", "src0"))
    for i in range(75, 90):  # near copies of one text
        w = base.split(" ")
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(1000)
        rows.append((i, " ".join(w), "en", "src1"))
    rows += [(90 + i, base, "en", "src0") for i in range(6)]          # exact copies
    rows += [(100, None, None, None), (101, "", "en", "src2"), (102, " \n\t ", "en", "src2"),
             (103, "one", "en", "src2"), (104, "one two", "en", None), (105, "One TWO three", None, "src2"),
             (106, "one two three", "en", "src2")]
    rows.append((107, ("ab " * 900).strip(), "en", "src2"))           # one window over and over
    rows.append((108, prose(rng, 6000, 3000), "en", "src2"))         # long
    rows.append((109, "línea ünï \u00a0 \x1c слово 漢字 \r\n\x0b end\u2028x  two  blanks ", "ru", "src2"))
    rows.append((110, base.upper(), "en", "src2"))
    rows += [(7, rows[7][1], "en", "src2")] * 2                       # repeated rows
    rows += [(None, shared, "en", "src2"), (None, shared, "en", "src2")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


def documents(spark, rows=None):
    """The fixture as a DataFrame, with extra columns that clash with inner names."""
    rows = fixture_rows() if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    return df.withColumns({"rk": F.lit("x"), "h": F.lit(1), "shard": F.lit("s"), "length": F.lit(2.5),
                           "score": F.lit("z"), "part": F.lit(None).cast("string")})
