"""Small document tables with everything that may go wrong in them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use inside.
CLASHING = ("id", "size", "row", "key", "h", "code", "rank", "start", "maps", "score", "kept", "d", "m")
WORDS = "the of and a to in is you that it he was for on are as with his they at be this have from".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", str(r.randrange(30))]) for _ in range(n))


def documents(seed=0, n=40):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, prose(r, r.randrange(1, 120)), r.choice(["en", "de", "fr", None]), r.choice(["s1", "s1", "s1", "s2", "é", None]), 1))
    shared = prose(r, 60)
    rows += [
        (100, None, "en", "s1", None),
        (101, "", None, None, 0),
        (102, " \t\n\x0b ", "en", "s2", 5),
        (103, "one two", "en", "s1", 7),
        (104, "one two", "en", "s1", 7),
        (105, "  ünïcode \U0001f600 wörds\r\nhere and\x0cthere", "de", "s2", 1),
        (106, rows[3][1], "en", "s1", 1),
        (107, rows[3][1] + " tail", "en", "s1", 1),
        (108, "intro words here " + shared + " end", "en", "s1", 1),
        (109, "another start " + shared, "en", "s2", 1),
        (110, shared + " " + shared, "en", "s2", 1),
        (111, prose(r, 6000), "en", "s3", 1),
        (112, "1234 5678 !!", "en", "s3", 1),
        (113, "x" * 5000, "en", "s3", 1),
        (114, "THE OF AND A TO IN", "en", "s3", 1),
        (5, rows[5][1], "en", "s1", 1),
        (5, rows[5][1], "en", "s1", 1),
    ]
    return rows


def frame(spark, rows, clashing=False):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASHING if clashing else ():
        d = d.withColumn(c, F.lit("clash"))
    return d


def words(text, lower=False):
    import re

    if lower:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
