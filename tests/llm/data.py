"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

SYLLABLES = {
    "en": "the and ing ion ent ess able wh th sh er re on an".split(),
    "de": "sch und ung keit lich ein ver ber pf ß ü ö ä tz".split(),
    "fr": "eau eux que oui ment ré è ç ê tion elle ou ai".split(),
}
#: Columns whose names the operators use inside.
CLASHING = {"id": "x", "fp": 1, "node": "n", "th": 2, "_gone": "g", "_first": "f", "_hit": "h", "component": 3, "lang_pred": "zz"}


def prose(rng: random.Random, words: int, lang: str = "en", per_line: int = 12) -> str:
    made = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(made[i : i + per_line]) for i in range(0, words, per_line))


def documents(n: int = 60, seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): prose, exact and near copies, nulls, empty, short and long texts."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = ("en", "en", "de", "fr")[k % 4]
        rows.append((k, prose(rng, rng.randint(20, 150), lang), lang, "s0"))
    for k in range(8):  # near copies: a word or two changed
        words = rows[k][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((n + k, " ".join(words), rows[k][2], "s0"))
    n += 8
    rows += [(n, rows[3][1], "en", "s1"), (n + 1, rows[3][1], None, "s1"), (n + 2, None, "en", "s2"), (n + 3, "", None, None), (n + 4, "!!! 123 ...", "en", "s2"), (n + 5, "one two", "en", "s2"), (n + 6, prose(rng, 30_000), "en", "s3"), (None, "a text that has no id at all here", "en", "s3"), (n + 7, "x" * 5000, "en", "s3"), (n + 8, " \t\n \r\n", "en", "s3")]
    rows.append(rows[5])  # a row twice
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, clash: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(v) for c, v in CLASHING.items()}) if clash else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
