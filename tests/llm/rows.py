"""Small tables with the cases that every operator must bear."""

from __future__ import annotations

import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use inside under the same names; none may disturb them.
CLASH = {"row": "r", "score": 1.5, "size": 7, "length": 8, "key": "k", "copies": 3, "island": 1,
         "component": 2, "nth": 4, "id": 5, "a": 6, "b": 7, "v": 8, "mix_who": 9}


def documents(spark, rows, clash: bool = True):
    from pyspark.sql import functions as F

    filled = [(*r, *[None] * (5 - len(r))) for r in rows]
    df = spark.createDataFrame(filled, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else df


def edge_rows():
    """NULL text, id and source, empty and blank texts, repeats, a very long text, every alphabet."""
    return [
        (1, None, "en", "s1"), (2, "", "en", "s1"), (3, "  \n\t ", None, None),
        (None, "no id here, none at all", "en", None), (5, "same words again and again", "en", "s2"),
        (5, "same words again and again", "en", "s2"), (6, "same words again and again", "en", "s2"),
        (7, "word " * 9_000 + "end", "en", "s1"), (8, "漢字かな交じり 한국어 naïve é 🎉", "ja", "s3"),
        (9, "One. Two! <|endoftext|> it's", "en", "s3"), (-4, "x", "", ""),
    ]


def held(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2
