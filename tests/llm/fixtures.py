"""Small awkward tables and plain helpers that the tests share."""

from __future__ import annotations

import re
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def passage(n, start=0):
    return " ".join(f"word{(start + i) * 7919 % 1009}" for i in range(n))


def awkward_rows():
    """Nulls in every column, empty and blank texts, ties, copies, odd white space, long texts, a repeated row."""
    long = passage(30_000)
    rows = [
        (1, None, "en", "web"), (2, "", "en", "web"), (3, " \n\t\x0b ", "en", None), (4, "one", None, "web"), (5, "ONE", "en", "books"),
        (6, "a b c", "en", "books"), (7, passage(80), "en", "web"), (8, passage(80), "en", "web"), (9, passage(80) + " tail", "de", "web"),
        (10, passage(60, 5) + "\n" + passage(60, 5), "de", None), (11, "x " * 5000, "en", "web"), (12, long, "en", "web"), (13, long[:-5], "en", "web"),
        (14, "É  İ \x85 \U0001f600 # $ | A1 b2\r\n\r\nc\x0cd", "fr", "web"), (15, "y" * 70_000, "en", "books"), (16, passage(80), "en", "web"), (16, passage(80), "en", "web"),
        (17, "header line of all 5 pages\n" + passage(55, 17), "en", "web"), (18, "'s it's DON'T 12345 \n\n  end  ", "en", "web"),
    ]
    return [(*r, len(r[1] or "")) for r in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def clashing(docs):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("fp", "h", "q", "size", "low", "kept", "target", "__id", "__n", "__drop", "__by_lang", "__h", "s0", "shard", "c0", "leaf", "source_size", "component", "whole", "below", "dist")
    return docs.withColumns({n: F.lit(7) for n in names})


def roots(nodes, links):
    """Smallest node reachable from each."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
