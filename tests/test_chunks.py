"""Chunks against spans worked out by hand, and the chunk queries against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from pathlib import Path

import pytest

from offerlens import plans
from offerlens.operators import chunks

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("too short", []),
        ("aaaa bbbb cccc", [(0, 14, "aaaa bbbb cccc")]),
        # size 20, overlap 6, least 10: cut behind the last space of 0..20, then six back
        ("aaaa bbbb cccc dddd eeee ffff", [(0, 20, "aaaa bbbb cccc dddd"), (15, 29, "dddd eeee ffff")]),
        # no space: cut through the word; the next begins six before
        ("x" * 30, [(0, 20, "x" * 20), (14, 30, "x" * 16)]),
        # the only space is too near to the start
        ("ab " + "y" * 25, [(0, 20, "ab " + "y" * 17), (14, 28, "y" * 14)]),
        # a chunk that would begin on a space begins behind it; a short rest is left out
        ("aaaaaaaaaaaaa bbbbb c", [(0, 20, "aaaaaaaaaaaaa bbbbb")]),
    ],
)
def test_spans(text, want):
    assert chunks.spans(text, 20, 6, 10) == want


def plain_chunks(text):
    text, seen, out = re.sub(r"\s+", " ", text or "").strip(), set(), []
    for a, b, piece in chunks.spans(text):
        assert text[a:b].strip() == piece and (b == len(text) or text[b - 1] == " " or " " not in text[a + 61 : b])
        if piece not in seen:
            out.append((len(seen), a, b, hashlib.sha256(piece.encode()).hexdigest(), max(1, len(piece) // 4)))
            seen.add(piece)
    return out


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_queries(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text").collect()
    want = {r.doc_id: plain_chunks(r.text) for r in docs}
    run = lambda name: [tuple(r) for r in plans.QUERIES[name](spark, str(DATA)).collect()]
    assert sorted(run("text_chunk")) == sorted((d, i, a, b, n, h) for d, cs in want.items() for i, a, b, h, n in cs)
    assert sorted(run("chunk_stats")) == sorted((d, len(cs), sum(c[4] for c in cs), max(c[2] for c in cs)) for d, cs in want.items() if cs)
    stored = {d: {c[3] for c in cs} for d, cs in want.items() if d % 3 == 0}
    assert sorted(run("chunk_incremental")) == sorted((d, i, h) for d, cs in want.items() for i, _, _, h, _ in cs if h not in stored.get(d, ()))
    now = {r.doc_id: plain_chunks("Revised. " + r.text) for r in docs if r.doc_id % 4 == 0 and r.text is not None}
    table = defaultdict(dict)
    for d, cs in want.items():
        known = {c[3] for c in cs}
        new = {c[0]: c[3] for c in now.get(d, []) if c[3] not in known}
        table[d] = {c[0]: c[3] for c in cs} | new
    assert sorted(run("upsert_chunk")) == sorted((d, i, h) for d, cs in table.items() for i, h in cs.items())
