"""Each stage of the pipeline on its own input, and the whole of it."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline as p
import duckdb
import numpy as np
import public_tokenizers
import pytest
from fixtures import DATA, awkward, clashing, roots, rows_of, words
from pyspark.sql import functions as F
from test_queries import RANKS, brute_counts, encoding

from offerlens.llm import lines, mixing, simhash

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
STAGES = dict(p.STAGES)


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_stage_on_odd_input(spark, name, kind):
    docs = clashing(awkward(spark)) if kind == "awkward" else clashing(awkward(spark)).limit(0)
    out = STAGES[name](spark, docs, str(DATA))
    assert out.count() >= 0
    if name != "encode":
        assert out.columns == docs.columns


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def shingles(text):
    w = words((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(str(DATA.parent / "sf0.01/documents.parquet"))
    stayed = {r.doc_id for r in STAGES["near_dedup"](spark, docs, "").select("doc_id").collect()}
    rows = {r.doc_id: shingles(r.text) for r in docs.collect()}
    by = {}
    for i, s in rows.items():
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for x in by.values() if 1 < len(x) < 200 for a in x for b in x if a < b}
    sim = {ab: jaccard(rows[ab[0]], rows[ab[1]]) for ab in pairs}
    near = [ab for ab, j in sim.items() if j >= 0.9]
    assert near and sum(b in stayed for _, b in near) <= 0.02 * len(near)
    loose = roots(rows, [ab for ab, j in sim.items() if j >= 0.4])
    alone = {i for i, n in Counter(loose.values()).items() if n == 1 and rows[i]}
    assert alone <= stayed
    assert {root for i, root in loose.items() if rows[i]} <= stayed


def test_near_dedup_takes_one_of_repeated_rows(spark):
    got = Counter(r.doc_id for r in STAGES["near_dedup"](spark, awkward(spark).union(awkward(spark).selectExpr("cast(null as long)", "text", "lang", "source", "n_chars").limit(2)), "").collect())
    assert got[None] == 2 and all(n == 1 for i, n in got.items() if i is not None)
    assert {1, 4, 7, 12}.issubset(got) and not {2, 3, 5, 8, 9, 16}.intersection(got)


def near_dedup_of(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in STAGES["near_dedup"](spark, docs, "").select("doc_id").collect()}


def test_near_dedup_judges_sets_of_shingles(spark):
    lines = {x: "\n".join(" ".join(f"{x}{i}w{j}" for j in range(14)) for i in range(22)) for x in "abcdefgh"}
    common = " ".join(f"same{j}" for j in range(14)) + "\n"
    # own texts that repeat one line, and texts that differ only in how often a line stands there
    assert near_dedup_of(spark, [t + "\n" + common * 40 for t in lines.values()]) == set(range(8))
    texts = [t + "\n" + (t.split("\n")[-1] + "\n") * n for t in lines.values() for n in (1, 40)]
    assert near_dedup_of(spark, texts) == set(range(0, 16, 2))


def test_near_dedup_finds_isolated_pairs_at_the_similarity(spark):
    # 320 or 319 shingles in common and 40 own ones each: a similarity of exactly 0.8 and just below, with no third text near
    def pair(i, both):
        own = lambda side, n: " ".join(f"p{i}{side}{j}" for j in range(n))
        shared = " ".join(f"p{i}w{j}" for j in range(both + 4))
        return f"{shared} {own('a', 40)}", f"{shared} {own('b', 40)}"

    texts = [t for i in range(200) for t in pair(i, 320)]
    assert jaccard(shingles(texts[0]), shingles(texts[1])) == 0.8
    assert len(near_dedup_of(spark, texts)) <= 200 + 0.05 * 200
    texts = [t for i in range(100) for t in pair(i, 319)]
    assert jaccard(shingles(texts[0]), shingles(texts[1])) < 0.8
    assert len(near_dedup_of(spark, texts)) == 200


def test_signature_of_short_texts():
    assert not simhash.signature(None, 3).any() and not simhash.signature(" \n", 3).any()
    assert (simhash.signature("A b", 3) == simhash.signature("a  B", 3)).all()


def test_whole_pipeline_stage_by_stage(spark):
    folder = str(DATA)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()

    def sql(text, df):
        con.register("documents", df.toArrow())
        return sorted(con.execute(text).fetchall(), key=repr)

    good = STAGES["quality_rules"](spark, docs, folder).cache()
    bad = {r.doc_id for r in docs.collect() if brute_counts(r.text)[-1]}
    assert not bad & {r.doc_id for r in good.collect()} and good.count() >= 0.9 * (docs.count() - len(bad))
    lined = STAGES["line_dedup"](spark, good, folder).cache()
    names = "doc_id, kept_sha256"
    assert rows_of(lined.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)), "*") == sql(f"select {names} from ({lines.SQL})", good)
    single = STAGES["near_dedup"](spark, lined, folder).cache()
    mix = STAGES["mix_sources"](spark, single, folder).cache()
    times = {i: t // s for i, s, t in sql(f"select doc_id, size, taken from ({mixing.SQL}) where size > 0", single)}
    got = Counter(r.doc_id for r in mix.collect() if words(r.text))
    assert got == Counter({i: n for i, n in times.items() if n})
    e = encoding()
    ids = [(r, e.encode_ordinary(r.text or "")) for r in mix.collect()]
    want = sorted(((r.doc_id, len(i), hashlib.sha256((r.text or "").encode()).hexdigest(), np.array(i, "<u4").tobytes()) for r, i in ids), key=repr)
    got = [(*r[:3], bytes(r[3])) for r in p.run(spark, folder).select("doc_id", "n_tokens", "decoded_sha256", "ids").collect()]
    assert sorted(got, key=repr) == want
    assert RANKS == public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
