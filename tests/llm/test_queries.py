"""Every operator against a brute-force version or its SQL, over the smallest tables and an awkward one."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import DATA, awkward, clashing, roots, rows_of, words
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from offerlens.llm import bpe, embeddings, lines, mixing, quality, queries, simhash, substring, token_counts, token_files, urls

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module", params=["table", "awkward", "empty"])
def docs(request, spark):
    if request.param == "awkward":
        return awkward(spark)
    d = spark.read.parquet(str(DATA / "documents.parquet"))
    return d if request.param == "table" else d.limit(0)


def sql(text, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def matches(df, text, **tables):
    names, want = sql(text, **tables)
    assert set(names) <= set(df.columns)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, rows_of(df, *names)), key=repr) == sorted(map(plain, want), key=repr)


def brute_print(text, shingle=3):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(lower)
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    ones = Counter()
    for g, n in Counter(grams).items():
        h = xxh64_intdigest(g.encode(), 42)
        ones.update({b: n for b in range(64) if h >> b & 1})
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_simhash(docs):
    got = rows_of(simhash.near_duplicates(clashing(docs)), "doc_id", "fingerprint", "component_id")
    d = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    links = [(a, b) for a, x in d for b, y in d if a < b and (x ^ y).bit_count() <= 2]
    root = roots({a for a, _ in d}, links)
    assert got == sorted(((a, f"{x:016x}", root[a]) for a, x in d), key=repr)


def test_simhash_over_many_shards(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flip = lambda x: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 4)).astype(np.uint64), initial=np.uint64(0))
    fps = np.unique(np.array([flip(x) for x in np.repeat(base, 7)], np.uint64)).view(np.int64)
    got = {r.fp: r.component for r in simhash.link_fingerprints(spark.createDataFrame([(int(x),) for x in fps], "fp long"), shard_rows=64).collect()}
    near = np.argwhere(np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)) <= 2)
    assert got == roots(fps.tolist(), [(int(fps[a]), int(fps[b])) for a, b in near if a < b])


def brute_counts(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, r, n < 50 or 100 * r > 50 * n


def test_quality_counts(docs):
    got = rows_of(quality.judged(clashing(docs)).select("doc_id", *(F.col("q")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), "kept"), "*")
    assert [r[:-1] for r in got] == sorted([(r.doc_id, *brute_counts(r.text)) for r in docs.collect()], key=repr)
    assert not any(r[-2] and r[-1] for r in got)


def quartiles(x):
    q = [np.sort(x, axis=0)[int(np.ceil(len(x) * p)) - 1] for p in (0.25, 0.5, 0.75)]
    return q, np.diag(((q[2] - q[0]) / 1.349) ** 2 + (quality.FLOOR * quality.SCALE) ** 2)


def brute_estimate(x, prior=None, share=0.5):
    """(centre, covariance, unit) of rows x by plain numpy; prior: (centre, covariance)."""
    k, floor = (quality.PRIOR if prior else 0), np.eye(x.shape[1]) * (quality.FLOOR * quality.SCALE) ** 2
    dist = lambda m, c: np.einsum("ij,ij->i", x - m, np.linalg.solve(c, (x - m).T).T)
    steps = lambda d: np.floor(np.log2(d + 1) * quality.STEPS)

    def moments(rows):
        p, q = (prior[0], prior[1] + np.outer(*[prior[0]] * 2)) if prior else (0, 0)
        m = (rows.sum(axis=0) + k * p) / (len(rows) + k)
        return m, (rows.T @ rows + k * q) / (len(rows) + k) - np.outer(m, m) + floor

    def unit(m, c):
        s = np.sort(steps(dist(m, c)))
        mid = 2 ** ((s[int(np.ceil(len(x) / 2)) - 1] + 0.5) / quality.STEPS) - 1
        return quality.MEDIAN / ((len(x) * mid + k * quality.MEDIAN) / (len(x) + k))

    (q1, q2, q3), spread = quartiles(x)
    fits = []
    for m in (q1, q2, q3):
        c, last = spread, 1e300
        while True:
            s = steps(dist(m, c))
            new = moments(x[np.array([(s < v).sum() for v in s]) < len(x) * share])
            if np.linalg.det(new[1]) >= last * 0.99:
                break
            (m, c), last = new, np.linalg.det(new[1])
        fits.append((last, len(fits), m, c))
    m, c = min(fits, key=lambda f: f[:2])[2:]
    inner = x[dist(m, c) * unit(m, c) <= quality.NORMAL]
    m, c = moments(inner) if len(inner) else (m, c)
    return m, c, unit(m, c)


def test_quality_verdicts(docs):
    got = quality.judged(docs).select("lang", "source", F.array(*(F.col("q")[s] for s in quality.STATS)).alias("v"), F.col("q")["base_failed"].alias("bad"), "kept").collect()
    rows = defaultdict(list)
    for r in got:
        if not r.bad:
            rows[r.lang, r.source].append(r.v)
    (q1, mid, q3), _ = quartiles(np.array([v for g in rows.values() for v in g], float)) if rows else (np.zeros((3, 1)), 0)
    prior = mid, np.diag((2 * np.minimum(mid - q1, q3 - mid) / 1.349) ** 2 + (quality.FLOOR * quality.SCALE) ** 2)
    fits = {g: brute_estimate(np.array(x, float), prior) for g, x in rows.items()}

    def keep(r):
        m, c, unit = fits[r.lang, r.source]
        d = np.array(r.v) - m
        return d @ np.linalg.solve(c, d) * unit <= quality.CUTOFF

    assert [r.kept for r in got] == [not r.bad and bool(keep(r)) for r in got]


def test_quality_judges_a_handful_by_its_own_group(spark):
    """Three texts of one source, one of them junk, beside a large source: no size is too small for a verdict."""
    rng = np.random.default_rng(12)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(90))
    rows = [(i, text(), "en", "web") for i in range(200)] + [(200, text(), "en", "few"), (201, text(), None, None), ()]
    rows[-1] = (202, " ".join(f"{w[:2]}#${i % 7}%{chr(97 + i % 26)}*" for i, w in enumerate(text().split())), "en", "few")
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "kept").collect()}
    assert got[200] and got[201] and not got[202] and sum(got.values()) >= 198


def test_quality_rejects_the_junk_of_a_source_that_is_two_fifths_junk(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    junk = lambda: word()[:3] + "".join(rng.choice(list("#*$%&|<>"), 2))
    rows = [(i, " ".join(junk() if i % 5 < 2 else word() for _ in range(90)), "en", "web") for i in range(300)]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "kept").collect()
    assert {r.doc_id for r in got if r.kept} == {i for i, *_ in rows if i % 5 >= 2}


def test_embeddings(spark):
    v = spark.read.parquet(str(DATA / "embeddings.parquet"))
    matches(embeddings.near_duplicates(clashing(v)), queries.ORACLES["op3_embeddings"], embeddings=v)
    assert embeddings.near_duplicates(v.limit(0)).count() == 0
    odd = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [1.0, float("nan")], 0), (5, [1.0, 0.0], None), (6, [1.0, 0.0], 0), (7, [2.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.3], 0), (12, [float("inf"), 1.0], 0)]
    got = rows_of(embeddings.near_duplicates(spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int")), "vec_id", "n_links", "component_id")
    linked = {6, 7, 8, 11}
    assert got == sorted([(i, 3, 6) if i in linked else (i, 0, i) for i, _, _ in odd], key=repr)


def test_embeddings_in_small_tiles(spark):
    v = spark.read.parquet(str(DATA / "embeddings.parquet"))
    matches(embeddings.near_duplicates(v, tile=8), queries.ORACLES["op3_embeddings"], embeddings=v)


def brute_substring(rows, window=20):
    """rows: one (doc_id, words) per id."""
    first, gone = {}, defaultdict(set)
    for i, w in sorted(rows.items()):
        for s in range(len(w) - window + 1):
            if first.setdefault(hash(tuple(w[s : s + window])), (i, s)) < (i, s):
                gone[i].update(range(s, s + window))
    return {i: (len(w), len(gone[i]), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone[i]).encode()).hexdigest()) for i, w in rows.items()}


@pytest.mark.parametrize("options", [{}, {"hot": 1, "shard_rows": 16}])
def test_substring(docs, options):
    got = rows_of(substring.deduplicated(clashing(docs), **options).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)), "*")
    all_rows = docs.collect()
    want = brute_substring({r.doc_id: words(r.text) for r in all_rows})
    assert got == sorted(((r.doc_id, *want[r.doc_id]) for r in all_rows), key=repr)


def test_mixing(docs):
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        matches(mixing.mixed(clashing(docs)), mixing.SQL, documents=docs)
    got = mixing.mixed(docs).collect()
    assert all(r.taken <= 2 * r["size"] for r in got) and len(got) == docs.count()
    copies = Counter({r.doc_id: r.copies for r in got})
    assert all(n == copies[i] * k for (i, k), n in [((i, Counter(r.doc_id for r in got)[i]), c) for i, c in Counter(r.doc_id for r in mixing.repeated(docs).select("doc_id").collect()).items()])


def test_urls(spark):
    p = spark.read.parquet(str(DATA / "pages.parquet"))
    matches(urls.judged(clashing(p)), urls.SQL, pages=p)
    assert urls.judged(p.limit(0)).count() == 0
    odd = [(1, None, None), (2, "", ""), (3, "no scheme/", "x"), (4, "http://A.Org", "<a href=http://b.test/x>"), (5, "http://x.org/fr", None), (6, "http://EXAMPLE.org/en/12?q", None), (7, "http://sub.example.org/es/", None), (8, "http://m.com/de/x", None), (9, "http://b.test/q", "<A HREF='http://m.com/de/'>"), (10, "://", None), (4, "http://A.Org", "<a href=http://b.test/x>")]
    o = spark.createDataFrame(odd, "page_id long, url string, html string")
    matches(urls.judged(o), urls.SQL, pages=o)


def test_line_dedup(docs, spark):
    new = lines.without_recurring(clashing(docs), extra=True)
    assert new.count() == docs.count()
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        matches(new.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")), lines.SQL, documents=docs)


def test_line_templates_recur(spark):
    rows = [(i, f"Printed on 2024-01-{i:02d} by the office of records\n{chr(97 + i)} own words here {chr(97 + i)}") for i in range(1, 15)]
    got = rows_of(lines.without_recurring(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "text")
    assert got == sorted([(i, t if i == 1 else t.split("\n")[1]) for i, t in rows], key=repr)


def encoding():
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs):
    e = encoding()
    got = rows_of(bpe.round_trip(clashing(docs), RANKS, public_tokenizers.PATTERN), "*")
    want = []
    for r in docs.collect():
        ids = e.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_token_counts(spark):
    e = encoding()
    first = {}
    for r in spark.read.parquet(str(DATA / "documents.parquet")).orderBy("doc_id").collect():
        if r.text is not None:
            first.setdefault(r.text, r)
    want = defaultdict(lambda: [0, 0])
    for t, r in first.items():
        want[r.source, r.lang][0] += 1
        want[r.source, r.lang][1] += len(e.encode_ordinary(" ".join(words(t))))
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in queries.op8_token_counts(spark, str(DATA)).collect()}
    assert got == dict(want)


def test_rollup_commits_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 3), (None, "en", 4), ("a", None, 5)], "source string, lang string, n long")
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert rows_of(r.totals(), "*") == []
    d = token_counts.deltas(rows, "v1", F.lit(1), F.col("n"))
    assert r.commit("one", d) and not r.commit("one", d)
    r.commit("two", token_counts.deltas(rows.filter("n = 4"), "v1", F.lit(-1), -F.col("n")))
    r.commit("none", d.limit(0))
    assert rows_of(r.totals(), "*") == [("a", None, "v1", 2, 8)]


def test_token_files(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    token_files.write_tokens(clashing(docs), str(tmp_path / "ids"), token_files.word_tokenizer(path))
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(token_files.read_tokens(spark, str(tmp_path / "ids")).drop("ids"), "*") == sorted(want, key=repr)


def test_word_encoder_meets_pieces_again(monkeypatch):
    """Words of known letters, digits and signs take no more of the library's work; any text has the library's ids."""
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    given = []
    for name in ("_joined", "_singly"):
        monkeypatch.setattr(encoder, name, lambda x, f=getattr(encoder, name): given.extend(x) or f(x))
    texts = [f"Part-{i}/rev{i % 7}: ÉTÉ{i}! id=\"{i:x}f\"" for i in range(2000)]
    for text, ids in zip(texts, encoder(pa.array(texts)), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(given) == len(set(given)) < 200


def test_word_encoder_forgets_without_a_trace():
    encoder, rng = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), remembered=20), np.random.default_rng(3)
    parts = [*"aZéÉß×÷µªºÿŸ7½٣-.<|'’=~\0\x1c\x7f\x85\xa0 \n\t\u0301\u2028日本𝕏İſK", "'s", "'LL", "<|endoftext|>", "the", "  ", "12", "Ã¿", "e\u0301", ""]
    texts = [None if i % 50 == 7 else "".join(rng.choice(parts, rng.integers(0, 12))) for i in range(3000)] + ["日本" * 4000, "x" * 5000, "", None]
    for i in range(0, len(texts), 60):
        some = pa.array(["not read", *texts[i : i + 60]], pa.string())[1:]
        for text, ids in zip(texts[i : i + 60], encoder(some), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_word_encoder_of_a_tokenizer_with_cases(tmp_path):
    settings = json.loads(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    (tmp_path / "cased.json").write_text(json.dumps(settings | {"normalizer": None}))
    encoder = token_files.WordEncoder(str(tmp_path / "cased.json"))
    texts = ["É é Été", "The the THE Straße-7", "", None, "Ü", "it's É'"]
    for some in (texts[2:4], texts):
        for text, ids in zip(some, encoder(pa.array(some)), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_simple8b_round_trips():
    rng = np.random.default_rng(5)
    parts = [np.zeros(5000), rng.integers(0, 2, 3000), rng.integers(0, 1 << 16, 4000), np.array([2**60, 2**64 - 1, 0, 1], np.uint64), 2.0 ** rng.integers(0, 60, 2000), []]
    for x in [np.concatenate([np.asarray(p, np.uint64) for p in parts]), *(np.asarray(p, np.uint64) for p in parts)]:
        w, o, e = token_files.pack(x)
        assert np.array_equal(token_files.unpack(w, o, e, len(x)), x)
    n, ids = token_files.from_image(token_files.image(np.array([2, 0, 1]), np.array([7, 8, 9], np.uint32)))
    assert n.tolist() == [2, 0, 1] and ids.tolist() == [7, 8, 9]
    with pytest.raises(ValueError):
        token_files.from_image(b"\0" * 48)
