"""Quality rules: counted statistics of a text, and robust multivariate outliers per language and source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .storage import kept
from .text import let, words

#: Transformed statistics, in fixed point: sums of integers do not depend on the order of rows, so reruns agree. Repeated
#: words and lines are left to the base rules: most texts have none, so an elliptic model has no scale for them.
SCALE = 1024
STATS = ("s_word", "s_symbol", "s_punct", "s_upper")
P = len(STATS)
#: Least spread of a statistic, so that a group in which one never varies does not reject at the first difference.
FLOOR = 0.05
#: Squared distance beyond which a text is an outlier. Measured on the labelled texts that pass the base rules: at 1,000 documents all
#: 27 of low quality lie beyond it and none of the 327 good ones, at 10,000 documents all 291 and 10 of 3,243.
CUTOFF = 50.0
#: Steps of a distance's logarithm in which subsets are cut.
STEPS = 32
#: Rows for which medians and spreads of all groups together count in each group's own: twice what a covariance needs to be regular.
PRIOR = 2 * (P + 1)
#: Median and 97.5 % point of the squared distances in a normal sample of P statistics.
MEDIAN, NORMAL = 3.357, 11.143


def repeated_words(w: Column) -> Column:
    """Words of w (an array) in windows of three that occur twice or more in it, the first occurrence included.

    Hashes of the windows are sorted with their places, so equal windows are neighbours: n log n time, however often one
    repeats. The words of neighbours are compared too, so that a shared hash alone never counts.
    """
    same = lambda x, y: (x["h"] == y["h"]) & (F.get(w, x["i"]) == F.get(w, y["i"])) & (F.get(w, x["i"] + 1) == F.get(w, y["i"] + 1)) & (F.get(w, x["i"] + 2) == F.get(w, y["i"] + 2))

    def twice(s: Column) -> Column:
        near = lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, near), lambda x: x["i"]))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda g, i: F.struct(g.alias("h"), i.alias("i"))))
        return let(let(placed, twice), lambda a: F.aggregate(F.transform(a, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x))

    hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    some = F.when(F.size(w) >= 3, hashes).otherwise(F.array().cast("array<long>"))
    return let(some, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one more column, `q`: a struct of the counts and transformed statistics of the text; null counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    df = docs.withColumn("q", counts)
    q = F.col("q")
    df = df.withColumn(
        "q",
        F.struct(
            q["n_words"].alias("n_words"),
            q["word_chars"].alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x)))).cast("long").alias("n_dup_lines"),
            q["n_repeat_words"].alias("n_repeat_words"),
            F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("n_punct"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        ),
    )
    fixed = lambda x: F.round(F.coalesce(x, F.lit(0.0)) * SCALE).cast("long")
    share = lambda a, b: F.sqrt(F.try_divide(q[a], q[b]))
    return df.withColumn(
        "q",
        q.withField("base_failed", (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"]))
        .withField("s_word", fixed(F.log(F.try_divide(q["word_chars"], q["n_words"]))))
        .withField("s_symbol", fixed(share("n_symbols", "word_chars")))
        .withField("s_punct", fixed(share("n_punct", "word_chars")))
        .withField("s_upper", fixed(share("n_upper", "word_chars"))),
    )


def _short_spread(quartiles: Row, i: int) -> float:
    """The variance that the quartile nearer to the median stands for: junk on one side of it leaves the other as it is."""
    q1, q2, q3 = (quartiles[f"{q}_{i}"] for q in ("q1", "q2", "q3"))
    return (2 * min(q2 - q1, q3 - q2) / 1.349) ** 2 + (FLOOR * SCALE) ** 2


def _factored(sums: DataFrame, prior: Row | None) -> DataFrame:
    """From n, sums and sums of products per group: the centre m_i and the factors l_ij, d_i of the covariance L D L'. The
    row `prior` of _quartiles counts as PRIOR rows of its medians and shorter spreads."""
    n = F.col("n").cast("double")
    k = PRIOR if prior else 0
    p = lambda i: prior[f"q2_{i}"] if prior else 0.0
    q = lambda i, j: (_short_spread(prior, i) if i == j else 0.0) + p(i) * p(j) if prior else 0.0
    df = sums
    m = {f"m{i}": (F.col(f"a{i}") + F.lit(k * p(i))) / (n + k) for i in range(P)}
    df = df.withColumns(m)
    cov = {f"c{i}_{j}": (F.col(f"b{i}_{j}") + F.lit(k * q(i, j))) / (n + k) - F.col(f"m{i}") * F.col(f"m{j}") + F.lit((FLOOR * SCALE) ** 2 if i == j else 0.0) for i in range(P) for j in range(i + 1)}
    df = df.withColumns(cov)
    for j in range(P):
        d = sum((-(F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}") * F.col(f"d{k}")) for k in range(j)), F.col(f"c{j}_{j}"))
        df = df.withColumn(f"d{j}", d)
        below = {f"l{i}_{j}": sum((-(F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") * F.col(f"d{k}")) for k in range(j)), F.col(f"c{i}_{j}")) / F.col(f"d{j}") for i in range(j + 1, P)}
        df = df.withColumns(below) if below else df
    det = F.col("d0")
    for j in range(1, P):
        det = det * F.col(f"d{j}")
    return df.select("g", "t", *m, *(f"d{j}" for j in range(P)), *(f"l{i}_{j}" for i in range(P) for j in range(i)), det.alias("det"))


def _distance(df: DataFrame, x, name: str) -> DataFrame:
    """df with the squared Mahalanobis distance of the statistics x(i) under the centre and factors in its columns."""
    for i in range(P):
        df = df.withColumn(f"z{i}", sum((-(F.col(f"l{i}_{k}") * F.col(f"z{k}")) for k in range(i)), x(i) - F.col(f"m{i}")))
    return df.withColumn(name, sum((F.col(f"z{i}") * F.col(f"z{i}") / F.col(f"d{i}") for i in range(1, P)), F.col("z0") * F.col("z0") / F.col("d0")))


def _stat(i: int) -> Column:
    return F.col(STATS[i])


def _sums() -> list[Column]:
    every = {"n": F.count("*")} | {f"a{i}": F.sum(_stat(i)) for i in range(P)} | {f"b{i}_{j}": F.sum(_stat(i) * _stat(j)) for i in range(P) for j in range(i + 1)}
    return [v.alias(k) for k, v in every.items()]


SUMS = ("n", *(f"a{i}" for i in range(P)), *(f"b{i}_{j}" for i in range(P) for j in range(i + 1)))
PARAMS = ("g", "t", *(f"m{i}" for i in range(P)), *(f"d{i}" for i in range(P)), *(f"l{i}_{j}" for i in range(P) for j in range(i)))


def _quartiles(rows: DataFrame) -> DataFrame:
    """(g, q1_i, q2_i, q3_i, d_i): quartiles of each statistic, and the variance that their distance stands for."""
    tall = rows.select("g", F.posexplode(F.array(*STATS)).alias("i", "x")).groupBy("g", "i", "x").count()
    w = Window.partitionBy("g", "i").orderBy("x")
    cum = tall.select("g", "i", "x", F.sum("count").over(w).alias("upto"), F.sum("count").over(Window.partitionBy("g", "i")).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") >= F.col("n") * p, F.col("x")))
    quart = cum.groupBy("g", "i").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    pick = lambda c, i: F.max(F.when(F.col("i") == i, c))
    spread = ((F.col("q3") - F.col("q1")) / 1.349) ** 2 + (FLOOR * SCALE) ** 2
    return quart.groupBy("g").agg(*(pick(F.col(q).cast("double"), i).alias(f"{q}_{i}") for q in ("q1", "q2", "q3") for i in range(P)), *(pick(spread, i).alias(f"d{i}") for i in range(P)))


def _estimates(rows: DataFrame, share: float, prior: Row | None) -> DataFrame:
    """(PARAMS, unit) for each group g of rows (g, statistics)."""
    start = _quartiles(rows).withColumn("t", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    from_ = lambda i: F.when(F.col("t") == 1, F.col(f"q1_{i}")).when(F.col("t") == 2, F.col(f"q2_{i}")).otherwise(F.col(f"q3_{i}")).alias(f"m{i}")
    zeros = [F.lit(0.0).alias(f"l{i}_{j}") for i in range(P) for j in range(i)]
    params = kept(start.select("g", "t", *map(from_, range(P)), *(f"d{i}" for i in range(P)), *zeros, F.lit(1e300).alias("det"), F.lit(True).alias("moved")), "quality-fit")

    step = F.floor(F.log2(F.col("dist") + 1) * STEPS).cast("int")
    by_step = Window.partitionBy("g", "t").orderBy("step")
    while True:
        near = _distance(rows.join(params.filter("moved").select(*PARAMS), "g"), _stat, "dist").withColumn("step", step)
        parts = near.groupBy("g", "t", "step").agg(*_sums())
        parts = parts.withColumn("before", F.sum("n").over(by_step) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("g", "t")))
        inner = parts.filter(F.col("before") < F.col("all") * share).groupBy("g", "t").agg(*(F.sum(k).alias(k) for k in SUMS))
        new = _factored(inner, prior)
        both = params.join(new.select("g", "t", *(F.col(c).alias(f"new_{c}") for c in (*PARAMS[2:], "det"))), ["g", "t"], "left")
        # determinants are bounded below by FLOOR, so falling by a hundredth ends
        falls = F.coalesce(F.col("new_det") < F.col("det") * 0.99, F.lit(False))
        params = kept(both.select("g", "t", *(F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in (*PARAMS[2:], "det")), falls.alias("moved")), "quality-fit")
        if params.filter("moved").isEmpty():
            break

    best = Window.partitionBy("g").orderBy("det", "t")
    params = kept(params.withColumn("place", F.row_number().over(best)).filter("place = 1").select(*PARAMS), "quality-best")

    def with_unit(fitted: DataFrame) -> DataFrame:
        near = _distance(rows.join(fitted, "g"), _stat, "dist").groupBy("g", "t", step.alias("step")).agg(F.count("*").alias("n"))
        near = near.withColumn("upto", F.sum("n").over(by_step)).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
        median = near.groupBy("g").agg(F.max("all").alias("n"), F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("step"))).alias("mid"))
        known = F.pow(2.0, (F.col("mid") + 0.5) / STEPS) - 1
        k = PRIOR if prior else 0
        return fitted.join(median.select("g", (MEDIAN / ((F.col("n") * known + k * MEDIAN) / (F.col("n") + k))).alias("unit")), "g")

    # reweighting: once more from all rows that are no outliers of a normal sample under the estimate
    first = kept(with_unit(params), "quality-first")
    inner = _distance(rows.join(first, "g"), _stat, "dist").filter(F.col("dist") * F.col("unit") <= NORMAL).groupBy("g", "t").agg(*_sums())
    again = kept(_factored(inner, prior).select(*PARAMS), "quality-reweighted")
    return with_unit(again.union(params.join(again.select("g"), "g", "left_anti")))


def fit(stats: DataFrame, by: tuple[str, ...] = ("lang", "source"), share: float = 0.5) -> DataFrame:
    """Minimum-covariance-determinant estimates: (by..., centre, factors, unit) for each combination of `by` in stats.

    stats: `by` and the statistics of the rows that pass the base rules. There are three starts, at each group's quartiles
    and medians, so that junk of less than half a group is left out whichever side it lies on; each concentration step keeps
    the `share` of the group at the smallest distances and estimates again from these, until no determinant falls by a
    hundredth any more. The start of the least determinant is estimated once more from all rows that are no outliers under it,
    and `unit` brings the group's median distance to that of a normal sample. A step reads the rows once and shuffles partial
    sums by group and step of distance: a bounded number of rows for a group of any size.

    Every combination has an estimate of its own, at any size: medians and spreads of all rows together count in it as PRIOR
    further rows (a regularised determinant), which decide for a handful of rows and vanish in thousands.
    """
    name = F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(by)), F.lit(1).alias("one")))
    rows = kept(stats.select(name.alias("g"), *STATS), "quality-rows")
    prior = _quartiles(rows.withColumn("g", F.lit("all"))).first()
    own = _estimates(rows, share, prior)
    names = stats.select(*by, name.alias("g")).distinct()
    return names.join(own.select(*PARAMS, "unit"), "g").drop("g", "t")


def verdicts(counted: DataFrame, fitted: DataFrame, by: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """counted (see with_counts) with `outlier_distance` (null without an estimate) and `kept` (false for base failures too)."""
    names = {k: f"__{k}" for k in by}
    right = fitted.withColumnsRenamed(names)
    same = F.lit(True)
    for k, v in names.items():
        same = same & counted[k].eqNullSafe(right[v])
    df = _distance(counted.join(right, same, "left"), lambda i: F.col("q")[STATS[i]], "__dist")
    far = F.col("__dist") * F.col("unit")
    keep = ~F.col("q")["base_failed"] & F.coalesce(far <= cutoff, F.lit(True))
    return df.select(*counted.columns, far.alias("outlier_distance"), keep.alias("kept"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), **options) -> DataFrame:
    """(id, by..., q, outlier_distance, kept) for every document.

    Null texts count as empty and fail the base rules, as empty ones do; null languages and sources form groups of their
    own; repeated rows give repeated rows; an empty table gives an empty result; columns with other names are not read.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), *by, F.col(text_col).alias("text"))
    counted = kept(with_counts(narrow).drop("text"), "quality-counts")
    passed = counted.filter("not q.base_failed").select(*by, *(f"q.{s}" for s in STATS))
    cutoff = options.pop("cutoff", CUTOFF)
    return verdicts(counted, kept(fit(passed, by, **options), "quality-estimates"), by, cutoff)


def passing(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), **options) -> DataFrame:
    """The documents that are kept, with the columns of docs, with one pass that counts the texts; none is shuffled.

    Null, empty and short texts fail the base rules and go; null languages and sources form groups of their own; repeated
    rows fare alike and all stay or go; an empty table gives an empty result; other columns may have any name.
    """
    cutoff = options.pop("cutoff", CUTOFF)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: f"c{docs.columns.index(c)}" for c in (*by, "text")}
    named = lambda df: df.select(*df.columns, *(F.col(at[k]).alias(f"__by_{k}") for k in by))
    keys = tuple(f"__by_{k}" for k in by)
    counted = with_counts(named(plain), at["text"])
    # written with their counts, so that no text is counted twice
    counted = kept(counted, "quality-counted")
    stats = counted.filter("not q.base_failed").select(*keys, *(f"q.{s}" for s in STATS))
    fitted = kept(fit(stats, keys, **options), "quality-estimates")
    return verdicts(counted, fitted, keys, cutoff).filter("kept").select(*plain.columns).toDF(*docs.columns)
