"""URL filters: path rules, and host trust spread over the link graph in Spark."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import kept


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rank of all seeds together, shared evenly. Ranks are integers, so their sums do not depend on the order of rows and reruns
#: agree; they fit a long whatever the graph, and a host with 10^9 links still passes some on.
WHOLE = 10**18
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a url; both empty for null and where there is no ://."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Index of the longest rule that fits; null if none does."""
    out = None
    for i, r in sorted(enumerate(rules), key=lambda x: (-len(x[1].name), x[1].name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return out if out is not None else F.lit(None).cast("int")


def host_edges(pages: DataFrame, family: bool = False) -> DataFrame:
    """(src, dst, n): links between different hosts, counted, from pages (host, html); links without a host of their own stay
    within the page's. With `family`, also one edge each way between a host and the host above it."""
    link = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1))
    to, _ = host_and_path(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    linked = pages.filter("host <> ''").select(F.col("host").alias("src"), link.alias("link")).select("src", to.alias("dst")).filter("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    if not family:
        return linked
    names = pages.select("host").union(linked.select("dst")).filter("host <> ''").distinct()
    above = names.select("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("above")).filter("above <> ''")
    both = above.select("host", "above").union(above.select("above", "host")).toDF("src", "dst").withColumn("n", F.lit(1).cast("long"))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, steps: int = 30, damping: int = 85, stored: int = 3) -> DataFrame:
    """(host, kind, rank): personalised PageRank of each kind's seeds over its edges (kind, src, dst, n), by power iteration.

    A step passes `damping` per cent of a host's rank along its edges by their counts and gives seeds their share anew. It ends
    when no rank changes, or after `steps`: then damping^steps of the rank, 0.8 % by default, is not yet where it belongs.
    Products are taken in decimals before they are divided, so a hub passes on what it has however many links it has. Sums are
    combined before the shuffle; a hub's edges are an ordinary skewed join, which AQE splits. Every `stored` steps are written.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    weighed = kept(edges.join(out, ["kind", "src"]), "host-edges")
    total = seeds.count()
    base = kept(seeds.select("kind", "host", F.lit(WHOLE // max(1, total)).cast("long").alias("rank")), "host-seeds")
    share = F.expr(f"(cast(rank as decimal(19, 0)) * {damping} * cast(n as decimal(15, 0))) div (cast(out as decimal(20, 0)) * 100)").cast("long")
    rank = base
    for step in range(1, steps + 1):
        passed = weighed.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), share.alias("rank"))
        new = passed.union(base.select("kind", "host", F.expr(f"rank div 100 * {100 - damping}"))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % stored and step < steps:
            rank = new
            continue
        new, last = kept(new, "host-ranks"), rank
        if step >= 2 * stored and new.exceptAll(last).isEmpty():
            return new
        rank = new
    return rank


def host_scores(judged: DataFrame, steps: int = 30, damping: int = 85, family: bool = False) -> DataFrame:
    """(host, trust, distrust) from pages (host, html, ruled): trust spreads from hosts that a rule allows, distrust from hosts
    that a rule blocks to those that link to them."""
    edges = kept(host_edges(judged, family), "host-links")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), "dst", "src", "n"))
    seeds = judged.filter("host <> '' and ruled is not null").select(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host").distinct()
    ranks = spread(both, seeds, steps, damping)
    side = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0)).alias(k)
    return ranks.groupBy("host").agg(side("trust"), side("distrust"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, steps: int = 30, damping: int = 85, threshold: int = 50, family: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page.

    A rule that fits decides. Else the page's host does: it is blocked if distrust makes up at least `threshold` per cent of
    its trust and distrust, and allowed if it has neither. Null urls and urls without a host are allowed; null html has no
    links; repeated rows give repeated rows; an empty table gives an empty result; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).select("page_id", host.alias("host"), path.alias("path"), "html")
    rows = rows.withColumn("at", rule_of(F.col("host"), F.col("path"), rules))
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("at"))
    rows = rows.withColumn("rule", pick([r.name for r in rules])).withColumn("ruled", pick([r.verdict for r in rules])) if rules else rows.withColumn("rule", F.lit(None).cast("string")).withColumn("ruled", F.lit(None).cast("string"))
    scores = host_scores(rows, steps, damping, family)
    joined = rows.select("page_id", "host", "path", "rule", "ruled").join(scores, "host", "left")
    bad = F.coalesce((F.col("distrust") > 0) & (F.col("distrust") * 100 >= (F.col("trust") + F.col("distrust")) * threshold), F.lit(False))
    verdict = F.coalesce("ruled", F.when(bad, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))


def _sql(steps: int = 30, damping: int = 85, threshold: int = 50) -> str:
    """The same with RULES over `pages`, each step a table expression."""
    by_length = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    case = lambda of: "case " + " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{of(r)}'" for r in by_length) + " end"
    host = lambda url: f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    link = r"""(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)"""
    parts = [
        f"p as materialized (select page_id, {host('url')} host, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') path, html from pages)",
        f"r as materialized (select *, {case(lambda r: r.name)} \"rule\", {case(lambda r: r.verdict)} ruled from p)",
        f"l as (select host src, {host("case when starts_with(u, '//') then 'http:' || u else u end")} dst from (select host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) u from p where host <> ''))",
        "e as materialized (select src, dst, count(*) n from l where dst <> '' and dst <> src group by 1, 2)",
        "both_ways as (select 'trust' kind, src, dst, n from e union all select 'distrust', dst, src, n from e)",
        "w as materialized (select *, sum(n) over (partition by kind, src)::bigint o from both_ways)",
        "s0 as materialized (select distinct case ruled when 'allow' then 'trust' else 'distrust' end kind, host from r where host <> '' and ruled is not null)",
        f"s as materialized (select *, {WHOLE}::bigint // (count(*) over ()) v from s0)",
        "k0 as (select * from s)",
    ]
    parts += [
        f"k{i + 1} as materialized (select kind, host, sum(v)::bigint v from (select w.kind, dst host, ((v::hugeint * {damping} * n) // (o::hugeint * 100))::bigint v from w join k{i} on w.kind = k{i}.kind and src = host union all select kind, host, v // 100 * {100 - damping} from s) group by 1, 2)"
        for i in range(steps)
    ]
    parts.append(f"h as (select host, coalesce(sum(v) filter (kind = 'trust'), 0)::bigint t, coalesce(sum(v) filter (kind = 'distrust'), 0)::bigint d from k{steps} group by 1)")
    return "with " + ",\n".join(parts) + f"\nselect page_id, r.host, path, \"rule\", coalesce(ruled, case when d > 0 and d * 100 >= (t + d) * {threshold} then 'block' else 'allow' end) verdict, coalesce(t, 0)::bigint trust, coalesce(d, 0)::bigint distrust from r left join h on r.host = h.host"


SQL = _sql()
