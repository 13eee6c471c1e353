"""Comparison, scoring, decisions and economics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import rows, scoring
from .registry import Tables, query

AS_OF = "1998-12-01"


def dec(x: str):
    """An exact decimal literal, so that halves of a cent round alike in every engine."""
    return F.lit(Decimal(x))


@query("""with q as (select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice p, l_returnflag f, l_discount d, l_tax x from lineitem),
 m as (select *, min(case when f <> 'R' then p end) over w lo, max(case when f <> 'R' then p end) over w hi from q window w as (partition by l_partkey)),
 s as (select *, case when f = 'R' then 0 else round(60 + 40 * (hi - p) / greatest(hi - lo, 1), 2) end price, case when f = 'A' then 92 when f = 'N' then 85 else 10 end delivery,
  case when f = 'R' then least(round((1 - d) * 100 * 0.2, 2), 20) else round((1 - d) * 100 * case when x <= 0.02 then 1.0::double when x <= 0.05 then 0.65::double else 0.2::double end, 2) end quality from m),
 t as (select *, round(0.45::decimal(3,2) * price::decimal(12,2) + 0.15::decimal(3,2) * delivery + 0.40::decimal(3,2) * quality::decimal(12,2), 2)::double total from s)
 select l_partkey, l_suppkey, l_orderkey, l_linenumber, round(price, 4) price, quality, total, row_number() over (partition by l_partkey order by total desc, quality desc, p, l_orderkey, l_linenumber) rank_order from t""")
def quote_comparison(t: Tables) -> DataFrame:
    f, p, w = F.col("l_returnflag"), F.col("l_extendedprice"), Window.partitionBy("l_partkey")
    live = F.when(f != "R", p)
    q = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_discount", "l_tax")
    q = q.withColumn("lo", F.min(live).over(w)).withColumn("hi", F.max(live).over(w))
    q = q.withColumn("price", F.when(f == "R", 0.0).otherwise(F.round(60 + 40 * (F.col("hi") - p) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0)), 2)))
    q = q.withColumn("delivery", F.when(f == "A", 92).when(f == "N", 85).otherwise(10))
    status = F.when(F.col("l_tax") <= 0.02, 1.0).when(F.col("l_tax") <= 0.05, 0.65).otherwise(0.2)
    score = (1 - F.col("l_discount")) * 100
    q = q.withColumn("quality", F.when(f == "R", F.least(F.round(score * 0.2, 2), F.lit(20.0))).otherwise(F.round(score * status, 2)))
    q = q.withColumn("total", F.round(dec("0.45") * F.col("price").cast("decimal(12,2)") + dec("0.15") * F.col("delivery") + dec("0.40") * F.col("quality").cast("decimal(12,2)"), 2).cast("double"))
    q = rows.ranked(q, ["l_partkey"], [F.desc("total"), F.desc("quality"), p, F.col("l_orderkey"), F.col("l_linenumber")])
    return q.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.round("price", 4).alias("price"), "quality", "total", "rank_order")


DEALS = f"""o as (select o_orderkey, o_totalprice, o_orderdate, count(*) offers, count(*) filter (l_returnflag = 'R') risky, count(*) filter (l_returnflag = 'N' and l_discount >= 0.09) unknown, bool_or(coalesce(s_acctbal, 0) < -900) blocked,
  sum((l_extendedprice * l_discount)::decimal(18,4))::double profit, sum((l_extendedprice * (1 - l_discount))::decimal(18,4))::double cash, count(*) filter (l_quantity < 2) insufficient, count(*) filter (l_extendedprice < 1200) no_price,
  count(*) filter (l_tax >= 0.08) manual, count(*) filter (l_linestatus = 'O' and l_returnflag = 'A') unknown_delivery from orders join lineitem on l_orderkey = o_orderkey left join supplier on s_suppkey = l_suppkey group by 1, 2, 3),
 s as (select *, profit / nullif(o_totalprice, 0) * 100 margin, datediff('hour', timestamp '{AS_OF}', o_orderdate + interval 120 day) h from o),
 p as (select *, case when margin >= 35 then 30 when margin >= 25 then 20 when margin >= 20 then 10 when margin >= 10 then 0 else -30 end score_margin,
  case when profit >= 100000 then 30 when profit >= 50000 then 20 when profit >= 20000 then 10 when profit >= 5000 then 5 else 0 end score_profit,
  case when h <= 0 then -100 when h < 3 then -30 when h < 12 then -10 when h < 24 then 3 else 10 end score_deadline, case when h <= 0 then 'expired' when h < 24 then 'deadline_soon' else 'active' end deadline_status,
  case when no_price > 0 then -30 when insufficient > 0 then -40 when manual > 0 then -10 else 20 end score_data_quality,
  case when blocked then -100 when risky = 0 and unknown = 0 then 10 else case when risky > 0 then -15 else 0 end - case when unknown > 0 then 3 else 0 end end score_supplier_quality,
  case when cash <= 0 then 0 when profit / cash * 100 >= 50 then 20 when profit / cash * 100 >= 30 then 10 when profit / cash * 100 >= 15 then 5 else -10 end score_cash_efficiency,
  case when offers >= 8 then -8 when offers <= 2 then -2 when h > 0 and h < 24 then -3 else -5 end score_competition,
  5 * unknown_delivery + 20 * risky + 50 * insufficient + case when manual > 2 then 15 else 0 end + case when blocked then 100 else 0 end risk_penalty from s),
 r as (select *, score_margin + score_profit + score_deadline + score_data_quality + score_supplier_quality + score_cash_efficiency + score_competition - risk_penalty score_total,
  case when risk_penalty >= 100 then 'critical' when risk_penalty >= 60 then 'high' when risk_penalty >= 25 then 'medium' else 'low' end risk_level from p),
 d as (select *, case when h <= 0 or blocked or risk_level = 'critical' then 'reject' when no_price > 0 then 'needs_manual_review' when score_total >= 60 then 'strong_recommend' when score_total >= 30 then 'recommend' when score_total >= 10 then 'watch' when score_total >= -10 then 'needs_manual_review' else 'reject' end decision from r),
 a as (select *, case when decision in ('strong_recommend', 'recommend') then case when unknown_delivery > 0 then 'ask_delivery' when unknown > 0 then 'check_suppliers' when manual > 0 then 'check_positions' else 'prepare_offer' end
  when decision = 'watch' then 'monitor' when decision = 'needs_manual_review' then case when deadline_status = 'deadline_soon' then 'urgent_review' else 'manual_review' end else 'decline' end next_action from d)"""


def deals(t: Tables) -> DataFrame:
    """Every order with what its offers come to, the points of each part of its score, the risk penalty, the decision and what to do next.

    Lines stand for positions: returned ones come from risky suppliers, those at a high discount from unknown ones, low prices for missing
    ones, high taxes for those to be reviewed by hand; a supplier deep in debt is blocked.
    """
    flag, dec_sum = F.col("l_returnflag"), lambda c: F.sum(c.cast("decimal(18,4)")).cast("double")
    lines = t.lineitem.join(t.supplier.select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    li = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("offers"), F.count_if(flag == "R").alias("risky"), F.count_if((flag == "N") & (F.col("l_discount") >= 0.09)).alias("unknown"), F.bool_or(F.coalesce("s_acctbal", F.lit(0.0)) < -900).alias("blocked"),
        dec_sum(F.col("l_extendedprice") * F.col("l_discount")).alias("profit"), dec_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cash"), F.count_if(F.col("l_quantity") < 2).alias("insufficient"),
        F.count_if(F.col("l_extendedprice") < 1200).alias("no_price"), F.count_if(F.col("l_tax") >= 0.08).alias("manual"), F.count_if((F.col("l_linestatus") == "O") & (flag == "A")).alias("unknown_delivery"),
    )
    s = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate").join(li, "o_orderkey")
    s = s.withColumn("h", F.expr(f"timestampdiff(HOUR, timestamp_ntz '{AS_OF} 00:00:00', date_trunc('HOUR', o_orderdate + interval 120 days))"))
    points, state = scoring.deadline_points(F.col("h"))
    cash, _ = scoring.cash_points(F.col("profit"), F.col("cash"))
    n = lambda c: F.col(c) > 0
    trust = F.when(F.col("blocked"), -100).when(~n("risky") & ~n("unknown"), 10).otherwise(F.when(n("risky"), -15).otherwise(0) - F.when(n("unknown"), 3).otherwise(0))
    s = s.select(
        "*", scoring.margin_points(F.try_divide("profit", "o_totalprice") * 100).alias("score_margin"), scoring.profit_points(F.col("profit")).alias("score_profit"), points.alias("score_deadline"), F.when(state == "soon", "deadline_soon").otherwise(state).alias("deadline_status"),
        F.when(n("no_price"), -30).when(n("insufficient"), -40).when(n("manual"), -10).otherwise(20).alias("score_data_quality"), trust.alias("score_supplier_quality"), cash.alias("score_cash_efficiency"),
        F.when(F.col("offers") >= 8, -8).when(F.col("offers") <= 2, -2).when(state == "soon", -3).otherwise(-5).alias("score_competition"),
        (5 * F.col("unknown_delivery") + 20 * F.col("risky") + 50 * F.col("insufficient") + F.when(F.col("manual") > 2, 15).otherwise(0) + F.when(F.col("blocked"), 100).otherwise(0)).alias("risk_penalty"),
    )
    parts = ("margin", "profit", "deadline", "data_quality", "supplier_quality", "cash_efficiency", "competition")
    total = sum((F.col(f"score_{p}") for p in parts), F.lit(0)) - F.col("risk_penalty")
    s = s.select("*", total.cast("long").alias("score_total"), scoring.ladder(F.col("risk_penalty"), scoring.RISK_LEVELS, "low").alias("risk_level"))
    never = (F.col("deadline_status") == "expired") | F.col("blocked") | (F.col("risk_level") == "critical")
    s = s.withColumn("decision", F.when(never, "reject").when(n("no_price"), "needs_manual_review").otherwise(scoring.ladder(F.col("score_total"), scoring.DECISION, "reject")))
    go = F.when(n("unknown_delivery"), "ask_delivery").when(n("unknown"), "check_suppliers").when(n("manual"), "check_positions").otherwise("prepare_offer")
    review = F.when(F.col("deadline_status") == "deadline_soon", "urgent_review").otherwise("manual_review")
    act = F.when(F.col("decision").isin("strong_recommend", "recommend"), go).when(F.col("decision") == "watch", "monitor").when(F.col("decision") == "needs_manual_review", review).otherwise("decline")
    return s.withColumn("next_action", act)


@query(f"with {DEALS} select o_orderkey, score_total::bigint score, risk_penalty::bigint penalty, risk_level as level, decision, next_action from a")
def deal_decision(t: Tables) -> DataFrame:
    """Flagship: every order scored from its offers, with the risk penalty, its level, the decision and the next step."""
    return deals(t).select("o_orderkey", F.col("score_total").alias("score"), F.col("risk_penalty").cast("long").alias("penalty"), F.col("risk_level").alias("level"), "decision", "next_action")


def part_of_deal(name: str, columns: tuple[str, ...]) -> None:
    """Register one part of what is known of deals, with what it follows from."""

    def run(t: Tables) -> DataFrame:
        whole = lambda c: F.col(c).cast("long").alias(c) if c.startswith(("score_", "risk_penalty")) or c == "h" else F.col(c)
        return deals(t).withColumn("margin", F.round(F.try_divide("profit", "o_totalprice") * 100, 4)).select("o_orderkey", *map(whole, columns))

    run.__name__ = name
    said = {"margin": "round(margin, 4) margin"}
    query(f"with {DEALS} select o_orderkey, {', '.join(said.get(c, f'{c}::bigint {c}' if c.startswith(('score_', 'risk_penalty')) or c == 'h' else c) for c in columns)} from a")(run)


for _name, _columns in {
    "score_margin": ("margin", "score_margin"), "score_profit": ("profit", "score_profit"), "score_deadline": ("deadline_status", "score_deadline"), "score_data_quality": ("no_price", "insufficient", "manual", "score_data_quality"),
    "score_supplier_quality": ("risky", "unknown", "blocked", "score_supplier_quality"), "score_cash_efficiency": ("profit", "cash", "score_cash_efficiency"), "score_competition": ("offers", "deadline_status", "score_competition"),
    "score_total": ("score_total",), "risk_penalty": ("risk_penalty", "risk_level"), "decision_from_score": ("score_total", "risk_level", "decision"), "next_action": ("decision", "next_action"), "date_hours_to_deadline": ("h",),
}.items():
    part_of_deal(_name, _columns)


@query("""select o_orderkey, list_filter([case when o_totalprice <= 0 then 'price' end, case when b < 0 then 'cash' end], lambda x: x is not null)::varchar errors_,
  case when o_totalprice <= 0 or b < 0 then 'error' when b < 1000 or o_totalprice > b * 50 then 'warning' else 'ok' end status from (select o_orderkey, o_totalprice, c_acctbal b from orders join customer on o_custkey = c_custkey)""".replace("list_filter(", "array_to_string(list_filter(").replace(")::varchar errors_", "), ',') errors"))
def financial_check(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    price, bal = F.col("o_totalprice"), F.col("c_acctbal")
    errors = scoring.reasons((price <= 0, "price"), (bal < 0, "cash"))
    status = F.when(F.size(errors) > 0, "error").when((bal < 1000) | (price > bal * 50), "warning").otherwise("ok")
    return o.select("o_orderkey", F.array_join(errors, ",").alias("errors"), status.alias("status"))


@query("""select event_id, case event_type when 'error' then case when value > 50 then 'critical' else 'high' end when 'purchase' then case when value > 50 then 'high' else 'medium' end
  else case when value > 50 then 'critical' else 'high' end end lvl from events where event_type in ('error', 'purchase')""".replace("lvl", "level"))
def escalate_risk(t: Tables) -> DataFrame:
    e = t.events.filter(F.col("event_type").isin("error", "purchase"))
    base = F.when(F.col("event_type") == "error", "medium").otherwise("low")
    return e.select("event_id", scoring.escalated(base, F.when(F.col("value") > 50, 2).otherwise(1)).alias("level"))


@query("""select o_orderkey, round(100 * (0.25::double * u + 0.2::double * v + 0.2::double * d + 0.25::double * s + 0.1::double * c), 2) score from
 (select o_orderkey, case when n >= 2 then 0.9::double else 0.55::double end u, case when o_totalprice > 100000 then 0.8::double else 0.4::double end v, case when o_orderpriority <> '4-NOT SPECIFIED' then 0.9::double else 0.45::double end d,
  case o_orderstatus when 'F' then 0.95::double when 'O' then 0.6::double else 0.1::double end s, case when o_custkey % 2 = 0 then 0.85::double else 0.65::double end c
  from orders join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey)""")
def priority_score(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    pick = lambda c, a, b: F.when(c, a).otherwise(b)
    u, v = pick(F.col("n") >= 2, 0.9, 0.55), pick(F.col("o_totalprice") > 100000, 0.8, 0.4)
    d = pick(F.col("o_orderpriority") != "4-NOT SPECIFIED", 0.9, 0.45)
    s = F.when(F.col("o_orderstatus") == "F", 0.95).when(F.col("o_orderstatus") == "O", 0.6).otherwise(0.1)
    c = pick(F.col("o_custkey") % 2 == 0, 0.85, 0.65)
    return t.orders.join(n, "o_orderkey").select("o_orderkey", F.round(100 * (0.25 * u + 0.2 * v + 0.2 * d + 0.25 * s + 0.1 * c), 2).alias("score"))


@query("""select s_suppkey, greatest(0, least(100, 80 - 25 * claim - 20 * severe - 5 * incident))::int rating, case when 80 - 25 * claim - 20 * severe - 5 * incident >= 85 then 'PREFERRED' when 80 - 25 * claim - 20 * severe - 5 * incident >= 70 then 'APPROVED'
  when 80 - 25 * claim - 20 * severe - 5 * incident >= 50 then 'WATCHLIST' else 'BLOCKED' end band from
  (select s_suppkey, (s_acctbal < 0)::int claim, coalesce(bool_or(l_tax > 0.07 and l_returnflag = 'R'), false)::int severe, coalesce(bool_or(l_returnflag = 'R'), false)::int incident from supplier left join lineitem on l_suppkey = s_suppkey group by s_suppkey, s_acctbal)""")
def supplier_rating(t: Tables) -> DataFrame:
    back = F.col("l_returnflag") == "R"
    li = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.bool_or((F.col("l_tax") > 0.07) & back).alias("severe"), F.bool_or(back).alias("incident"))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    raw = 80 - 25 * one(F.col("s_acctbal") < 0) - 20 * one(F.col("severe")) - 5 * one(F.col("incident"))
    band = scoring.ladder(raw, [(85, "PREFERRED"), (70, "APPROVED"), (50, "WATCHLIST")], "BLOCKED")
    return t.supplier.join(li, "s_suppkey", "left").select("s_suppkey", scoring.clamp(raw, 0, 100).cast("int").alias("rating"), band.alias("band"))


@query("""select s_suppkey, (30 * (n_parts >= 50)::int + 20 * (n_flags >= 3)::int + 10 * (s_nationkey < 10)::int - 10 * (s_acctbal < 0)::int)::int score from supplier join
  (select l_suppkey, count(distinct l_partkey) n_parts, count(distinct l_returnflag) n_flags from lineitem group by 1) on l_suppkey = s_suppkey order by score desc, s_suppkey limit 10""")
def supplier_rank(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_partkey").alias("p"), F.countDistinct("l_returnflag").alias("f"))
    i = lambda c: c.cast("int")
    score = 30 * i(F.col("p") >= 50) + 20 * i(F.col("f") >= 3) + 10 * i(F.col("s_nationkey") < 10) - 10 * i(F.col("s_acctbal") < 0)
    return t.supplier.join(n, "s_suppkey").select("s_suppkey", score.alias("score")).orderBy(F.desc("score"), "s_suppkey").limit(10)


@query("""select o_custkey, case when bool_or(o_totalprice > 400000) then 'NO_GO' when count(*) filter (o_totalprice > 250000) >= 3 then 'NEEDS_REVIEW' when count(*) filter (o_totalprice > 250000) >= 1 then 'GO_WITH_CONDITIONS' else 'GO' end decision from orders group by 1""")
def risk_memo_decision(t: Tables) -> DataFrame:
    high = F.count_if(F.col("o_totalprice") > 250000)
    d = F.when(F.bool_or(F.col("o_totalprice") > 400000), "NO_GO").when(high >= 3, "NEEDS_REVIEW").when(high >= 1, "GO_WITH_CONDITIONS").otherwise("GO")
    return t.orders.groupBy("o_custkey").agg(d.alias("decision"))


@query("""with c as (select o_orderkey, o_totalprice::decimal(18,2) b, case o_orderstatus when 'F' then 0.03 when 'O' then 0.05 else 0.08 end r from orders),
  l as (select o_orderkey, b, round(b * 0.08, 2) x, round(b * r, 2) y, round(b * 0.07, 2) z from c)
  select o_orderkey, unnest(['logistics', 'buffer', 'overhead', 'minimum_bid']) line, unnest([x::double, y::double, z::double, round((b + x + y + z) * 1.12, 2)::double]) amount from l""")
def cost_model(t: Tables) -> DataFrame:
    b = F.col("o_totalprice").cast("decimal(18,2)")
    rate = F.when(F.col("o_orderstatus") == "F", dec("0.03")).when(F.col("o_orderstatus") == "O", dec("0.05")).otherwise(dec("0.08"))
    parts = {"logistics": F.round(b * dec("0.08"), 2), "buffer": F.round(b * rate, 2), "overhead": F.round(b * dec("0.07"), 2)}
    parts["minimum_bid"] = F.round((b + parts["logistics"] + parts["buffer"] + parts["overhead"]) * dec("1.12"), 2)
    lines = F.array(*(F.struct(F.lit(k).alias("line"), v.cast("double").alias("amount")) for k, v in parts.items()))
    return t.orders.select("o_orderkey", F.inline(lines))


GAPS = "g as (select o_orderkey, round(o_totalprice::decimal(18,2) * 0.55, 2) gap, case when o_totalprice <= 50000 then 45 when o_totalprice <= 150000 then 60 else 90 end d from orders)"


def gaps(t: Tables) -> DataFrame:
    """The peak of cash that each order ties up, and for how many days."""
    days = scoring.ladder(-F.col("o_totalprice"), [(-50000, 45), (-150000, 60)], 90)
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice").cast("decimal(18,2)") * dec("0.55"), 2).alias("gap"), days.alias("d"))


@query(f"""with {GAPS} select o_orderkey, unnest(['BASE', 'FAST', 'DELAYED']) scenario, unnest([gap::double, round(gap * 0.75, 2)::double, round(gap * 1.25, 2)::double]) gap, unnest([d, greatest(20, d - 15), d + 20]) as days from g""")
def cash_gap(t: Tables) -> DataFrame:
    p, d = F.col("gap"), F.col("d")
    row = lambda n, a, b: F.struct(F.lit(n).alias("scenario"), a.cast("double").alias("gap"), b.alias("days"))
    scenarios = F.array(row("BASE", p, d), row("FAST", F.round(p * dec("0.75"), 2), F.greatest(F.lit(20), d - 15)), row("DELAYED", F.round(p * dec("1.25"), 2), d + 20))
    return gaps(t).select("o_orderkey", F.inline(scenarios))


@query(f"""with {GAPS},
  o as (select o_orderkey, unnest(['SELF_FUNDED', 'FACTORING', 'BANK_LINE']) opt, unnest([gap::double, round(gap * 0.85, 2)::double, gap::double]) amount,
   unnest([0.0::double, round(gap * 0.85 * case when d <= 45 then 0.06 else 0.09 end, 2)::double, round(gap * case when d <= 60 then 0.08 else 0.12 end, 2)::double]) cost,
   unnest([case when gap <= 30000 then 0 when gap <= 100000 then 1 else 2 end, case when d <= 60 then 0 else 1 end, case when gap <= 200000 then 0 else 2 end]) feasible from g)
  select o_orderkey, opt, amount, cost, row_number() over (partition by o_orderkey order by feasible, cost, opt) rank_order from o""")
def financing_options(t: Tables) -> DataFrame:
    gap, d = F.col("gap"), F.col("d")
    row = lambda n, a, c, f: F.struct(F.lit(n).alias("opt"), a.cast("double").alias("amount"), c.cast("double").alias("cost"), f.alias("feasible"))
    options = F.array(
        row("SELF_FUNDED", gap, F.lit(0.0), F.when(gap <= 30000, 0).when(gap <= 100000, 1).otherwise(2)),
        row("FACTORING", F.round(gap * dec("0.85"), 2), F.round(gap * dec("0.85") * F.when(d <= 45, dec("0.06")).otherwise(dec("0.09")), 2), F.when(d <= 60, 0).otherwise(1)),
        row("BANK_LINE", gap, F.round(gap * F.when(d <= 60, dec("0.08")).otherwise(dec("0.12")), 2), F.when(gap <= 200000, 0).otherwise(2)),
    )
    o = rows.ranked(gaps(t).select("o_orderkey", F.inline(options)), ["o_orderkey"], [F.col("feasible"), F.col("cost"), F.col("opt")])
    return o.select("o_orderkey", "opt", "amount", "cost", "rank_order")


@query("""select l_partkey, base::double base, round(base * 1.4125, 2)::double bid, round(base * 0.5, 2)::double gap from (select l_partkey, min(l_extendedprice)::decimal(18,2) base from lineitem group by 1)""")
def economics_summary(t: Tables, reserves: str = "1.13", margin: float = 0.2, days: int = 45) -> DataFrame:
    base = F.col("base")
    cost = t.lineitem.groupBy("l_partkey").agg(F.min("l_extendedprice").cast("decimal(18,2)").alias("base"))
    factor = str(round(Decimal(reserves) / Decimal(str(max(1 - margin, 0.01))), 6).normalize())
    return cost.select("l_partkey", base.cast("double").alias("base"), F.round(base * dec(factor), 2).cast("double").alias("bid"), F.round(base * dec(str(min(days / 90, 1.5))), 2).cast("double").alias("gap"))


@query("select r_name, y, round(n * (1 + 0.1::double * y), 2) forecast from (select r_name, count(*) n from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1) cross join (values (1), (3), (5)) v(y)")
def capacity_grid(t: Tables) -> DataFrame:
    n = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    years = n.withColumn("y", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    return years.select("r_name", "y", F.round(F.col("n") * (1 + 0.1 * F.col("y")), 2).alias("forecast"))


@query("""select p_partkey, greatest(0, least(100, 20 * (contains(lower(p_name), 'a'))::int + 20 * (contains(lower(p_type), 'brass'))::int - 15 * (contains(lower(p_name), 'x'))::int + case when p_retailprice between 500 and 1500 then 20 else 5 end + 5 + 15))::int score from part""")
def relevance_card(t: Tables) -> DataFrame:
    has = lambda c, w: F.lower(c).contains(w).cast("int")
    price = F.when(F.col("p_retailprice").between(500, 1500), 20).otherwise(5)
    return t.part.select("p_partkey", scoring.clamp(20 * has("p_name", "a") + 20 * has("p_type", "brass") - 15 * has("p_name", "x") + price + 20, 0, 100).cast("int").alias("score"))
