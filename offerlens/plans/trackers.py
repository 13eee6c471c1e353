"""Registers that events drive: payments, logistics, milestones, shipping, suppliers, collection, submissions, incidents, procedures, statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranges, statuses
from .registry import Tables, query

# By tracker, what a state makes of the set's status, of the phase of execution and of the command's status; null: any other state.
OUTCOMES = {
    "shipping": {"ACCEPTED": ("ACCEPTED", "ACCEPTANCE", "IN_PROGRESS"), "DELIVERED": ("DELIVERED", "SHIPPING", "IN_PROGRESS"), "REJECTED": ("FAILED", "ACCEPTANCE", "ON_HOLD"), None: ("ACTIVE", "SHIPPING", "IN_PROGRESS")},
    "fulfillment": {"FULFILLED": ("COMPLETED", "SHIPPING", "IN_PROGRESS"), "DELAYED": ("AT_RISK", "PROCUREMENT", "IN_PROGRESS"), "FAILED": ("FAILED", "PROCUREMENT", "ON_HOLD"), None: ("ACTIVE", "PROCUREMENT", "IN_PROGRESS")},
    "collection": {"INVOICED": ("INVOICED", "INVOICING", "IN_PROGRESS"), "PARTIAL": ("PARTIALLY_COLLECTED", "COLLECTION", "IN_PROGRESS"), "COLLECTED": ("COLLECTED", "COLLECTION", "COMPLETED"), "OVERDUE": ("FAILED", "COLLECTION", "ON_HOLD"), None: ("ACTIVE", "INVOICING", "IN_PROGRESS")},
    "progress": {"READY": ("COMPLETED",), "DELAYED": ("AT_RISK",), "BLOCKED": ("FAILED",), None: ("ACTIVE",)},
    "procedure": {"AWARDED": ("WON_PENDING_CONTRACT",), "WON_PENDING_CONTRACT": ("WON_PENDING_CONTRACT",), "LOST": ("LOST",), "CANCELLED": ("CANCELLED",), None: ("BID_IN_PROGRESS",)},
}
PAYMENT = {"PAID": "PAID", "PARTIAL_PAYMENT": "PARTIAL", "OVERDUE": "OVERDUE", None: "PENDING"}
LOGISTICS = {"ACCEPTED": "ACCEPTED", "DELIVERED": "DELIVERED", "DELAY": "DELAYED", "CHECKPOINT": "IN_TRANSIT"}
INCIDENT = {"ESCALATED": "ESCALATED", "RESOLVED": "RESOLVED", None: "OPEN"}
MILESTONE_PHASES = {"MS-PROCUREMENT": "PROCUREMENT", "MS-SHIPPING": "SHIPPING", "MS-ACCEPTANCE": "ACCEPTANCE", "MS-COLLECTION": "COLLECTION", "MS-LAUNCH": "LAUNCHED"}
CLOSED_STAGES = ("AWARDED", "LOST", "CANCELLED")

AT = "(ts, event_id)"


def looked_up(key: Column, table: dict[str | None, str]) -> Column:
    """The value of the key, or that of None; null if there is none."""
    cases = [F.when(key == k, v) for k, v in table.items() if k is not None]
    return F.coalesce(*cases, F.lit(table.get(None)).cast("string"))


def outcome(state: Column, tracker: str, part: int) -> Column:
    return looked_up(state, {k: v[part] for k, v in OUTCOMES[tracker].items()})


def case(column: str, table: dict[str | None, str]) -> str:
    """The same lookup in SQL."""
    other = f"'{table[None]}'" if None in table else "null"
    return f"case {column} {' '.join(f'''when '{k}' then '{v}' ''' for k, v in table.items() if k is not None)} else {other} end"


def outcome_case(column: str, tracker: str, part: int) -> str:
    return case(column, {k: v[part] for k, v in OUTCOMES[tracker].items()})


def at() -> Column:
    return F.struct("ts", "event_id")


def last(value: Column | str) -> Column:
    """A patched field after all events: the value of the last event that has one."""
    c = F.col(value) if isinstance(value, str) else value
    return F.max_by(c, F.when(c.isNotNull(), at()))


def given(t: Tables, name: str, table: dict[str, str]) -> DataFrame:
    """Events with a column made from the kind of event; kinds that are not listed give null."""
    return t.events.withColumn(name, looked_up(F.col("event_type"), table))


def sql_given(name: str, table: dict[str, str]) -> str:
    return f"(select *, {case('event_type', table)} {name} from events)"


PAYMENT_EVENTS = {"purchase": "PAID", "click": "PARTIAL_PAYMENT", "error": "OVERDUE"}


@query(f"""with e as (select *, case when value > 97 then 'PAID' else {case("kind", PAYMENT)} end status from {sql_given("kind", PAYMENT_EVENTS)})
 select user_id, arg_max(status, {AT}) status, arg_max(value, {AT}) filter (event_type = 'signup') expected_amount, arg_max(value, {AT}) filter (event_type in ('purchase', 'click')) last_amount,
 arg_max(floor(value)::bigint, {AT}) filter (event_type = 'error') overdue_days, count(*) filter (status = 'OVERDUE') alerts from e group by 1""")
def state_register_event(t: Tables) -> DataFrame:
    """Payments: amounts and days are patched where an event gives them; the status is the event's own, else that of its kind; overdue ones raise alerts."""
    kind = F.col("event_type")
    e = given(t, "kind", PAYMENT_EVENTS).withColumn("status", F.when(F.col("value") > 97, "PAID").otherwise(looked_up(F.col("kind"), PAYMENT)))
    patched = {"expected_amount": F.when(kind == "signup", F.col("value")), "last_amount": F.when(kind.isin("purchase", "click"), F.col("value")), "overdue_days": F.when(kind == "error", F.floor("value"))}
    return e.groupBy("user_id").agg(last("status").alias("status"), *(last(v).alias(k) for k, v in patched.items()), F.count_if(F.col("status") == "OVERDUE").alias("alerts"))


LOGISTIC_EVENTS = {"purchase": "DELIVERED", "click": "ACCEPTED", "error": "DELAY", "signup": "CHECKPOINT", "view": "NOTE"}


@query(f"""with e as (select *, case when value > 95 then 'CLOSED' else {case("kind", LOGISTICS)} end status from {sql_given("kind", LOGISTIC_EVENTS)})
 select user_id, arg_max(status, {AT}) filter (status is not null) status, arg_max(ts, {AT}) filter (value > 50) eta_at, count(*) filter (value < 20) links from e group by 1""")
def state_logistics_event(t: Tables) -> DataFrame:
    """Deliveries on their way: the time of arrival is patched; events of other kinds leave the status as it is; an event with a source adds a link."""
    e = given(t, "kind", LOGISTIC_EVENTS).withColumn("status", F.when(F.col("value") > 95, "CLOSED").otherwise(looked_up(F.col("kind"), LOGISTICS)))
    return e.groupBy("user_id").agg(last("status").alias("status"), last(F.when(F.col("value") > 50, F.col("ts"))).alias("eta_at"), F.count_if(F.col("value") < 20).alias("links"))


MILESTONES = {"purchase": "MS-COLLECTION", "click": "MS-SHIPPING", "error": "MS-ACCEPTANCE", "signup": "MS-LAUNCH", "view": "MS-PROCUREMENT"}


@query(f"""with e as (select *, case when value < 3 then 'CANCELLED' when value < 10 then 'DELAYED' when value < 70 then 'DONE' when value < 85 then 'PLANNED' end state from {sql_given("milestone", MILESTONES)}),
 m as (select user_id, milestone, coalesce(arg_max(state, {AT}) filter (state is not null), 'PLANNED') state from e group by 1, 2),
 p as (select user_id, arg_max({case("milestone", MILESTONE_PHASES)}, {AT}) filter (state = 'DONE') phase from e group by 1)
 select user_id, case when bool_and(state = 'DONE') then 'COMPLETED' when bool_or(state in ('DELAYED', 'CANCELLED')) then 'BLOCKED' else 'ACTIVE' end status, count(*) filter (state = 'DONE') done, any_value(phase) phase from m join p using (user_id) group by 1""")
def state_delivery_event(t: Tables) -> DataFrame:
    """Milestones: each has the last state given; the set's status follows from all of them, and a milestone that is done moves the phase on."""
    v = F.col("value")
    state = F.when(v < 3, "CANCELLED").when(v < 10, "DELAYED").when(v < 70, "DONE").when(v < 85, "PLANNED")
    e = given(t, "milestone", MILESTONES).withColumn("state", state)
    each = e.groupBy("user_id", "milestone").agg(F.coalesce(last("state"), F.lit("PLANNED")).alias("state"))
    status = F.when(F.bool_and(F.col("state") == "DONE"), "COMPLETED").when(F.bool_or(F.col("state").isin("DELAYED", "CANCELLED")), "BLOCKED").otherwise("ACTIVE")
    sets = each.groupBy("user_id").agg(status.alias("status"), F.count_if(F.col("state") == "DONE").alias("done"))
    done = F.when(F.col("state") == "DONE", looked_up(F.col("milestone"), MILESTONE_PHASES))
    return sets.join(e.groupBy("user_id").agg(last(done).alias("phase")), "user_id")


def by_state(name: str, tracker: str, states: dict[str, str], patches: dict[str, tuple[str, str]], text: str) -> None:
    """Register a tracker whose outcome follows from its state alone. patches: field -> (column, kind of event that gives it)."""
    parts = ("status", "phase", "command")[: len(OUTCOMES[tracker][None])]
    fields = "".join(f", arg_max({c}, {AT}) filter (event_type = '{k}' and {c} is not null) {f}" for f, (c, k) in patches.items())
    sql = f"""with s as (select user_id, arg_max(state, {AT}) filter (state is not null) state{fields} from {sql_given("state", states)} group by 1)
 select *, {", ".join(f"{outcome_case('state', tracker, i)} {p}" for i, p in enumerate(parts))} from s"""

    def run(t: Tables) -> DataFrame:
        e = given(t, "state", states)
        s = e.groupBy("user_id").agg(last("state").alias("state"), *(last(F.when(F.col("event_type") == k, F.col(c))).alias(f) for f, (c, k) in patches.items()))
        return s.select("*", *(outcome(F.col("state"), tracker, i).alias(p) for i, p in enumerate(parts)))

    run.__name__, run.__doc__ = name, text
    query(sql)(run)


by_state("state_shipping_event", "shipping", {"purchase": "ACCEPTED", "click": "DELIVERED", "error": "REJECTED", "view": "PACKED"}, {"shipment_ref": ("props", "click"), "acceptance_ref": ("props", "purchase")}, "Shipping: state and references are patched, status and phase follow from the state.")
by_state("state_fulfillment_event", "fulfillment", {"purchase": "FULFILLED", "click": "IN_PROGRESS", "error": "FAILED", "view": "DELAYED"}, {}, "What suppliers fulfil: status, phase and command follow from the state.")
by_state("state_payment_collection_event", "collection", {"purchase": "COLLECTED", "click": "PARTIAL", "error": "OVERDUE", "view": "INVOICED"}, {"collected_amount": ("value", "purchase"), "invoice_ref": ("props", "view")}, "Money collected: the amount is replaced, not summed.")

PROGRESS_STATES = {"purchase": "READY", "click": "IN_PROGRESS", "error": "BLOCKED", "view": "DELAYED"}
DAY = 86_400_000_000


@query(f"""with e as (select *, last_value(state ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) now from {sql_given("state", PROGRESS_STATES)})
 select user_id, arg_max(now, {AT}) state, {outcome_case(f"arg_max(now, {AT})", "progress", 0)} status, count(*) filter (now = 'DELAYED') high_alerts, count(*) filter (now = 'BLOCKED') critical_alerts from e group by 1""")
def state_supplier_progress_event(t: Tables) -> DataFrame:
    """Progress of suppliers: any event while the supplier is delayed or blocked raises an alert, also one that gives no state."""
    e = ranges.last_known(given(t, "state", PROGRESS_STATES), ["user_id"], ["ts", "event_id"], F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY), "state", "now")
    s = e.groupBy("user_id").agg(last("now").alias("state"), F.count_if(F.col("now") == "DELAYED").alias("high_alerts"), F.count_if(F.col("now") == "BLOCKED").alias("critical_alerts"))
    return s.withColumn("status", outcome(F.col("state"), "progress", 0))


STAGES = {"purchase": "AWARDED", "error": "LOST", "click": "CLARIFICATION", "view": "EVALUATION"}


@query(f"""with e as (select *, case when {" or ".join(f"stage = '{s}'" for s in CLOSED_STAGES)} then (ts, event_id) end closing from (select event_id, ts, user_id, case when value > 80 then {case("event_type", STAGES)} end stage from events)),
 f as (select *, min(closing) over (partition by user_id) first from e)
 select user_id, coalesce(arg_max(stage, {AT}) filter (stage is not null), 'SUBMITTED') stage, case when any_value(first) is not null then 'CLOSED' else 'OPEN' end status, count(*) filter ((ts, event_id) >= first) closed_events from f group by 1""")
def state_post_submission_event(t: Tables) -> DataFrame:
    """After submission: a final stage closes the tracker for good, and each event from then on is followed by one that says so."""
    e = t.events.withColumn("stage", F.when(F.col("value") > 80, looked_up(F.col("event_type"), STAGES)))
    closed = e.filter(F.col("stage").isin(*CLOSED_STAGES)).groupBy("user_id").agg(F.min(at()).alias("first"))
    rows = e.join(closed, "user_id", "left")
    status = F.when(F.first("first").isNotNull(), "CLOSED").otherwise("OPEN")
    return rows.groupBy("user_id").agg(F.coalesce(last("stage"), F.lit("SUBMITTED")).alias("stage"), status.alias("status"), F.count_if(at() >= F.col("first")).alias("closed_events"))


INCIDENTS = {"error": "ESCALATED", "purchase": "RESOLVED", "view": "UPDATED"}


@query(f"""with e as (select *, case when value > 96 then 'MONITORING' else {case("kind", INCIDENT)} end status, case when value < 5 then 'SLA' end flag from {sql_given("kind", INCIDENTS)})
 select user_id, arg_max(status, {AT}) status, arg_max(case when value > 90 then 'CRITICAL' else 'LOW' end, {AT}) filter (value > 90 or value < 15) severity, count(*) filter (flag is not null or kind = 'ESCALATED') flags,
 count(*) filter (kind = 'ESCALATED' and flag is null) escalation_flags from e group by 1""")
def state_incident_event(t: Tables) -> DataFrame:
    """Incidents: severity is patched; the status is the event's own, else that of its kind; escalations and flagged events add a flag."""
    v = F.col("value")
    e = given(t, "kind", INCIDENTS).withColumn("status", F.when(v > 96, "MONITORING").otherwise(looked_up(F.col("kind"), INCIDENT))).withColumn("flag", F.when(v < 5, "SLA"))
    up = F.coalesce(F.col("kind") == "ESCALATED", F.lit(False))
    severity = F.when(v > 90, "CRITICAL").when(v < 15, "LOW")
    return e.groupBy("user_id").agg(last("status").alias("status"), last(severity).alias("severity"), F.count_if(F.col("flag").isNotNull() | up).alias("flags"), F.count_if(up & F.col("flag").isNull()).alias("escalation_flags"))


PROCEDURES = {"purchase": "AWARDED", "error": "LOST", "signup": " CANCELLED ", "click": "WON_PENDING_CONTRACT"}


@query(f"""with s as (select user_id, trim(arg_max(stage, {AT}) filter (stage is not null)) stage, count(*) filter (event_type = 'view') alerts from {sql_given("stage", PROCEDURES)} group by 1)
 select *, {outcome_case("stage", "procedure", 0)} status from s""")
def state_procedure_event(t: Tables) -> DataFrame:
    """Procedures: the stage is patched, the status follows from it; events of the kind alert raise one."""
    s = given(t, "stage", PROCEDURES).groupBy("user_id").agg(F.trim(last("stage")).alias("stage"), F.count_if(F.col("event_type") == "view").alias("alerts"))
    return s.withColumn("status", outcome(F.col("stage"), "procedure", 0))


def requests(t: Tables) -> DataFrame:
    """Events as requests for a status: which one follows from the day and the kind of event, so that many are allowed and many are not."""
    names = list(dict.fromkeys(s for pair in statuses.RULES for s in pair))
    day = F.date_diff("ts", F.lit("2024-01-01").cast("date"))
    n = F.pmod(F.floor(day / 2) + F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).otherwise(0), F.lit(len(names)))
    to = F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    wanted = F.when(F.col("value") < 10, F.lit("NEW"))
    return t.events.select("user_id", "ts", "event_id", wanted.alias("from_status"), to.alias("to_status"))


NAMES = list(dict.fromkeys(s for pair in statuses.RULES for s in pair))
RULE_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in statuses.RULES)
REQUESTS = f"""q as (select user_id, ts, event_id, case when value < 10 then 'NEW' end wanted,
  [{", ".join(f"'{n}'" for n in NAMES)}][((date_diff('day', date '2024-01-01', ts::date) // 2 + case event_type when 'error' then 1 when 'signup' then 2 else 0 end) % {len(NAMES)})::int + 1] next,
  row_number() over (partition by user_id order by ts, event_id) n from events),
 rules(a, b) as (values {RULE_ROWS}),
 w as (select user_id, 0::bigint n, 'NEW' before, 'NEW' after, null::bigint event_id, null::varchar next, null::varchar reason from q where n = 1
  union all select q.user_id, q.n, w.after, case when coalesce(wanted, w.after) = w.after and (w.after, q.next) in (select (a, b) from rules) then q.next else w.after end, q.event_id, q.next,
   case when coalesce(wanted, w.after) <> w.after then '{statuses.MISMATCH}' when (w.after, q.next) not in (select (a, b) from rules) then '{statuses.NO_RULE}' end
   from w join q on q.user_id = w.user_id and q.n = w.n + 1)"""


@query(f"with recursive {REQUESTS} select user_id, event_id, before, after, case when reason is null then '{statuses.CHANGED}' else '{statuses.BLOCKED}' end event_code, reason from w where n > 0")
def status_transition(t: Tables) -> DataFrame:
    """Requests for a status in order: what each leads to, and why those that are blocked are."""
    return statuses.transitions(requests(t), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "before", "after", "event_code", "reason")


@query(f"with recursive {REQUESTS} select a from_status, b to_status, count(event_id) applied from rules left join w on w.before = a and w.next = b and w.reason is null and w.n > 0 group by 1, 2")
def status_rules(t: Tables) -> DataFrame:
    """The thirteen rules, with how many requests each allowed."""
    rules = t.spark.createDataFrame(statuses.RULES, "from_status string, to_status string")
    used = statuses.transitions(requests(t), "user_id", ["ts", "event_id"]).filter("reason is null").groupBy(F.col("before").alias("from_status"), F.col("to_status")).agg(F.count("*").alias("applied"))
    return rules.join(used, ["from_status", "to_status"], "left").select("from_status", "to_status", F.coalesce("applied", F.lit(0)).alias("applied"))


def appended(events: DataFrame, deals: DataFrame) -> DataFrame:
    """Event rows that may be appended: they name a deal, a module or an agent, have a code, and their deal is there."""
    named = reduce(lambda a, b: a | b, (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in ("deal_id", "source_module_id", "source_agent_code")))
    good = events.filter(named & (F.coalesce(F.trim("event_code"), F.lit("")) != ""))
    found = good.join(deals.select(F.col("deal_id").alias("known")).distinct(), good["deal_id"] == F.col("known"), "left")
    return found.filter(F.col("deal_id").isNull() | F.col("known").isNotNull()).drop("known").withColumn("event_code", F.trim("event_code"))


@query("""select event_id, case when value > 5 then user_id end deal_id, event_type event_code, case when event_type <> 'view' then 'M-004' end source_module_id, case when event_type = 'error' then 'WARNING' else 'INFO' end severity
 from events where (value > 5 or event_type <> 'view') and (not value > 5 or user_id in (select c_custkey from customer where c_acctbal >= 0))""")
def event_append(t: Tables) -> DataFrame:
    """Events as rows of the log; those that name nothing, or a deal that is not there (a customer in debt counts as deleted), are left out."""
    kind = F.col("event_type")
    rows = t.events.select("event_id", F.when(F.col("value") > 5, F.col("user_id")).alias("deal_id"), kind.alias("event_code"), F.when(kind != "view", "M-004").alias("source_module_id"), F.lit(None).cast("string").alias("source_agent_code"), F.when(kind == "error", "WARNING").otherwise("INFO").alias("severity"))
    return appended(rows, t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("deal_id"))).drop("source_agent_code")


@query("""with d as (select event_id, user_id, event_type, props from events where event_type in ('purchase', 'error') and user_id in (select c_custkey from customer) and coalesce(props, '') <> '')
 select 'decision' kind, event_id, user_id deal_id, upper(event_type) code, null::boolean known from d union all select 'event', event_id, user_id, 'decision_recorded', event_type = 'purchase' from d""")
def decision_append(t: Tables) -> DataFrame:
    """Decisions of deals that are there, each with the event that records it; a decision has to give its reasons."""
    d = t.events.filter("event_type in ('purchase', 'error') and coalesce(props, '') <> ''").join(t.customer, F.col("user_id") == F.col("c_custkey"), "left_semi")
    rows = F.array(
        F.struct(F.lit("decision").alias("kind"), F.upper("event_type").alias("code"), F.lit(None).cast("boolean").alias("known")),
        F.struct(F.lit("event").alias("kind"), F.lit("decision_recorded").alias("code"), (F.col("event_type") == "purchase").alias("known")),
    )
    return d.select("event_id", F.col("user_id").alias("deal_id"), F.inline(rows)).select("kind", "event_id", "deal_id", "code", "known")
