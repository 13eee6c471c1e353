"""Statuses of deals: which transitions the rules allow, applied to requests in order, for tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold

# The transitions that hold unless others are given, in the order in which they are listed.
RULES = (
    ("NEW", "CANDIDATE"),
    ("CANDIDATE", "DOCS_ANALYSIS"),
    ("CANDIDATE", "REJECTED_EARLY"),
    ("DOCS_ANALYSIS", "SUPPLIER_SOURCING"),
    ("DOCS_ANALYSIS", "REJECTED_EARLY"),
    ("SUPPLIER_SOURCING", "ECONOMICS_REVIEW"),
    ("ECONOMICS_REVIEW", "WAITING_CEO_APPROVAL_TO_BID"),
    ("WAITING_CEO_APPROVAL_TO_BID", "BID_PREPARATION"),
    ("WAITING_CEO_APPROVAL_TO_BID", "DECLINED_TO_BID"),
    ("BID_PREPARATION", "PRE_SUBMISSION"),
    ("PRE_SUBMISSION", "SUBMISSION"),
    ("SUBMISSION", "POST_SUBMISSION"),
    ("POST_SUBMISSION", "OUTCOME_CAPTURE"),
)
FIRST = "NEW"
CHANGED, BLOCKED = "deal_status_changed", "deal_status_transition_blocked"
MISMATCH = "deal.current_status does not match requested from_status"
NO_RULE = "transition rule does not exist or is disabled"


def step(rules: frozenset[tuple[str, str]], now: str, wanted_from: str | None, to: str | None) -> tuple[str, str | None]:
    """(status after a request, why it is blocked or null). A request without a status to leave leaves the current one."""
    if wanted_from and wanted_from != now:
        return now, MISMATCH
    if (now, to) not in rules:
        return now, NO_RULE
    return to, None


def transitions(requests: DataFrame, key: str, order: list[str], rules: tuple[tuple[str, str], ...] = RULES, first: str = FIRST) -> DataFrame:
    """Each request (key, order..., from_status, to_status) with `before`, `after`, `event_code` and `reason`: requests of a key are applied in
    order; one without a rule, or that names another status to leave than the current one, changes nothing and is logged as blocked.

    A stretch of a key's requests turns each status it may begin with into one it ends with; these small maps are composed over the
    stretches, so a key with any number of requests is spread over tasks. Null statuses have no rule; an empty table gives an empty result.
    """
    allowed = frozenset(rules)
    names = sorted({s for pair in rules for s in pair} | {first})

    def summarise(run: pa.Table) -> dict[str, str]:
        ends = {s: s for s in names}
        for wanted, to in zip(run.column("from_status").to_pylist(), run.column("to_status").to_pylist(), strict=True):
            after = {s: step(allowed, s, wanted, to)[0] for s in set(ends.values())}
            ends = {s: after[e] for s, e in ends.items()}
        return ends

    def replay(run: pa.Table, state: str) -> pa.Table:
        before, after, reasons = [], [], []
        for wanted, to in zip(run.column("from_status").to_pylist(), run.column("to_status").to_pylist(), strict=True):
            before.append(state)
            state, why = step(allowed, state, wanted, to)
            after.append(state)
            reasons.append(why)
        code = [BLOCKED if r else CHANGED for r in reasons]
        cols = {"before": before, "after": after, "event_code": code, "reason": reasons}
        for name, values in cols.items():
            run = run.append_column(name, pa.array(values, pa.string()))
        return run

    rows = requests.select(key, *order, "from_status", "to_status")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", before string, after string, event_code string, reason string"
    return ordered_fold(rows, key, order, summarise, lambda state, ends: ends[state], first, replay, schema)


def stream_transitions(requests: DataFrame, key: str, at: str, id_: str, rules: tuple[tuple[str, str], ...] = RULES, first: str = FIRST, late: str = "1 hour") -> DataFrame:
    """The same for a stream: (key, id, at, to_status, before, after, event_code, reason).

    A request waits in its key's state until the watermark, `late` behind the latest event time seen, has passed it; then a timer
    applies what waits in order of time and id. So requests may come in any order within that time, and the result is the batch
    one; later ones are dropped by the watermark. State and timers live in the checkpoint, and a restart goes on from there.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    allowed, kinds, name = frozenset(rules), dict(requests.dtypes), key

    class Applied(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.now = handle.getValueState("now", "status string")
            self.waiting = handle.getListState("waiting", "us long, id long, wanted string, to string")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            for f in rows:
                for us, i, wanted, to in zip(f["us"], f[id_], f["from_status"], f["to_status"], strict=True):
                    self.waiting.appendValue((int(us), int(i), wanted, to))
                    self.handle.registerTimer(int(us) // 1000 + 1)
            return iter(())

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            due = expiredTimerInfo.getExpiryTimeInMs() * 1000
            every = sorted(self.waiting.get())
            ready = [r for r in every if r[0] < due]
            if not ready:
                return
            rest = [r for r in every if r[0] >= due]
            self.waiting.put(rest) if rest else self.waiting.clear()
            state, out = (self.now.get()[0] if self.now.exists() else first), []
            for us, i, wanted, to in ready:
                before = state
                state, why = step(allowed, state, wanted, to)
                out.append((key[0], i, us, to, before, state, BLOCKED if why else CHANGED, why))
            self.now.update((state,))
            yield pd.DataFrame(out, columns=[name, id_, "us", "to_status", "before", "after", "event_code", "reason"])

        def close(self) -> None:
            pass

    rows = requests.withWatermark(at, late).select(key, id_, at, F.unix_micros(F.col(at).cast("timestamp")).alias("us"), "from_status", "to_status")
    schema = f"{key} {kinds[key]}, {id_} long, us long, to_status string, before string, after string, event_code string, reason string"
    return rows.groupBy(key).transformWithStateInPandas(Applied(), schema, "Append", "EventTime")
