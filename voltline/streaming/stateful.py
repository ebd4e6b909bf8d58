"""Sessions and first alerts of a stream with the full rules, by processors that keep state for each connector.

A row waits in a list state until the watermark has passed it, so rows are taken in the order that the batch operators see,
however late they arrive. Conditions on a single row are columns, evaluated before the rows reach Python; the
processors hold what depends on earlier rows. One event-time timer per connector wakes it for the next waiting row, the end of
the open session or the next deadline, so silence closes sessions and alerts without a new row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import constants as K
from ..functions import scalars as S
from ..operators.features import v2g
from ..operators.sessions import GAP_S, JOIN_NEXT_S
from .live import LATENESS, with_time

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST_WAITING, KEPT_WAITING = 200, 100

PLACE = {"us": "bigint", "t": "double", "seq": "bigint", "act": "boolean", "mark": "string"}
FLAGS = {
    "v2g": "boolean", "msg": "string", "base": "string", "suffix": "string", "named": "string", "ends": "boolean", "ongoing": "boolean", "finished": "boolean", "cable_ok": "boolean",
    "retx": "boolean", "rst": "boolean", "link": "boolean", "matched": "boolean", "slac": "boolean", "max_v": "double", "volts": "double", "family": "string", "said": "string",
}
CORE = "sid int, last double, mark string, open boolean, due bigint"
SESSION_OUT = "station string, connector string, sid int, n_events bigint, seq_sum bigint, t_start double, t_end double"
ALERT_OUT = "station string, connector string, sid int, detector string, t double, fault_guess string, reason string"


def _timed(events: DataFrame, lateness: str) -> DataFrame:
    return events if "ts" in events.columns else with_time(events).withWatermark("ts", lateness)


def _place() -> dict:
    mark = F.when((F.col("kind") == "v2g") & F.col("msg").isin("SessionStopReq", "SessionStopRes"), "S").when(S.is_opener(F.col("kind"), F.col("msg")), "O")
    return {"us": F.unix_micros("ts"), "t": F.col("t"), "seq": F.col("seq").cast("bigint"), "act": S.is_activity(F.col("kind"), F.col("msg")), "mark": mark}


def _flags() -> dict:
    """What the rules ask of a row alone."""
    msg, failed = F.col("msg"), S.is_failed(F.col("resp_code"))
    suffix = F.when(v2g(), S.msg_suffix(msg)).otherwise("")
    hpav, tcp = F.col("kind") == "hpav", F.col("kind") == "tcp"
    hard, isolated, ev = F.col("evse_status").isin("EVSE_Malfunction", "EVSE_EmergencyShutdown"), F.col("isolation") == "Fault", ~F.col("ev_err").isin("", "NO_ERROR")
    return {
        "v2g": v2g(), "msg": msg, "base": S.msg_base(msg), "suffix": suffix,
        "named": F.when(v2g(), S.phase_of(msg)).when(hpav & msg.contains("SLAC_PARM.REQ"), "slac"),
        "ends": (msg == "SessionStopRes") | failed,
        "ongoing": v2g() & (F.col("evse_processing") == "Ongoing"), "finished": v2g() & (F.col("evse_processing") == "Finished"),
        "cable_ok": v2g() & (msg == "CableCheckRes") & (S.rc_severity(F.col("resp_code")) == 0) & (F.col("evse_processing") == "Finished"),
        "retx": tcp & (msg != "RST"), "rst": tcp & (msg == "RST"), "link": hpav & msg.contains("LINK_STATUS") & msg.endswith("CNF"),
        "matched": hpav & msg.contains("SLAC_MATCH.CNF"), "slac": hpav & msg.contains("SLAC_PARM.REQ"),
        "max_v": F.col("ev_max_v"), "volts": F.col("evse_v"),
        "family": F.when(failed, "PROTOCOL_FAILED").when(hard, "EVSE_FAULT").when(isolated, "ISOLATION_FAULT").when(ev, "EV_ERROR"),
        "said": F.when(failed, F.concat(F.lit("ResponseCode "), "resp_code")).when(hard, F.col("evse_status")).when(isolated, F.lit("isolation Fault")).when(ev, F.concat(F.lit("EVErrorCode "), "ev_err")),
    }


class _Row:
    __slots__ = ("values",)
    names: dict[str, int] = {n: i for i, n in enumerate([*PLACE, *FLAGS])}

    def __init__(self, values: tuple):
        self.values = values

    def __getattr__(self, name: str):
        return self.values[_Row.names[name]]


class SessionProcessor(StatefulProcessor):
    """Numbers the sessions of a connector as ``operators.sessions.sessionize`` does and emits each when it is closed."""

    columns = PLACE
    body_schema = "n_events bigint, seq_sum bigint, t_start double, t_end double"
    out = SESSION_OUT

    def __init__(self, gap_s: float = GAP_S, join_next_s: float = JOIN_NEXT_S):
        self.gap_s, self.join_next_s = gap_s, join_next_s

    # ------------------------------------------------ what happens in a session

    def begin(self) -> None:
        self.body = [0, 0, None, None]

    def take(self, r: _Row) -> None:
        n, total, start, _ = self.body
        self.body = [n + 1, total + r.seq, r.t if start is None else start, r.t]

    def until(self, t: float) -> None:
        """Nothing but time has passed, up to ``t``."""

    def finish(self) -> None:
        self.found.append((*self.key, self.sid, *self.body))

    def deadline(self) -> float | None:
        """The next time at which ``until`` has something to say."""
        return None

    # ------------------------------------------------ state

    def init(self, handle) -> None:
        self.handle = handle
        row = ", ".join(f"{n} {t}" for n, t in self.columns.items())
        self.ahead, self.waiting = handle.getListState("ahead", row), handle.getListState("waiting", row)
        self.core, self.stored = handle.getValueState("core", CORE), handle.getValueState("body", self.body_schema)

    def close(self) -> None:
        pass

    def _load(self) -> None:
        self.sid, self.last, self.mark, self.open, self.due = tuple(self.core.get()) if self.core.exists() else (-1, None, None, False, None)
        self.body = list(self.stored.get()) if self.open and self.stored.exists() else None

    def _save(self) -> None:
        self.core.update((self.sid, self.last, self.mark, self.open, self.due))
        if self.open:
            self.stored.update(tuple(self.body))

    def _wake(self, us: int) -> None:
        """One timer: at the first millisecond after ``us``, unless it is set earlier."""
        ms = us // 1000 + 1
        if self.due is not None and self.due <= ms:
            return
        if self.due is not None:
            self.handle.deleteTimer(self.due)
        self.handle.registerTimer(ms)
        self.due = ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            frame = frame[list(self.columns)].astype(object)
            new += frame.where(frame.notna(), None).itertuples(index=False, name=None)
        self.ahead.appendList(new)
        self._load()
        self._wake(min(r[0] for r in new))
        self._save()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.key, self.found = key, []
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self._load()
        self.due = None
        rows = [tuple(r) for r in self.ahead.get()] if self.ahead.exists() else []
        later = [r for r in rows if r[0] > passed]
        quiet = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        before = len(quiet)
        for values in sorted((r for r in rows if r[0] <= passed), key=lambda r: r[1:3]):
            quiet = self._row(_Row(values), quiet)
        if self.open:
            self.until(min(passed / 1e6, self.last + self.gap_s))
            if (self.last + self.gap_s) * 1e6 < passed:
                self.finish()
                self.open = False
        for state, now, was in ((self.ahead, later, len(rows)), (self.waiting, quiet, before)):
            if now:
                state.put(now)
            elif was:
                state.clear()
        ahead = [r[0] for r in later]
        if self.open:
            ahead.append(math.ceil((self.last + self.gap_s) * 1e6))
            if (at := self.deadline()) is not None:
                ahead.append(max(math.ceil(at * 1e6), passed))
        if ahead:
            self._wake(min(ahead))
        self._save()
        if self.found:
            yield pd.DataFrame(self.found, columns=[c.split()[0] for c in self.out.split(", ")])

    def _row(self, r: _Row, quiet: list[tuple]) -> list[tuple]:
        """Take one row in order; returns the quiet rows that wait for the next session."""
        if not r.act:
            if self.last is not None and r.t - self.last <= self.gap_s:
                self.take(r)
                return quiet
            quiet.append(r.values)
            return quiet if len(quiet) <= MOST_WAITING else quiet[-KEPT_WAITING:]
        gap = self.last is None or r.t - self.last > self.gap_s
        if gap or (r.mark == "O" and self.mark == "S"):
            if self.open:
                self.until(self.last + self.gap_s if gap else r.t)
                self.finish()
            self.sid, self.open = self.sid + 1, True
            self.begin()
            for waited in map(_Row, quiet):
                if r.t - waited.t <= self.join_next_s:
                    self.take(waited)
        self.take(r)
        self.last = r.t
        self.mark = r.mark if r.mark is not None else "" if gap else self.mark
        return []


class UpdateProcessor(SessionProcessor):
    """Emits a session each time that the watermark has passed more of its rows, so a keyed table of its output is the table of sessions so far."""

    def begin(self) -> None:
        super().begin()
        self.touched = True

    def take(self, r: _Row) -> None:
        super().take(r)
        self.touched = True

    def finish(self) -> None:
        if self.touched:
            super().finish()
        self.touched = False

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.touched = False
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def deadline(self) -> float | None:
        """Asked when all rows of a wake-up are taken: what the open session is by now goes out."""
        if self.touched:
            super().finish()
        return None


class AlertProcessor(SessionProcessor):
    """The first alert of each session by the limits of ``spec_rules`` and the criteria and timers of ``conformance_rules``.

    Requests that wait for an answer are a map state by message, retransmissions of the last minute a list state. With ``timers`` a deadline
    that passes in silence alerts at the deadline; without, at the next row of the session, as in the batch operators.
    """

    columns = PLACE | FLAGS
    body_schema = """phase string, v2g_t double, cable_t double, max_v double, rst boolean, link_t double, n_slac int, dialog int, marker string, owed double,
    going double, matched_t double, dialog_t double, setup_t double, c0 double, c1 double, spec boolean, conformance boolean"""
    names = [c.split()[0] for c in body_schema.replace("\n", " ").split(", ")]
    out = ALERT_OUT
    DETECTORS = ("Spec", "Conformance")

    def __init__(self, timers: bool = True, **limits):
        super().__init__(**limits)
        self.timers = timers

    def init(self, handle) -> None:
        super().init(handle)
        self.requests, self.retx = handle.getMapState("requests", "base string", "at double"), handle.getListState("retx", "t double")

    def _load(self) -> None:
        super()._load()
        self.s = dict(zip(self.names, self.body)) if self.open else {}
        self.asked = {k[0]: v[0] for k, v in self.requests.iterator()} if self.open else {}
        self.again = [x[0] for x in self.retx.get()] if self.open and self.retx.exists() else []
        self.had = (dict(self.asked), list(self.again))

    def _save(self) -> None:
        if self.open:
            self.body = [self.s[n] for n in self.names]
        if self.asked != self.had[0]:
            self.requests.clear()
            for base, at in self.asked.items():
                self.requests.updateValue((base,), (at,))
        if self.again != self.had[1]:
            self.retx.clear()
            if self.again:
                self.retx.put([(t,) for t in self.again])
        super()._save()

    def begin(self) -> None:
        self.s = dict.fromkeys(self.names) | {"phase": "idle", "rst": False, "n_slac": 0, "dialog": 0, "spec": False, "conformance": False}
        self.asked, self.again = {}, []

    def finish(self) -> None:
        self.asked, self.again = {}, []

    def _say(self, detector: str, t: float, family: str, reason: str) -> None:
        name = detector.lower()
        if not self.s[name]:
            self.s[name] = True
            self.found.append((*self.key, self.sid, detector, t, family, reason))

    # ------------------------------------------------ deadlines

    def _deadlines(self) -> list[tuple[float, str, str, str]]:
        """(time, detector, family, reason) of what would alert if no row came."""
        s, out = self.s, []
        if not s["spec"]:
            if s["phase"] == "cablecheck" and s["cable_t"] is not None:
                out.append((s["cable_t"] + K.CABLECHECK_TIMEOUT_S, "Spec", "COMM_FREEZE", "CableCheck > 40s (spec)"))
            if s["phase"] != "idle" and s["link_t"] is not None:
                out.append((s["link_t"] + 3.0, "Spec", "SESSION_ABORT", "PLC link silent 3.0s"))
        if not s["conformance"]:
            if s["going"] is not None:
                out.append((s["going"] + K.ONGOING_PERFORMANCE_S, "Conformance", "COMM_FREEZE", "[V2G2-711] EVSEProcessing Ongoing"))
            if s["owed"] is not None:
                out.append((s["owed"] + K.SEQ_TIMEOUT_S, "Conformance", "COMM_FREEZE", "[V2G2-443] no request for 60s"))
            if s["dialog"] and s["setup_t"] is None:
                out.append((self._ready() + K.COMM_SETUP_TIMEOUT_S, "Conformance", "SESSION_ABORT", "[V2G2-448] no SessionSetupRes within 20s of link-up"))
            if s["c0"] is not None and s["c1"] is None:
                out.append((s["c0"] + K.CABLECHECK_TIMEOUT_S, "Conformance", "COMM_FREEZE", "[V2G2-702] CableCheck 40s"))
            out += [(at + K.MSG_TIMEOUT_S[f"{base}Req"], "Conformance", "COMM_FREEZE", f"Table 109: {base}Req unanswered") for base, at in self.asked.items()]
        return sorted(out)

    def _ready(self) -> float:
        return max(x for x in (self.s["matched_t"], self.s["dialog_t"]) if x is not None)

    def deadline(self) -> float | None:
        return min((d[0] for d in self._deadlines()), default=None) if self.timers else None

    def until(self, t: float) -> None:
        if self.timers:
            for at, *alert in self._deadlines():
                if at < t:
                    self._say(alert[0], at, *alert[1:])

    # ------------------------------------------------ rows

    def take(self, r: _Row) -> None:
        self.until(r.t)
        s = self.s
        if r.family is not None:
            self._say("Spec", r.t, r.family, f"rule: {r.said}")
            self._say("Conformance", r.t, r.family, f"ISO: {r.said}")
        if not s["spec"]:
            self._limits(r)
        if not s["conformance"]:
            self._criteria(r)

    def _limits(self, r: _Row) -> None:
        s, t = self.s, r.t
        s["phase"] = r.named or s["phase"]
        silent = t - s["v2g_t"] if r.v2g and s["v2g_t"] is not None else None
        if r.v2g:
            s["v2g_t"] = t
            if r.msg == "CableCheckReq" and s["cable_t"] is None:
                s["cable_t"] = t
            s["max_v"] = r.max_v if r.max_v is not None else s["max_v"]
        if r.retx:
            self.again.append(t)
        self.again = [x for x in self.again if x >= t - 60]
        s["rst"] = s["rst"] or bool(r.rst)
        s["link_t"] = t if r.link else s["link_t"]
        s["n_slac"] += bool(r.slac)
        phase, most = s["phase"], r.max_v if r.max_v is not None else s["max_v"]
        if phase == "cablecheck" and s["cable_t"] is not None and t - s["cable_t"] > 40:
            self._say("Spec", t, "COMM_FREEZE", "rule: CableCheck > 40s (spec)")
        elif phase == "delivery" and silent is not None and silent > 3.5:
            self._say("Spec", t, "COMM_FREEZE", f"rule: msg gap {silent:.1f}s in delivery")
        elif most and r.volts is not None and r.volts > most * 1.02:
            self._say("Spec", t, "EVSE_FAULT", "rule: V above EV max limit")
        elif len(self.again) > 60:
            self._say("Spec", t, "SESSION_ABORT", f"rule: {len(self.again)} retx/60s")
        elif phase != "idle" and s["link_t"] is not None and t - s["link_t"] > 3:
            self._say("Spec", t, "SESSION_ABORT", f"rule: PLC link silent {t - s['link_t']:.1f}s")
        elif s["n_slac"] >= 3:
            self._say("Spec", t, "SLAC_FAILURE", "rule: 3+ SLAC attempts")
        elif s["rst"] and phase in ("delivery", "cablecheck", "precharge"):
            self._say("Spec", t, "SESSION_ABORT", "rule: TCP RST mid-session")

    def _criteria(self, r: _Row) -> None:
        s, t = self.s, r.t
        s["matched_t"] = t if r.matched else s["matched_t"]
        answered = None
        if r.v2g:
            if r.msg == "supportedAppProtocolReq" or (r.msg == "SessionSetupReq" and s["marker"] != "supportedAppProtocolRes"):
                s |= {"dialog": s["dialog"] + 1, "dialog_t": t, "owed": None, "going": None, "setup_t": None, "c0": None, "c1": None}
                self.asked = {}
            if r.suffix == "Req":
                s["owed"] = None
                if f"{r.base}Req" in K.MSG_TIMEOUT_S:
                    self.asked[r.base] = t
            elif r.suffix == "Res":
                s["owed"] = None if r.ends else t
                sent = self.asked.pop(r.base, None)
                answered = (t - sent) / K.MSG_TIMEOUT_S[f"{r.base}Req"] if sent is not None else None
                if r.msg == "SessionSetupRes" and s["setup_t"] is None:
                    s["setup_t"] = t
            if r.suffix == "Res" or r.msg == "supportedAppProtocolReq":
                s["marker"] = r.msg
            if r.finished or (r.suffix == "Res" and r.ends):
                s["going"] = None
            if r.ongoing and s["going"] is None:
                s["going"] = t
            if r.msg == "CableCheckReq" and s["c0"] is None:
                s["c0"] = t
            if s["c1"] is None and (r.cable_ok or (r.msg == "PreChargeReq" and s["c0"] is not None)):
                s["c1"] = t
        worst = max([(t - at) / K.MSG_TIMEOUT_S[f"{base}Req"] for base, at in self.asked.items()] + ([answered] if answered is not None else []), default=0.0)
        if s["going"] is not None and t - s["going"] >= K.ONGOING_PERFORMANCE_S:
            self._say("Conformance", t, "COMM_FREEZE", f"[V2G2-711] EVSEProcessing Ongoing {t - s['going']:.0f}s (timeout 60s)")
        elif s["owed"] is not None and t - s["owed"] >= K.SEQ_TIMEOUT_S:
            self._say("Conformance", t, "COMM_FREEZE", f"[V2G2-443] no request for {t - s['owed']:.0f}s (V2G_SECC_Sequence_Timeout 60s)")
        elif s["dialog"] and (s["setup_t"] if s["setup_t"] is not None else t) - self._ready() >= K.COMM_SETUP_TIMEOUT_S:
            self._say("Conformance", t, "SESSION_ABORT", "[V2G2-448] no SessionSetupRes within 20s of link-up")
        elif s["c0"] is not None and s["c1"] is None and t - s["c0"] >= K.CABLECHECK_TIMEOUT_S:
            self._say("Conformance", t, "COMM_FREEZE", f"[V2G2-702] CableCheck {t - s['c0']:.0f}s (timeout 40s)")
        elif s["dialog"] >= 2:
            self._say("Conformance", t, "SESSION_ABORT", f"ISO 8.8.1: dialog reopened {s['dialog'] - 1}x (previous session was terminated)")
        elif worst >= 1:
            self._say("Conformance", t, "COMM_FREEZE", f"Table 109: request unanswered for {worst:.1f}x its timeout")


def _run(events: DataFrame, processor: SessionProcessor, columns: dict, lateness: str) -> DataFrame:
    rows = _timed(events, lateness).withColumns({f"_{n}": c for n, c in columns.items()})
    rows = rows.select("station", "connector", "ts", *[F.col(f"_{n}").alias(n) for n in columns])
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the only store with list and map states and timers
    return rows.groupBy("station", "connector").transformWithStateInPandas(processor, outputStructType=processor.out, outputMode="append", timeMode="eventTime")


def closed_sessions(events: DataFrame, lateness: str = LATENESS, **limits) -> DataFrame:
    """(station, connector, sid, n_events, seq_sum, t_start, t_end) of a stream's sessions as they close.

    Dialogs that reopen split and quiet rows are carried as in ``sessionize``; sessions still open at the watermark are not there yet.
    """
    return _run(events, SessionProcessor(**limits), _place(), lateness)


def session_updates(events: DataFrame, lateness: str = LATENESS, **limits) -> DataFrame:
    """The same for open sessions too, each again whenever it has grown; a later row of a session replaces an earlier one."""
    return _run(events, UpdateProcessor(**limits), _place(), lateness)


def stream_alerts(events: DataFrame, lateness: str = LATENESS, timers: bool = True) -> DataFrame:
    """(station, connector, sid, detector, t, fault_guess, reason): first alerts of a stream's sessions by both detectors, once each."""
    return _run(events, AlertProcessor(timers), _place() | _flags(), lateness)
