"""Review sessions as keyed state: rows come in any number of batches, and a session ends by decision or by silence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import row_key

#: What a stream of review events has; `event` is append, finalize or discard, and only append has a row.
EVENTS = (
    "session_id string, profile_id long, event string, ord long, at timestamp, title string, accession_number string, "
    "study_date date, study_time string, route string, duplicate_status string"
)
OUT = "session_id string, kind string, ord long, route string, duplicate_status string, status string, rows long, skipped long, at timestamp"
STATE = "status string, keys array<string>, rows long, skipped long, last timestamp"
#: Why a row is skipped that its session has already.
REPEATED = "very_likely"


def sessions(events: DataFrame, silence: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Rows as they are routed, and a line for each session that changed.

    A row whose key its session has already is skipped as a very likely duplicate. Rows after the end of a session
    begin a new one under its id. A session without events for `silence` (by the events' own time) expires. Kinds of
    lines: row (ord, route, duplicate_status) and session (status, rows, skipped). In a batch a session's events go
    by `ord`. State is a digest for each row of an open session; what ends is forgotten.
    """
    keyed = events.withWatermark("at", late).withColumn("key", F.md5(row_key().cast("binary")))
    own = keyed.select("session_id", "event", "ord", "at", "key", "route", "duplicate_status")

    def line(session: str, status: str, rows: int, skipped: int, at) -> dict:
        return {"session_id": session, "kind": "session", "status": status, "rows": rows, "skipped": skipped, "at": at}

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, out = key[0], []
        status, keys, rows, skipped, last = state.get if state.exists else ("active", [], 0, 0, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([line(session, "expired", rows, skipped, last)], columns=columns)
            return
        known = set(keys)
        came = pd.concat(list(batches)).sort_values(["ord", "at"], kind="stable")
        for e in came.itertuples(index=False):
            last = e.at if last is None else max(last, e.at)
            if e.event != "append":
                out.append(line(session, {"finalize": "finalized", "discard": "discarded"}[e.event], rows, skipped, e.at))
                status, rows, skipped = "active", 0, 0
                known.clear()
                continue
            repeated = e.key in known
            known.add(e.key)
            rows, skipped = rows + 1, skipped + (repeated or e.route == "skipped")
            route, why = ("skipped", e.duplicate_status or REPEATED) if repeated else (e.route, e.duplicate_status)
            out.append({"session_id": session, "kind": "row", "ord": e.ord, "route": route, "duplicate_status": why, "at": e.at})
        if rows:
            state.update((status, sorted(known), rows, skipped, last))
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + wait)
            out.append(line(session, status, rows, skipped, last))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    columns = [c.split()[0] for c in OUT.split(", ")]
    wait = int(pd.Timedelta(silence).total_seconds() * 1000)
    return own.groupBy("session_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
