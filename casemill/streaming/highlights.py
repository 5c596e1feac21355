"""The life of a highlight as keyed state with timers: sent, then answered, failed or timed out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a highlight without an answer in time shows.
TIMED_OUT = "Error: timed out"
#: Keys of the state: highlights are dealt to so many by a hash of their id, and a key's highlights are stepped side by side.
BUCKETS = 256
#: What is kept of a highlight: when it was sent and by whom, its best answer, its version, and when it is let go.
_OPEN = pa.schema([("highlight_id", pa.string()), ("sent", pa.int64()), ("user", pa.string()), ("at", pa.int64()), ("answer", pa.string()), ("version", pa.int32()), ("until", pa.int64())])
_STATE = "open binary"
#: Times that stand for "not sent yet" and "not answered yet".
_UNSENT, _UNANSWERED = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: Rows as the step gives them: -1 and false stand for what is not there.
_OUT = "highlight_id string, user_id string, has_user boolean, sent_ms long, summary string, answered boolean, answered_ms long, version int"


def _packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _OPEN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.Table.from_pandas(held, _OPEN, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(state: GroupState) -> pd.DataFrame:
    if not state.exists:
        return _OPEN.empty_table().to_pandas()
    return pa.ipc.open_stream(state.get[0]).read_all().to_pandas()


def _in_time(held: pd.DataFrame, span: int) -> pd.Series:
    """Whether the best answer is one, and not later than the limit behind the sending."""
    sent = held["sent"] != _UNSENT
    return sent & (held["at"] != _UNANSWERED) & (held["at"] <= held["sent"].where(sent, 0) + span)


def _shown(held: pd.DataFrame, answered: pd.Series, summary: pd.Series, at: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({
        "highlight_id": held["highlight_id"], "user_id": held["user"].fillna(""), "has_user": held["user"].notna(), "sent_ms": held["sent"],
        "summary": summary.where(answered, ""), "answered": answered, "answered_ms": at, "version": held["version"],
    })


def _stepped(held: pd.DataFrame, rows: pd.DataFrame, mark: int, span: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The highlights that ``rows`` name, as they are then, and a row for each that changed; ``held`` has those that are open."""
    codes, names = pd.factorize(rows["highlight_id"])
    rows = rows.assign(code=codes)
    place = pd.Index(held["highlight_id"]).get_indexer(names)
    known = place >= 0

    def old(column: str, missing: object) -> pd.Series:
        taken = held[column].to_numpy()[place[known]]
        values = np.full(len(names), missing, object if held[column].dtype == object or missing is None else taken.dtype)
        values[known] = taken
        return pd.Series(values)

    now = pd.DataFrame({"highlight_id": names, "sent": old("sent", _UNSENT), "user": old("user", None), "at": old("at", _UNANSWERED), "answer": old("answer", None), "version": old("version", 0), "until": old("until", 0)})
    was = _in_time(now, span)
    before = (now["sent"].copy(), now["at"].where(was, _UNANSWERED), now["answer"].where(was, ""))

    # of the sendings the earliest counts, of equals that of the smaller user
    first = rows[rows["kind"] == "sent"].sort_values(["code", "ms", "user_id"]).drop_duplicates("code")
    first = first[first["ms"].to_numpy() < now["sent"].to_numpy()[first["code"]]]
    now.loc[first["code"], "sent"], now.loc[first["code"], "user"] = first["ms"].to_numpy(), first["user_id"].to_numpy()

    # of the answers in time the latest, of equals the larger text, the one that is held among them
    sent = now["sent"] != _UNSENT
    now.loc[sent & ~_in_time(now, span), "at"] = _UNANSWERED
    last = rows[rows["kind"].isin(["summary", "failed"])]
    last = last.assign(answer=np.where(last["kind"] == "failed", "Error: ", "") + last["text"].fillna("").astype(object))
    limit = now["sent"].where(sent, _UNSENT - span) + span
    last = last[last["ms"].to_numpy() <= limit.to_numpy()[last["code"]]]
    stands = now[now["at"] != _UNANSWERED]
    every = pd.concat([last[["code", "ms", "answer"]], pd.DataFrame({"code": stands.index, "ms": stands["at"], "answer": stands["answer"]})])
    best = every.sort_values(["code", "ms", "answer"]).drop_duplicates("code", keep="last")
    now.loc[best["code"], "at"], now.loc[best["code"], "answer"] = best["ms"].to_numpy(), best["answer"].to_numpy()

    waits = now["until"].where(known, rows.groupby("code")["ms"].min() + span)
    now["until"] = (now["sent"].where(sent, 0) + span).where(sent, waits).clip(lower=mark + 1)
    timely = _in_time(now, span)
    at, answer = now["at"].where(timely, _UNANSWERED), now["answer"].where(timely, "")
    changed = sent & ((now["sent"] != before[0]) | (at != before[1]) | (answer != before[2]))
    now["version"] += changed.astype(now["version"].dtype)
    return now, _shown(now, timely, answer, at.where(timely, -1))[changed]


def lifecycle(events: DataFrame, limit: str = "10 minutes", delay: str = "5 minutes", buckets: int = BUCKETS) -> DataFrame:
    """highlight_id, user_id, sent_at, summarization, summarized_at, version: a row for every change of a highlight; the last version counts.

    ``events`` is a stream of (highlight_id, user_id, kind, text, ts): ``sent`` inserts a highlight without a summary (the earliest
    one counts), ``summary`` and ``failed`` answer it. Of the answers not later than ``limit`` after the sending the latest counts, of
    equals the larger text; an answer that comes before its highlight waits for it. A highlight that has none when the
    watermark (``delay`` behind the latest event) passes the limit times out. State is kept until then and no longer: what comes
    later is late and dropped, and answers without a highlight go. Repeated events change nothing. Events without an id, a kind
    or a time are left out.

    Highlights are dealt to ``buckets`` keys of the state, each with one table of its open highlights and one timer, that of the first
    to be let go; a run goes on with the number that it began with. A task holds one key's events of a batch and its open highlights.
    """
    span = int(pd.Timedelta(limit).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, mark, shown, kept = _unpacked(state), state.getCurrentWatermarkMs(), [], []
        if not state.hasTimedOut:
            rows = pd.concat([batch[["highlight_id", "user_id", "kind", "text", "ms"]].drop_duplicates() for batch in batches], ignore_index=True)
            now, changed = _stepped(held, rows, mark, span)
            held = held[~held["highlight_id"].isin(now["highlight_id"])]
            kept.append(now)
            shown.append(changed)
        gone = held["until"] < mark
        kept.append(held[~gone])
        left = held[gone & (held["sent"] != _UNSENT) & ~_in_time(held, span)]
        left = left.assign(version=left["version"] + 1)
        shown.append(_shown(left, left["sent"].notna(), pd.Series(TIMED_OUT, left.index, object), pd.Series(-1, left.index)))
        still = pd.concat([frame for frame in kept if len(frame)] or kept, ignore_index=True)
        if len(still):
            state.update((_packed(still),))
            state.setTimeoutTimestamp(max(int(still["until"].min()), mark, 1))
        else:
            state.remove()
        yield from (frame for frame in shown if len(frame))

    whole = events.where("highlight_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL").select(F.col("highlight_id").cast("string").alias("highlight_id"), F.col("user_id").cast("string").alias("user_id"), "kind", "text", "ts", F.unix_millis("ts").alias("ms"))
    dealt = whole.withColumn("bucket", F.pmod(F.xxhash64("highlight_id"), F.lit(buckets)))
    rows = dealt.withWatermark("ts", delay).groupBy("bucket").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return rows.select(
        "highlight_id", F.when(F.col("has_user"), F.col("user_id")).alias("user_id"), F.timestamp_millis("sent_ms").alias("sent_at"), F.when(F.col("answered"), F.col("summary")).alias("summarization"),
        F.when(F.col("answered_ms") >= 0, F.timestamp_millis("answered_ms")).alias("summarized_at"), "version",
    )
