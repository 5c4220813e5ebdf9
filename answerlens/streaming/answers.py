"""Answer streams: the hold-back of the no-answer mark as a stateful operator, and windowed metrics over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from answerlens.functions.text import NO_ANSWER

OUT = "request_id string, seq long, event string, payload string, prompt_tokens long, completion_tokens long"
STATE = "next long, text string, held boolean, waiting string, prompt_tokens long, completion_tokens long"


def hold_back(deltas: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """Events of each request from deltas (request_id, seq, text, prompt_tokens, completion_tokens, ended).

    While the text so far may still become the no-answer mark nothing is shown; then the whole buffer is, and later
    deltas as they come. Deltas out of order wait in the state for those before them. The end, or `idle_ms` without a
    delta, gives one 'done' with the status.
    """
    import json

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, text, held, waiting, used, made = state.get if state.exists else (0, "", True, "{}", None, None)
        rows, queue = [], {int(k): v for k, v in json.loads(waiting).items()}
        done = state.hasTimedOut
        if not done:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    queue[int(r.seq)] = [None if pd.isna(r.text) else r.text, bool(r.ended)]
                    used = used if pd.isna(r.prompt_tokens) else int(r.prompt_tokens)
                    made = made if pd.isna(r.completion_tokens) else int(r.completion_tokens)
            while nxt in queue:
                part, ended = queue.pop(nxt)
                if part:
                    text += part
                    if not NO_ANSWER.startswith(text.strip()):
                        rows.append((key[0], nxt, "delta", text if held else part, None, None))
                        held = False
                done = done or ended
                nxt += 1
        if done:
            status = "insufficient_context" if NO_ANSWER in text else "answered"
            rows.append((key[0], nxt, "done", json.dumps({"status": status, "answer": text}, ensure_ascii=False), used, made))
            state.remove()
        else:
            state.update((nxt, text, held, json.dumps(queue), used, made))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    return deltas.groupBy("request_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed(events: DataFrame, ts: str, value: str, by: list[str], width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(window_start, window_end, by, n, total, mean) of tumbling or sliding windows; the same on streams, with `late` as
    the watermark."""
    rows = events.withWatermark(ts, late) if late else events
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total", "mean")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str | None = None) -> DataFrame:
    """(session_start, session_end, by, n) of sessions that end after `gap` without an event."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
