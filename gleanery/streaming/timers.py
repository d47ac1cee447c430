"""Timed tasks that close by themselves: a student opens one, and it ends when it is handed in or when its time is up.

State is a key's events that the watermark hasn't passed, and the open task. A timer stands on the next thing that can happen, an event or
the end of the open task; when the watermark passes it, events are taken in order of time, however they came, and a task whose time is up
is closed with no further event.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that a task folds at once.
AT_ONCE = 1 << 20
HANDED_IN, TIME_UP = "handed_in", "time_up"


class _Closing(StatefulProcessor):
    def __init__(self, key: str, limit_ms: int):
        self.key, self.limit = key, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, id long, opens boolean")
        self.open = handle.getValueState("open", "since long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        first = None
        for batch in rows:
            events = list(zip(batch["t"].tolist(), batch["id"].tolist(), batch["opens"].tolist(), strict=True))
            self.waiting.appendList(events)
            first = min([t for t, _, _ in events] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        events = sorted(tuple(x) for x in self.waiting.get())
        since = self.open.get()[0] if self.open.exists() else None
        closed = []

        def up_to(t: int) -> None:
            nonlocal since
            if since is not None and since + self.limit <= t:
                closed.append((since, since + self.limit, TIME_UP))
                since = None

        for t, _, opens in (e for e in events if e[0] <= now):
            up_to(t)
            if opens and since is None:
                since = t
            elif not opens and since is not None:
                closed.append((since, t, HANDED_IN))
                since = None
        up_to(now)
        rest = [e for e in events if e[0] > now]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if since is None:
            self.open.clear()
        else:
            self.open.update((since,))
        ahead = [t for t, _, _ in rest[:1]] + ([] if since is None else [since + self.limit])
        if ahead:
            self.handle.registerTimer(min(ahead))
        if closed:
            yield pd.DataFrame({self.key: key[0], "opened": [a for a, _, _ in closed], "closed": [b for _, b, _ in closed], "how": [h for _, _, h in closed]})

    def close(self) -> None:
        pass


def closed_tasks(events: DataFrame, key: str, seconds: int, event_id: str = "event_id", opens: str = "opens", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, opened, closed, how) in milliseconds: each task's end. events: opens tells what opens a task (if none is open) from what hands
    the open one in. The session must keep state in RocksDB (``ROCKS``)."""
    kind = dict(events.dtypes)[key]
    rows = events.withWatermark(ts, late).select(key, ts, F.unix_millis(ts).alias("t"), F.col(event_id).cast("long").alias("id"), F.col(opens).alias("opens"))
    return rows.groupBy(key).transformWithStateInPandas(
        _Closing(key, 1000 * seconds), f"{key} {kind}, opened long, closed long, how string", "Append", "EventTime"
    )


class _Cutoffs(StatefulProcessor):
    """State is a key's lines and times as rows of packed numbers, one for each that ``_packed`` made: what a row costs is the way to the store
    and back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "packed binary")
        self.times = handle.getListState("times", "packed binary")
        self.closed = handle.getValueState("closed", "at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        import numpy as np

        open_ = not self.closed.exists()
        for batch in rows:
            if "t" in batch:  # rows as they come, not folded before
                line = batch["cutoff"].notna()
                found = batch[line][["t", "due", "cutoff"]].to_numpy(np.int64), batch[~line]["t"].to_numpy(np.int64)
                lines, times = ([(x.tobytes(),)] if len(x) else [] for x in found)
            else:
                lines, times = ([(bytes(x),) for x in batch[c] if x is not None] for c in ("lines", "times"))
            if open_ and lines:
                self.lines.appendList(lines)
                first = min(int(np.frombuffer(x, np.int64).reshape(-1, 3)[:, 2].min()) for x, in lines)
                self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
            if open_ and times:
                self.times.appendList(times)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        import numpy as np
        import pandas as pd

        if self.closed.exists():
            return
        lines = np.concatenate([np.frombuffer(x, np.int64) for x, in self.lines.get()]).reshape(-1, 3)
        lines = lines[np.lexsort(lines.T[::-1])]
        # the first cutoff that no later line came in time to move
        final = np.append(lines[1:, 0] > lines[:-1, 2], True)
        _, due, cutoff = (int(x) for x in lines[np.argmax(final)])
        if cutoff > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(cutoff)
            return
        on_time = late = 0
        for (packed,) in self.times.get():
            t = np.frombuffer(packed, np.int64)
            on_time += int((t <= due).sum())
            late += int(((due < t) & (t <= cutoff)).sum())
        self.closed.update((cutoff,))
        self.lines.clear()
        self.times.clear()
        yield pd.DataFrame({"key": [key[0]], "due": [due], "cutoff": [cutoff], "on_time": [on_time], "late": [late]})

    def close(self) -> None:
        pass


def _packed(rows: DataFrame, parts: int, kind: str) -> DataFrame:
    """(key, part, ts, lines, times) of rows (key, part, ts, t, due, cutoff): up to AT_ONCE rows of a task folded into one for each key and part,
    its times as packed numbers, and one for each key's lines, in every part. ts is the latest of what was folded."""
    import numpy as np
    import pyarrow as pa

    def folded(held: list) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.filter(table["t"].is_valid())
        if not table.num_rows:
            return
        keys = table["key"].combine_chunks().dictionary_encode(null_encoding="encode")
        line, t = table["cutoff"].is_valid().to_numpy(), table["t"].to_numpy()
        three = np.stack([t, *(table[c].fill_null(0).to_numpy() for c in ("due", "cutoff"))], axis=1)
        group = keys.indices.to_numpy().astype(np.int64) * (parts + 1) + np.where(line, parts, table["part"].to_numpy())
        order = np.lexsort((t, group))
        begin = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
        latest, code, part, lines, times = [], [], [], [], []
        for own in np.split(order, begin[1:]):
            at, mine = divmod(int(group[own[0]]), parts + 1)
            to = range(parts) if mine == parts else [mine]
            latest += [own[-1]] * len(to)
            code += [at] * len(to)
            part += to
            lines += [three[own].tobytes() if mine == parts else None] * len(to)
            times += [None if mine == parts else t[own].tobytes()] * len(to)
        columns = [keys.dictionary.take(pa.array(code)), pa.array(part, pa.int32()), table["ts"].combine_chunks().take(pa.array(latest)), pa.array(lines, pa.binary()), pa.array(times, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "part", "ts", "lines", "times"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                yield from folded(held)
                held, n = [], 0
        if held:
            yield from folded(held)

    return rows.mapInArrow(pack, f"key {kind}, part int, ts timestamp, lines binary, times binary")


def cut_off(rows: DataFrame, key: str, event_id: str = "event_id", ts: str = "ts", late: str = "1 hour", parts: int = 8) -> DataFrame:
    """(key, due, cutoff, on_time, late) of each assignment once its own cutoff has passed, in up to ``parts`` rows that add up.

    rows: a stream of submissions, and of lines, which carry due and cutoff (milliseconds) and hold from their own time on; a line that comes
    before the cutoff moves it. Submissions are held until then, so one that comes late counts as long as its own assignment is open,
    whatever others' cutoffs are. An assignment's submissions are dealt into parts by their id and lines go to all of them, so that one
    with a third of all rows isn't one task. What a task reads is folded first (``_packed``); a row behind the watermark that is folded with
    later ones is held like these. The session must keep state in RocksDB (``ROCKS``).
    """
    kind = dict(rows.dtypes)[key]
    dealt = rows.select(
        F.col(key).alias("key"), F.pmod(F.xxhash64(event_id), F.lit(parts)).cast("int").alias("part"), F.col(ts).alias("ts"),
        F.unix_millis(ts).alias("t"), F.col("due").cast("long").alias("due"), F.col("cutoff").cast("long").alias("cutoff")
    )
    found = _packed(dealt, parts, kind).withWatermark("ts", late).groupBy("key", "part").transformWithStateInPandas(
        _Cutoffs(), f"key {kind}, due long, cutoff long, on_time long, late long", "Append", "EventTime"
    )
    return found.withColumnRenamed("key", key)
