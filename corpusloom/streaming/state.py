"""Keyed streaming state with event-time timers: shared requests, progress, seen films, activity sessions.

Rows are reduced inside their Arrow batch before they are shuffled, so a key that holds a third of all rows sends its
state a few partial rows a batch. Each processor answers per micro-batch and drops what the watermark has passed.
What arrives after its state is gone is not lost: it comes out as rows of the kind `late`, partial as it is, for the
caller to count and to merge. Times are microseconds; a watermark of `ms` has passed everything up to `ms` * 1000.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _ms(us: int) -> int:
    """The first watermark that has passed `us`."""
    return -(-us // 1000)


def _mark(timers) -> int:
    return timers.getCurrentWatermarkInMs() * 1000


def _columns(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


class Sliced(StatefulProcessor):
    """Keys are dealt to `SLICES` states, each read and written once a batch: a state call costs more than a key's work.

    A subclass takes a batch's rows, which begin with their key as text, into `held`, a dict of plain values by key,
    and says until when, in microseconds, a value is held. A slice has one timer, for the value that goes next.
    """

    SLICES = 1_024
    # Key columns that the rows carry as numbers too.
    CARRIED: tuple[str, ...] = ()
    # The columns of a row, key first; set by who runs the stream.
    columns: list[str]

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "held binary, timer long")

    def take(self, held: dict, rows: Iterator[tuple], mark: int) -> list[tuple]:
        raise NotImplementedError

    def until(self, value) -> int:
        raise NotImplementedError

    def expire(self, held: dict, mark: int) -> list[tuple]:
        for key in [k for k, v in held.items() if self.until(v) <= mark]:
            del held[key]
        return []

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            columns = ["key", *(c.split()[0] for c in self.SCHEMA.split(", "))]
            yield pd.DataFrame(dict(zip(columns, map(list, zip(*out)))))

    def _keep(self, held: dict, timer: int | None, mark: int) -> None:
        """A timer that the watermark has passed fires after this batch's rows and is set anew then."""
        if timer is None or timer * 1000 > mark:
            due = min((_ms(self.until(v)) for v in held.values()), default=None)
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if due is not None:
                    self.handle.registerTimer(due)
                timer = due
        if timer is None:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(held), timer))

    def _held(self) -> tuple[dict, int | None]:
        found = self.state.get()
        return ({}, None) if found is None else (pickle.loads(bytes(found[0])), found[1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, (held, timer) = _mark(timerValues), self._held()
        each = (row for part in rows for row in zip(*(part[c].tolist() for c in self.columns)))
        out = self.take(held, each, mark)
        self._keep(held, timer, mark)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, (held, _) = _mark(timerValues), self._held()
        out = self.expire(held, mark)
        self._keep(held, None, mark)
        yield from self._frame(out)


class Shared(Sliced):
    """The first row of a key starts the work; others share it until the watermark is `span` microseconds past it."""

    SCHEMA = "kind string, us long"

    def __init__(self, names: list[str], span: int):
        super().__init__(names)
        self.span = span

    def until(self, value: int) -> int:
        return value + self.span

    def take(self, held, rows, mark):
        first, out = {}, []
        for key, us in rows:
            if us < first.get(key, us + 1):
                first[key] = us
        for key, us in first.items():
            # Timers fire after a batch's rows: what the watermark has passed counts as gone already.
            if key in held:
                if self.until(held[key]) > mark:
                    continue
                del held[key]
            late = us + self.span <= mark
            if not late:
                held[key] = us
            out.append((key, "late" if late else "row", us))
        return out


class Progress(Sliced):
    """The latest stage and the step counts of a (request, window); a window's state goes when the watermark passes its end."""

    SCHEMA = "kind string, us long, seq long, stage string, steps long, terminal_steps long"
    # The window's end, in microseconds, is one of the key columns.
    CARRIED = ("span_end",)

    def until(self, value: tuple) -> int:
        return value[0]

    def take(self, held, rows, mark):
        part: dict = {}
        for key, end, us, seq, stage, steps, terminal in rows:
            was = part.get(key)
            at = (us, seq, stage) if was is None or (us, seq) >= was[1][:2] else was[1]
            part[key] = (end, at, steps + (was[2] if was else 0), terminal + (was[3] if was else 0))
        out = []
        for key, (end, at, steps, terminal) in part.items():
            kind = "late"
            if end > mark:
                kind, was = "row", held.get(key)
                if was is not None:
                    at = was[1] if was[1][:2] > at[:2] else at
                    steps, terminal = steps + was[2], terminal + was[3]
                held[key] = (end, at, steps, terminal)
            out.append((key, kind, *at, steps, terminal))
        return out


class Seen(Sliced):
    """Films that a session shows for the first time. Undoing or trimming a path takes none back; `keep` idle microseconds do."""

    SCHEMA = "kind string, film string, us long"

    def __init__(self, names: list[str], keep: int):
        super().__init__(names)
        self.keep = keep

    def until(self, value: tuple) -> int:
        return value[0] + self.keep

    def take(self, held, rows, mark):
        part: dict = {}
        for key, film, us in rows:
            films = part.setdefault(key, {})
            low, high = films.get(film, (us, us))
            films[film] = (min(low, us), max(high, us))
        out = []
        for key, films in part.items():
            was = held.get(key)
            if was is not None and self.until(was) <= mark:
                was = None
                del held[key]
            latest, known = was if was is not None else (None, {})
            for film, (low, high) in sorted(films.items(), key=lambda f: (f[0] is None, f[0] or "")):
                if film in known:
                    latest = max(latest, high)
                elif latest is None and high + self.keep <= mark:
                    out.append((key, "late", film, low))
                else:
                    known[film] = low
                    latest = high if latest is None else max(latest, high)
                    out.append((key, "row", film, low))
            if latest is not None:
                held[key] = (latest, known)
        return out


class Sessions(Sliced):
    """Activity sessions of a key, closed by a timer once the watermark has passed their end.

    Partial sessions that touch are one; those held of a key lie apart, in order. Kinds: `closed`, a whole session;
    `late`, a partial one that ended before the watermark and touches nothing open; `open`, what an open session spans
    after it grew backwards behind the watermark, where closed ones lie that it may touch.
    """

    SCHEMA = "kind string, start long, end long, steps long, finished boolean"

    def until(self, value: list[tuple]) -> int:
        return value[0][1]

    def take(self, held, rows, mark):
        out = []
        for key, start, end, steps, finished in sorted(rows, key=lambda r: r[1]):
            own = held.get(key, [])
            low = bisect_left(own, start, key=lambda s: s[1])
            touched = own[low : bisect_right(own, end, key=lambda s: s[0])]
            if not touched and end <= mark:
                out.append((key, "late", start, end, steps, bool(finished)))
                continue
            whole = [(start, end, steps, bool(finished)), *touched]
            one = (min(s[0] for s in whole), max(s[1] for s in whole), sum(s[2] for s in whole), any(s[3] for s in whole))
            if one[0] <= mark and (not touched or one[0] < touched[0][0]):
                out.append((key, "open", one[0], one[1], 0, False))
            own[low : low + len(touched)] = [one]
            held[key] = own
        return out

    def expire(self, held, mark):
        out = []
        for key, own in list(held.items()):
            over = bisect_right(own, mark, key=lambda s: s[1])
            out += [(key, "closed", *s) for s in own[:over]]
            if over == len(own):
                del held[key]
            else:
                held[key] = own[over:]
        return out


class Latency(StatefulProcessor):
    """Attempts, successes and exact percentiles of a (window, kind) as they stand after each batch, from counts per value.

    Kinds: `row`, the measures so far; `closed`, the counts themselves once the watermark has passed the window's end;
    `late`, counts that came after that. A missing time is `NO_TIME` and counts as an attempt only.
    """

    NO_TIME = -(1 << 62)
    SCHEMA = "kind string, ok boolean, elapsed_ms long, n long, attempts long, successes long, within_target long, percentiles array<long>"

    def __init__(self, names: list[str], target: int, percentiles: list[int]):
        # The window's end, in microseconds, is the last of the key columns.
        self.names, self.target, self.percentiles = names, target, percentiles

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "ok array<boolean>, elapsed_ms array<long>, n array<long>")

    def _held(self) -> pd.DataFrame | None:
        held = self.counts.get()
        return None if held is None else pd.DataFrame({c: list(v) for c, v in zip(("ok", "elapsed_ms", "n"), held)})

    def _rows(self, key, kind: str, counts: pd.DataFrame) -> pd.DataFrame:
        out = counts.assign(kind=kind, attempts=None, successes=None, within_target=None, percentiles=None)
        for at, name in enumerate(self.names):
            out[name] = [key[at]] * len(out)
        return out[[*self.names, "kind", "ok", "elapsed_ms", "n", "attempts", "successes", "within_target", "percentiles"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = _columns(rows)[["ok", "elapsed_ms", "n"]]
        if int(key[-1]) <= _mark(timerValues):
            yield self._rows(key, "late", part.groupby(["ok", "elapsed_ms"], as_index=False)["n"].sum())
            return
        held = self._held()
        if held is None:
            self.handle.registerTimer(_ms(int(key[-1])))
        else:
            part = pd.concat([held, part], ignore_index=True)
        part = part.groupby(["ok", "elapsed_ms"], as_index=False)["n"].sum()
        self.counts.update(tuple(part[c].tolist() for c in ("ok", "elapsed_ms", "n")))
        good = part[part["ok"] & (part["elapsed_ms"] != self.NO_TIME)].sort_values("elapsed_ms")
        upto = good["n"].cumsum().to_numpy()
        of = int(upto[-1]) if len(upto) else 0
        found = [int(good["elapsed_ms"].iloc[np.searchsorted(upto, of - of * (100 - p) // 100)]) for p in self.percentiles] if of else None
        measures = [
            int(part["n"].sum()), int(part.loc[part["ok"], "n"].sum()), int(good.loc[good["elapsed_ms"] <= self.target, "n"].sum()), found
        ]
        columns = [*self.names, "kind", "ok", "elapsed_ms", "n", "attempts", "successes", "within_target", "percentiles"]
        yield pd.DataFrame([[*key, "row", None, None, None, *measures]], columns=columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self.counts.clear()
        if held is not None:
            yield self._rows(key, "closed", held)


# Reductions of a batch before it is shuffled.


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _codes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """One number for each distinct combination of the named columns."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for name in names:
        column = batch.column(name).dictionary_encode(null_encoding="encode")
        code = code * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    return code


def earliest(names: list[str]):
    """(names, us): the first row of each key in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _codes(batch, names)
            order = np.lexsort((batch.column("us").to_numpy(), code))
            yield batch.take(pa.array(order[_runs(code[order])])).select([*names, "us"])

    return run


def latest(names: list[str]):
    """(names, us, seq, stage, steps, terminal_steps): the last stage and the counts of a key in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, us, seq = _codes(batch, names), batch.column("us").to_numpy(), batch.column("seq").to_numpy()
            order = np.lexsort((seq, us, code))
            first = _runs(code[order])
            last = order[np.append(first[1:], len(order)) - 1]
            terminal = batch.column("terminal").fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)[order]
            rows = batch.take(pa.array(last))
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in (*names, "us", "seq", "stage")), pa.array(np.diff(np.append(first, len(order)))),
                    pa.array(np.add.reduceat(terminal, first)),
                ],
                [*names, "us", "seq", "stage", "steps", "terminal_steps"],
            )

    return run


def ends(names: list[str]):
    """(names, us): the first and the last row of each key in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, us = _codes(batch, names), batch.column("us").to_numpy()
            order = np.lexsort((us, code))
            first = _runs(code[order])
            last = np.append(first[1:], len(order)) - 1 if len(order) else first
            yield batch.take(pa.array(order[np.union1d(first, last)])).select([*names, "us"])

    return run


def spans(names: list[str], gap: int):
    """(names, start, end, steps, finished): runs of a key's rows in the batch that are at most `gap` microseconds apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, us = _codes(batch, names), batch.column("us").to_numpy()
            order = np.lexsort((us, code))
            code, us = code[order], us[order]
            new = np.ones(len(us), dtype=bool)
            new[1:] = (code[1:] != code[:-1]) | (us[1:] - us[:-1] > gap)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(us)) - 1
            terminal = batch.column("terminal").fill_null(False).to_numpy(zero_copy_only=False)[order]
            rows = batch.take(pa.array(order[first]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in names), pa.array(us[first]), pa.array(us[last] + gap),
                    pa.array(last - first + 1), pa.array(np.logical_or.reduceat(terminal, first)),
                ],
                [*names, "start", "end", "steps", "finished"],
            )

    return run


def tallies(names: list[str]):
    """(names, ok, elapsed_ms, n): how often each value occurs in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({
                **{n: batch.column(n) for n in names}, "ok": batch.column("ok").fill_null(False),
                "elapsed_ms": batch.column("elapsed_ms").fill_null(Latency.NO_TIME),
            })
            keys = [*names, "ok", "elapsed_ms"]
            counted = table.group_by(keys).aggregate([([], "count_all")]).rename_columns([*keys, "n"])
            yield from counted.combine_chunks().to_batches()

    return run
