"""Chat formatting by columnar byte assembly.

A turn becomes `<turn ROLE>`, a line feed, the text, a line feed, `</turn>` and a line feed. Inside roles and texts
a backslash goes before every backslash and `<`, in roles also before `>` and line feed; a bare `<` therefore
always opens a control string, and dropping the backslashes gives the text back. All turns of an Arrow batch are
written at once: segment lengths, cumulative offsets and scatter indices are numpy columns, and headers and contents
are copied into one preallocated buffer, which is the output column.

The output has a row per turn, so a conversation of any length is never one value; `start` is the turn's place in
its conversation and `loss_start`, `loss_end` the assistant's text, all in code points of the whole conversation.

Defined results: null text and role are empty; turns go by (turn, role, text), null first, so ties have one order;
repeated rows are repeated turns; a null conv_id is a conversation of its own; extra columns are ignored; an empty
table gives an empty result. A conversation passes through one task as a stream, a batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scan

_FOOT = np.frombuffer(b"\n</turn>\n", dtype=np.uint8)
_ESCAPED = np.zeros(256, dtype=bool)
_ESCAPED[[ord("\\"), ord("<")]] = True
_HEAD = re.compile(r"<turn ((?:[^\\<>\n]|\\.)*)>\n", re.DOTALL)
_TAIL = "\n</turn>\n"
FORMATTED = (
    "conv_id {kind}, turn long, position long, role string, formatted string, start long, loss_start long, loss_end long"
)


def _head(role: str) -> bytes:
    return b"<turn " + re.sub(r"([\\<>\n])", r"\\\1", role).encode() + b">\n"


def _copy(out: np.ndarray, at: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy ranges of `source` to the places `at` of `out`."""
    total = int(length.sum())
    ends = np.cumsum(length)
    step = np.arange(total) - np.repeat(ends - length, length)
    out[np.repeat(at, length) + step] = source[np.repeat(start, length) + step]


def assemble(roles: list[str], offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns, bytes per turn, where each turn's text starts in it, bytes of its escaped text)."""
    names = sorted(set(roles))
    heads = [_head(name) for name in names]
    which = np.searchsorted(np.array(names, dtype=object), np.array(roles, dtype=object)) if names else np.zeros(0, int)
    head_size = np.array([len(h) for h in heads], dtype=np.int64)
    head_data = np.frombuffer(b"".join(heads), dtype=np.uint8)
    head_start = np.cumsum(head_size) - head_size

    special = _ESCAPED[data]
    before = np.concatenate([[0], np.cumsum(special)])  # escapes before each byte
    text_size = np.diff(offsets) + np.diff(before[offsets])
    size = head_size[which] + text_size + len(_FOOT)
    begin = np.cumsum(size) - size
    text_at = begin + head_size[which]

    out = np.empty(int(size.sum()), dtype=np.uint8)
    _copy(out, begin, head_data, head_start[which], head_size[which])
    shift = np.repeat(text_at - offsets[:-1] - before[offsets[:-1]], np.diff(offsets))
    place = np.arange(len(data)) + shift + before[1:]
    out[place] = data
    out[place[special] - 1] = ord("\\")
    out[(text_at + text_size)[:, None] + np.arange(len(_FOOT))] = _FOOT
    return out, size, text_at - begin, text_size


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, written, position = object(), 0, 0
    for whole in batches:
        offsets, _ = scan.buffers(whole.column("text"))
        for low, high in scan.rows_up_to(offsets, 4 * scan.CHUNK):
            batch = whole.slice(low, high - low)
            n = batch.num_rows
            roles = [r or "" for r in batch.column("role").to_pylist()]
            local, data = scan.buffers(batch.column("text"))
            out, size, text_at, text_size = assemble(roles, local, data)
            points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
            begin = np.cumsum(size) - size
            chars = points[begin + size] - points[begin]
            loss_at, loss_size = points[begin + text_at] - points[begin], (
                points[begin + text_at + text_size] - points[begin + text_at]
            )
            start, place = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if conv != current:
                    current, written, position = conv, 0, 0
                start[i], place[i] = written, position
                written += int(chars[i])
                position += 1
            other = np.array([r != "assistant" for r in roles], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), batch.column("turn").cast(pa.int64()), pa.array(place),
                    pa.array(roles, pa.string()), scan.strings(out, size), pa.array(start),
                    pa.array(start + loss_at, mask=other), pa.array(start + loss_at + loss_size, mask=other),
                ],
                ["conv_id", "turn", "position", "role", "formatted", "start", "loss_start", "loss_end"],
            )


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def format_turns(conversations: DataFrame) -> DataFrame:
    """A row per turn: conv_id, turn, position, role, formatted, start, loss_start and loss_end (null but for assistants)."""
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        _format, FORMATTED.format(kind=_kind(conversations))
    )


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parse(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    head = _HEAD.match(formatted)
    if head is None or not formatted.endswith(_TAIL):
        raise ValueError("not a formatted turn")
    return unescape(head[1]), unescape(formatted[head.end() : len(formatted) - len(_TAIL)])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind, current, turns, loss, counts = None, None, None, None, [0, 0, 0]

    def row() -> pa.RecordBatch:
        values = [current, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]]
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, text, start, low, high in zip(
            *(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "start", "loss_start", "loss_end"))
        ):
            if turns is None or conv != current:
                if turns is not None:
                    yield row()
                current, turns, loss, counts = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            role, said = parse(text)
            turns.update(f"{role}\n{said}\n".encode())
            counts[0] += 1
            counts[2] += len(text)
            if low is not None:
                learnt = unescape(text[low - start : high - start])
                counts[1] += len(learnt)
                loss.update(learnt.encode())
    if turns is not None:
        yield row()


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns and their digest, the text under the loss mask and its digest, code points written."""
    schema = (
        f"conv_id {_kind(formatted)}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long"
    )
    rows = formatted.select("conv_id", "position", "formatted", "start", "loss_start", "loss_end")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(_digest, schema)
