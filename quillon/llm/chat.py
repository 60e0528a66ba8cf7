"""Chat formatting by columnar byte assembly.

Turns of a conversation become one marked-up byte string plus loss spans over the assistant texts. A batch of sorted turns is
assembled at once: segment lengths give cumulative offsets, numpy scatter indices copy headers, contents, escapes and footers
into one preallocated Arrow data buffer, without a Python string for each turn.

Template: ``<s>`` opens a conversation; each turn is a header, the escaped text and a footer. A backslash goes before every
control string and every backslash inside a text (and inside an unusual role), so reading back is exact.

Defined results: turns are ordered by turn, then role, then text (nulls first), so ties and repeated rows have one order; a
null text or role is empty; rows with a null conv_id form one conversation; an empty table gives no rows; other columns are
ignored. A conversation is one output row, so it must fit in one Arrow value (2 GB); batches hold only one more than that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template: role, header, footer. Every other role uses OTHER.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>")}
BEGIN = "<s>"
OTHER = ("[ROLE] ", "[/ROLE] ", "[/TURN]")
CONTROLS = (BEGIN, "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[/ROLE]", "[/TURN]")
SCHEMA = "conv_id long, formatted string, loss_spans array<int>, n_turns long"
_TOKEN = re.compile(r"\\.|" + "|".join(re.escape(c) for c in CONTROLS), re.DOTALL)
_NEEDS = re.compile(r"(?=\\|" + "|".join(re.escape(c) for c in CONTROLS) + ")")


def escape_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted positions in ``data`` before which a backslash goes: backslashes, and control strings that end within their row."""
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    hits = [np.flatnonzero(data == ord("\\"))]
    for first in (ord("<"), ord("[")):
        at = np.flatnonzero(data == first)
        if not len(at):
            continue
        row = np.searchsorted(starts, at, side="right") - 1
        room = ends[row] - at
        for c in CONTROLS:
            raw = np.frombuffer(c.encode(), dtype=np.uint8)
            if raw[0] != first:
                continue
            ok = at[room >= len(raw)]
            for j in range(1, len(raw)):
                ok = ok[data[ok + j] == raw[j]]
            hits.append(ok)
    return np.unique(np.concatenate(hits))


def escape(text: str) -> str:
    return _NEEDS.sub(r"\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def assemble(conv: np.ndarray, roles: list[str], texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Formatted strings, loss spans and turn counts of the conversations that start where ``conv`` (bool) is true."""
    n = len(roles)
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32, count=n + 1).astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    heads, feet = [], []
    for starts, role in zip(conv.tolist(), roles, strict=True):
        head, foot = MARKS.get(role) or (f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2])
        heads.append(((BEGIN if starts else "") + head).encode())
        feet.append(foot.encode())
    head_len = np.fromiter(map(len, heads), dtype=np.int64, count=n)
    foot_len = np.fromiter(map(len, feet), dtype=np.int64, count=n)
    starts, ends = offsets[:-1], offsets[1:]
    points = escape_points(data[: offsets[-1]], starts, ends)
    before = np.searchsorted(points, offsets)  # escapes in front of each row's first byte
    body_len = ends - starts + np.diff(before)
    total = head_len + body_len + foot_len
    at = np.concatenate(([0], np.cumsum(total)))
    if at[-1] > 2**31 - 1:
        raise ValueError("the formatted texts of one batch exceed one Arrow string buffer")
    out = np.empty(at[-1], dtype=np.uint8)

    def scatter(source: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> None:
        shift = to - np.concatenate(([0], np.cumsum(lengths)[:-1]))
        out[np.arange(len(source)) + np.repeat(shift, lengths)] = source

    scatter(np.frombuffer(b"".join(heads), dtype=np.uint8), head_len, at[:-1])
    scatter(np.frombuffer(b"".join(feet), dtype=np.uint8), foot_len, at[1:] - foot_len)
    body_at = at[:-1] + head_len
    span = data[offsets[0] : offsets[-1]]
    shift = np.repeat(body_at - starts - before[:-1], ends - starts)  # to the body's place; earlier rows' escapes don't count
    index = np.arange(offsets[0], offsets[-1])
    extra = np.zeros(len(span) + 1, dtype=np.int64)
    extra[points - offsets[0]] = 1
    to = index + shift + np.cumsum(extra)[:-1]
    out[to] = span
    out[to[points - offsets[0]] - 1] = ord("\\")
    first = np.flatnonzero(conv)
    bounds = np.concatenate((at[first], at[-1:]))
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))
    turn_conv = np.cumsum(conv) - 1
    said = np.fromiter((r == "assistant" for r in roles), dtype=bool, count=n)
    flat = np.stack([body_at[said], body_at[said] + body_len[said]], axis=1) - at[first][turn_conv[said]][:, None]
    counts = np.bincount(turn_conv[said], minlength=len(first)) * 2
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat.reshape(-1), pa.int32()))
    return formatted, spans, np.bincount(turn_conv, minlength=len(first))


def _formatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None

    def rows(t: pa.Table) -> pa.RecordBatch:
        ids = t.column("conv_id").combine_chunks()
        key = np.array(ids.fill_null(0))
        null = np.array(ids.is_null())
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])))
        texts = t.column("text").cast(pa.string()).combine_chunks()
        formatted, spans, turns = assemble(new, t.column("role").to_pylist(), texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.flatnonzero(new))), formatted, spans, pa.array(turns, pa.int64())], names=["conv_id", "formatted", "loss_spans", "n_turns"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        ids = held.column("conv_id").to_pylist()
        last = len(ids) - 1
        while last > 0 and ids[last - 1] == ids[-1]:
            last -= 1
        if last > 0:
            yield rows(held.slice(0, last).combine_chunks())
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield rows(held.combine_chunks())


def format_chat(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans (byte offsets: start, end, start, ...), n_turns."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_formatter, SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    heads = {h.strip(): (role, foot.strip()) for role, (h, foot) in MARKS.items()}
    turns: list[tuple[str, str]] = []
    pos, role, start, end = 0, None, 0, ""
    while m := _TOKEN.search(formatted, pos):
        mark, pos = m[0], m.end()
        if mark[0] == "\\" or mark == BEGIN:
            continue
        if mark in heads:
            role, end = heads[mark]
            start = pos = pos + 1
        elif mark == OTHER[0].strip():
            start = pos = pos + 1
        elif mark == OTHER[1].strip():
            role, end = unescape(formatted[start : m.start()]), OTHER[2]
            start = pos = pos + 1
        elif mark == end:
            blank = 0 if mark in ("</s>", OTHER[2]) else 1
            turns.append((role or "", unescape(formatted[start : m.start() - blank])))
            end = ""
    return turns


def masked(formatted: str, spans: list[int]) -> str:
    """All text under the loss mask, unescaped."""
    raw = formatted.encode()
    return "".join(unescape(raw[a:b].decode()) for a, b in zip(spans[::2], spans[1::2], strict=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            turns, loss = parse(text), masked(text, spans)
            whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            for o, v in zip(out, (conv, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                o.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives: turn digest, loss digest and lengths."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
