"""Chat formatting by columnar byte assembly.

Turns in order become one byte buffer per batch: segment lengths give cumulative
offsets, offsets give scatter indices, and headers, texts and marks are copied into
one preallocated Arrow buffer by numpy. A conversation may span several segments,
so none has to fit in one task; each segment carries its loss spans.

Template: `<|im_start|>role\\n` text `<|im_end|>\\n` for each turn. A text gets one
backslash more between every `<`, its backslashes and `|`, so it can't hold a mark,
and loses it again when read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm.batches import by_weight, stage_arrow

#: Fixed values of the template.
START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
SEGMENT = 1 << 20
SEGMENTS = "conv_id long, segment long, whole boolean, turns long, formatted binary, loss_from array<long>, loss_to array<long>"
TURNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=r"<(\\*)\|", replacement=r"<\1\\|")


def escape_role(roles: pa.Array) -> pa.Array:
    """A role stays on the header's line: backslash and line feed are written as \\\\ and \\n."""
    roles = pc.replace_substring(pc.replace_substring(roles, pattern="\\", replacement="\\\\"), pattern="\n", replacement="\\n")
    return escape(roles)


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=r"<(\\*)\\\|", replacement=r"<\1|")


def unescape_role(role: str) -> str:
    role, out, i = unescape(pa.array([role]))[0].as_py(), [], 0
    while i < len(role):
        if role[i] == "\\":
            out.append("\n" if role[i + 1] == "n" else "\\")
            i += 1
        else:
            out.append(role[i])
        i += 1
    return "".join(out)


def _scatter(out: np.ndarray, at: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy source[start:start + length] of each piece to out[at:]."""
    total = int(length.sum())
    if not total:
        return
    inner = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + inner] = source[np.repeat(start, length) + inner]


def _column(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a string column without nulls."""
    values = values.cast(pa.large_binary())
    borders = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), borders[:-1], np.diff(borders)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all turns, the turns' borders, and where their texts begin and end."""
    coded = pc.dictionary_encode(roles)
    heads = [START + r.encode() + MIDDLE for r in coded.dictionary.to_pylist()]
    head_bytes = np.frombuffer(b"".join(heads) + END, np.uint8)
    head_length = np.array([len(h) for h in heads], np.int64)
    head_start = np.cumsum(head_length) - head_length
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    data, start, length = _column(texts)
    before = head_length[which]
    borders = np.concatenate(([0], np.cumsum(before + length + len(END))))
    buffer = pa.allocate_buffer(int(borders[-1]))
    out = np.frombuffer(buffer, np.uint8)
    begin = borders[:-1] + before
    for part in by_weight(length, 1 << 22):
        _scatter(out, borders[:-1][part], head_bytes, head_start[which[part]], before[part])
        _scatter(out, begin[part], data, start[part], length[part])
        n = len(length[part])
        _scatter(out, begin[part] + length[part], head_bytes, np.full(n, len(head_bytes) - len(END)), np.full(n, len(END)))
    return buffer, borders, begin, begin + length


def _formatted(trained: str, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []  # turns of the last conversation, not yet formatted
        first_conv, size = True, 0

        def flush(rows: pa.Table, last: bool, ended: bool) -> pa.RecordBatch:
            """Format whole batches of turns; a conversation is whole unless it touches a border of the task."""
            nonlocal number, first_conv
            rows = rows.combine_chunks()
            one = lambda c: rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c)
            roles = one("role").fill_null("")
            texts = one("text").fill_null("")
            buffer, borders, begin, end = assemble(escape_role(roles), escape(texts))
            conv = one("conv_id")
            code = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((code[0][1:] != code[0][:-1]) | (code[1][1:] != code[1][:-1])) + 1
            cuts = np.concatenate(([0], cuts, [rows.num_rows]))
            loss = pc.equal(roles, trained).to_numpy(zero_copy_only=False)
            n = len(cuts) - 1
            whole = np.ones(n, bool)
            whole[0] = not (first_conv or flush.open)
            whole[-1] &= not (last or not ended)
            starts = borders[cuts[:-1]]
            spans = [np.flatnonzero(loss[a:b]) + a for a, b in zip(cuts, cuts[1:], strict=False)]
            view = memoryview(buffer)
            out = pa.RecordBatch.from_arrays([
                conv.take(pa.array(cuts[:-1])), pa.array(number + np.arange(n)), pa.array(whole), pa.array(np.diff(cuts)),
                pa.array([view[a:b] for a, b in zip(starts, borders[cuts[1:]], strict=True)], pa.binary()),
                pa.array([begin[i] - s for i, s in zip(spans, starts, strict=True)], pa.list_(pa.int64())),
                pa.array([end[i] - s for i, s in zip(spans, starts, strict=True)], pa.list_(pa.int64()))],
                names=["conv_id", "segment", "whole", "turns", "formatted", "loss_from", "loss_to"])
            number += n
            first_conv, flush.open = False, not ended
            return out

        flush.open = False
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < segment:
                continue
            rows = pa.Table.from_batches(held)
            conv = rows.column("conv_id").combine_chunks()
            lasting = conv[-1]
            same = pc.is_null(conv) if not lasting.is_valid else pc.fill_null(pc.equal(conv, lasting), False)
            keep = len(same) - int(pc.sum(same.cast(pa.int64())).as_py())  # rows are sorted
            if keep:
                yield flush(rows.slice(0, keep), False, True)
                held, size = rows.slice(keep).to_batches(), rows.slice(keep).nbytes
            if size >= segment:
                yield flush(pa.Table.from_batches(held), False, False)
                held, size = [], 0
        if held:
            yield flush(pa.Table.from_batches(held), True, True)
    return run


def format_conversations(rows: DataFrame, trained: str = "assistant", segment: int = SEGMENT) -> DataFrame:
    """Segments of formatted conversations, as a table.

    `rows` has `conv_id`, `turn`, `role`, `text`. Turns are ordered by `turn` (null first), then role
    and text, so repeated turns stay beside each other; null role and text count as empty, a null
    `conv_id` is a conversation of its own. A segment holds consecutive turns of one conversation:
    `formatted` bytes and the byte spans `loss_from`, `loss_to` of the texts of role `trained`;
    segments in ascending order make the conversation. `whole` says that a segment surely is all of it.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    return stage_arrow(turns.mapInArrow(_formatted(trained, segment), SEGMENTS), "chat")


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """Roles and texts of a formatted segment."""
    out, at, mark = [], 0, END[:-1]
    while at < len(formatted):
        head, text = at + len(START), formatted.find(MIDDLE, at) + 1
        stop = formatted.find(mark, text)
        if not formatted.startswith(START, at) or not text or stop < 0 or not formatted.startswith(END, stop):
            raise ValueError("a turn must begin and end with its marks")
        out.append((unescape_role(formatted[head:text - 1].decode()), formatted[text:stop].decode()))
        at = stop + len(END)
    texts = unescape(pa.array([t for _, t in out], pa.string())).to_pylist()
    return [(role, text) for (role, _), text in zip(out, texts, strict=True)]


def _digests():
    """Digests of conversations whose segments come sorted, read from formatted bytes and spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row():
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        done = []
        for batch in batches:
            for conv, formatted, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
                if now != (conv,):
                    if now:
                        done.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(role.encode() + b"\n" + text.encode() + b"\n")
                loss = unescape(pa.array([formatted[a:b].decode() for a, b in zip(begin, end, strict=True)], pa.string())).to_pylist()
                for text in loss:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted.decode())
            if done:
                yield _rows(done)
                done = []
        if now:
            yield _rows([row()])
    return run


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)],
                                      names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_digests(segments: DataFrame) -> DataFrame:
    """Per conversation what its formatted segments say.

    Whole segments are read where they lie. Only conversations cut by a border of a task or by
    size are brought together, as segments and in streams, since a running digest needs its
    bytes in order.
    """
    columns = ["conv_id", "segment", "formatted", "loss_from", "loss_to"]
    whole = segments.where("whole").select(*columns)
    cut = segments.where("NOT whole").select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return whole.mapInArrow(_digests(), TURNS).unionByName(cut.mapInArrow(_digests(), TURNS))
