"""JSON values of files without line structure, read in parallel: one array in a file, or values back to back.

Spark's text source cuts a file into byte ranges at closing braces, wherever they stand. What a range means depends on
where the reader is when it begins: in a string, behind a backslash, how deep. So every chunk of a range is first scanned for
each state it may begin in, which gives its transition: the state it ends in, the change of depth and how many values begin at each depth.
Composing the transitions of a file (one short row for each chunk) gives the true state at the start of each chunk and the ordinal of its
first value. The second scan then cuts the values out; those that cross chunks, at most two of a chunk, are put together by their ordinal.
No task reads a whole file unless it has no closing brace at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sceneframe.session import written

CHUNK = 1 << 22  # bytes of a chunk, which is scanned as one array
OUTSIDE, STRING, ESCAPED = range(3)  # states a chunk can begin in
QUOTE, SLASH, COMMA = b'"\\,'
STEP = np.zeros(256, np.int64)  # change of depth
STEP[list(b"[{")], STEP[list(b"]}")] = 1, -1
MARKS = STEP != 0
MARKS[COMMA] = True
TRANSITION = "array<struct<state:int,delta:int,low:int,marks:map<int,bigint>>>"
CHUNKS = f"file string, block bigint, seq int, size bigint, bytes bigint, text binary, moves {TRANSITION}"
PIECES = "ordinal bigint, block bigint, seq int, text binary, whole boolean"


def _slash_runs(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the backslashes and, for each, how many stand in a row up to it; one that is escaped itself does not count."""
    at = np.flatnonzero(data == SLASH)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    run = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) + 1
    if state == ESCAPED and len(at) and at[0] == 0:
        run[:first[1] if len(first) > 1 else len(run)] -= 1
    return at, run


def _marks(text: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
    """Brackets, braces and commas: their places, bytes and whether an odd number of quotes stands before each; then the number of
    quotes and whether the text ends behind an open backslash. These are the same for a reader inside and outside a string."""
    data = np.frombuffer(text, np.uint8)
    slashes, run = _slash_runs(data, ESCAPED if escaped else OUTSIDE)
    quotes = np.flatnonzero(data == QUOTE)
    before = np.searchsorted(slashes, quotes) - 1  # the last backslash before each quote
    literal = np.zeros(len(quotes), bool)
    if len(slashes):
        literal = (before >= 0) & (slashes[before] == quotes - 1) & (run[before] % 2 == 1)
    if escaped and len(quotes) and quotes[0] == 0:
        literal[0] = True
    quotes = quotes[~literal]
    at = np.flatnonzero(MARKS[data])
    open_end = bool(len(slashes)) and slashes[-1] == len(data) - 1 and run[-1] % 2 == 1
    return at, data[at], np.searchsorted(quotes, at) % 2 == 1, len(quotes), open_end or (escaped and not len(data))


def _outside(marks: tuple[np.ndarray, np.ndarray, np.ndarray, int, bool], state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    at, token, odd, quotes, open_end = marks
    inside = state != OUTSIDE
    kept = odd == inside
    at, token = at[kept], token[kept]
    depth = np.cumsum(STEP[token]) - STEP[token]
    if (quotes + inside) % 2 == 0:
        return at, token, depth, OUTSIDE
    return at, token, depth, ESCAPED if open_end else STRING


def scan(text: bytes, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Brackets, braces and commas outside strings: their places, bytes and depths before them, and the state at the end."""
    return _outside(_marks(text, state == ESCAPED), state)


def transition(text: bytes, state: int, elements: bool) -> dict:
    """What a chunk does to a reader in ``state``; ``marks`` counts, by depth relative to the start, what begins a value there."""
    return _moved(scan(text, state), elements)


def _moved(found: tuple[np.ndarray, np.ndarray, np.ndarray, int], elements: bool) -> dict:
    _, token, depth, end = found
    step = STEP[token]
    level = depth[step > 0]
    if elements:  # a comma in an array that opened one level up
        level = np.append(level, depth[token == COMMA] - 1)
    after = depth + step
    marks = zip(*(x.tolist() for x in np.unique(level, return_counts=True)))
    return {"state": end, "delta": int(step.sum()), "low": int(min(after.min(initial=0), 0)), "marks": list(marks)}


def transitions(text: bytes, elements: bool) -> list[dict]:
    marks = _marks(text, False)
    outside, string = (_moved(_outside(marks, s), elements) for s in (OUTSIDE, STRING))
    escaped = string if text and text[0] not in (QUOTE, SLASH) else transition(text, ESCAPED, elements)
    return [outside, string, escaped]


def pieces(text: bytes, state: int, depth: int, ordinal: int, elements: bool) -> Iterator[tuple[int, bytes, bool]]:
    """``(ordinal, text, whole)`` of the values, or parts of values, of a chunk; ``ordinal`` values have begun before it.

    A value is a top-level array or object, or an element of one with ``elements``. Text outside comes with the ordinal of the
    value it precedes.
    """
    at, token, level, _ = scan(text, state)
    level = level + depth
    step = STEP[token]
    border = ((step > 0) & (level == 0)) | ((step < 0) & (level == 1))
    if elements:
        border |= (token == COMMA) & (level == 1)
    start, whole = 0, depth == 0
    for place, change in zip(at[border].tolist(), step[border].tolist()):
        if change > 0:
            if text[start:place].strip():
                yield ordinal, text[start:place], True
            ordinal, start, whole = ordinal + 1, place + elements, True
        elif change < 0:
            yield ordinal - 1, text[start:place + (not elements)], whole
            start, whole = place + 1, True
        else:
            yield ordinal - 1, text[start:place], whole
            ordinal, start, whole = ordinal + 1, place + 1, True
    if depth + int(step.sum()) > 0:
        yield ordinal - 1, text[start:], False
    elif text[start:].strip():
        yield ordinal, text[start:], True


def _chunks(spark: SparkSession, path: str, elements: bool, chunk: int) -> DataFrame:
    """The text of all files in chunks of about ``chunk`` characters, each with its transitions."""

    def row(key: tuple, seq: int, parts: list[bytes]) -> dict:
        text = b"}".join(parts) + b"}"
        return {"file": key[0], "block": key[1], "size": key[2], "seq": seq, "bytes": len(text),
                "text": text, "moves": transitions(text, elements)}

    def cut(batches):
        key, seq, parts, held = None, 0, [], 0
        kind = pa.list_(pa.struct([("state", pa.int32()), ("delta", pa.int32()), ("low", pa.int32()), ("marks", pa.map_(pa.int32(), pa.int64()))]))
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int32()), ("size", pa.int64()), ("bytes", pa.int64()),
                            ("text", pa.binary()), ("moves", kind)])
        for b in batches:
            if not b.num_rows:
                continue
            file, block = b.column("file"), b.column("block")
            new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
            starts = [0, *(np.flatnonzero(np.asarray(new)) + 1).tolist(), b.num_rows]
            for at, end in zip(starts, starts[1:]):  # rows of one byte range
                here = (file[at].as_py(), block[at].as_py(), b.column("size")[at].as_py())
                if parts and (held >= chunk or here != key):
                    yield pa.RecordBatch.from_pylist([row(key, seq, parts)], schema)
                    seq, parts, held = seq + 1, [], 0
                if here != key:
                    key, seq = here, 0
                lines = pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), b.column("value").slice(at, end - at))
                parts.append(pc.binary_join(lines, pa.scalar(b"}"))[0].as_py())
                held += len(parts[-1]) + 1
        if parts:
            yield pa.RecordBatch.from_pylist([row(key, seq, parts)], schema)

    meta = {"file": "file_path", "block": "file_block_start", "size": "file_size"}
    lines = spark.read.option("lineSep", "}").text(path)
    rows = lines.select(*[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()], F.col("value").cast("binary").alias("value"))
    return written(rows.mapInArrow(cut, CHUNKS), "json-chunks")


def _starts(chunks: DataFrame) -> DataFrame:
    """State, depth and ordinal at the start of each chunk; one short row a chunk of a file meets in a task."""

    def compose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["seq"]))
        surplus = sum(r["bytes"] for r in rows) == rows[0]["size"] + 1  # the file does not end in a brace
        state, depth, ordinal, out = OUTSIDE, 0, 0, []
        for k, r in enumerate(rows):
            move = r["moves"][state]
            last = k + 1 == len(rows)
            cut = last and (surplus or depth + move["delta"] < 0)
            if depth + move["low"] + cut < 0:
                raise ValueError(f"a bracket closes that was not opened: {r['file']} near byte {r['block']}")
            out.append({"file": r["file"], "block": r["block"], "seq": r["seq"], "state": state, "depth": depth, "ordinal": ordinal, "cut": cut})
            ordinal += dict(move["marks"]).get(-depth, 0)
            state, depth = move["state"], depth + move["delta"]
        kinds = zip(("file", "block", "seq", "state", "depth", "ordinal", "cut", "values"),
                    (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()))
        return pa.Table.from_pylist([r | {"values": ordinal} for r in out], pa.schema(list(kinds)))

    short = chunks.select("file", "block", "seq", "size", "bytes", "moves")
    starts = short.groupBy("file").applyInArrow(
        compose, "file string, block bigint, seq int, state int, depth int, ordinal bigint, cut boolean, values bigint")
    starts = written(starts, "json-starts")
    files = starts.groupBy("file").agg(F.max("values").alias("values"))  # files count in the order of their names
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", F.coalesce(F.sum("values").over(before), F.lit(0)).alias("offset"))
    return starts.join(offsets, "file").withColumn("ordinal", F.col("ordinal") + F.col("offset")).drop("values", "offset")


def read_json_values(spark: SparkSession, path: str, elements: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``(ordinal, text)`` of the arrays and objects in the files of ``path``, or of the elements of each with ``elements``.

    Ordinals count from 0 in reading order, files by name. Blank elements give no row. Text outside any array or object has
    the ordinal of the value it precedes. A value that its file breaks off comes as far as it goes. Scanned when called.
    """
    chunks = _chunks(spark, path, elements, chunk)
    ready = chunks.select("file", "block", "seq", "text").join(_starts(chunks), ["file", "block", "seq"])

    def cut(batches):
        for b in batches:
            for r in b.to_pylist():
                text = r["text"][:-1] if r["cut"] else r["text"]
                rows = [(n, r["block"], r["seq"], t, whole) for n, t, whole in pieces(text, r["state"], r["depth"], r["ordinal"], elements)]
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["ordinal", "block", "seq", "text", "whole"])

    found = written(ready.mapInArrow(cut, PIECES), "json-values")
    parts = found.filter("not whole").groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("parts"))
    joined = parts.select("ordinal", F.aggregate("parts.text", F.lit(b""), lambda a, b: F.concat(a, b)).alias("text"))
    values = found.filter("whole").select("ordinal", "text").unionByName(joined)
    return values.select("ordinal", F.btrim(F.col("text").cast("string"), F.lit(" \t\r\n")).alias("text")).filter("text <> ''")


def row_values(rows: DataFrame, value: str) -> DataFrame:
    """``(text)`` of the arrays and objects in every row's own text, and of what stands outside them."""

    def cut(batches):
        for b in batches:
            texts = [t.strip() for line in b.column(0).to_pylist() if line for _, t, _ in pieces(line, OUTSIDE, 0, 0, False)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t in texts if t], pa.binary()).cast(pa.string())], ["text"])

    return rows.select(F.col(value).cast("string").cast("binary").alias("text")).mapInArrow(cut, "text string")
