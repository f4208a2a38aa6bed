"""Rows that fail to parse: structural indexing over whole Arrow batches.

The text of a batch is one byte array. Quote masks and their prefix parity tell for every
comma and quote at once whether it stands inside a quoted field; line feeds and structural
commas become a field index; counts and character checks on that index give each row its
fields or the first reason that applies. There is no loop over rows but for the output of
fields that hold doubled quotes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table

REASONS = ("", "empty", "quoting", "columns", "header", "separator", "sequence", "quality", "length", "layout")
OK, EMPTY, QUOTING, COLUMNS, HEADER, SEPARATOR, SEQUENCE, QUALITY, LENGTH, LAYOUT = range(10)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 13, 32]] = True
BASE = np.zeros(256, bool)
# fixed values: the nucleotide letters of the format
BASE[list(b"ACGTRYMKWSBDHVNacgtrymkwsbdhvn")] = True
SCORE = np.zeros(256, bool)
SCORE[33:127] = True

SCHEMA = "reason string, header string, sequence string, quality string"


def _upto(marks: np.ndarray) -> np.ndarray:
    """prefix[i] = marks before position i; one longer than marks."""
    out = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=out[1:])
    return out


def _last_solid(solid: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The end of each span without its trailing white space."""
    at = np.where(solid, np.arange(1, len(solid) + 1), 0)
    reach = np.concatenate(([0], np.maximum.accumulate(at))) if len(at) else np.zeros(1, np.int64)
    return np.maximum(reach[end], start)


def classify(data: np.ndarray, start: np.ndarray, end: np.ndarray, null: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reason codes and the spans (first byte, end) of header, sequence and quality of each row.

    data: the bytes of all rows; start, end: each row's bytes; kind: 0 fastq, 1 csv, 2 another layout.
    The spans of a quoted csv field are without its outer quotes.
    """
    n, reason = len(start), np.zeros(len(start), np.int8)
    lo, hi = np.zeros((n, 3), np.int64), np.zeros((n, 3), np.int64)
    solid = ~SPACE[data]
    end = _last_solid(solid, start, end)
    owner = np.full(len(data), -1, np.int64)
    lengths = end - start
    pos = np.repeat(start - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    owner[pos] = np.repeat(np.arange(n), lengths)
    mine = np.where(owner >= 0, kind[owner], -1)
    empty = null | (lengths == 0)

    # csv: structural commas, quotes in places where none may stand
    quote = (data == 34) & (mine == 1)
    quotes = _upto(quote)
    inside = ((quotes[:-1] - quotes[np.where(owner >= 0, start[owner], 0)]) & 1).astype(bool)  # parity before the byte
    comma = (data == 44) & (mine == 1) & ~inside
    first = np.zeros(len(data) + 1, bool)
    first[start[lengths > 0]] = True
    before = lambda m: np.concatenate(([False], m[:-1]))
    after = lambda m: np.concatenate((m[1:], [False]))
    opens, closes = quote & ~inside, quote & inside
    final = np.zeros(len(data) + 1, bool)
    final[end[lengths > 0] - 1] = True
    bad = opens & ~(first[:-1] | before(comma) | (before(closes) & ~first[:-1]))
    bad |= closes & ~(final[:-1] | after(data == 44) | after(quote))
    bad_before = _upto(bad)
    odd = ((quotes[end] - quotes[start]) & 1).astype(bool)
    quoting = (kind == 1) & ((bad_before[end] > bad_before[start]) | odd)

    # the field index: structural commas, or in fastq line feeds
    mark = comma | ((data == 10) & (mine == 0))
    marks = _upto(mark)
    found = marks[end] - marks[start]
    at = np.flatnonzero(mark)
    wanted = np.where(kind == 1, 2, 3)
    right = (found == wanted) & ~empty
    rows = np.flatnonzero(right)
    cuts = np.zeros((n, 5), np.int64)
    cuts[:, 0] = start - 1
    cuts[:, 4] = end
    for k in range(3):
        r = rows[wanted[rows] > k]
        cuts[r, k + 1] = at[marks[start[r]] + k]
    csv = kind == 1
    cuts[csv & right, 3] = end[csv & right]
    spans = [(cuts[:, k] + 1, cuts[:, k + 1]) for k in range(4)]
    spans = [(np.where(right, a, start), np.where(right, b, start)) for a, b in spans]
    lines = [(a, np.where(csv, b, _last_solid(solid, a, b))) for a, b in spans]
    third = lines[2]
    lines[2] = tuple(np.where(csv, x, y) for x, y in zip(lines[2], lines[3], strict=True))
    size = len(data)
    for k in range(3):
        a, b = lines[k]
        quoted = csv & (b > a) & (size > 0)
        if size:
            quoted &= data[np.minimum(a, size - 1)] == 34
        lo[:, k], hi[:, k] = np.where(quoted, a + 1, a), np.where(quoted, b - 1, b)

    def has_other(allowed: np.ndarray, k: int) -> np.ndarray:
        others = _upto(~allowed[data])
        return others[hi[:, k]] > others[lo[:, k]]

    # in a quoted field a doubled quote is one character
    pairs = _upto(quote & inside & after(quote))
    double = np.where(csv[:, None], pairs[hi] - pairs[lo], 0)
    chars = hi - lo - np.where(hi > lo, double, 0)
    at_byte = lambda i: data[np.minimum(i, size - 1)] if size else np.zeros(n, np.uint8)
    head = (chars[:, 0] < 2) | (at_byte(lo[:, 0]) != 64) | ~solid_at(solid, lo[:, 0] + 1, hi[:, 0])
    plus = (kind == 0) & ((third[1] <= third[0]) | (at_byte(third[0]) != 43))
    steps = [
        (EMPTY, empty),
        (LAYOUT, kind == 2),
        (QUOTING, quoting),
        (COLUMNS, ~right),
        (HEADER, head),
        (SEPARATOR, plus),
        (SEQUENCE, (chars[:, 1] == 0) | has_other(BASE, 1)),
        (QUALITY, has_other(SCORE, 2)),
        (LENGTH, chars[:, 1] != chars[:, 2]),
    ]
    for code, applies in reversed(steps):
        reason[applies] = code
    return reason, lo, hi


def solid_at(solid: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(solid):
        return np.zeros(len(at), bool)
    return (at < end) & solid[np.minimum(at, len(solid) - 1)]


def _texts(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, good: np.ndarray, unquote: np.ndarray) -> pa.Array:
    """The spans of the good rows as strings, null for the others."""
    raw, out = data.tobytes(), [None] * len(good)
    for i in np.flatnonzero(good):
        text = raw[lo[i] : hi[i]]
        out[i] = (text.replace(b'""', b'"') if unquote[i] else text).decode("utf-8", "replace")
    return pa.array(out, pa.string())


def parse_batch(batch: pa.RecordBatch, text: str, layout: str) -> pa.RecordBatch:
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and len(column) else np.zeros(0, np.uint8)
    null = np.asarray(column.is_null())
    shape = np.array(batch.column(batch.schema.get_field_index(layout)).to_pylist(), object)
    kind = np.where(shape == "fastq", 0, np.where(shape == "csv", 1, 2))
    reason, lo, hi = classify(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0], null, kind)
    good = reason == OK
    fields = [_texts(data, lo[:, k], hi[:, k], good, kind == 1) for k in range(3)]
    said = pa.array([REASONS[r] or None for r in reason], pa.string())
    kept = [(f, batch.column(i)) for i, f in enumerate(batch.schema.names) if f not in (text, layout)]
    names = [f for f, _ in kept] + ["reason", "header", "sequence", "quality"]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [said, *fields], names)


def parse_records(raw: DataFrame, id_column: str = "raw_id", text: str = "raw_text", layout: str = "layout") -> DataFrame:
    """Every row as id, reason, header, sequence, quality: `reason` is null for a valid record, else the fields are null.

    The order of reasons is that of REASONS. Defined cases: null, empty and blank texts are `empty`; a layout other than
    fastq or csv (or null) is `layout`; repeated rows come out each; very long texts are handled within their batch;
    other columns of `raw` aren't read, so their names can't clash.
    """
    schema = f"{id_column} {raw.schema[id_column].dataType.simpleString()}, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield parse_batch(batch, text, layout)

    return raw.select(id_column, text, layout).mapInArrow(run, schema)


def split_records(raw: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """Valid records and rejected rows with their reason."""
    parsed = parse_records(raw, **names)
    return parsed.filter(F.col("reason").isNull()).drop("reason"), parsed.filter(F.col("reason").isNotNull()).drop("header", "sequence", "quality")


# queries


def p3_found(spark, sf_dir: str) -> DataFrame:
    return split_records(table(spark, sf_dir, "raw_records"))[1]


def p3_valid(spark, sf_dir: str) -> DataFrame:
    return split_records(table(spark, sf_dir, "raw_records"))[0]
