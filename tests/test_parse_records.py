"""Row parsing against a character-by-character parser."""

import random

import pyarrow as pa
import pytest

from seqloom.operators.parse_records import parse_batch, parse_records, split_records

WS = " \t\r\n"
BASES = "ACGTRYMKWSBDHVNacgtrymkwsbdhvn"


def by_hand(text, layout):
    if text is None or not text.strip(WS):
        return "empty", None
    text = text.rstrip(WS)
    if layout == "csv":
        fields, i = [], 0
        while True:
            if text[i : i + 1] == '"':
                j, value = i + 1, ""
                while True:
                    if j >= len(text):
                        return "quoting", None
                    if text[j] == '"':
                        if text[j + 1 : j + 2] != '"':
                            break
                        j += 1
                    value += text[j]
                    j += 1
                fields.append(value)
                j += 1
                if j >= len(text):
                    break
                if text[j] != ",":
                    return "quoting", None
                i = j + 1
            else:
                j = text.find(",", i)
                value = text[i:] if j < 0 else text[i:j]
                if '"' in value:
                    return "quoting", None
                fields.append(value)
                if j < 0:
                    break
                i = j + 1
        if len(fields) != 3:
            return "columns", None
        header, sequence, quality = fields
    else:
        lines = [x.rstrip(WS) for x in text.split("\n")]
        if len(lines) != 4:
            return "columns", None
        header, sequence, plus, quality = lines
    if len(header) < 2 or header[0] != "@" or header[1] in WS:
        return "header", None
    if layout == "fastq" and not plus.startswith("+"):
        return "separator", None
    if not sequence or any(c not in BASES for c in sequence):
        return "sequence", None
    if any(not 33 <= ord(c) <= 126 for c in quality):
        return "quality", None
    if len(sequence) != len(quality):
        return "length", None
    return None, (header, sequence, quality)


def check(texts, layouts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array(layouts, pa.string())], ["raw_id", "raw_text", "layout"])
    for row, text, layout in zip(parse_batch(batch, "raw_text", "layout").to_pylist(), texts, layouts, strict=True):
        reason, fields = by_hand(text, layout)
        assert row["reason"] == reason, (text, layout)
        assert (row["header"], row["sequence"], row["quality"]) == (fields or (None, None, None)), (text, layout)


CASES = [None, "", " \r\n", "@h\nAC\n+\nII", "@h\r\nAC\r\n+\r\nII\r\n", "@h\nAC\n+\nII\n\n", "@ h\nAC\n+\nII", "@h\nAC\n-\nII", "@h\n\n+\n", "@h\nAX\n+\nII", "@h\nAC\n+\nI é", "@h\nAC\n+\nIII"]
CSV = ["@h,AC,II", '"@h","AC","II"', '"@h,x",AC,II', '@h,AC,"I"""', '@h,AC,"II', '"@h"x,AC,II', '@"h,AC,II', "@h,AC", "@h,AC,II,", ",AC,II", '"",AC,II', '@h,"",""', '"""@h""",AC,II', '@h,A"C,II']


def test_cases():
    check(CASES, ["fastq"] * len(CASES))
    check(CSV, ["csv"] * len(CSV))


def test_random():
    r = random.Random(5)
    texts, layouts = [], []
    for _ in range(4000):
        layouts.append(r.choice(["fastq", "csv"]))
        base = list(r.choice(["@h x\nAC\n+\nII\n", '"@h","AC","I"""', "@h,AC,II", ""]))
        for _ in range(r.randint(0, 4)):
            base.insert(r.randint(0, len(base)), r.choice('",\n @éA+I'))
        texts.append("".join(base))
    check(texts, layouts)


def test_very_long_and_repeated():
    long = "A" * 200_000
    check([f"@h\n{long}\n+\n{'I' * len(long)}"] * 3 + [f'@h,{long},"{"I" * len(long)}"'], ["fastq"] * 3 + ["csv"])


def test_frame(spark):
    rows = [(1, "fastq", "@h\nAC\n+\nII", "x"), (2, "csv", None, "y"), (3, None, "@h,AC,II", "z"), (3, "other", "a", "z")]
    raw = spark.createDataFrame(rows, "raw_id bigint, layout string, raw_text string, reason string")  # reason clashes
    got = sorted((r.raw_id, r.reason or "", r.header) for r in parse_records(raw).collect())
    assert got == [(1, "", "@h"), (2, "empty", None), (3, "layout", None), (3, "layout", None)]
    valid, rejected = split_records(raw.limit(0))
    assert valid.count() == rejected.count() == 0


@pytest.mark.parametrize("layout", ["fastq", "csv"])
def test_empty_batch(layout):
    check([], [])
