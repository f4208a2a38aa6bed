"""FASTQ and FASTA files as a Spark data source.

spark.dataSource.register(FastxDataSource); spark.read.format("fastx").load("a.fastq;b.fa.gz")

Plain files are cut into byte ranges and each range finds its first record itself: a FASTQ
record begins at a line with @ whose second next begins with + and whose sequence and quality
are of one length (a quality line may begin with @, too). Compressed files are one range, read in
blocks. read_ord is the file's number and the record's byte offset, so it is unique and in input
order without counting anything. Inputs are parted by ;, the files of an input by commas: one file,
both mates, or both mates with the index reads between them.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "read_ord bigint, file_name string, format string, header string, read_id string, sequence string, quality string, qual_offset int, input int, mate int"
RANGE = 64 << 20
BLOCK = 1 << 20
#: Mates by the number of files of an input; index reads are mate 0.
MATES = {1: (1,), 2: (1, 2), 3: (1, 0, 2)}
ROWS = 10_000
FILE_SHIFT = 44

# fixed values: header forms of which the offset is known, and the score of bases without quality
SANGER = re.compile(r" [12]:[NY]:")
NO_QUALITY = 11


def detect_offset(header: str, quality: str) -> int:
    """Offset of the quality characters, from one record."""
    if SANGER.search(header) or not quality:
        return 33
    codes = quality.encode("latin-1", "replace")
    return 33 if min(codes) < 59 else 64 if max(codes) > 74 else 33


def sniff(head: bytes) -> str:
    """fastq or fasta, by the first character that isn't white space; ValueError for anything else."""
    text = head.removeprefix(b"\xef\xbb\xbf").lstrip()
    if text[:1] in (b"@", b">"):
        return "fastq" if text[:1] == b"@" else "fasta"
    raise ValueError("neither FASTA nor FASTQ")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _is_gzip(path: str) -> bool:
    return path.lower().endswith(".gz")


class Range(InputPartition):
    def __init__(self, number: int, path: str, start: int, stop: int | None, input_: int = 0, mate: int = 1) -> None:
        self.number, self.path, self.start, self.stop, self.input, self.mate = number, path, start, stop, input_, mate


def _lines(data: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """Byte offset and text of each line, whatever its end."""
    if b"\r" not in data:
        for line in data.split(b"\n"):
            yield at, line
            at += len(line) + 1
        return
    for m in re.finditer(rb"([^\r\n]*)(\r\n|\r|\n|$)", data):
        yield at + m.start(), m[1]


def _streamed(blocks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """Byte offset and text of each line of blocks, whatever its end; holds one block and one line."""
    at, rest = 0, b""
    for block in blocks:
        data = rest + block
        whole = max(data.rfind(b"\n"), data.rfind(b"\r", 0, len(data) - 1)) + 1  # a CR at the end may be half a line end
        yield from list(_lines(data[:whole], at))[:-1]
        at, rest = at + whole, data[whole:]
    yield from _lines(rest, at)


def fastq_stream(lines: Iterator[tuple[int, bytes]], tolerant: bool) -> Iterator[tuple[int, str, str, str]]:
    """What fastq_records gives for a whole file, of lines that come one by one."""
    held: list[tuple[int, bytes]] = []
    for line in lines:
        if not held and not line[1].strip():
            continue
        held.append(line)
        while len(held) == 4:
            if _is_record(held, 0):
                yield held[0][0], *(held[i][1].decode("utf-8", "replace") for i in (0, 1, 3))
                held = []
            elif tolerant:
                held = held[1:]
                while held and not held[0][1].strip():
                    held = held[1:]
            else:
                raise ValueError(f"broken FASTQ record at byte {held[0][0]}")
    if not tolerant and any(x.strip() for _, x in held):
        raise ValueError(f"broken FASTQ record at byte {held[0][0]}")


def fastq_records(lines: list[tuple[int, bytes]], tolerant: bool, first: bool, stop: int = 1 << 62) -> Iterator[tuple[int, str, str, str]]:
    """offset, header, sequence, quality of records that begin before stop; a broken one raises, or is skipped up to the
    next record if tolerant. Unless first, what is before the first record belongs to the range before, which raises if
    a broken record begins where its last one ends."""
    k = 0 if first else _next_record(lines, 0)
    while k < len(lines) and lines[k][0] < stop:
        if not lines[k][1].strip():
            k += 1
            continue
        if _is_record(lines, k):
            yield lines[k][0], *(lines[k + i][1].decode("utf-8", "replace") for i in (0, 1, 3))
            k += 4
        elif tolerant:
            k = _next_record(lines, k + 1)
        else:
            raise ValueError(f"broken FASTQ record at byte {lines[k][0]}")
    while k < len(lines) and not lines[k][1].strip():
        k += 1
    if k < len(lines) and not tolerant and not _is_record(lines, k):
        raise ValueError(f"broken FASTQ record at byte {lines[k][0]}")


def _is_record(lines: list[tuple[int, bytes]], k: int) -> bool:
    return k + 3 < len(lines) and lines[k][1][:1] == b"@" and lines[k + 2][1][:1] == b"+" and len(lines[k + 1][1]) == len(lines[k + 3][1])


def _next_record(lines: list[tuple[int, bytes]], k: int) -> int:
    while k < len(lines) and not _is_record(lines, k):
        k += 1
    return k


def fasta_records(lines: list[tuple[int, bytes]]) -> Iterator[tuple[int, str, str, str]]:
    at, header, parts = 0, None, []
    for offset, line in lines:
        if line[:1] == b">":
            if header is not None:
                yield at, header, b"".join(parts).decode("utf-8", "replace"), ""
            at, header, parts = offset, line.decode("utf-8", "replace"), []
        elif header is not None:
            parts.append(b"".join(line.split()))
    if header is not None:
        yield at, header, b"".join(parts).decode("utf-8", "replace"), ""


class FastxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        inputs = [[p.strip() for p in x.split(",") if p.strip()] for x in options.get("path", "").split(";")]
        inputs = [x for x in inputs if x]
        if any(len(x) > 3 for x in inputs):
            raise ValueError("an input has one to three files: reads, both mates, or both mates and index reads")
        paths = [(p, n, m) for n, x in enumerate(inputs) for p, m in zip(x, MATES[len(x)], strict=True)]
        if not paths:
            raise ValueError("no path given")
        self.size = int(options.get("rangebytes", RANGE))
        self.form = options.get("fileformat", "auto")
        self.offset = options.get("offset", "auto")
        self.tolerant = options.get("mode", "FAILFAST").upper() != "FAILFAST"
        self.limit = int(options.get("firstreads", 0))
        self.files: list[tuple[str, int, int, int]] = []
        for path, number, mate in paths:
            fs, name = _open(path)
            info = fs.get_file_info(name)
            found = fs.get_file_info(pafs.FileSelector(name)) if info.type == pafs.FileType.Directory else [info]
            if info.type == pafs.FileType.NotFound:
                raise ValueError(f"no such file: {path}")
            prefix = path.split("://")[0] + "://" if "://" in path else ""
            self.files += sorted((prefix + f.path, f.size, number, mate) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for number, (path, size, input_, mate) in enumerate(self.files):
            if _is_gzip(path) or self.limit or size <= self.size:
                out.append(Range(number, path, 0, None, input_, mate))
            else:
                out += [Range(number, path, at, min(size, at + self.size), input_, mate) for at in range(0, size, self.size)]
        return out

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, name = _open(part.path)
        if _is_gzip(part.path):
            with fs.open_input_stream(name, compression=None) as source:
                yield from self._compressed(gzip.GzipFile(fileobj=io.BufferedReader(source)), part)
            return
        with fs.open_input_file(name) as source:
            form, known = self._begin(source)
            if form is None:
                return
            data = self._range(source, part, form)
        skip = 3 if part.start == 0 and data[:3] == b"\xef\xbb\xbf" else 0
        base = max(0, part.start - 1) if part.start else 0
        lines = list(_lines(data[skip:], base + skip))
        if part.start:  # the line that the cut went through belongs to the range before
            lines = lines[1:]
        stop = part.stop if part.stop is not None else 1 << 62
        if form == "fastq":
            records = fastq_records(lines, self.tolerant, part.start == 0, stop)
        else:
            records = fasta_records(lines[next((i for i, line in enumerate(lines) if line[1][:1] == b">"), len(lines)) :])
        yield from self._rows(records, part, form, known, stop)

    def _compressed(self, source: gzip.GzipFile, part: Range) -> Iterator[pa.RecordBatch]:
        first = b""
        while len(first) < 4 or not first.removeprefix(b"\xef\xbb\xbf").strip():
            more = source.read(BLOCK)
            if not more:
                break
            first += more
        if not first.removeprefix(b"\xef\xbb\xbf").strip():
            return
        form = sniff(first) if self.form == "auto" else self.form
        bom = 3 * first.startswith(b"\xef\xbb\xbf")
        lines = ((at + bom, line) for at, line in _streamed(chain([first[bom:]], iter(lambda: source.read(BLOCK), b""))))
        records = fastq_stream(lines, self.tolerant) if form == "fastq" else fasta_records(lines)
        one = next(records, None)
        if one is not None:
            yield from self._rows(chain([one], records), part, form, self._given() or (detect_offset(one[1], one[3]) if form == "fastq" else 33), 1 << 62)

    def _given(self) -> int | None:
        return None if self.offset == "auto" else {"1": 33, "2": 64}.get(self.offset, int(self.offset))

    def _begin(self, source) -> tuple[str | None, int]:
        """Form and offset of a file from its first record, however far that goes; None for an empty file."""
        size, have = source.size(), 1 << 14
        while True:
            data = source.read_at(min(have, size), 0).removeprefix(b"\xef\xbb\xbf")
            if data.strip():
                form = sniff(data) if self.form == "auto" else self.form
                if form == "fasta" or self._given():
                    return form, self._given() or 33
                lines = list(_lines(data, 0))
                record = next(fastq_records(lines if have >= size else lines[:-1], True, True), None)
                if record:
                    return form, detect_offset(record[1], record[3])
            if have >= size:
                return (form, 33) if data.strip() else (None, 33)
            have *= 4

    def _rows(self, records: Iterator[tuple[int, str, str, str]], part: Range, form: str, known: int, stop: int) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        short, seen = part.path.rsplit("/", 1)[-1], 0
        for at, header, sequence, quality in records:
            if at >= stop or (self.limit and seen >= self.limit):
                break
            seen += 1
            rows.append(((part.number << FILE_SHIFT) + at, short, form, header, re.split(r"\s", header[1:], maxsplit=1)[0], sequence.upper(), quality, known, part.input, part.mate))
            if len(rows) >= ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _range(self, source, part: Range, form: str) -> bytes:
        """The bytes of a range, one before it and as many after it as end its last record and the next one."""
        size, start = source.size(), max(0, part.start - 1)
        stop = size if part.stop is None else part.stop
        data, step = source.read_at(stop - start, start), 1 << 16
        while stop < size:
            more = source.read_at(min(step, size - stop), stop)
            data, stop, step = data + more, stop + len(more), step * 2
            tail = data[part.stop - start :]
            if (form == "fastq" and len(re.findall(rb"\S[^\r\n]*[\r\n]", tail)) > 10) or b"\n>" in tail or b"\r>" in tail:
                break
        return data

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.string()] * 6, *[pa.int32()] * 3]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class FastxDataSource(DataSource):
    """Options: path (;-separated inputs of files or folders), fileformat (auto, fastq, fasta), offset (auto, 33, 64, 59; 1 and 2
    for the first two), mode (FAILFAST, DROPMALFORMED), firstreads (so many of each file), rangebytes."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastxReader(dict(self.options))


def read_fastx(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    spark.dataSource.register(FastxDataSource)
    joined = paths if isinstance(paths, str) else ";".join(paths)
    return spark.read.format("fastx").options(**options).load(joined)


def read_mates(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """One row a pair of inputs R1,R2 or R1,index,R2: input, stem, r1, r2 and index_read as structs; null where a mate is missing.

    Mates are joined by what their ids share, not by their place, so files needn't be in step; same_mates() tells where they
    aren't. A mate that comes twice counts as first read.
    """
    from ..functions.sequence import pair_stem

    reads = read_fastx(spark, paths, **options).withColumn("stem", pair_stem(F.substr("header", F.lit(2))))
    struct = F.struct("read_ord", "header", "read_id", F.col("sequence").alias("seq"), "quality", "qual_offset")
    one = lambda m: F.min_by(F.when(F.col("mate") == m, struct), F.when(F.col("mate") == m, F.col("read_ord")))
    return reads.groupBy("input", "stem").agg(one(1).alias("r1"), one(2).alias("r2"), one(0).alias("index_read"))


def with_quality(fasta: DataFrame, qual: DataFrame) -> DataFrame:
    """FASTA records with the scores of a QUAL file (numbers, as read_qual gives them) in `scores` and as text of offset 33 in `quality`;
    NO_QUALITY for each base of a record without scores. Scores over 93 are 93 in the text, those under 0 are 0."""
    joined = fasta.drop("quality", "qual_offset").join(qual.select("read_id", "scores"), "read_id", "left")
    plain = F.transform(F.sequence(F.lit(1), F.length("sequence")), lambda _: F.lit(NO_QUALITY))
    empty = F.array().cast("array<int>")
    scored = joined.withColumn("scores", F.coalesce("scores", F.when(F.length("sequence") > 0, plain).otherwise(empty)))
    text = F.array_join(F.transform("scores", lambda x: F.chr(F.least(F.lit(93), F.greatest(F.lit(0), x)) + 33)), "")
    return scored.withColumns({"quality": text, "qual_offset": F.lit(33)})


def read_qual(spark: SparkSession, path: str) -> DataFrame:
    """read_id and scores of a QUAL file: header lines with >, numbers over any number of lines."""
    text = spark.read.option("lineSep", ">").text(path).withColumn("v", F.regexp_replace("value", "\r", "")).filter(F.trim("v") != "")
    head, body = F.substring_index("v", "\n", 1), F.expr("substr(v, instr(v, '\n') + 1)")
    numbers = F.filter(F.split(F.trim(F.regexp_replace(body, r"\s+", " ")), " "), lambda x: x != "")
    return text.select(F.regexp_extract(head, r"^\S+", 0).alias("read_id"), numbers.cast("array<int>").alias("scores"))


def same_mates(first: DataFrame, second: DataFrame, stem: Column | None = None) -> DataFrame:
    """Mates of two files whose ids don't agree at the same place; empty for a sound pair of files."""
    from ..functions.sequence import pair_stem
    from ..operators.keyed_chunks import number_rows, positioned_any

    def numbered(df: DataFrame) -> DataFrame:
        rows = positioned_any(df.orderBy("read_ord"), F.lit("all").alias("k"), pair_stem(F.col("read_id")).alias("stem"))
        return number_rows(rows, "k").select("_number", "stem")

    a, b = numbered(first), numbered(second)
    both = a.join(b.withColumnRenamed("stem", "other"), "_number", "full")
    return both.filter(~F.col("stem").eqNullSafe(F.col("other")))
