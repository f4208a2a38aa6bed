"""Outputs: FASTQ, FASTA and QUAL text, routed to files by tier, sample or list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import rebased
from ..functions.sequence import wrap


def fastq_text(header: Column, seq: Column, quality: Column, length: Column | None = None) -> Column:
    """The four lines of a record; header without @, cut to the effective length if given."""
    cut = (lambda c: c) if length is None else (lambda c: F.substr(c, F.lit(1), length))
    return F.concat(F.lit("@"), header, F.lit("\n"), cut(seq), F.lit("\n+\n"), cut(quality))


def fasta_text(header: Column, seq: Column, one_line: bool = False) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq if one_line else wrap(seq))


def qual_text(header: Column, quality: Column, offset: Column, per_line: int = 80) -> Column:
    """Scores as numbers, so many a line."""
    numbers = F.transform(F.split(quality, ""), lambda c: (F.ascii(c) - offset).cast("string"))
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / per_line)), lambda k: F.array_join(F.slice(numbers, k * per_line + 1, per_line), " "))
    return F.concat(F.lit(">"), header, F.lit("\n"), F.array_join(lines, "\n"))


def write_text(df: DataFrame, text: Column, path: str, by: list[str] | None = None, gzip: bool = False, max_records: int = 0) -> None:
    """One line group a row, into a folder for each value of `by`; max_records starts another file after so many."""
    made = df.select(*[F.col(c) for c in by or []], text.alias("_text"))
    writer = made.write.option("lineSep", "\n").option("maxRecordsPerFile", max_records)
    if gzip:
        writer = writer.option("compression", "gzip")
    (writer.partitionBy(*by) if by else writer).text(path)


def write_fastq(df: DataFrame, path: str, header: str = "read_id", by: list[str] | None = None, offset: int = 33, length: str | None = None, **options) -> None:
    q = rebased(F.col("quality"), F.col("qual_offset"), offset)
    write_text(df.withColumn("_q", q), fastq_text(F.col(header), F.col("seq"), F.col("_q"), F.col(length) if length else None), path, by, **options)


def write_fasta(df: DataFrame, path: str, header: str = "read_id", by: list[str] | None = None, one_line: bool = False, **options) -> None:
    write_text(df, fasta_text(F.col(header), F.col("seq"), one_line), path, by, **options)


def write_tiers(routed: DataFrame, path: str, suppress: tuple[str, ...] = (), **options) -> None:
    """Reads with stream and slot to a folder for each; streams in `suppress` are not written."""
    write_fastq(routed.filter(~F.col("stream").isin(*suppress)) if suppress else routed, path, by=["stream", "slot"], **options)


def write_samples(graded: DataFrame, path: str, **options) -> None:
    """First-tier reads to a folder for each sample, with their own ids."""
    write_fastq(graded.filter("tier = 'green' AND sample_id IS NOT NULL"), path, by=["sample_id", "mate"], **options)


def write_unassigned(pairs: DataFrame, path: str, **options) -> None:
    """Pairs of which neither mate has a sample."""
    none = pairs.filter("r1.sample_id IS NULL AND r2.sample_id IS NULL")
    rows = none.select(F.explode(F.array(F.struct(F.lit(1).alias("mate"), "r1.*"), F.struct(F.lit(2).alias("mate"), "r2.*"))).alias("r")).select("r.*").filter("seq IS NOT NULL")
    write_fastq(rows, path, by=["mate"], **options)


def write_listed(listed: DataFrame, path: str, rest: DataFrame | None = None, **options) -> None:
    """Reads of a list to the file each names; the others to `excluded`, if given."""
    write_fastq(listed.withColumn("out_file", F.coalesce("out_file", F.lit("listed"))), f"{path}/listed", by=["out_file"], **options)
    if rest is not None:
        write_fastq(rest, f"{path}/excluded", **options)


def write_derep(derep: DataFrame, occurrences: DataFrame, samples: DataFrame, passing: Column, path: str) -> None:
    """passing and rest as FASTA with sizes, and the map of counts by sample, from one evaluation of the plan.

    derep: key, total; occurrences: key, occurrences ('idx:count' entries).
    """
    from ..session import written

    named = written(derep.join(occurrences.select("key", "occurrences"), "key").withColumn("_p", passing))
    title = F.concat(F.substr(F.sha2("key", 256), F.lit(1), F.lit(16)), F.lit(";size="), F.col("total").cast("string"), F.lit(";"))
    for name, part in (("passing", named.filter("_p")), ("rest", named.filter("NOT _p"))):
        write_text(part, F.concat(F.lit(">"), title, F.lit("\n"), F.col("key")), f"{path}/{name}")
    head = samples.agg(F.array_sort(F.collect_list(F.struct("sample_idx", "sample_id"))).alias("s")).select(F.concat(F.lit("#SMPLS\t"), F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["sample_idx"].cast("string"), x["sample_id"])), "\t")).alias("_text"))
    head.coalesce(1).write.text(f"{path}/map_head")
    write_text(named, F.concat_ws("\t", title, F.col("occurrences")), f"{path}/map")


def write_reports(graded: DataFrame, path: str) -> None:
    """The reports of a run, a folder of tab-separated text each: counters, reads accepted by sample and by file, lengths and mean
    qualities as histograms, bases. The graded reads are written once and read by each report."""
    from ..operators import reports
    from ..session import written

    g = written(graded)
    accepted = {f"accepted_by_{c.removesuffix('_id').removesuffix('_name')}": reports.accepted_by(g.filter(F.col(c).isNotNull()), [c]) for c in ("sample_id", "file_name") if c in g.columns}
    passed = g.filter(F.col("tier") != "failed")
    tables = {
        "counters": reports.counters(g),
        **accepted,
        "lengths": reports.histogram(passed, F.col("length"), ["mate"]),
        "mean_qualities": reports.histogram(passed, F.floor(F.col("mean_quality") + 0.5), ["mate"]),
        "bases": reports.base_table(passed, ["mate"]),
    }
    for name, t in tables.items():
        write_table(t, f"{path}/{name}")


def write_table(df: DataFrame, path: str) -> None:
    """A report or matrix as tab-separated text with a header."""
    df.write.option("sep", "\t").option("header", True).csv(path)


def write_seeds(seeds: DataFrame, path: str, **options) -> None:
    """Representatives named after their cluster, .1 and .2 for mates."""
    name = F.concat("otu", F.when(F.col("mate").isNotNull(), F.concat(F.lit("."), F.col("mate").cast("string"))).otherwise(F.lit("")))
    write_fastq(seeds.withColumn("_name", name), path, header="_name", **options)
