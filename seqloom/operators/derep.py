"""Dereplication: one row for each different search key, with counts by sample.

Counts are taken by (key, sample) first, so a key that a third of all reads has leaves one row a
sample and map task before anything is gathered; no group holds reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import text_bytes
from .config import FilterConfig

#: Bases of a key where no options say it.
KEY_LENGTH = 150


def keyed(reads: DataFrame, length: int = -1, seq: str = "seq") -> DataFrame:
    """reads with `key`: the first `length` bases, or all of them."""
    return reads.withColumn("key", F.col(seq) if length < 0 else F.substr(seq, F.lit(1), F.lit(length)))


def key_length(config: FilterConfig) -> int:
    """Length of the key: derepSrchLen (-1: the whole read), without it the least length of a read, or KEY_LENGTH."""
    if config.derep_length is not None:
        return config.derep_length
    return config.min_length if config.min_length > 0 else KEY_LENGTH


def opened(reads: DataFrame, keys: list[str], order: str = "read_ord") -> DataFrame:
    """Reads with a sample that count: those from the key's first green read on. Keys without a green read have none."""
    have = reads.filter("sample_id IS NOT NULL")
    first = have.filter("tier = 'green'").groupBy(*keys).agg(F.min(order).alias("_open"))
    return have.join(first, keys).filter(F.col(order) >= F.col("_open")).drop("_open")


def occurrences(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sample_id, n."""
    return reads.groupBy(*keys, "sample_id").agg(F.count("*").alias("n"))


def dereplicated(occ: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, n_samples, largest (the greatest count of a sample)."""
    return occ.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("n_samples"), F.max("n").alias("largest"))


def occurrence_text(occ: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, occurrences: 'idx:count' by sample, at most one entry for each sample of the map."""
    named = occ.join(samples.select("sample_id", "sample_idx"), "sample_id")
    entry = F.struct("sample_idx", F.concat_ws(":", "sample_idx", "n").alias("t"))
    listed = named.groupBy(*keys).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(entry)).alias("e"))
    return listed.select(*keys, "total", F.array_join(F.col("e.t"), "\t").alias("occurrences"))


def parse_min_copies(spec: str) -> list[int | None]:
    """'10:1,3:3' to thresholds by number of samples (from one on): [10, None, 3]."""
    out: dict[int, int] = {}
    for part in spec.split(","):
        copies, _, samples = part.strip().partition(":")
        out[int(samples or 1)] = int(copies)
    return [out.get(k) for k in range(1, max(out) + 1)]


def enough_copies(spec: str, total: Column, n_samples: Column, strict: Column | None = None) -> Column:
    """Whether a key has enough copies: the total reaches a threshold set for as many samples as it has, or fewer."""
    ok = F.lit(False)
    for k, copies in enumerate(parse_min_copies(spec), 1):
        if copies is not None:
            ok |= (n_samples >= k) & ((total if strict is None else strict) >= copies)
    return ok


def enough_in_sample(occ: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys where a sample has as many copies as its own row of the map asks for."""
    asked = occ.join(samples.filter("derep_min IS NOT NULL").select("sample_id", "derep_min"), "sample_id")
    return asked.filter("n >= derep_min").select(*keys).distinct()


def ranked(derep: DataFrame, keys: list[str]) -> DataFrame:
    """By total, most first; ties by key."""
    return derep.orderBy(F.desc("total"), *keys)


#: Positions of a key whose sums are one row.
SPAN = 256


def mean_quality(reads: DataFrame, key: str, quality: str = "quality", offset: str = "qual_offset") -> DataFrame:
    """key, position (from 0), mean: the rounded mean score of each base over all reads of a key; scores under 0 count 0.

    A batch leaves one row for a key and SPAN positions with arrays of sums and counts, which are added up by position
    before the key is spread over its positions; a null key is a key.
    """

    def spans(k: pa.Array, sums: np.ndarray, n: np.ndarray, place: np.ndarray, key_of: np.ndarray) -> pa.RecordBatch:
        """One row for each key and span of rows ordered by key and position."""
        span = place // SPAN
        first = np.flatnonzero(np.concatenate(([True], (key_of[1:] != key_of[:-1]) | (span[1:] != span[:-1])))) if len(place) else np.zeros(0, np.int64)
        bounds = pa.array(np.concatenate((first, [len(place)])).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (place.astype(np.int32), sums, n)]
        return pa.RecordBatch.from_arrays([k.take(pa.array(key_of[first])), pa.array(span[first].astype(np.int32)), *lists], ["k", "span", "p", "s", "n"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, at = text_bytes(batch.column(1))
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            score = np.maximum(flat.astype(np.int64) - batch.column(2).fill_null(33).to_numpy(zero_copy_only=False)[row], 0)
            coded = batch.column(0).dictionary_encode("encode")
            width = max(1, int(n.max(initial=1)))
            pair = coded.indices.to_numpy().astype(np.int64)[row] * width + np.arange(len(flat)) - at[:-1][row]
            order = np.argsort(pair, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], pair[order][1:] != pair[order][:-1]))) if len(pair) else np.zeros(0, np.int64)
            found = pair[order][first]
            sums = np.add.reduceat(score[order], first) if len(first) else np.zeros(0, np.int64)
            yield spans(coded.dictionary, sums, np.diff(np.concatenate((first, [len(pair)]))).astype(np.int64), found % width, found // width)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key and span, whole ones at a time, to means by position."""
        for rows in whole_groups(batches, 2):
            key_of = group_numbers(rows, 2)
            p, s, n = (rows.column(c).combine_chunks() for c in ("p", "s", "n"))
            sizes = np.diff(p.offsets.to_numpy())
            where = np.repeat(key_of, sizes) * SPAN + p.flatten().to_numpy() % SPAN
            total, count = (np.bincount(where, x.flatten().to_numpy(), (key_of[-1] + 1) * SPAN) for x in (s, n))
            at = np.flatnonzero(count)
            first = np.flatnonzero(np.concatenate(([True], key_of[1:] != key_of[:-1])))
            span = rows.column("span").combine_chunks().to_numpy()[first]
            mean = np.floor(total[at] / count[at] + 0.5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column("k").combine_chunks().take(pa.array(first[at // SPAN])), pa.array((span[at // SPAN] * SPAN + at % SPAN).astype(np.int32)), pa.array(mean)], ["k", "position", "mean"])

    kind = reads.schema[key].dataType.simpleString()
    parts = reads.select(key, quality, offset).mapInArrow(local, f"k {kind}, span int, p array<int>, s array<bigint>, n array<bigint>")
    ordered = parts.repartition("k", "span").sortWithinPartitions("k", "span")
    return ordered.mapInArrow(means, f"k {kind}, position int, mean int").withColumnRenamed("k", key)


def group_numbers(rows: pa.Table, columns: int) -> np.ndarray:
    """The number of each row's group, from 0, of rows sorted by their first columns; nulls are equal."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in range(columns):
        code = rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new) - 1


def whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Tables of whole groups of rows sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        number = group_numbers(rows, columns)
        cut = int(np.searchsorted(number, number[-1]))  # the last group may go on
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def best_subgroup(reads: DataFrame, key: str, merge_length: str) -> DataFrame:
    """key, merge_length, n: the subgroup of a key (reads merged to one length, or unmerged: null) that stands for it.

    Score: count, times 0.8 if unmerged, times its length by the longest; the first of the greatest in order of length.
    """
    counts = reads.groupBy(key, merge_length).agg(F.count("*").alias("n"))
    own = Window.partitionBy(key)
    part = F.coalesce(F.col(merge_length) / F.max(merge_length).over(own), F.lit(1.0))
    scored = counts.withColumn("_s", F.col("n") * F.when(F.col(merge_length).isNull(), 0.8).otherwise(part)).withColumn("total", F.sum("n").over(own))
    first = F.row_number().over(own.orderBy(F.desc("_s"), F.col(merge_length).asc_nulls_first()))
    return scored.withColumn("_k", first).filter("_k = 1").drop("_k", "_s")


def report(derep: DataFrame, passing: Column) -> DataFrame:
    return derep.agg(F.count("*").alias("uniques"), F.sum("total").alias("reads"), F.count_if(passing).alias("passing"), F.count_if(~passing).alias("not_passing"), F.avg(F.length("key")).alias("mean_key_length"))
