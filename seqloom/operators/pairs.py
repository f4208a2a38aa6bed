"""Read pairs: joining mates, merging overlaps, routing to outputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as fs
from ..functions.quality import error_of, text_bytes

MIN_OVERLAP = 12
MIN_IDENTITY = 0.9
TOP_SCORE = 40

COMPLEMENT = np.full(256, ord("N"), np.uint8)
COMPLEMENT[list(fs.CODES.encode())] = list(fs.COMPLEMENTS.encode())
PLAIN = np.isin(np.arange(256), list(b"ACGT"))


def joined(reads: DataFrame, keep: list[str], group: str = "seq_run", read_id: str = "read_id", order: str = "read_ord") -> DataFrame:
    """One row a pair: pair_id and r1, r2 structs of `keep`. A mate that was delivered again counts once, as first seen;
    a read without its mate has null in the other struct."""
    stem = fs.pair_stem(F.col(read_id))
    rows = reads.select(F.concat_ws("|", group, stem).alias("pair_id"), "mate", F.struct(*keep).alias("_r"), F.col(order).alias("_o"))
    first = lambda m: F.min_by(F.when(F.col("mate") == m, F.col("_r")), F.when(F.col("mate") == m, F.col("_o")))
    return rows.groupBy("pair_id").agg(first(1).alias("r1"), first(2).alias("r2"))


def _one_overlap(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """For long reads: only shifts on which a run of five bases is shared, which every good overlap has."""
    n, m = len(x), len(y)
    code = lambda a: np.lib.stride_tricks.sliding_window_view(a.astype(np.int64), 5) @ (256 ** np.arange(5))
    cx, cy = code(x), code(y)
    order = np.argsort(cy, kind="stable")
    lo, hi = (np.searchsorted(cy[order], cx, s) for s in ("left", "right"))
    i = np.repeat(np.arange(len(cx)), hi - lo)
    j = order[np.repeat(lo, hi - lo) + np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
    shifts = np.unique(i - j)
    sizes = np.minimum(n - np.maximum(shifts, 0), m - np.maximum(-shifts, 0))
    for k in np.lexsort((shifts, -sizes)):
        d, size = int(shifts[k]), int(sizes[k])
        if size < MIN_OVERLAP:
            break
        wrong = int((x[max(d, 0) : max(d, 0) + size] != y[max(-d, 0) : max(-d, 0) + size]).sum())
        if wrong <= size // 10 and 1 - wrong / size > MIN_IDENTITY:
            return size, d, wrong
    return 0, 0, 0


LONG = 600


def _overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Of each pair the longest good overlap: its size, the shift of y against x and the mismatches; size 0 if none.

    Pairs are laid side by side and every shift is one comparison of two matrices; reads over LONG bases go alone.
    """
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(xs)
    for k in range(len(xs)):
        if max(len(xs[k]), len(ys[k])) > LONG:
            out[k] = _one_overlap(xs[k], ys[k])
    rows = [k for k in range(len(xs)) if max(len(xs[k]), len(ys[k])) <= LONG]
    for at in range(0, len(rows), 512):
        part = rows[at : at + 512]
        n, m = (np.array([len(z[k]) for k in part]) for z in (xs, ys))
        a, b = np.zeros((len(part), n.max()), np.uint8), np.ones((len(part), m.max()), np.uint8)  # fillings never equal
        for r, k in enumerate(part):
            a[r, : n[r]], b[r, : m[r]] = xs[k], ys[k]
        best, shift, wrong = (np.zeros(len(part), np.int64) for _ in range(3))
        for d in range(-(b.shape[1] - MIN_OVERLAP), a.shape[1] - MIN_OVERLAP + 1):
            i, j = max(d, 0), max(-d, 0)
            size = np.minimum(n - i, m - j)
            width = min(a.shape[1] - i, b.shape[1] - j)
            bad = size - (a[:, i : i + width] == b[:, j : j + width]).sum(1)
            better = (size >= MIN_OVERLAP) & (size > best) & (bad <= size // 10) & (bad < (1 - MIN_IDENTITY) * size)
            best, shift, wrong = np.where(better, size, best), np.where(better, d, shift), np.where(better, bad, wrong)
        for r, k in enumerate(part):
            out[k] = (int(best[r]), int(shift[r]), int(wrong[r]))
    return out


TOP = 94


def _score_table() -> np.ndarray:
    """Score of a base by [the mates agree, score of one, score of the other]."""
    q = np.arange(TOP)
    p, r = error_of(q)[:, None], error_of(q)[None, :]
    low, high = np.minimum(p, r), np.maximum(p, r)
    right = p * r / 3 / np.maximum(1 - p - r + 4 * p * r / 3, 1e-12)
    wrong = low * (1 - high / 3) / (p + r - 4 * p * r / 3)
    made = np.floor(-10 * np.log10(np.maximum(np.stack((wrong, right)), 1e-12)) + 0.5)
    return np.clip(made, 0, TOP_SCORE).astype(np.int64)


SCORES = _score_table()


MERGED = "seq string, quality string, overlap int, mismatches int, merge_length int"


def merged(seq1: Column, quality1: Column, seq2: Column, quality2: Column, offset1: Column, offset2: Column) -> Column:
    """Both mates as one read, null if they don't overlap: seq, quality (offset 33), overlap, mismatches, merge_length.

    The second mate is taken as reverse complement. Of all shifts with an overlap of at least MIN_OVERLAP, an identity
    over MIN_IDENTITY and at most a tenth mismatches the longest is taken. In the overlap the higher score wins, a plain
    base before an ambiguous one; scores follow from the two error probabilities. Overhangs beyond the other mate's
    start (the insert is shorter than the reads) are cut. Ambiguous ends are stripped; reads with other ambiguous bases,
    and those where a mate has none or under 20 bases, are null.
    """

    @F.arrow_udf(MERGED)
    def kernel(s1: pa.Array, q1: pa.Array, s2: pa.Array, q2: pa.Array, o1: pa.Array, o2: pa.Array) -> pa.Array:
        (a, at), (qa, qat), (b, bt), (qb, qbt) = (text_bytes(x) for x in (s1, q1, s2, q2))
        oa, ob = (o.fill_null(33).to_numpy(zero_copy_only=False) for o in (o1, o2))
        cut = lambda flat, bounds, i: flat[bounds[i] : bounds[i + 1]]
        rows = []
        for i in range(len(s1)):
            x, y = cut(a, at, i), COMPLEMENT[cut(b, bt, i)][::-1]
            p, q = cut(qa, qat, i).astype(np.int64) - oa[i], cut(qb, qbt, i).astype(np.int64)[::-1] - ob[i]
            if min(len(x), len(y)) >= 20 and len(p) == len(x) and len(q) == len(y):
                rows.append((i, x, y, p, q))
        overlaps = _overlaps([r[1] for r in rows], [r[2] for r in rows])
        out: list[dict | None] = [None] * len(s1)
        for (i, x, y, p, q), (size, d, wrong) in zip(rows, overlaps, strict=True):
            n, m = len(x), len(y)
            if not size:
                continue
            i0, j0 = max(d, 0), max(-d, 0)
            u, v, pu, qv = x[i0 : i0 + size], y[j0 : j0 + size], p[i0 : i0 + size], q[j0 : j0 + size]
            agree = u == v
            second = (qv > pu) & PLAIN[v] | (PLAIN[v] & ~PLAIN[u])
            core = np.where(second, v, u)
            score = SCORES[agree.astype(np.int64), np.clip(pu, 0, TOP - 1), np.clip(qv, 0, TOP - 1)]
            head, tail = (x[:i0], p[:i0]) if d >= 0 else (x[:0], p[:0]), (y[j0 + size :], q[j0 + size :]) if m - j0 > n - i0 else (y[:0], q[:0])
            seq = np.concatenate((head[0], core, tail[0]))
            qual = np.clip(np.concatenate((head[1], score, tail[1])), 0, 93).astype(np.uint8) + 33
            plain = np.flatnonzero(PLAIN[seq])
            if not len(plain) or len(plain) != plain[-1] - plain[0] + 1:
                continue
            part = slice(plain[0], plain[-1] + 1)
            out[i] = {"seq": seq[part].tobytes().decode("ascii"), "quality": qual[part].tobytes().decode("ascii"), "overlap": size, "mismatches": wrong, "merge_length": len(plain)}
        kinds = [("seq", pa.string()), ("quality", pa.string()), ("overlap", pa.int32()), ("mismatches", pa.int32()), ("merge_length", pa.int32())]
        return pa.array(out, pa.struct(kinds))

    return kernel(seq1, quality1, seq2, quality2, offset1, offset2)


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """joined() pairs with both mates as one row each with `merge`; structs need seq, quality and qual_offset."""
    both = pairs.filter("r1 IS NOT NULL AND r2 IS NOT NULL")
    return both.withColumn("merge", merged(*[F.col(c) for c in ("r1.seq", "r1.quality", "r2.seq", "r2.quality", "r1.qual_offset", "r2.qual_offset")]))


def merge_statistics(merges: DataFrame, groups: list[str]) -> DataFrame:
    return merges.groupBy(*groups).agg(F.count("*").alias("n_pairs"), F.count("merge").alias("n_merged"), F.avg("merge.overlap").alias("mean_overlap"), F.avg("merge.mismatches").alias("mean_mismatches"))


def routed(pairs: DataFrame, tier: str = "tier") -> DataFrame:
    """pair_id, mate, stream, slot: where each mate of a pair goes.

    Both mates of one tier go to its pair outputs; a mate whose partner fails goes to the single output of its tier;
    mates of different tiers go as singles too, as pairs must stay in step. Failed mates go nowhere.
    """
    t1, t2 = (F.coalesce(F.col(f"r{k}.{tier}"), F.lit("failed")) for k in (1, 2))
    passed = lambda t: t.isin("green", "yellow")
    rows = F.array(F.struct(F.lit(1).alias("mate"), t1.alias("mine"), t2.alias("other")), F.struct(F.lit(2).alias("mate"), t2.alias("mine"), t1.alias("other")))
    long = pairs.select("pair_id", F.explode(rows).alias("m")).select("pair_id", "m.*").filter(passed(F.col("mine")))
    slot = F.when(F.col("mine") == F.col("other"), F.concat(F.lit("pair"), F.col("mate").cast("string"))).otherwise(F.concat(F.lit("single"), F.col("mate").cast("string")))
    return long.select("pair_id", "mate", F.col("mine").alias("stream"), slot.alias("slot"))


def oriented(pairs: DataFrame, start1: Column, start2: Column) -> DataFrame:
    """Mates swapped where the forward primer stands in the second read and not in the first."""
    swap = (start2 >= 0) & (F.coalesce(start1, F.lit(-1)) < 0)
    return pairs.withColumns({"r1": F.when(swap, F.col("r2")).otherwise(F.col("r1")), "r2": F.when(swap, F.col("r1")).otherwise(F.col("r2")), "swapped": F.coalesce(swap, F.lit(False))})


def subset(reads: DataFrame, wanted: DataFrame, read_id: str = "read_id") -> DataFrame:
    """Reads of a list (read_id[, new_header][, out_file]) once each, in the order of the list's first mention."""
    return reads.join(wanted.dropDuplicates([read_id]), read_id)


def excluded(reads: DataFrame, wanted: DataFrame, read_id: str = "read_id") -> DataFrame:
    return reads.join(wanted.select(read_id), read_id, "left_anti")
