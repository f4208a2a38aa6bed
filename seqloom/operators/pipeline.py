"""From raw reads to graded reads of samples, as one lazy plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matching
from ..functions import sequence as fs
from . import samples as sample_ops
from .config import FilterConfig, require_implemented
from .tiers import graded

#: How far into a read a primer may begin, and an adapter; and in an extensive search, as a part of the read.
PRIMER_SCAN, ADAPTER_SCAN, EXTENSIVE = 22, 40, 0.75
#: Different forward primers of a map by which mates are told apart, at most.
PRIMERS = 64
#: Quality offsets by fastqVersion; any other is 59.
PHRED = {"1": 33, "2": 64}


def _cut(df: DataFrame, start: Column, stop: Column | None = None) -> DataFrame:
    """Bases and scores from start (0-based) to before stop."""
    length = F.length("seq") if stop is None else stop - start
    return df.withColumns({c: F.substr(c, start + 1, F.greatest(F.lit(0), length)) for c in ("seq", "quality")})


def without_adapter(df: DataFrame, adapter: str) -> DataFrame:
    """An exact adapter at the start is cut."""
    return _cut(df, F.when(F.startswith("seq", F.lit(adapter)), F.lit(len(adapter))).otherwise(F.lit(0))) if adapter else df


def clip_adapters(df: DataFrame, adapters: list[str], errors: int = 1) -> DataFrame:
    """For reads without a sample map: what stands before the end of each adapter (begun within ADAPTER_SCAN bases) is cut,
    one adapter after another; n_clipped counts them."""
    out = df.withColumn("n_clipped", F.lit(0))
    for adapter in adapters:
        at = matching.match_forward(F.col("seq"), F.lit(adapter), errors, ADAPTER_SCAN)
        out = out.withColumn("_at", at).withColumn("n_clipped", F.col("n_clipped") + (F.col("_at") >= 0).cast("int"))
        out = _cut(out, F.when(F.col("_at") >= 0, F.col("_at") + len(adapter)).otherwise(F.lit(0))).drop("_at")
    return out


def reoriented(df: DataFrame, primer: str, errors: int = 1, part: float = 0) -> DataFrame:
    """Reads whose primer stands on the other strand only are turned; `turned` says which."""
    here = matching.match_forward(F.col("seq"), F.col(primer), errors, PRIMER_SCAN, part=part)
    there = matching.match_forward(F.col("_rc"), F.col(primer), errors, PRIMER_SCAN, part=part)
    both = df.withColumn("_rc", fs.revcomp(F.col("seq"))).withColumns({"_h": here, "_t": there})
    both = both.withColumn("turned", (F.coalesce("_h", F.lit(0)) < 0) & (F.coalesce("_t", F.lit(-1)) >= 0))
    turn = both.withColumn("seq", F.when(F.col("turned"), F.col("_rc")).otherwise(F.col("seq"))).withColumn("quality", F.when(F.col("turned"), F.reverse("quality")).otherwise(F.col("quality")))
    return turn.drop("_rc", "_h", "_t")


def primers_cut(df: DataFrame, config: FilterConfig) -> DataFrame:
    """Cuts the sample's forward primer and what is before it, and the reverse primer and what is behind it.

    `second` marks reads that passed with the looser number of errors, or without a primer that is asked for and may be
    missing in the second tier; `no_primer` marks those that fail for it. Samples without a primer ask for none.
    """
    c, part = config, EXTENSIVE if config.extensive_primers else 0
    first = matching.match_forward(F.col("seq"), F.col("forward_primer"), c.primer_errors, PRIMER_SCAN, part=part)
    df = df.withColumn("_f", first).withColumns({"second": F.lit(False), "no_primer": F.lit(False)})
    if c.primer_errors_2 is not None:
        loose = matching.match_forward(F.col("seq"), F.col("forward_primer"), c.primer_errors_2, PRIMER_SCAN, part=part)
        df = df.withColumn("_g", loose).withColumn("second", (F.col("_f") < 0) & (F.col("_g") >= 0)).withColumn("_f", F.greatest("_f", "_g")).drop("_g")
    missing = F.coalesce(F.col("_f") < 0, F.lit(False))
    if c.need_forward_primer:
        df = df.withColumn("no_primer" if c.need_forward_primer_2 else "second", missing | F.col("no_primer" if c.need_forward_primer_2 else "second"))
    start = F.when(F.col("_f") >= 0, F.col("_f") + (F.lit(0) if c.keep_primer else F.length("forward_primer"))).otherwise(F.lit(0))
    df = _cut(df, start).withColumn("forward_found", F.coalesce(F.col("_f") >= 0, F.lit(False))).drop("_f")
    back = matching.match_reverse(F.col("seq"), F.col("_rp"), c.primer_errors)
    df = df.withColumn("_rp", fs.revcomp(F.col("reverse_primer"))).withColumn("_r", back)
    if c.primer_errors_2 is not None:  # a second try with more errors, which makes a read second tier
        loose = matching.match_reverse(F.col("seq"), F.col("_rp"), c.primer_errors_2)
        df = df.withColumn("_g", loose).withColumn("second", F.col("second") | F.coalesce((F.col("_r") < 0) & (F.col("_g") >= 0), F.lit(False))).withColumn("_r", F.greatest("_r", "_g")).drop("_g")
    found = F.coalesce(F.col("_r") >= 0, F.lit(False))
    if c.need_reverse_primer:
        lost = ~found & (F.col("reverse_primer") != "")
        df = df.withColumn("no_primer" if c.need_reverse_primer_2 else "second", F.coalesce(lost, F.lit(False)) | F.col("no_primer" if c.need_reverse_primer_2 else "second"))
    stop = F.when(found, F.col("_r") + (F.length("_rp") if c.keep_primer else F.lit(0))).otherwise(F.length("seq"))
    return _cut(df.withColumn("reverse_found", found), F.lit(0), stop).drop("_r", "_rp")


def _offset(reads: DataFrame, config: FilterConfig) -> DataFrame:
    return reads if config.phred == "auto" else reads.withColumn("qual_offset", F.lit(PHRED.get(config.phred, 59)))


def _graded(primed: DataFrame, config: FilterConfig, none: Column, quality_filter: bool) -> DataFrame:
    lost = F.col("no_primer")
    if not quality_filter:
        tier = F.when(none, "unassigned").when(lost, "failed").when(F.col("second"), "yellow").otherwise("green")
        return primed.withColumn("tier", tier).withColumn("length", F.length("seq"))
    g = primed.withColumn("_g", graded(F.col("seq"), F.col("quality"), F.col("qual_offset"), F.col("mate"), config, F.col("second"))).select("*", "_g.*").drop("_g")
    return g.withColumn("tier", F.when(none, "unassigned").when(lost, "failed").otherwise(F.col("tier")))


def voted(reads: DataFrame, samples: DataFrame, seq: str = "seq") -> DataFrame:
    """The sample map, its barcodes turned to the other strand if the reads' vote says so. One row is asked for at once."""
    vote = sample_ops.strand_votes(reads, samples, seq).first()
    return samples.withColumn("barcode_sequence", fs.revcomp(F.col("barcode_sequence"))) if vote and vote["swap"] else samples


def demultiplexed(reads: DataFrame, samples: DataFrame | None, config: FilterConfig, quality_filter: bool = True, clip: list[str] | None = None) -> DataFrame:
    """reads (seq with barcode and primer, quality, qual_offset, mate) with sample_idx, sample_id, the cut seq and quality,
    tier, length and reasons. Without barcode: tier `unassigned`. quality_filter=False only assigns and cuts: reads are
    first or second tier by their primers, as seed reads are.

    Without a map (None) no sample is asked for: adapters in `clip` and the start of reads are cut instead.
    """
    require_implemented(config)
    if config.check_mixed_pairs:
        raise ValueError("CheckForMixedPairs needs pairs: demultiplexed_pairs")
    reads = _offset(reads.drop("sample_id", "sample_idx"), config)
    if samples is None:
        cut = clip_adapters(without_adapter(reads, config.adapter), clip or [])
        cut = _cut(cut, F.lit(config.trim_start)) if config.trim_start else cut
        none = F.lit(None).cast("string")
        bare = cut.withColumns({"sample_idx": none.cast("int"), "sample_id": none, "second": F.lit(False), "no_primer": F.lit(False)})
        return _graded(bare, config, F.lit(False), quality_filter)
    found = sample_ops.by_barcode(reads, samples, "seq", matching.SCAN, config.barcode_errors)
    named = found.join(samples.select("sample_idx", "sample_id", "forward_primer", "reverse_primer", F.length("barcode_sequence").alias("_w")), "sample_idx", "left")
    if not config.keep_barcode:
        named = _cut(named, F.when(F.col("sample_idx").isNotNull(), F.col("start") + F.col("_w")).otherwise(F.lit(0)))
    named = without_adapter(named.drop("_w"), config.adapter)
    if config.extensive_primers or config.check_reversed:
        named = reoriented(named, "forward_primer", config.primer_errors, EXTENSIVE if config.extensive_primers else 0).drop("turned")
    return _graded(primers_cut(named, config), config, F.col("sample_idx").isNull(), quality_filter)


def mates_in_order(pairs: DataFrame, samples: DataFrame, config: FilterConfig) -> DataFrame:
    """Pairs whose forward primer stands in the second mate and not in the first, swapped; primers are those of the map."""
    from .pairs import oriented

    primers = [r[0] for r in samples.filter("forward_primer <> ''").select("forward_primer").distinct().limit(PRIMERS + 1).collect()]
    if len(primers) > PRIMERS:
        raise ValueError(f"mates can't be told apart by over {PRIMERS} primers")
    part = EXTENSIVE if config.extensive_primers else 0.5
    starts = [F.greatest(F.lit(-1), *[matching.match_forward(F.col(f"r{k}.seq"), F.lit(p), config.primer_errors, part=part) for p in sorted(primers)], F.lit(-1)) for k in (1, 2)]
    with_starts = pairs.withColumns({"_s1": starts[0], "_s2": starts[1]})
    return oriented(with_starts, F.col("_s1"), F.col("_s2")).drop("_s1", "_s2")


def demultiplexed_pairs(pairs: DataFrame, samples: DataFrame, config: FilterConfig, pair: str = "pair_id") -> DataFrame:
    """Pairs (pair, structs r1 and r2 of read_ord, seq, quality, qual_offset, and index_read where there are index reads) to graded mates:
    pair, mate, sample_idx, sample_id, cut seq and quality, tier, length and reasons.

    The sample is that of the barcode at the start of the index read, or else of the first mate; where the map row has a second
    barcode, the second mate must begin with it. Both mates get the pair's sample. The first mate loses the forward primer at its start and the
    reverse primer's other strand at its end, the second mate the other way round. A missing mate has no row.
    """
    require_implemented(config)
    if config.check_mixed_pairs:
        pairs = mates_in_order(pairs, samples, config)
    place = "index_read.seq" if "index_read" in pairs.columns else "r1.seq"
    second = sample_ops.barcode_list(samples, "barcode2nd_pair")
    codes = sorted({b for b, _ in sample_ops.barcode_list(samples)})
    partners = sorted({b for b, _ in second})
    one = matching.find_barcode(F.coalesce(F.col(place), F.lit("")), [(b, i) for i, b in enumerate(codes)], matching.SCAN, config.barcode_errors)
    two = matching.find_barcode(F.coalesce(F.col("r2.seq"), F.lit("")), [(b, i) for i, b in enumerate(partners)], matching.SCAN, config.barcode_errors)
    none = F.lit(None).cast("string")
    text = lambda found, listed: F.when(found["sample_idx"].isNotNull(), F.element_at(F.array(*map(F.lit, listed)), found["sample_idx"] + 1)) if listed else none
    found = pairs.withColumns({"_1": one, "_2": two}).withColumns({"_c1": text(F.col("_1"), codes), "_c2": text(F.col("_2"), partners)})
    listed = samples.filter("barcode_sequence <> ''").select("sample_idx", "sample_id", "forward_primer", "reverse_primer", F.col("barcode_sequence").alias("_c1"), F.nullif("barcode2nd_pair", F.lit("")).alias("_wanted"))
    named = found.join(listed, "_c1").filter(F.col("_wanted").isNull() | (F.col("_wanted") == F.col("_c2")))
    # a row that names both barcodes goes before one that takes any second one
    first = named.groupBy(pair).agg(F.min_by(F.struct("sample_idx", "sample_id", "forward_primer", "reverse_primer", (F.length("_wanted") > 0).alias("both")), F.struct(F.col("_wanted").isNull(), "sample_idx")).alias("s"))
    joined = found.join(first, pair, "left")
    there = F.col("s.sample_idx").isNotNull()
    cut1 = F.when(there & F.lit(place == "r1.seq" and not config.keep_barcode), F.col("_1.start") + F.length("_c1")).otherwise(0)
    cut2 = F.when(F.coalesce("s.both", F.lit(False)) & F.lit(not config.keep_barcode), F.col("_2.start") + F.length("_c2")).otherwise(0)
    mate = lambda k, cut, fwd, rev: F.struct(F.lit(k).alias("mate"), cut.alias("_cut"), F.col(f"s.{fwd}").alias("forward_primer"), F.col(f"s.{rev}").alias("reverse_primer"), *[F.col(f"r{k}.{c}").alias(c) for c in ("read_ord", "seq", "quality", "qual_offset")])
    rows = joined.select(pair, F.col("s.sample_idx").alias("sample_idx"), F.col("s.sample_id").alias("sample_id"), F.explode(F.array(mate(1, cut1, "forward_primer", "reverse_primer"), mate(2, cut2, "reverse_primer", "forward_primer"))).alias("m"))
    rows = _offset(rows.select(pair, "sample_idx", "sample_id", "m.*").filter("seq IS NOT NULL"), config)
    plain = without_adapter(_cut(rows, F.col("_cut")).drop("_cut"), config.adapter)
    if config.extensive_primers or config.check_reversed:
        plain = reoriented(plain, "forward_primer", config.primer_errors, EXTENSIVE if config.extensive_primers else 0).drop("turned")
    return _graded(primers_cut(plain, config), config, F.col("sample_idx").isNull(), True)


def seed_config(config: FilterConfig, merged: bool = False) -> FilterConfig:
    """Thresholds for reads that may become seeds: a short, strict end trim, or none for merged reads; no other filter."""
    return replace(config, trim_width=10, trim_threshold=0 if merged else 25, min_length=1, min_length_2=None, min_quality=0, min_quality_2=None, window_threshold=0, max_accumulated_error=None, alpha=-1)
