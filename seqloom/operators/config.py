"""Filter thresholds, and the options files that set them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

# fixed values: the option keys of the file format and the field that each sets
KEYS = {
    "minSeqLength": "min_length",
    "maxSeqLength": "max_length",
    "derepSrchLen": "derep_length",
    "minAvgQuality": "min_quality",
    "maxAmbiguousNT": "max_ambiguous",
    "QualWindowThreshhold": "window_threshold",
    "QualWindowWidth": "window_width",
    "BinErrorModelMaxExpError": "max_expected_errors",
    "BinErrorModelAlpha": "alpha",
    "TrimWindowWidth": "trim_width",
    "TrimWindowThreshhold": "trim_threshold",
    "maxBarcodeErrs": "barcode_errors",
    "maxPrimerErrs": "primer_errors",
    "keepBarcodeSeq": "keep_barcode",
    "keepPrimerSeq": "keep_primer",
    "maxHomonucleotide": "max_run",
    "trimHomonucleotide": "trim_run",
    "maxAccumulatedError": "max_accumulated_error",
    "TechnicalAdapter": "adapter",
    "PEheaderPairFmt": "pair_format",
    "TrimStartNTs": "trim_start",
    "fastqVersion": "phred",
    "ExtensivePrimerChecks": "extensive_primers",
    "RejectSeqWithoutRevPrim": "need_reverse_primer",
    "RejectSeqWithoutFwdPrim": "need_forward_primer",
    "TruncateSequenceLength": "truncate",
    "AmpliconShortPE": "short_amplicon",
    "CheckForMixedPairs": "check_mixed_pairs",
    "CheckForReversedSeqs": "check_reversed",
    "SyncReadPairs": "sync_pairs",
}
#: Options whose effect isn't implemented, with the value at which they have none: any other is an error.
MISSING = {"PEheaderPairFmt": 0, "AmpliconShortPE": False}
SECOND = {"min_length", "min_quality", "max_ambiguous", "window_threshold", "trim_threshold", "primer_errors", "keep_primer", "max_accumulated_error", "need_reverse_primer", "need_forward_primer"}


@dataclass(frozen=True)
class FilterConfig:
    """Thresholds of a read; those ending in _2 let it pass as second tier. None: not set."""

    min_length: int = 250
    min_length_2: int | None = None
    max_length: int = 1000
    derep_length: int | None = None
    min_quality: float = 25
    min_quality_2: float | None = None
    max_ambiguous: int = 0
    max_ambiguous_2: int | None = None
    window_threshold: float = 0
    window_threshold_2: float | None = None
    window_width: int = 50
    trim_width: int = 15
    trim_threshold: float = 20
    trim_threshold_2: float | None = None
    max_expected_errors: float = 2.5
    alpha: float = -1
    max_accumulated_error: float | None = None
    max_accumulated_error_2: float | None = None
    barcode_errors: int = 0
    primer_errors: int = 1
    primer_errors_2: int | None = None
    keep_barcode: bool = False
    keep_primer: bool = False
    keep_primer_2: bool = False
    max_run: int = 12
    trim_run: int = 12
    adapter: str = ""
    pair_format: int = 0
    trim_start: int = 0
    phred: str = "auto"
    extensive_primers: bool = False
    need_reverse_primer: bool = False
    need_reverse_primer_2: bool = False
    need_forward_primer: bool = False
    need_forward_primer_2: bool = False
    truncate: int = 0
    short_amplicon: bool = False
    check_mixed_pairs: bool = False
    check_reversed: bool = False
    sync_pairs: bool = False
    binomial_both: bool = False
    second_output: bool = True


def require_implemented(config: FilterConfig) -> FilterConfig:
    """config; ValueError if it asks for what isn't implemented."""
    asked = [k for k, none in MISSING.items() if getattr(config, KEYS[k]) != none]
    if asked:
        raise ValueError(f"options that are not implemented: {', '.join(asked)}")
    return config


def parse_options(lines: Iterable[str], base: FilterConfig | None = None) -> FilterConfig:
    """key<TAB>value lines; # begins a comment, *key sets the second tier. Unknown keys and options that aren't implemented raise ValueError."""
    config, kinds, values = base or FilterConfig(), {f.name: str(f.type) for f in fields(FilterConfig)}, {}
    for number, line in enumerate(lines, 1):
        text = line.lstrip("﻿").split("#", 1)[0].strip()
        if not text:
            continue
        key, value = ([*text.split(None, 1), ""])[:2]
        name = KEYS.get(key.lstrip("*"))
        if name is None:
            raise ValueError(f"line {number}: unknown option {key}")
        if key.startswith("*"):
            if name not in SECOND:
                raise ValueError(f"line {number}: {key} has no second tier")
            name += "_2"
        values[name] = _typed(kinds[name], value)
    return require_implemented(replace(config, **values))


def _typed(kind: str, value: str):
    if kind.startswith("bool"):
        return value.upper() in ("1", "T", "TRUE", "YES")
    if kind.startswith("int"):
        return int(float(value))
    return float(value) if kind.startswith("float") else value
