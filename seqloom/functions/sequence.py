"""Sequence and header functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the nucleotide codes, their complements and what each may stand for
CODES = "ACGTRYMKWSBDHVN"
COMPLEMENTS = "TGCAYRKMWSVHDBN"
STANDS_FOR = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "W": "AT", "S": "CG", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def revcomp(seq: Column) -> Column:
    """Reverse complement in upper case; other letters become N."""
    known = F.regexp_replace(F.upper(seq), f"[^{CODES}]", "N")
    return F.reverse(F.translate(known, CODES, COMPLEMENTS))


def cut(text: Column, start: Column | int, stop: Column | int | None = None) -> Column:
    """text without the characters from start to before stop (to the end, if null); 0-based."""
    start, size = F.lit(start) if isinstance(start, int) else start, F.length(text)
    stop = size if stop is None else F.lit(stop) if isinstance(stop, int) else stop
    return F.concat(F.substr(text, F.lit(1), F.greatest(F.lit(0), start)), F.substr(text, F.least(size, stop) + 1))


def ambiguous(seq: Column) -> Column:
    """How many letters are none of A, C, G and T."""
    return F.length(F.regexp_replace(seq, "[ACGTacgt]", ""))


def has_run(seq: Column, length: int) -> Column:
    """Whether a letter is repeated `length` times or more."""
    return F.upper(seq).rlike(rf"(.)\1{{{length - 1},}}") if length > 1 else F.length(seq) >= length


def tail_run(seq: Column) -> Column:
    """Length of the run of equal letters at the end; 0 for an empty text."""
    return F.length(F.regexp_extract(F.upper(seq), r"((.)\2*)$", 1))


def tail_kept(seq: Column, longest: int) -> Column:
    """How much to keep so that no run of `longest` or more ends the read: all but the run, at least one letter.

    Nothing is cut where `longest` is not less than the length.
    """
    size, run = F.length(seq), tail_run(seq)
    return F.when((run >= longest) & (F.lit(longest) < size), F.greatest(F.lit(1), size - run)).otherwise(size)


def strip_ambiguous(seq: Column) -> Column:
    return F.regexp_replace(seq, "^[^ACGTacgt]+|[^ACGTacgt]+$", "")


def canonical(seq: Column, instead: str = "A") -> Column:
    return F.regexp_replace(F.upper(seq), "[^ACGT]", instead)


def canonical_quality(seq: Column, quality: Column, offset: Column) -> Column:
    """The quality text of canonical(): score 0 where a base was replaced. Texts of unlike lengths give null."""
    letters = F.zip_with(F.split(F.upper(seq), ""), F.split(quality, ""), lambda b, q: F.when(b.rlike("[^ACGT]"), F.chr(offset)).otherwise(q))
    return F.when(F.length(seq) == F.length(quality), F.when(F.length(seq) == 0, F.lit("")).otherwise(F.array_join(letters, "")))


def wrap(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def first_word(header: Column) -> Column:
    return F.regexp_extract(header, r"^\S*", 0)


def pair_stem(header: Column) -> Column:
    """What both mates' ids share: up to the first blank, without a trailing /1 /2 .1 .2 or #1:0 #2:0."""
    return F.regexp_replace(F.regexp_extract(header, r"^[^ \t]*", 0), r"([/.][12]|#[12]:0)$", "")


def slash_mate(header: Column) -> Column:
    """The colon form ' 1:' of mate numbers as '/1'."""
    return F.regexp_replace(header, r"^(\S+) ([12]):.*$", "$1/$2")


def with_size(name: Column, size: Column, form: str = ";size=") -> Column:
    return F.concat(name, F.lit(";size="), size.cast("string"), F.lit(";")) if form == ";size=" else F.concat(name, F.lit("_"), size.cast("string"))


def without_size(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r";(?:size|seqs)=.*$", ""), r"^centroid=", "")


def size_of(name: Column) -> Column:
    said = F.regexp_extract(name, r"(?:;size=|;seqs=|_)(\d+);?$", 1)
    return F.when(said != "", said.cast("bigint"))


def header_stem(header: Column) -> Column:
    """Up to the first slash; without one, the fields of a colon header that name the spot."""
    word = first_word(header)
    parts = F.split(word, ":")
    n = F.size(parts)
    spot = F.when(n >= 7, F.concat_ws(":", parts[0], parts[3], parts[4], parts[5], parts[6])).when(n >= 6, F.concat_ws(":", parts[0], parts[2], parts[3], parts[4], parts[5])).otherwise(word)
    return F.when(F.instr(word, "/") > 0, F.substring_index(word, "/", 1)).otherwise(spot)


def barcode_header(sample: Column, separator: str, read_id: Column, found: Column, corrected: Column, errors: Column) -> Column:
    base = F.concat(sample, F.lit(separator), first_word(read_id), F.lit(" orig_bc="), found)
    return F.when(errors > 0, F.concat(base, F.lit(" new_bc="), corrected, F.lit(" bc_diffs="), errors.cast("string"))).otherwise(base)


def head_sample_header(sample: Column, separator: str, read_id: Column, token: Column) -> Column:
    return F.concat(sample, F.lit(separator), F.replace(read_id, token, F.lit("")), F.lit(" orig_hdPart="), token)


def ratio(a: Column, b: Column, scale: float = 0.5) -> Column:
    """a's part of a + b, plus a half; a scale other than a half draws it to 1; 1 where there is nothing."""
    part = a / (a + b) + 0.5
    return F.when(a + b <= 0, F.lit(1.0)).otherwise(part if scale == 0.5 else 1 - (1 - part) * scale)


def revcomp_text(seq: str) -> str:
    """Reverse complement of one short text, such as a barcode of a map."""
    return "".join(COMPLEMENTS[CODES.index(c)] if c in CODES else "N" for c in reversed(seq.upper()))
