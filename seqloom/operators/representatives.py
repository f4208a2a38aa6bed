"""Choosing the read that stands for a group: an ordered tournament.

Whether one read beats another is no order (it is not transitive), so a group is folded in input
order, champion against challenger. Groups are cut into chunks of equal size that are folded
alone; their champions are folded in chunk order. For groups of up to chunk_rows reads that is
the plain fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .keyed_chunks import CHUNK_ROWS, chunked

FEATURES = ("odd", "error", "quality", "length", "identity", "merge_length", "size")


@dataclass(frozen=True)
class Weights:
    """Exponents of the terms of a comparison."""

    # fixed values
    odd: float = 0.08
    error: float = 0.32
    quality: float = 0.16
    length: float = 0.08
    identity: float = 0.0
    merged: float = 0.34
    size: float = 0.04
    deviation: float = 0.38


DEREP = Weights()
SEED = Weights(error=0.44, quality=0.14, identity=0.42, merged=0.10, size=0.02, deviation=0.0)
NEEDED = 1.01


def _half(a: float, b: float, scale: float = 0.5) -> float:
    if a + b <= 0:
        return 1.0
    r = a / (a + b) + 0.5
    return r if scale == 0.5 else 1 - (1 - r) * scale


def _clamped(x: float) -> float:
    return min(2.5, max(0.2, x)) if x == x else 1.0


class Tournament:
    """A fold over reads (dicts of FEATURES) that keeps the champion."""

    def __init__(self, weights: Weights, seed: bool) -> None:
        self.w, self.seed = weights, seed
        self.best: dict | None = None
        self.best_identity = 0.0
        self.merged_seen = self.plain_seen = 0
        self.merged_length = 0.0

    def meets(self, new: dict) -> bool:
        """Whether the new read becomes champion."""
        if self.best is None or self.better(new, self.best):
            self.best = new
            self.best_identity = max(self.best_identity, new["identity"] or 0.0)
            return True
        return False

    def better(self, d: dict, r: dict) -> bool:
        d_merged, r_merged = d["merge_length"] is not None, r["merge_length"] is not None
        d_id, r_id = d["identity"] or 0.0, r["identity"] or 0.0
        if d_id < r_id - 0.3 or d_id < self.best_identity - 0.5:
            return False
        d_len, r_len = (float(x["merge_length"] or x["length"]) for x in (d, r))
        for x, m in ((d, d_merged), (r, r_merged)):
            self.merged_seen += m
            self.plain_seen += not m
            self.merged_length += x["merge_length"] or 0
        if r_len <= 0 or (d_len / r_len < 0.8 and not (d_merged and not r_merged)):
            return False
        odd = d["odd"] + r["odd"]
        share = self.merged_seen / (self.merged_seen + self.plain_seen)
        usual = self.merged_length / self.merged_seen if self.merged_seen else 0.0
        prefer = 1.0
        if d_merged != r_merged:
            prefer = (1.35 if d_merged else 0.75) if self.seed else (1 + share if d_merged else 1 - share / 2)
        deviation = 1.0
        if not self.seed and d_merged and r_merged and usual > 0:
            deviation = (abs(usual - d["merge_length"]) + usual) / (abs(usual - r["merge_length"]) + usual)
        w = self.w
        terms = (
            (1 - (d["odd"] - r["odd"]) / (odd + 10) if odd else 1.0, w.odd),
            (_half(d["error"], r["error"], 0.25), w.error),
            (_half(d["quality"], r["quality"]), w.quality),
            (_half(d_len, r_len), w.length),
            (50 * d_id / r_id - 49 if self.seed and r_id else 1.0, w.identity),
            (prefer, w.merged),
            (_half(d["size"], r["size"]), w.size),
            (deviation, w.deviation),
        )
        product = 1.0
        for value, weight in terms:
            product *= _clamped(value) ** weight
        return product > NEEDED


def _fold(batches: Iterator[pa.RecordBatch], groups: int, weights: Weights, seed: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and order to one champion a group; the first `groups` columns are the group."""
    current, fold, out, schema = None, None, [], None
    for batch in batches:
        schema = batch.schema
        columns = [c.to_pylist() for c in batch.columns]
        features = [schema.get_field_index(f) for f in FEATURES]
        for row in zip(*columns, strict=True):
            if row[:groups] != current:
                if fold is not None:
                    out.append(fold.best["row"])
                current, fold = row[:groups], Tournament(weights, seed)
            fold.meets({f: row[k] for f, k in zip(FEATURES, features, strict=True)} | {"row": row})
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if fold is not None:
        out.append(fold.best["row"])
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def representatives(rows: DataFrame, key: str, keep: list[str], seed: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """key and `keep` of the read that stands for each key.

    rows: positioned() rows with key, keep and the FEATURES (odd: ambiguous bases, error, quality, length, identity,
    merge_length and size; identity and merge_length may be null). A null key is a key.
    """
    weights = SEED if seed else DEREP
    wide = chunked(rows, key, chunk_rows).select(key, "_chunk", "_number", *keep, *FEATURES)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema)
    inner = wide.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", "_number")
    champions = inner.mapInArrow(lambda b: _fold(b, 2, weights, seed), kinds)
    outer = champions.repartition(key).sortWithinPartitions(key, "_chunk")
    return outer.mapInArrow(lambda b: _fold(b, 1, weights, seed), kinds).select(key, *keep)
