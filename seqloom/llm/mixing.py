"""Mixing sources to target weights.

Each document has a membership over the target sources: its own source where it is a target,
nothing where its source is none, and a classifier's posteriors where its source is missing. The
classifier is fitted on a bounded sample of documents with a source, by sums in the cluster, and reads whole texts.
Document rates between 0 and the source's repeats are fitted by projected gradient steps on the squared difference of
expected and wanted tokens of each source; a step needs only the vector of expected tokens, which
is a distributed sum. Rates become whole numbers by systematic rounding along running sums in
order of size, so a source's tokens come out within about one document of the expected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import running_sum
from ..session import written
from . import mail, tokens

#: Labelled documents that the classifier is fitted on, about, in equal parts by label.
SAMPLE = 4000
FEATURES = 1 << 14
#: How much the way a mail came and its words may count, of which the likeliest pair is taken.
WEIGHTS = np.array([(a, b) for a in (0, *(2.0**e for e in range(-4, 5))) for b in (0, *(2.0**e for e in range(-4, 5)))])
STEPS = 60
ENOUGH = 1e-4

HEADER = re.compile(r"^([A-Za-z][A-Za-z0-9-]*):[ \t]*([^\n]*)", re.M)
FOLD = re.compile(r"\n[ \t]+")
DOMAIN = re.compile(r"@([\w.-]+)")
WORD = re.compile(r"[^\W\d_]{2,}")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the way a mail came (its header lines, unfolded, and their order, domains, kinds of content, subject words, time
    zone, form of the id, line ends and length) and of all words in it, those of the whole text as written and of the decoded body."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n")
    head, _, _ = lines.lstrip("\n").partition("\n\n")
    found, names = {f"length {len(text).bit_length()}", f"crlf {text.count(chr(13)) > 0}"}, []
    for name, value in HEADER.findall(FOLD.sub(" ", head)):
        name = name.lower()
        names.append(name)
        found |= {f"{name}@{d}" for d in DOMAIN.findall(value)}
        if name == "subject":
            found |= {f"subject {w}" for w in WORD.findall(value.lower())}
        elif name == "date":
            found.add(f"zone {value[-5:]}")
        elif name.startswith(("content-", "x-", "mime", "received", "precedence")):
            found |= {f"{name} {w}" for w in re.findall(r"[\w/-]{3,}", value)}
    found |= {f"has {n}" for n in names} | {"order " + ",".join(names)}
    try:
        body = mail.body_of(text)
    except UnicodeError:  # named in a code that can't be read; its words as written are there
        body = ""
    words = {m[0] for t in (lines, body) for m in WORD.finditer(t.lower())}
    return _numbers(found), _numbers(words)


def _numbers(found: set[str]) -> np.ndarray:
    return np.unique(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES for w in found], np.int64))


class SourceClassifier:
    """Naive Bayes over hashed features of two kinds: from counts by label and feature, with the number of documents last, the posteriors of a text."""

    def __init__(self, labels: list[str], counts: np.ndarray, prior: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.labels, self.prior, self.counts = labels, prior + 1.0, counts
        self.weights = np.ones(2) if weights is None else weights
        self.log_prior = np.log(self.prior / self.prior.sum())

    def evidence(self, seen: tuple[np.ndarray, np.ndarray], own: int | None = None) -> np.ndarray:
        """How much either kind speaks for each label; without the document itself where it was counted under `own`.

        A label's rate of a feature is taken half and half with that of all, so what no document of a label has speaks alike
        against labels of few and of many documents.
        """
        out = np.zeros((2, len(self.labels)))
        for kind, at in enumerate(seen):
            c, n = self.counts[:, kind * FEATURES + at], self.counts[:, -1:].copy()
            if own is not None:
                c[own] -= 1
                n[own] -= 1
            c = c[:, c.sum(0) > 0]
            if c.size:
                ratio = c / np.maximum(n, 1) / (c.sum(0) / n.sum())
                out[kind] = np.log((ratio + 1) / 2).sum(1) / np.sqrt(c.shape[1])  # features of a mail are far from independent
        return out

    def posteriors(self, text: str | None) -> np.ndarray:
        score = self.log_prior
        if text:
            score = score + self.weights @ self.evidence(features(text))
        p = np.exp(score - score.max())
        return p / p.sum()


def classifier(docs: DataFrame, labels: list[str], id_column: str = "doc_id", text: str = "text", source: str = "source", sample: int = SAMPLE) -> SourceClassifier:
    """Fitted on about `sample` documents whose source is a label, as many of each (all, where there are fewer), chosen by a hash of the id.

    One pass over ids and sources and one over the texts of the sample; the driver gets one row of counts a label. The
    weights of both kinds of features are those under which each document of the sample is the likeliest by all others;
    documents count by how many of their label there are.
    """
    known = docs.filter(F.col(source).isin(labels) & F.col(text).isNotNull())
    n = {r[0]: r[1] for r in known.groupBy(source).count().collect()}
    prior = np.array([n.get(x, 0) for x in labels], float)
    rate = {x: min(1.0, sample / max(1, len(labels)) / n[x]) for x in labels if n.get(x)}
    if not rate:
        return SourceClassifier(labels, np.zeros((len(labels), 2 * FEATURES + 1)), prior)
    least = F.element_at(F.create_map(*[F.lit(v) for x, r in rate.items() for v in (x, round(r * (1 << 30)))]), F.col(source))
    taken = known.filter(F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < least).select(source, text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [[at.astype(np.int32).tobytes() for at in features(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), *(pa.array([x[k] for x in seen], pa.binary()) for k in (0, 1))], ["label", "way", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for label, seen in _seen(batches):
            row = sums.setdefault(label, np.zeros(2 * FEATURES + 1, np.int64))
            for kind, at in enumerate(seen):
                row[kind * FEATURES + at] += 1
            row[-1] += 1
        yield _rows(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = sums.setdefault(label, np.zeros(2 * FEATURES + 1, np.int64))
                row += np.frombuffer(raw, np.int64)
        yield _rows(sums)

    kind = "label string, counts binary"
    sampled = written(taken.mapInArrow(read, "label string, way binary, words binary"))
    counts = np.zeros((len(labels), 2 * FEATURES + 1))
    for label, raw in sampled.mapInArrow(count, kind).repartition("label").mapInArrow(add, kind).collect():
        counts[labels.index(label)] = np.frombuffer(raw, np.int64)
    held = docs.sparkSession.sparkContext.broadcast(SourceClassifier(labels, counts, prior))

    def surprise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        share = c.prior / c.prior.sum() / np.maximum(c.counts[:, -1], 1)
        total = np.zeros(len(WEIGHTS), np.int64)  # whole numbers add up alike in whatever order
        for label, seen in _seen(batches):
            own = c.labels.index(label)
            score = c.log_prior + WEIGHTS @ c.evidence(seen, own)
            top = score.max(1)
            total += np.rint((np.log(np.exp(score - top[:, None]).sum(1)) + top - score[:, own]) * share[own] * (1 << 40)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(WEIGHTS)), pa.int32()), pa.array(total)], ["pair", "loss"])

    losses = sampled.mapInArrow(surprise, "pair int, loss bigint").groupBy("pair").agg(F.sum("loss").alias("loss"))
    best = losses.orderBy("loss", "pair").first()
    return SourceClassifier(labels, counts, prior, WEIGHTS[best[0]] if best else None)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[np.ndarray]]]:
    """Label and features of each document of the sample."""
    for batch in batches:
        for label, *seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield label, [np.frombuffer(at, np.int32) for at in seen]


def _rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["label", "counts"])


def memberships(docs: DataFrame, targets: list[str], id_column: str, text: str, source: str, path: str, sample: int) -> DataFrame:
    """id, source, n_tokens, member (array over targets)."""
    # two scans, filtered before the tokens are counted: each text is encoded once and only texts without source are carried on
    counted = tokens.count_column(docs.filter(F.col(source).isNotNull()), [id_column, source], text, path)
    one = F.array(*[(F.col(source) == s).cast("double") for s in targets])
    known = counted.select(F.col(id_column).alias("id"), F.col(source).alias("source"), "n_tokens", one.alias("member"))
    missing = tokens.count_column(docs.filter(F.col(source).isNull()), [id_column, text], text, path)
    held = docs.sparkSession.sparkContext.broadcast(classifier(docs, targets, id_column, text, source, sample))

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            p = [c.posteriors(t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.list_(pa.float64()))], ["id", "n_tokens", "member"])

    kind = docs.schema[id_column].dataType.simpleString()
    guessed = missing.select(id_column, "n_tokens", text).mapInArrow(posteriors, f"id {kind}, n_tokens bigint, member array<double>")
    return known.unionByName(guessed.withColumn("source", F.lit(None).cast("string")).select("id", "source", "n_tokens", "member"))


def _fit(members: DataFrame, shares: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents as a linear rule: the rate of d is clip(member . weights, 0, cap), cap = member . caps.

    Documents with the same membership move alike under the gradient (scaled by the size of a document), so the
    state of all rates is what the steps so far add up to for a membership; that is kept for each distinct one.
    """
    labelled = F.col("source").isNotNull().alias("labelled")  # a posterior may be 1 as well
    groups = members.filter(F.col("n_tokens") > 0).groupBy(labelled, "member").agg(F.sum("n_tokens").alias("t")).filter(F.aggregate("member", F.lit(0.0), lambda a, x: a + x) > 0)
    pure = {int(np.argmax(r[0])): float(r[1]) for r in groups.filter("labelled").select("member", "t").collect()}  # one row a source
    soft = groups.filter("NOT labelled")
    k = len(shares)
    own = np.array([pure.get(j, 0.0) for j in range(k)])
    wanted = np.where(own > 0, shares, 0)
    if not wanted.sum():
        return np.zeros(k), np.zeros((0, k))
    wanted = wanted / wanted.sum()
    total = min(caps[j] * own[j] / wanted[j] for j in range(k) if wanted[j] > 0)
    goal = wanted * total
    rates = np.zeros(k)
    path: list[np.ndarray] = []
    soft, before = written(soft.select("member", "t")), np.full(k, np.inf)
    # a step is scaled by what can move, the tokens of a source and those that lean to it: less would overshoot
    lean = soft.agg(*[F.sum(F.col("t") * F.get("member", F.lit(j))).alias(f"e{j}") for j in range(k)]).first()
    size = np.maximum(np.where(wanted > 0, own, 0) + [x or 0.0 for x in lean], 1)
    for _ in range(STEPS):
        expected = rates * own + _soft_tokens(soft, path, caps)
        gap = (expected - goal) / size
        # there, or at the least squares that documents of mixed membership allow
        if min(np.abs(expected - goal).max(), np.abs(expected - before).max()) <= ENOUGH * total:
            break
        before = expected
        path.append(-gap)
        rates = np.clip(rates - gap, 0, caps) * (own > 0)
    else:
        raise ValueError(f"the rates still move after {STEPS} steps; shares differ by up to {np.abs(expected - goal).max() / total:.2g}")
    return rates, np.array(path).reshape(-1, k)


def _rate(member, path: list[np.ndarray] | np.ndarray, caps: np.ndarray):
    """The rate of a membership after the steps in path, each projected to [0, cap]."""
    rate = F.lit(0.0)
    cap = sum((F.get(member, F.lit(j)) * float(c) for j, c in enumerate(caps)), F.lit(0.0))
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in path])
    move = lambda r, s: F.least(cap, F.greatest(F.lit(0.0), r + F.aggregate(F.zip_with(member, s, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)))
    return F.aggregate(steps, rate, move) if len(path) else rate


def _soft_tokens(soft: DataFrame, path: list[np.ndarray], caps: np.ndarray) -> np.ndarray:
    k = len(caps)
    if not path:
        return np.zeros(k)
    rated = soft.select("member", "t", _rate(F.col("member"), path, caps).alias("r"))
    row = rated.agg(*[F.sum(F.col("r") * F.col("t") * F.get("member", F.lit(j))).alias(f"e{j}") for j in range(k)]).first()
    return np.array([x or 0.0 for x in row])


def mixed(docs: DataFrame, targets: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", path: str = tokens.VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """id, source (of the target list; the likeliest where it was missing), n_tokens, n_times: how often each document is used.

    The total is the largest at which every source that has documents reaches its share with no document used more than
    max_repeats times; the shares of sources without documents are spread over the others in proportion. Defined cases:
    documents of other sources and those without tokens are not used (no row); repeated documents are documents; null
    shares count 0, null repeats 1; empty tables give no rows. `targets` is a small table of fixed size.
    """
    wanted = [(r[0], float(r[1] or 0), int(1 if r[2] is None else r[2])) for r in targets.select("source", "target_share", "max_repeats").filter(F.col("source").isNotNull()).orderBy("source").collect()]
    names, shares, caps = [w[0] for w in wanted], np.array([w[1] for w in wanted]), np.array([float(max(0, w[2])) for w in wanted])
    if not names or not shares.sum():
        return docs.select(id_column, source, F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).alias("n_times")).limit(0)
    members = written(memberships(docs, names, id_column, text, source, path, sample))
    rates, steps = _fit(members, shares, caps)
    rated = members.filter(F.col("n_tokens") > 0)
    known = F.array(*[F.lit(float(r)) for r in rates])
    likeliest = F.array_position("member", F.array_max("member")).cast("int")
    rated = rated.filter(F.array_max("member") > 0).withColumn("_s", likeliest)
    rate = F.when(F.col("source").isNotNull(), F.element_at(known, F.col("_s"))).otherwise(F.least(_rate(F.col("member"), steps, caps), F.element_at(F.array(*[F.lit(float(c)) for c in caps]), F.col("_s"))))
    # whole numbers add up without rounding error in whatever order
    rated = rated.withColumn("_u", F.round(rate * (1 << 20)).cast("bigint"))
    summed = running_sum(rated.select("id", "_s", "n_tokens", "_u"), ["_s"], ["n_tokens", "id"], "_u", "_sum")
    half = F.lit(1 << 19)
    whole = lambda c: F.floor((c + half) / (1 << 20))
    times = (whole(F.col("_sum")) - whole(F.col("_sum") - F.col("_u"))).cast("int")
    title = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_s"))
    return summed.select(F.col("id").alias(id_column), title.alias("source"), "n_tokens", times.alias("n_times")).filter(F.col("n_times") > 0)


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, n_documents, n_used, n_tokens, most_repeats for each target source, used or not."""
    used = mixture.groupBy("source").agg(
        F.count("*").alias("n_documents"),
        F.sum("n_times").alias("n_used"),
        F.sum(F.col("n_tokens") * F.col("n_times")).alias("n_tokens"),
        F.max("n_times").alias("most_repeats"),
    )
    joined = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").fillna(0, ["n_documents", "n_used", "n_tokens", "most_repeats"])
    return joined.withColumn("actual_share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy(F.lit(1))))
