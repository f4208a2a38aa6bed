"""Subject areas of mails from their own text.

Mails are embedded by term weighting and a truncated singular value decomposition, found by
subspace iteration: each pass sends the basis to the partitions and adds up their shares of
X'(XQ). Terms are hashed to DIM numbers, so that all statistics of the corpus are complete and
bounded whatever its vocabulary. Seed centroids come from the labelled examples, one for each
subject and language, less the mean of their language. Then, over all sentences of the corpus:

- a sentence goes to the centroid of greatest cosine similarity;
- from the sentences assigned so far each term gets its weight: one less the entropy of its
  subjects, times the share of its sentences that were assigned, so that words of everyday
  phrases lose theirs and subject words that no example has gain it;
- the centroids move to the mean of their sentences.

A mail gets a subject that at least two of its sentences have. Words with several subjects are
settled by the rest of the sentence and, if that is undecided, by the rest of the mail.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .mail import own_sentences

DIM = 1 << 20
RANK = 48
PASSES = 4
ROUNDS = 2
LEAST_MAILS = 3
SEED_COSINE = 0.5
COSINE = 0.4
STRENGTH = 0.25
SENTENCES = 2
BLOCK = 1 << 10
#: Partitions whose matrices are added up, at most.
SUMS = 512

WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
ADDRESS = re.compile(r"\S+@\S+")


class Terms(dict):
    """Word to term number; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        number = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIM
        return number


def terms_of(sentence: str, known: Terms) -> list[int]:
    """The different terms of a sentence."""
    if "@" in sentence:
        sentence = ADDRESS.sub(" ", sentence)
    return list({known[w] for w in WORD.findall(sentence.lower())})


def sentence_terms(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, terms (of all sentences one after another), lengths (terms of each sentence); mails without own text are left out."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        for batch in batches:
            rows, flat, sizes = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = [x for x in (terms_of(s, known) for s in own_sentences(t)) if x]
                if found:
                    rows.append(i)
                    flat.append([w for x in found for w in x])
                    sizes.append([len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(flat, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], ["id", "terms", "lengths"])

    there = docs.select(id_column, text).filter(F.col(text).isNotNull() & (F.col(text) != ""))
    return there.mapInArrow(run, f"id {kind}, terms array<int>, lengths array<int>")


class Batch:
    """The terms of an Arrow batch as flat arrays of known terms."""

    def __init__(self, batch: pa.RecordBatch, place: np.ndarray) -> None:
        terms, lengths = batch.column(1), batch.column(2)
        number = terms.flatten().to_numpy()
        sizes = lengths.flatten().to_numpy()
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        self.mail_of = np.repeat(np.arange(batch.num_rows), np.diff(lengths.offsets.to_numpy()))
        at = place[number]
        self.mails, self.sentences = batch.num_rows, len(sizes)
        self.term, self.sentence = at[at >= 0], sentence[at >= 0]

    def by_sentence(self, values: np.ndarray) -> np.ndarray:
        """The sums of values[term] over the terms of each sentence."""
        out = np.zeros((self.sentences, values.shape[1]), np.float32)
        if len(self.term):
            first = np.flatnonzero(np.concatenate(([True], self.sentence[1:] != self.sentence[:-1])))
            out[self.sentence[first]] = np.add.reduceat(values[self.term], first)
        return out

    def by_mail(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term, mail and sentences of each different pair, ordered by mail."""
        width = int(self.term.max()) + 1 if len(self.term) else 1
        pair, n = np.unique(self.mail_of[self.sentence].astype(np.int64) * width + self.term, return_counts=True)
        return pair % width, pair // width, n


def _sum(sent: DataFrame, shape: tuple[int, int], give: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of the matrices that `give` makes of the partitions, added up block by block in the cluster.

    A matrix is as large as the model, whatever a partition holds, so there are at most SUMS large partitions, and
    what they send is bounded by SUMS models.
    """

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = give(batches)
        for k in range(0, len(m), BLOCK):
            if m[k : k + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([m[k : k + BLOCK].astype(np.float32).tobytes()], pa.binary())], ["k", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(m, np.float32).astype(np.float64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.astype(np.float32).tobytes() for m in sums.values()], pa.binary())], ["k", "m"])

    out = np.zeros(shape)
    for k, m in sent.coalesce(SUMS).mapInArrow(share, "k int, m binary").repartition("k").mapInArrow(add, "k int, m binary").collect():
        part = np.frombuffer(m, np.float32).reshape(-1, shape[1])
        out[k : k + len(part)] = part
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


class Model:
    """Terms, weights, basis and centroids; what is sent to the partitions."""

    def __init__(self, codes: list[str]) -> None:
        self.codes = codes
        self.place = np.full(DIM, -1, np.int32)  # of the terms that occur in enough mails
        self.weight = np.zeros(0, np.float32)
        self.basis = np.zeros((0, RANK), np.float32)
        self.spec = np.zeros(0, np.float32)
        self.centroids = np.zeros((0, RANK), np.float32)
        self.subject = np.zeros(0, np.int64)  # of each centroid

    def assign(self, b: Batch, seed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentence vectors, centroid of greatest cosine, whether assigned, similarity to each subject."""
        vectors = _unit(b.by_sentence(self.basis * (self.weight * (1 if seed else self.spec))[:, None]))
        cosine = vectors @ self.centroids.T
        best = cosine.argmax(1)
        most = cosine[np.arange(len(best)), best]
        strength = np.ones(len(best)) if seed else b.by_sentence(self.spec[:, None])[:, 0]
        ok = (most > (SEED_COSINE if seed else COSINE)) & (strength > STRENGTH)
        near = np.stack([cosine[:, self.subject == j].max(1) for j in range(len(self.codes))], 1)
        return vectors, best, ok, near


def fitted(sent: DataFrame, areas: DataFrame, examples: DataFrame) -> Model:
    """The model over all sentences; `areas` and `examples` are small labelled tables of fixed size."""
    m = Model(sorted(r[0] for r in areas.select("subject_code").collect()))

    # term weighting: log(mails / mails with the term), squared
    def mails_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM + 1, np.int64)
        every = np.arange(DIM, dtype=np.int32)
        for batch in batches:
            if batch.num_rows:
                term, _, _ = Batch(batch, every).by_mail()
                total[:DIM] += np.bincount(term, minlength=DIM)
                total[DIM] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["t", "n"])

    counted = sent.mapInArrow(mails_with, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).filter((F.col("n") >= LEAST_MAILS) | (F.col("t") == DIM)).collect()
    counts = dict(map(tuple, counted))
    mails = counts.pop(DIM, 0)
    terms = np.array(sorted(counts), np.int64)
    if not len(terms) or not m.codes:
        return m
    m.place[terms] = np.arange(len(terms))
    m.weight = (np.log(mails / np.array([counts[t] for t in terms])) ** 2).astype(np.float32)
    place, weight, size = m.place, m.weight, len(terms)
    rank = min(RANK, max(2, size // 8))  # far below the number of terms, or nothing is drawn together
    cast = sent.sparkSession.sparkContext.broadcast

    # truncated singular value decomposition: subspace iteration, the last product also gives the values
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((size, rank)))[0].astype(np.float32)
    for _ in range(PASSES):
        sent_q = cast((q, weight, place))

        def product(batches: Iterator[pa.RecordBatch], held=sent_q) -> np.ndarray:
            q, weight, place = held.value
            out = np.zeros((len(weight), q.shape[1]), np.float32)
            for batch in batches:
                term, mail, n = Batch(batch, place).by_mail()
                if not len(term):
                    continue
                x = np.log1p(n).astype(np.float32) * weight[term]
                first = np.flatnonzero(np.concatenate(([True], mail[1:] != mail[:-1])))
                sizes = np.diff(np.concatenate((first, [len(mail)])))
                x /= np.repeat(np.maximum(np.sqrt(np.add.reduceat(x * x, first)), 1e-9), sizes)
                y = np.repeat(np.add.reduceat(q[term] * x[:, None], first), sizes, axis=0) * x[:, None]
                order = np.argsort(term, kind="stable")
                term = term[order]
                first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
                out[term[first]] += np.add.reduceat(y[order], first)
            return out

        z = _sum(sent, (size, rank), product)
        sent_q.destroy()
        last, q = q, np.linalg.qr(z)[0].astype(np.float32)
    values, rotation = np.linalg.eigh((last.T @ z + z.T @ last) / 2)
    m.basis = (last @ rotation[:, np.argsort(-values)]).astype(np.float32)

    # seed centroids
    known, vectors, labels = Terms(), [], []
    for code, lang, text in examples.select("subject_code", "lang", "example_text").collect():
        at = m.place[np.array(list({t for s in re.split(r"(?<=[.?!])\s+", text or "") for t in terms_of(s, known)}), np.int64)]
        if code in m.codes and (at >= 0).any():
            at = at[at >= 0]
            vectors.append(_unit((m.basis[at] * m.weight[at, None]).sum(0)))
            labels.append((lang, m.codes.index(code)))
    made, subject = [], []
    for lang in sorted({x for x, _ in labels}, key=str):
        own = {j: np.mean([v for v, x in zip(vectors, labels, strict=True) if x == (lang, j)], 0) for j in range(len(m.codes)) if (lang, j) in labels}
        mean = np.mean(list(own.values()), 0) if len(own) > 1 else 0
        made += [v - mean for v in own.values()]
        subject += list(own)
    absent = [j for j in range(len(m.codes)) if j not in subject]
    m.centroids = _unit(np.array([*made, *[np.zeros(rank)] * len(absent)])).astype(np.float32)
    m.subject = np.array([*subject, *absent])

    # refinement over all sentences
    seeds = m.centroids
    for turn in range(ROUNDS):
        sent_m = cast(m)

        def tally(batches: Iterator[pa.RecordBatch], held=sent_m, seed=turn == 0) -> np.ndarray:
            m = held.value
            size, subjects, spots = len(m.weight), len(m.codes), len(m.centroids)
            by_term = np.zeros((size, subjects + 1))
            moved = np.zeros((spots, m.basis.shape[1] + 1))
            for batch in batches:
                b = Batch(batch, m.place)
                if not len(b.term):
                    continue
                vectors, best, ok, _ = m.assign(b, seed)
                taken = ok[b.sentence]
                which = m.subject[best][b.sentence[taken]]
                by_term[:, :subjects] += np.bincount(b.term[taken] * subjects + which, minlength=size * subjects).reshape(size, subjects)
                by_term[:, subjects] += np.bincount(b.term, minlength=size)
                np.add.at(moved, best[ok], np.concatenate((vectors[ok], np.ones((ok.sum(), 1))), 1))
            wide = max(by_term.shape[1], moved.shape[1])
            pad = lambda a: np.pad(a, ((0, 0), (0, wide - a.shape[1])))
            return np.concatenate((pad(by_term), pad(moved)))

        subjects = len(m.codes)
        both = _sum(sent, (size + len(m.centroids), max(subjects + 1, rank + 1)), tally)
        sent_m.destroy()
        n, total, moved = both[:size, :subjects], both[:size, subjects], both[size:, : rank + 1]
        base = n.sum(0) / max(1, n.sum())
        share = (n + 2 * base + 1e-9) / (n.sum(1, keepdims=True) + 2 + 1e-9)
        entropy = -(share * np.log(share)).sum(1) / np.log(max(2, subjects))
        m.spec = (np.clip(1 - entropy, 0, 1) * n.sum(1) / np.maximum(total, 1)).astype(np.float32)
        if turn:
            some = moved[:, rank] > 20
            m.centroids = m.centroids.copy()
            m.centroids[some] = _unit(_unit(moved[some, :rank]) + seeds[some]).astype(np.float32)  # the seeds stay an anchor
    return m


def subjects_of(docs: DataFrame, areas: DataFrame, examples: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, subject_code, n_sentences: one row for each subject that SENTENCES or more sentences of a mail's own text have.

    Defined cases: null, empty and body-less texts give no rows; repeated mails count each; subjects without examples and
    an empty corpus give none; very long texts are read whole; other columns of docs aren't read.
    """
    sent = written(sentence_terms(docs, id_column, text))
    held = docs.sparkSession.sparkContext.broadcast(fitted(sent, areas, examples))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            if not batch.num_rows or not len(m.centroids):
                continue
            b = Batch(batch, m.place)
            _, _, ok, near = m.assign(b, False)
            near = np.clip(near, 0, None)
            count = len(m.codes)
            profile = np.zeros((b.mails, count))
            np.add.at(profile, b.mail_of[ok], near[ok] ** 2)
            profile /= np.maximum(profile.sum(1, keepdims=True), 1e-9)
            chosen = (near * (1 + profile[b.mail_of])).argmax(1)
            n = np.bincount(b.mail_of[ok] * count + chosen[ok], minlength=b.mails * count).reshape(b.mails, count)
            mail, subject = np.nonzero(n >= SENTENCES)
            codes = pa.array([m.codes[j] for j in subject], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mail)), codes, pa.array(n[mail, subject].astype(np.int64))], [id_column, "subject_code", "n_sentences"])

    return sent.mapInArrow(run, f"{id_column} {kind}, subject_code string, n_sentences bigint")
