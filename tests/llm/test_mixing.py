import base64
import os
import random

import pytest

from seqloom.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary files")
TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    words = {"a": "alpha apple", "b": "beta banana", "c": "gamma grape", "z": "zeta zebra"}
    rows = []
    for i in range(3000):
        s = r.choice(["a"] * 6 + ["b"] * 3 + ["c", "z"])
        text = " ".join(r.choice(words[s].split()) for _ in range(r.randint(1, 60)))
        rows.append((i, r.choice([text] * 20 + [None, ""]), s if r.random() > 0.05 else None, 7))
    rows.append((5000, "alpha " * 50_000, "z", 7))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int")  # n_tokens clashes


def test_shares_and_repeats(spark, docs):
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.3, 8), ("absent", 0.1, 4)], TARGETS)
    mixture = mixing.mixed(docs, targets)
    got = {r.source: r for r in mixing.shares(mixture, targets).collect()}
    for s, most in (("a", 1), ("b", 2), ("c", 8)):
        assert got[s].actual_share == pytest.approx(1 / 3, abs=0.02)
        assert got[s].most_repeats <= most
    assert got["absent"].actual_share == 0 and got["absent"].n_used == 0
    used = mixture.collect()
    assert len({r.doc_id for r in used}) == len(used) and all(r.n_times >= 1 and r.n_tokens > 0 for r in used)
    known = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    assert all(known[r.doc_id] in (None, r.source) for r in used)
    assert not any(known[r.doc_id] == "z" for r in used)
    guessed = [r for r in used if known[r.doc_id] is None]
    assert guessed  # documents without source take part by their likeliest


def test_same_again(spark, docs):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    first, second = ({(r.doc_id, r.n_times) for r in mixing.mixed(docs.repartition(n), targets).collect()} for n in (3, 11))
    assert first == second


def test_odd_tables(spark, docs):
    targets = spark.createDataFrame([("a", 1.0, None), (None, 0.5, 1), ("b", None, 3)], TARGETS)
    got = {r.source: r.actual_share for r in mixing.shares(mixing.mixed(docs, targets), targets.filter("source IS NOT NULL")).collect()}
    assert got["a"] == pytest.approx(1.0)
    assert mixing.mixed(docs.limit(0), targets).count() == 0
    assert mixing.mixed(docs, targets.limit(0)).count() == 0


def test_classifier(spark):
    """Fitted on a part of the labelled mails, the posteriors find the source of others by the way they came."""
    r = random.Random(4)
    rows = [(i, f"From: x@{r.choice('ab')}{i % 3}.test\nDate: Thu, 30 Jun 2016 18:44:57 +0{i % 3}00\nSubject: note {r.choice('uvw')}\n\ntext", f"s{i % 3}") for i in range(900)]
    df = spark.createDataFrame([*rows, (1000, None, "s1"), (1001, "x", None)], "doc_id bigint, text string, source string").repartition(5)
    c = mixing.classifier(df, ["absent", "s0", "s1", "s2"], sample=200)
    assert c.prior.tolist() == [1, 301, 301, 301]
    p = [c.posteriors(t) for _, t, _ in rows]
    assert sum(c.labels[x.argmax()] == s for x, (_, _, s) in zip(p, rows, strict=True)) > 850
    assert all(abs(x.sum() - 1) < 1e-9 for x in [*p, c.posteriors(None), c.posteriors("")])
    assert mixing.classifier(df.limit(0), ["a"]).posteriors("x").tolist() == [1.0]


def test_no_mixture_is_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    monkeypatch.setattr(mixing, "ENOUGH", 1e-12)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    with pytest.raises(ValueError, match="still move"):
        mixing.mixed(docs, targets)


def test_whole_text(spark):
    """Sources that differ in a word at the end of long texts only, in an encoded body or far down in a header line are told apart."""
    r = random.Random(6)
    head = "From: x@y.test\nSubject: note\n"
    filler = lambda: "\n\n".join(" ".join(r.choice(["one", "two", "three", "four"]) for _ in range(40)) for _ in range(30))
    encoded = lambda x: base64.b64encode(x.encode()).decode()
    ways = {
        "end": lambda word: f"{head}\n{filler()}\n\n{word}",
        "bare": lambda word: f"{filler()}\n\n{word}",
        "encoded": lambda word: f"{head}Content-Transfer-Encoding: base64\n\n{encoded('one two ' * r.randint(20, 60) + word)}",
        "folded": lambda word: f"{head}Received: from z\n by {word}\n\none",
        "ninth": lambda word: f"{head}To: {', '.join(f'u@d{i}.test' for i in range(8))}, u@{word}.test\n\none",
    }
    for way, text in ways.items():
        rows = [(i, text(("alpha", "beta")[i % 2]), "ab"[i % 2]) for i in range(200)]
        c = mixing.classifier(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), ["a", "absent", "b"])
        told = [c.labels[c.posteriors(text(word)).argmax()] for word in ("alpha", "beta") * 10]
        assert told == ["a", "b"] * 10, way


@pytest.mark.parametrize("missing", [0.1, 0.9])
def test_missing_sources_by_words(spark, missing):
    """Mails without head and source are booked by their words, whether few or most of them."""
    r = random.Random(7)
    words, truth, rows = {"a": "alpha apple", "b": "beta banana"}, {}, []
    for i in range(600):
        truth[i] = s = r.choice("aab")
        rows.append((i, " ".join(r.choice(words[s].split()) for _ in range(r.randint(1, 30))), s if r.random() > missing else None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    used = mixing.mixed(docs, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)).collect()
    unknown = {i for i, _, s in rows if s is None}
    assert any(x.doc_id in unknown for x in used)
    assert all(truth[x.doc_id] == x.source for x in used)
