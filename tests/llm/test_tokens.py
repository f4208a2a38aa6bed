"""The transducer against public libraries, and round trips."""

import os
import random

import numpy as np
import pytest

from seqloom.llm import tokens as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.VOCABULARY), reason="no vocabulary files")
POOL = "ab cdeXY  \n\n\t'''sreltdvm019.,;!?<|endoftext|>éüß漢字😀👍  \x85\x1c٣½ªǅاالع‍"


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    v = tk.vocabulary()
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ids, special_tokens={})


def random_texts(n):
    r = random.Random(1)
    return ["".join(r.choice(POOL) * r.choice([1, 1, 1, 2, 7]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_ids(library):
    v = tk.vocabulary()
    for text in random_texts(800):
        assert tk.encode(text, v) == library.encode_ordinary(text), text


def test_any_pieces_give_the_same(library):
    r, v = random.Random(2), tk.vocabulary()
    for text in random_texts(400):
        machine, out, at = tk.StreamingEncoder(v), b"", 0
        while at < len(text):
            step = r.randint(1, 9)
            out += machine.feed(text[at : at + step])
            at += step
        out += machine.feed("", True)
        assert np.frombuffer(out, np.int32).tolist() == library.encode_ordinary(text), text


@pytest.mark.parametrize("text", ["a" * 9000, " " * 9000 + "x", "ab" * 5000 + " \n" * 3000, "\n" * 9000, "x " + "!?" * 4000 + "1" * 5000 + "é" * 5000])
def test_long_words(library, monkeypatch, text):
    monkeypatch.setattr(tk, "CHUNK", 1000)
    assert tk.encode(text, tk.vocabulary()) == library.encode_ordinary(text)


def test_memory_is_bounded():
    machine, most = tk.MergeMachine(tk.vocabulary()), 0
    for _ in range(100):
        list(machine.feed(b"abcabz" * 50))
        most = max(most, len(machine.begins))
    assert most < 6 * tk.vocabulary().longest


def test_every_text_streams(monkeypatch):
    """Texts of any length go through the encoder in pieces."""
    fed = []
    feed = tk.StreamingEncoder.feed
    monkeypatch.setattr(tk.StreamingEncoder, "feed", lambda self, text, final=False: fed.append(text) or feed(self, text, final))
    tk.encode("a few words", tk.vocabulary())
    assert fed == ["a few words"]


def test_words_by_machine():
    """The machine gives what merging by rank gives, for words of any length."""
    v = tk.vocabulary()
    for text in random_texts(60):
        for word in text.split():
            machine, data = tk.MergeMachine(v), word.encode("utf-8", "surrogatepass")
            assert machine.feed(data[:5]) + machine.feed(data[5:]) + machine.flush() == [v.ids[t] for t in v.merge(data)]


def test_table_of_words(monkeypatch):
    """Words that come again stay in the bounded table."""
    monkeypatch.setattr(tk, "CACHE_WORDS", 10)
    words = tk._Words(tk.vocabulary())
    for k in range(100):
        words[f" word{k}"], words[" often"]
        assert len(words) <= 10 and len(words.old) <= 10 and (" often" in words or " often" in words.old)


def test_round_trip():
    v = tk.vocabulary()
    for text in random_texts(300):
        assert tk.decode(tk.encode(text, v), v) == text
    for text in ("", "aé", "\U0001f600"):
        assert tk.decode(tk.encode(text, v), v) == text


def test_decoder_replaces_broken_bytes():
    v = tk.vocabulary()
    byte = {i: t for t, i in v.ids.items() if len(t) == 1}
    of = {t: i for i, t in byte.items()}
    for data in (b"\xc3", b"\xe2\x82", b"a\xffb", b"\xf0\x9f\x98", b"\xc3\xa9\xc3(", b"\xed\xa0\x80"):
        got = tk.decode([of[bytes([b])] for b in data], v)
        assert "�" in got and got.replace("�", "").isprintable()


def test_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello world", "c"), (3, "Hello world", "c"), (4, "x" * 200_000, "d"), (5, "<|endoftext|>", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = tk.encode_column(df, ["doc_id"]).collect()
    by = {r.doc_id: list(r.ids) for r in got}
    assert len(got) == 6 and by[1] == by[2] == [] and by[3] == [15496, 995] and len(by[5]) > 1
    counts = {r.doc_id: r.n_tokens for r in tk.count_column(df, ["doc_id"]).collect()}
    assert counts == {k: len(v) for k, v in by.items()}
    back = {r.doc_id: r.decoded for r in tk.decode_column(tk.encode_column(df, ["doc_id"]), ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert tk.encode_column(df.limit(0), ["doc_id"]).count() == 0
