"""Encoding with a public byte-level BPE vocabulary as a streaming transducer.

Two stages, each of which emits what no later input can change and keeps the rest:

- Words. The pattern's alternatives are runs of one character class, so a word that ends at e
  is final once two characters after e are known (the longest contraction has two letters, and
  white space is undecided only in its last character).
- Merges. For a prefix of a word's bytes there is exactly one last token t such that t fits
  the last token of the rest: a pair (s, t) fits if s + t encodes to just s and t, and an
  encoding is one whose neighbouring pairs all fit. The machine keeps, for each byte position,
  where its last token begins. A later token can begin at most `lookahead()` bytes back, the
  length of the longest merge result less one; tokens on which all positions in that window
  agree are final and leave the machine. Memory is the window and not the text.

Every text goes through the first stage in pieces of CHUNK characters. The second stage holds back the lookahead; a
word that ends within it is merged at once, rank by rank, with the same result. Words repeat, so short ones are
looked up in a bounded table of what came out before.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 1 << 16
LONG = 1 << 12
CACHE_WORDS = 1 << 17
CACHE_BYTES = 64
NEVER = 1 << 60

# fixed values: the white space of Unicode's White_Space property
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"


def _ranges(major: str) -> str:
    """The code points of a general category as ranges of a character class."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append((first, c - 1))
            first = None
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in out)


@lru_cache(1)
def patterns() -> tuple[re.Pattern, re.Pattern, dict[str, re.Pattern]]:
    """Words of any text, words of ASCII text, and the runs by class."""
    letters, digits = _ranges("L"), _ranges("N")

    def words(ltr: str, num: str, white: str) -> re.Pattern:
        # the most frequent first; only contractions and other marks can begin alike
        return re.compile(f" ?[{ltr}]+| ?[{num}]+|{CONTRACTIONS}| ?[^{white}{ltr}{num}]+|[{white}]+(?![^{white}])|[{white}]+")

    runs = {"L": f"[{letters}]*", "N": f"[{digits}]*", "P": f"[^{WHITE}{letters}{digits}]*", "W": f"[{WHITE}]*"}
    return words(letters, digits, WHITE), words("A-Za-z", "0-9", "\t-\r "), {k: re.compile(v) for k, v in runs.items()}


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.texts = {i: t for t, i in self.ids.items()}
        self.packed = {t: i.to_bytes(4, sys.byteorder) for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self._automaton: ahocorasick.Automaton | None = None
        self.words = _Words(self)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}  # whether tokens can be neighbours; bounded

    @property
    def automaton(self) -> ahocorasick.Automaton:
        """Of all tokens, byte by byte; made for the first long word."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for token in self.ids:
                self._automaton.add_word(token.decode("latin-1"), token)
            self._automaton.make_automaton()
        return self._automaton

    def lookahead(self) -> int:
        """How many bytes after a byte position can still take part in a token that covers it."""
        return self.longest - 1

    def merge(self, word: bytes) -> list[bytes]:
        """The encoding by its definition: again and again the merge of lowest rank, leftmost first."""
        get, parts = self.ids.get, [word[i : i + 1] for i in range(len(word))]
        ranks = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], NEVER)
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHE_WORDS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == ([left, right] if left else [right])
        return known


class _Words(dict):
    """Encodings of short words as the bytes of int32 ids; bounded: what wasn't asked for since the table was last full is forgotten."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, word: str) -> bytes:
        v = self.vocabulary
        out = self.old.get(word)
        if out is None:
            data = word.encode("utf-8", "surrogatepass")
            if len(data) > v.lookahead():
                machine = MergeMachine(v)
                return np.array(machine.feed(data) + machine.flush(), np.int32).tobytes()
            # it ends within the lookahead, so the machine could emit nothing before its end: merge at once, which takes a third of the time
            out = b"".join([v.packed[t] for t in v.merge(data)])
            if len(data) > CACHE_BYTES:
                return out
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


class MergeMachine:
    """Bytes of one word in, final token ids out. Positions count from the word's first byte."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.matches = None  # the automaton's state
        self.base = 0  # up to here all is emitted
        self.begins = [0]  # of the last token by end position, from base on
        self.last = [b""]  # the last token itself

    def feed(self, data: bytes) -> list[int]:
        v, text, out = self.v, data.decode("latin-1"), []
        if self.matches is None:
            self.matches = v.automaton.iter(text)
        else:
            self.matches.set(text)
        base, begins, last, fits = self.base, self.begins, self.last, v.fits
        end = base + len(begins)  # the position that is open
        for at, token in self.matches:  # by end, the longest first
            if at + 1 < end:
                continue
            start = end - len(token)
            if start >= base and fits(last[start - base], token):
                begins.append(start)
                last.append(token)
                end += 1
                if end - base > 4 * v.longest:
                    out += self._settle(v.lookahead())
                    base, begins, last = self.base, self.begins, self.last
        return out

    def _settle(self, window: int) -> list[int]:
        """Emit what all positions from which a later token can start have in common."""
        end = self.base + len(self.begins) - 1
        waiting = set(range(max(self.base, end - window), end + 1))
        while len(waiting) > 1:
            latest = max(waiting)
            waiting.remove(latest)
            waiting.add(self.begins[latest - self.base])
        (common,) = waiting
        out = self._path(common)
        k = common - self.base
        self.base, self.begins, self.last = common, self.begins[k:], self.last[k:]
        return out

    def _path(self, end: int) -> list[int]:
        out = []
        while end > self.base:
            out.append(self.v.ids[self.last[end - self.base]])
            end = self.begins[end - self.base]
        return out[::-1]

    def flush(self) -> list[int]:
        out = self._path(self.base + len(self.begins) - 1)
        self.matches, self.base, self.begins, self.last = None, 0, [0], [b""]
        return out


class StreamingEncoder:
    """Text in pieces of any size in, the int32 bytes of final ids out."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.any, self.ascii, self.runs = patterns()
        self.text = ""
        self.open = ""  # the class of a long word that goes through the machine
        self.machine = MergeMachine(vocabulary)

    def feed(self, text: str, final: bool = False) -> bytes:
        self.text += text
        out = []
        while True:
            if self.open and not self._continue(out, final):
                break
            words = (self.ascii if self.text.isascii() else self.any).findall(self.text)
            kept = 0
            if not final:
                while words and (kept == 0 or kept + len(words[-1]) < len(words[-1]) + 2):
                    kept += len(words.pop())
            out += map(self.v.words.__getitem__, words)
            self.text = self.text[len(self.text) - kept :]
            if final or len(self.text) < LONG:
                break
            head = self.text[1] if self.text[0] == " " and len(self.text) > 1 else self.text[0]
            self.open = next(c for c in "WLNP" if self.runs[c].match(head).end())
            if self.open != "W" and self.text[0] == " ":
                out.append(self._ids(self.machine.feed(b" ")))
                self.text = self.text[1:]
        return b"".join(out)

    def _continue(self, out: list[bytes], final: bool) -> bool:
        """Feed the open word; true if it ended, with the rest of the text to be done."""
        end = self.runs[self.open].match(self.text).end()
        over = final or end < len(self.text)
        if self.open == "W" and not (final and end == len(self.text)):
            end -= 1  # its last character goes to the next word, if one follows
        out.append(self._ids(self.machine.feed(self.text[: max(0, end)].encode("utf-8", "surrogatepass"))))
        self.text = self.text[max(0, end) :]
        if over:
            out.append(self._ids(self.machine.flush()))
            self.open = ""
        return over

    @staticmethod
    def _ids(ids) -> bytes:
        return np.array(list(ids), np.int32).tobytes()


class StreamingDecoder:
    """Ids in, text out: an incremental byte-to-text state machine.

    The state is the bytes of an unfinished character (at most three). Tokens that are whole
    characters are looked up while the state is empty. Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.need = 0
        self.low, self.high = 0x80, 0xBF
        self.value = 0

    def feed(self, ids) -> str:
        out = []
        for i in ids:
            token = self.v.texts[i]
            if not self.need and token.isascii():
                out.append(token.decode("ascii"))
                continue
            for byte in token:
                self._byte(byte, out)
        return "".join(out)

    def _byte(self, byte: int, out: list[str]) -> None:
        if self.need:
            if self.low <= byte <= self.high:
                self.value, self.need, self.low, self.high = self.value << 6 | byte & 63, self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(chr(self.value))
                return
            out.append("�")
            self.need, self.low, self.high = 0, 0x80, 0xBF
        if byte < 0x80:
            out.append(chr(byte))
        elif 0xC2 <= byte <= 0xDF:
            self.need, self.value = 1, byte & 31
        elif 0xE0 <= byte <= 0xEF:
            self.need, self.value = 2, byte & 15
            self.low, self.high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(byte, (0x80, 0xBF))
        elif 0xF0 <= byte <= 0xF4:
            self.need, self.value = 3, byte & 7
            self.low, self.high = {0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
        else:
            out.append("�")

    def flush(self) -> str:
        left, self.need, self.low, self.high = self.need, 0, 0x80, 0xBF
        return "�" if left else ""


@lru_cache(4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)


def encode_bytes(text: str, v: Vocabulary) -> bytes:
    """The int32 bytes of a text's ids."""
    machine = StreamingEncoder(v)
    return b"".join([machine.feed(text[i : i + CHUNK], i + CHUNK >= len(text)) for i in range(0, len(text), CHUNK)])


def encode(text: str, v: Vocabulary) -> list[int]:
    return np.frombuffer(encode_bytes(text, v), np.int32).tolist()


def decode(ids, v: Vocabulary) -> str:
    machine = StreamingDecoder(v)
    return machine.feed(ids) + machine.flush()


def _over(df: DataFrame, keep: list[str], text: str, out: str, kind: str, make) -> DataFrame:
    """keep and `out` for each row; only these columns and `text` are read."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), make(batch.column(len(keep)))], [*keep, out])

    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, f"{fields}, {out} {kind}")


def encode_column(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """keep and `ids`, the ids of the whole text without special tokens.

    Defined cases: null and empty texts give an empty list; a special token's string is ordinary text; very long texts
    go through the machine in pieces of CHUNK characters; repeated rows come out each.
    """

    def make(column: pa.Array) -> pa.Array:
        v = vocabulary(path)
        parts = [encode_bytes(t, v) if t else b"" for t in column.to_pylist()]
        offsets = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return _over(df, keep, text, "ids", "array<int>", make)


def count_column(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """keep and `n_tokens`; 0 for null and empty texts."""

    def make(column: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([len(encode_bytes(t, v)) // 4 if t else 0 for t in column.to_pylist()], pa.int64())

    return _over(df, keep, text, "n_tokens", "bigint", make)


def decode_column(df: DataFrame, keep: list[str], ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """keep and `decoded`, the text of a list of ids; null for null, empty for an empty list."""

    def make(column: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([None if i is None else decode(i, v) for i in column.to_pylist()], pa.string())

    return _over(df, keep, ids, "decoded", "string", make)
