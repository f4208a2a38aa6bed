"""Similar records by signature trees.

A record is the set of its distinct token runs (here eight neighbouring letters). Copies of one
text are one record. The similarity of two records is the size of the intersection of their
sets by that of the union.

One tree over a whole collection is quadratic: the OR of a few unlike records prunes nothing, as each has
its share of all possible runs. So the trees stand under roots, each of which is a stretch of text: a record belongs to the
stretches of STRETCH letters with the least hash in any window of them (minimizers), so that two records
that have as many letters in common as reach() says, wherever they stand, have a root in common. An edit, an insertion or a moved part costs
each record seven runs or more; two records of the threshold's similarity have so few such breaks that one of the
pieces between them is that long. Only breaks that cost less, as runs that chance to stand elsewhere too, can make
the pieces shorter. For records of few runs, where the pieces are short, the roots are single runs by
the prefix rule (the runs of least hash, as many as a partner can't all be without), which misses nothing.

Roots with up to LEAF records are a single node: their pairs are candidates at once. Larger ones are trees: leaves in order of size, inner
nodes with the OR of the bitmaps of up to FAN children and their range of sizes. A dual traversal from (root, root) follows only
pairs of nodes whose greatest possible overlap can still reach the threshold, and not those whose records
all meet under an earlier root. Candidates are compared exactly, once.

A root with more than BLOCK records is cut into blocks by hash, and each pair of blocks is a
task of its own with a tree for each side: no root is held by one task and none is cut short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

RUN = 8
#: Bits of an inner node, and of a record.
BITS, LEAF_BITS = 1 << 13, 1 << 10
FAN = 4
LEAF = 8
BLOCK = 8192
#: Letters of a stretch, at most.
STRETCH = 16
FRONT = 1 << 20
MEMBERS = 1000

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def reach(threshold: float, run: int = RUN) -> tuple[int, int]:
    """letters, few: so many neighbouring letters two records of the threshold's similarity have in common if each break between
    common pieces costs run - 1 runs; records of fewer than `few` runs may have a partner for which that is not so."""
    t = min(threshold, 0.99)
    letters = min(run - 1 + math.floor(2 * (run - 1) * t / (1 - t)), 8 * STRETCH)
    while True:
        # the lesser of two records with n runs has ceil(2tn / (1 + t)) in common at least, and a break for each run - 1 of the others
        common = {n: math.ceil(2 * t * n / (1 + t) - 1e-9) for n in range(1, 40 * letters)}
        few = 1 + max((n for n, c in common.items() if math.ceil(c / (1 + (n - c) // (run - 1))) + run - 1 < letters), default=0)
        if few <= 3 * letters or letters <= run:
            return letters, math.ceil(few / t)
        letters -= 1


# fixed values: the nucleotide codes; texts of them are packed, four letters a byte, with the ambiguous ones beside
_LETTERS = "ACGTRYMKWSBDHVN"
_CODE = np.full(256, 255, np.uint8)
_CODE[list(_LETTERS.encode())] = range(15)
_UNPACKED = ((np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3).astype(np.uint8)
_OTHER = np.dtype([("at", "<u4"), ("code", "u1")])


Packed = tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def packed(texts: list[str]) -> Packed:
    """letters, body, other of texts, the latter two as bytes and row bounds. Of nucleotide texts: the number of letters, these by two
    bits and the ambiguous ones among them; of others: -1, UTF-8 and nothing."""
    whole = "".join(texts)
    codes = _CODE[np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)]
    if len(codes) != len(whole) or (codes == 255).any():  # some text is no nucleotide text: one by one
        if len(texts) > 1:
            return _joined([packed([t]) for t in texts])
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        return np.array([-1]), (data, np.array([0, len(data)])), (np.zeros(0, np.uint8), np.zeros(2, np.int64))
    n = np.array([len(t) for t in texts], np.int64)
    start, room = np.cumsum(n) - n, (n + 3) // 4
    bounds = np.concatenate(([0], np.cumsum(room)))
    odd = np.flatnonzero(codes > 3)
    owner = np.searchsorted(start, odd, "right") - 1
    other = np.zeros(len(odd), _OTHER)
    other["at"], other["code"] = odd - start[owner], codes[odd]
    codes[odd] = 0
    wide = np.zeros(4 * bounds[-1], np.uint8)
    wide[np.repeat(4 * bounds[:-1] - start, n) + np.arange(len(codes))] = codes
    wide = wide.reshape(-1, 4)
    body = wide[:, 0] << 6 | wide[:, 1] << 4 | wide[:, 2] << 2 | wide[:, 3]
    return n, (body, bounds), (other.view(np.uint8).ravel(), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(n))))) * _OTHER.itemsize)


def _joined(parts: list[Packed]) -> Packed:
    def bytes_(k: int) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([x[k][0] for x in parts]), np.concatenate(([0], np.cumsum([len(x[k][0]) for x in parts])))

    return np.concatenate([x[0] for x in parts]), bytes_(1), bytes_(2)


def _slow_tokens(text: str, run: int) -> np.ndarray:
    """The runs of any text as 64-bit numbers; a run of nucleotide codes has the number that it has in a packed text."""
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(data) < run:
        return np.zeros(0, _U)
    windows = np.lib.stride_tricks.sliding_window_view(data, run)
    value = np.zeros(len(windows), _U)
    for letter in windows.T:
        value = _mixed(value * _ODD + letter.astype(_U) + _U(1))
    value |= _U(1 << 63)
    if run == RUN:
        codes = np.where(data < 256, _CODE[np.minimum(data, 255)], 255).astype(_U)
        here = np.lib.stride_tricks.sliding_window_view(codes, run)
        known = (here < 15).all(1)
        value[known] = here[known] @ (_U(16) ** np.arange(run - 1, -1, -1, dtype=_U))
    return value


class Tokens:
    """The runs of many texts as packed() gives them: `flat` numbers with bounds `at` by record; a run that repeats in a record is there again."""

    def __init__(self, letters: np.ndarray, body: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], run: int) -> None:
        data, at = body
        if run == RUN and (letters >= 0).all():
            begin = at[:-1] * 4  # of each record among the unpacked codes
            codes = _UNPACKED[data[at[0] : at[-1]]].ravel()
            begin = begin - begin[0] if len(begin) else begin
            patches = np.frombuffer(other[0][other[1][0] : other[1][-1]].tobytes(), _OTHER)
            if len(patches):
                owner = np.repeat(np.arange(len(letters)), np.diff(other[1]) // _OTHER.itemsize)
                codes[begin[owner] + patches["at"]] = patches["code"]
            codes = np.concatenate((codes, np.zeros(run, np.uint8)))
            two = codes[:-1] << 4 | codes[1:]
            four = two[:-2].astype(np.uint16) << 8 | two[2:]
            eight = four[:-4].astype(np.uint32) << 16 | four[4:]
            count = np.maximum(letters - run + 1, 0)
            edge = np.zeros(len(eight) + 1, np.int8)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + count, -1)
            self.flat = eight[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
            self.at = np.concatenate(([0], np.cumsum(count)))
            return
        found = [_slow_tokens(unpacked(int(n), data[at[i] : at[i + 1]], other[0][other[1][i] : other[1][i + 1]]), run) for i, n in enumerate(letters)]
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
        self.flat = np.concatenate([*found, np.zeros(0, _U)])

    def mixed(self) -> np.ndarray:
        """32 well-mixed bits of each token."""
        x = self.flat.copy() if self.flat.dtype == np.uint32 else (self.flat ^ (self.flat >> _U(32))).astype(np.uint32)
        for shift, odd in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            x ^= x >> np.uint32(shift)
            x *= np.uint32(odd)
        x ^= x >> np.uint32(16)
        return x

    def distinct(self, i: int) -> np.ndarray:
        x = np.sort(self.flat[self.at[i] : self.at[i + 1]])
        return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x

    def sizes(self, part: np.ndarray | None = None) -> np.ndarray:
        """How many different runs (or numbers in `part`) each record has."""
        values = self.flat if part is None else part
        if values.dtype != np.uint32:
            values = np.unique(values, return_inverse=True)[1].astype(np.uint32)
        both = np.sort(np.repeat(np.arange(len(self.at) - 1, dtype=_U) << _U(32), np.diff(self.at)) | values)
        first = np.concatenate(([True], both[1:] != both[:-1])) if len(both) else np.zeros(0, bool)
        return np.bincount((both[first] >> _U(32)).astype(np.int64), minlength=len(self.at) - 1)


def unpacked(letters: int, body: np.ndarray, other: np.ndarray) -> str:
    if letters < 0:
        return body.tobytes().decode("utf-8", "surrogatepass")
    codes = _UNPACKED[body].ravel()[:letters]
    patches = np.frombuffer(other.tobytes(), _OTHER)
    codes[patches["at"]] = patches["code"]
    return np.frombuffer(_LETTERS.encode(), np.uint8)[codes].tobytes().decode("ascii")


def tokens_of(text: str, run: int = RUN) -> np.ndarray:
    """The distinct runs of a text as sorted numbers."""
    return Tokens(*packed([text]), run).distinct(0)


def bit_of(mixed: np.ndarray) -> np.ndarray:
    """The bit of a token in a node; a record's is that by BITS // LEAF_BITS."""
    return mixed >> np.uint32(32 - BITS.bit_length() + 1)


def stretches(texts: list[str], size: int, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """text, hash: the stretches of `size` letters that are least in a window of `letters` letters; where a text is shorter
    than a window, it is one."""
    whole = "".join(texts)
    data = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([len(t) for t in texts])
    start = np.cumsum(n) - n
    h, have = _mixed(data.astype(_U) + _U(1)), 1
    while have < size:  # hashes of longer and longer stretches
        step = min(have, size - have)
        h, have = _mixed(h[:-step] * _ODD + h[step:]) if len(h) > step else h[:0], have + step
    least, have, width = h, 1, letters - size + 1
    while have < width:
        step = min(have, width - have)
        least, have = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0], have + step
    count = np.maximum(n - letters + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    value = least[np.repeat(start - np.cumsum(count) + count, count) + np.arange(len(row))]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, bool)
    short = np.flatnonzero((n < letters) & (n >= size))
    few = np.array([h[start[i] : start[i] + n[i] - size + 1].min() for i in short], _U)
    return np.concatenate((row[new], short)), np.concatenate((value[new], few))


SIGNED = "rep bigint, size int, slack int, keys array<bigint>, letters int, body binary, other binary"


def signed(records: DataFrame, threshold: float, run: int = RUN) -> DataFrame:
    """Of records (rep, text): rep, size (distinct runs), slack (those beyond the first of each bit of a node), keys (its roots)
    and the packed text."""
    letters_common, few = reach(threshold, run)
    size_of_stretch = min(STRETCH, max(run, letters_common * 2 // 3))

    def prefix(t: Tokens, i: int) -> np.ndarray:
        own = _mixed(t.distinct(i).astype(_U) + _U(7))
        own.sort()
        return own[: len(own) - math.ceil(threshold * len(own) - 1e-9) + 1]

    def binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                letters, body, other = packed(texts)
                t = Tokens(letters, body, other, run)
                size = t.sizes()
                slack = size - t.sizes(bit_of(t.mixed()))
                row, key = stretches(texts, size_of_stretch, letters_common)
                small = np.flatnonzero(size < few)
                more = [prefix(t, i) for i in small]
                row = np.concatenate((row, np.repeat(small, [len(x) for x in more])))
                key = np.concatenate((key, *more))
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1]))) if len(row) else np.zeros(0, bool)
                row, key = row[new], key[new]  # a root once a record
                bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts))))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(key.view(np.int64)))
                columns = [pa.array(size.astype(np.int32)), pa.array(slack.astype(np.int32)), listed, pa.array(letters.astype(np.int32)), binary(*body), binary(*other)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["rep", "size", "slack", "keys", "letters", "body", "other"])

    return records.select("rep", "text").mapInArrow(run_all, SIGNED)


def _bitmaps(groups: int, place: np.ndarray, bits: int) -> np.ndarray:
    """The OR by group of single bits, as 64-bit words; place: group * bits + bit, groups ascending."""
    out = np.zeros((groups, bits // 64), _U)
    step = max(1, (1 << 22) // bits)
    cuts = np.searchsorted(place, np.arange(0, groups + step, step) * bits) if groups > step else [0, len(place)]
    for k in range(0, groups, step):
        flags = np.zeros(min(step, groups - k) * bits, bool)
        flags[place[cuts[k // step] : cuts[k // step + 1]] - k * bits] = True
        out[k : k + step] = np.packbits(flags).view(_U).reshape(-1, bits // 64)
    return out


class Forest:
    """Trees over consecutive records; level 0 are the records themselves.

    tree: the tree of each record, ascending; bit: of each token, of BITS; at: bounds of a record's tokens; met: records
    with one number here meet elsewhere, those with 0 don't. `seen` and `kept` count the pairs of nodes by level that
    were looked at and followed.
    """

    def __init__(self, tree: np.ndarray, size: np.ndarray, slack: np.ndarray, bit: np.ndarray, at: np.ndarray, met: np.ndarray, fan: int = FAN) -> None:
        counts, shift = np.diff(at), (BITS // LEAF_BITS).bit_length() - 1
        place = np.repeat(np.arange(len(tree)) * LEAF_BITS, counts) + (bit >> np.uint32(shift))
        bits = _by_rows(_bitmaps, len(tree), place, LEAF_BITS, at)
        self.levels = [{"bits": bits, "lo": size, "hi": size, "slack": size - np.bitwise_count(bits).sum(1, dtype=np.int64), "met": met}]
        while True:
            last = self.levels[-1]
            first = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
            many = np.diff(np.concatenate((first, [len(tree)])))
            if len(self.levels) > 1 and (many == 1).all():
                break
            starts = np.flatnonzero((np.arange(len(tree)) - np.repeat(first, many)) % fan == 0)
            stops = np.concatenate((starts[1:], [len(tree)]))
            node = {"lo": np.minimum.reduceat(last["lo"], starts), "hi": np.maximum.reduceat(last["hi"], starts), "from": starts, "to": stops}
            least, most = (f.reduceat(last["met"], starts) for f in (np.minimum, np.maximum))
            node["met"] = np.where(least == most, least, 0)
            if len(self.levels) == 1:
                tokens = at[stops] - at[starts]
                node["bits"] = _by_rows(_bitmaps, len(starts), np.repeat(np.arange(len(starts)) * BITS, tokens) + bit, BITS, np.concatenate((at[starts], at[-1:])))
                node["slack"] = np.maximum.reduceat(slack, starts)
            else:
                node["bits"] = np.bitwise_or.reduceat(last["bits"], starts, axis=0)
                node["slack"] = np.maximum.reduceat(last["slack"], starts)
            self.levels.append(node)
            tree = tree[starts]
        self.roots = tree
        self.seen, self.kept = ([0] * len(self.levels) for _ in range(2))

    def may(self, level: int, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """Whether a pair under these nodes can reach the threshold by sizes and greatest overlap.

        Common tokens take bits that both have; beyond one a bit, a record has at most its slack.
        """
        n = self.levels[level]
        bits, lo, hi, slack, met = n["bits"], n["lo"], n["hi"], n["slack"], n["met"]
        ok = ((met[i] == 0) | (met[i] != met[j])) & (hi[i] >= threshold * lo[j] - 1e-9) & (hi[j] >= threshold * lo[i] - 1e-9)
        rest = np.flatnonzero(ok)
        i, j = i[rest], j[rest]
        shared = np.zeros(len(rest), np.int64)
        step = max(1, (1 << 16) // bits.shape[1])  # as much as stays in a core's cache
        for k in range(0, len(rest), step):
            shared[k : k + step] = np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(1, dtype=np.uint16)
        most = np.minimum(np.minimum(hi[i], hi[j]), shared + np.minimum(slack[i], slack[j]))
        ok[rest] = most >= threshold / (1 + threshold) * (lo[i] + lo[j]) - 1e-9
        return ok

    def pairs(self, i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different records under the root pairs (i, j) that may reach the threshold."""
        stack = [(len(self.levels) - 1, i, j)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > FRONT // FAN**2 and level or len(i) > FRONT:
                half = len(i) // 2
                stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
                continue
            if level == 0:
                different = i != j
                i, j = i[different], j[different]
            self.seen[level] += len(i)
            ok = self.may(level, i, j, threshold)
            i, j = i[ok], j[ok]
            self.kept[level] += len(i)
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            n = self.levels[level]
            ni, nj = n["to"][i] - n["from"][i], n["to"][j] - n["from"][j]
            product = ni * nj
            of = np.repeat(np.arange(len(i)), product)
            k = np.arange(len(of)) - np.repeat(np.cumsum(product) - product, product)
            a, b = n["from"][i][of] + k // nj[of], n["from"][j][of] + k % nj[of]
            once = (i[of] != j[of]) | (a <= b)  # a node with itself: each pair of children once
            stack.append((level - 1, a[once], b[once]))


def _by_rows(make, groups: int, place: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    """make(groups, place, bits) in pieces of some rows, so that positions stay small; at: bounds of a group's tokens."""
    step = max(1, (1 << 23) // bits)
    return np.concatenate([make(min(step, groups - k), place[at[k] : at[min(groups, k + step)]] - k * bits, bits) for k in range(0, groups, step)])


def _bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and its row bounds."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


class Bucket:
    """Whole tasks (key, p, q) of sorted rows of trees(): their trees and the candidates found in them."""

    def __init__(self, rows: pa.Table, run: int) -> None:
        key, p, q, side, size, slack, first, self.rep, letters = (rows[c].to_numpy() for c in ("key", "p", "q", "side", "size", "slack", "first", "rep", "letters"))
        tokens = Tokens(letters.astype(np.int64), _bytes(rows["body"]), _bytes(rows["other"]), run)
        task = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))) - 1
        tree = task * 2 + (side == q) * (p != q)
        self.forest = Forest(tree, size.astype(np.int64), slack.astype(np.int64), bit_of(tokens.mixed()), tokens.at, np.where(first == key, 0, first))
        roots = self.forest.roots
        single = (p == q)[np.searchsorted(task, roots // 2)]
        own = np.flatnonzero(single)
        left = np.flatnonzero(~single & (roots % 2 == 0))
        right = np.searchsorted(roots, roots[left] + 1)
        there = (right < len(roots)) & (roots[np.minimum(right, len(roots) - 1)] == roots[left] + 1)
        self.i, self.j = np.concatenate((own, left[there])), np.concatenate((own, right[there]))

    def found(self, threshold: float) -> Iterator[pa.RecordBatch]:
        for i, j in self.forest.pairs(self.i, self.j, threshold):
            a, b = self.rep[i], self.rep[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, rep) sorted by key to pairs (a, b) of roots with 2 to LEAF records and members (key, a) of larger ones."""
    key, rep = np.zeros(0, np.int64), np.zeros(0, np.int64)
    large = None  # a root that is known to be large goes on

    def out(k: np.ndarray, r: np.ndarray, ends: bool) -> Iterator[pa.RecordBatch]:
        """Of whole roots; the last one may go on if not `ends`, and has more than LEAF records then."""
        if not len(k):
            return
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        n = np.diff(np.concatenate((first, [len(k)])))
        many = n > LEAF
        many[0] |= large is not None and k[0] == large
        member = np.repeat(many, n)
        a, b = [], []
        for step in range(1, LEAF):
            at = np.flatnonzero(~member[:-step] & (k[step:] == k[:-step]))
            a.append(np.minimum(r[at], r[at + step]))
            b.append(np.maximum(r[at], r[at + step]))
        a, b = np.concatenate(a), np.concatenate(b)
        keys = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(k[member])])
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate((a, r[member]))), pa.concat_arrays([pa.array(b), pa.nulls(int(member.sum()), pa.int64())])], ["key", "a", "b"])

    for batch in batches:
        key = np.concatenate((key, batch.column(0).to_numpy()))
        rep = np.concatenate((rep, batch.column(1).to_numpy()))
        if not len(key):
            continue
        start = int(np.searchsorted(key, key[-1]))
        if len(key) - start > LEAF or key[-1] == large:
            start, now = len(key), key[-1]
        else:
            now = None
        yield from out(key[:start], rep[:start], now is None)
        large = now
        key, rep = key[start:], rep[start:]
    yield from out(key, rep, True)


def _traverse(batches: Iterator[pa.RecordBatch], threshold: float, run: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pairs; whole tasks at a time."""
    held: list[pa.RecordBatch] = []

    def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        if rows.num_rows > 1:
            yield from Bucket(rows, run).found(threshold)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[batch.num_rows - 1] for c in range(3)]
        same = np.ones(batch.num_rows, bool)
        for c in range(3):
            same &= batch.column(c).to_numpy() == last[c].as_py()
        cut = int(np.argmax(same))  # the last task may go on in the next batch
        if cut or (held and any(held[-1].column(c)[0] != last[c] for c in range(3))):
            yield from flush([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from flush(held)


def _exact(batches: Iterator[pa.RecordBatch], threshold: float, run: int) -> Iterator[pa.RecordBatch]:
    """Candidates with both packed texts to pairs and their similarity."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sides = [Tokens(part.column(k).to_numpy().astype(np.int64), _bytes(part.column(k + 1)), _bytes(part.column(k + 2)), run) for k in (2, 5)]
            if any(t.flat.dtype != np.uint32 for t in sides):  # other texts: the numbers of both sides are numbered together
                number = np.unique(np.concatenate([t.flat.astype(_U) for t in sides]), return_inverse=True)[1].astype(np.uint32)
                sides[0].flat, sides[1].flat = number[: len(sides[0].flat)], number[len(sides[0].flat) :]
            sets = []
            for t in sides:
                both = np.sort(np.repeat(np.arange(part.num_rows, dtype=_U) << _U(32), np.diff(t.at)) | t.flat)
                sets.append(both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both)
            all_ = np.sort(np.concatenate(sets))
            shared = np.bincount((all_[1:][all_[1:] == all_[:-1]] >> _U(32)).astype(np.int64), minlength=part.num_rows)
            union = np.bincount((all_ >> _U(32)).astype(np.int64), minlength=part.num_rows) - shared
            ok = shared >= threshold * union - 1e-9
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(shared[ok] / np.maximum(union[ok], 1))], ["a", "b", "similarity"])


def record_classes(df: DataFrame, id_column: str, text: str, run: int = RUN) -> DataFrame:
    """rep (the least id), text, n: one row for each different text of at least `run` characters."""
    kept = df.select(F.col(id_column).cast("bigint").alias("_id"), F.col(text).alias("text")).filter(F.length("text") >= run)
    return kept.groupBy("text").agg(F.min("_id").alias("rep"), F.count("*").alias("n"))


def trees(signs: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, p, q, side, first, size, rep, slack and packed text: the members (key, rep) of large roots by pair of blocks, sorted as the
    trees need them; first: the least of a record's large roots."""
    hot = written(members.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > block).select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    first = members.groupBy("rep").agg(F.min("key").alias("first"))
    rows = members.join(first, "rep").join(signs.drop("keys"), "rep")
    if hot.isEmpty():
        cut = rows.withColumns({"p": F.lit(0), "q": F.lit(0), "side": F.lit(0)})
    else:  # Spark sends `hot` along if its file is small and joins on the key otherwise
        here = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        here = here.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cut = here.withColumns({"p": F.least("side", "against"), "q": F.greatest("side", "against")})
    ordered = cut.select("key", "p", "q", "side", "first", "size", "rep", "slack", "letters", "body", "other").repartition("key", "p", "q")
    return ordered.sortWithinPartitions("key", "p", "q", "side", "first", "size", "rep")


def similar_records(records: DataFrame, threshold: float, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """a < b, similarity: the pairs of different texts in records (rep bigint, text) with at least this similarity, once each."""
    signs = written(signed(records, threshold, run))
    roots = signs.select(F.explode("keys").alias("key"), "rep").repartition("key").sortWithinPartitions("key")
    shared = written(roots.mapInArrow(_shared, "key bigint, a bigint, b bigint"))
    members = shared.filter("b IS NULL").select("key", F.col("a").alias("rep"))
    grown = trees(signs, members, block).mapInArrow(lambda b: _traverse(b, threshold, run), "a bigint, b bigint")
    # as many tasks as the session has partitions, as comparing takes long for its bytes
    tasks = max(int(signs.sparkSession.conf.get("spark.sql.shuffle.partitions")), signs.sparkSession.sparkContext.defaultParallelism)
    found = shared.filter("b IS NOT NULL").select("a", "b").unionByName(grown).repartition(tasks, "a", "b").distinct()
    text = lambda x: signs.select(F.col("rep").alias(x), F.col("size").alias(f"s{x}"), *[F.col(c).alias(c + x) for c in ("letters", "body", "other")])
    both = found.join(text("a"), "a").join(text("b").repartition(tasks, "b"), "b").filter((F.col("sa") >= threshold * F.col("sb") - 1e-9) & (F.col("sb") >= threshold * F.col("sa") - 1e-9))
    return both.select("a", "b", "lettersa", "bodya", "othera", "lettersb", "bodyb", "otherb").mapInArrow(lambda b: _exact(b, threshold, run), "a bigint, b bigint, similarity double")


def _block(id_: Column, n: Column) -> Column:
    """The block of a member of a class of n rows; blocks have some MEMBERS rows."""
    return F.pmod(F.xxhash64(id_), F.ceil(n / MEMBERS)).cast("int")


def similar_rows(df: DataFrame, id_column: str, text: str, threshold: float, run: int = RUN) -> DataFrame:
    """rec_a < rec_b: all pairs of rows whose texts reach the threshold, copies of a text included.

    Pairs of classes become pairs of blocks of their members, so that no task holds a class of many copies.
    Defined cases: null texts and texts under `run` characters are in no pair; repeated texts pair with each other;
    ids must be unique; empty tables give no rows; other columns of df aren't read.
    """
    classes = written(record_classes(df, id_column, text, run))
    pairs = similar_records(classes, threshold, run).select("a", "b")
    many = written(classes.filter(F.col("n") > 1))
    members = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text")).join(many, "text").select("rep", _block(F.col("id"), F.col("n")).alias("blk"), "id")
    left, right = (members.select(F.col("rep").alias(x), F.col("blk").alias(f"_b{x}"), F.col("id").alias(f"_{x}")) for x in "ab")
    blocks = many.select("rep", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks"))
    block = lambda x: F.explode(F.sequence(F.lit(0), F.coalesce(f"_n{x}", F.lit(1)) - 1))
    for x in "ab":
        pairs = pairs.join(blocks.select(F.col("rep").alias(x), F.col("blocks").alias(f"_n{x}")), x, "left").withColumn(f"_b{x}", block(x))
    spread = pairs.join(left, ["a", "_ba"], "left").join(right, ["b", "_bb"], "left").select(F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b"))
    own = blocks.select(F.col("rep").alias("a"), F.col("rep").alias("b"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_ba"))
    own = own.select("a", "b", "_ba", F.explode(F.sequence(F.col("_ba"), F.col("blocks") - 1)).alias("_bb"))
    copies = own.join(left, ["a", "_ba"]).join(right, ["b", "_bb"]).filter((F.col("_ba") < F.col("_bb")) | (F.col("_a") < F.col("_b"))).select("_a", "_b")
    return spread.unionByName(copies).select(F.least("_a", "_b").alias("rec_a"), F.greatest("_a", "_b").alias("rec_b"))


def similar_classes(df: DataFrame, id_column: str, text: str, threshold: float, run: int = RUN) -> DataFrame:
    """One row for each row of at least `run` characters: id, class_id (least id with the same text), n_copies, n_links
    (other texts at least this similar)."""
    classes = written(record_classes(df, id_column, text, run))
    pairs = similar_records(classes, threshold, run)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    links = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
    counted = classes.join(links, "rep", "left").select("text", F.col("rep").alias("class_id"), F.col("n").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return rows.join(counted, "text").select("id", "class_id", "n_copies", "n_links")
