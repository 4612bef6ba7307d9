"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Ids stand in ascending doc_id order. A block has ``BLOCK`` ids and starts from an empty model. For every id an order-2 and an order-1 table (of the
ids before it) and an order-0 candidate each predict one id; which prediction hits, or else in which of five classes by size the id lies (the adaptive
order-0 distribution), is one of eight events. Their probabilities are mixed from two adaptive models (one sees the tables' confidences, one the last
event) by a weight that follows the better, and drive a range coder with 48-bit state and carries. The low bits of ids that nobody predicted, close to
even within a class, follow as plain bits.

Blocks don't depend on each other, so NumPy codes up to ``LANES`` of them in step, one id of each at a time. Eight probabilities of 16 bits are two
64-bit integers, so that one operation mixes, sums up or ages four of them. A block is a row of a table: (part, block, data); data is a header,
the pieces of documents it holds (place in its part, id, number of ids, whether the document ends), the coded words, the plain bits and a CRC-32 of all that.

Defined cases: null and empty texts are the end id alone; null doc_ids come first; rows of one doc_id are ordered by text; damaged blocks raise
``ValueError``; an empty table makes no block.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .bpe import byte_characters
from .common import release, slices, stash, text_or_empty, tidy, unstash

BLOCK, LANES = 2048, 8192
#: Bytes of text in a part at most, and at least where there are cores for more parts: NumPy's calls cost the same for few blocks as for many.
PART_BYTES, LEAST_BYTES = 32 << 20, 4 << 20
END = 1
#: Letter runs and other marks whose ids a task remembers: so many of the last ones, and as many of before.
MOST_CACHED = 400_000
#: Bytes of text whose words are numbered at once.
TEXT_BYTES = 8 << 20
MAGIC = b"QTK2"
_T2, _T1 = 512, 256
_BITS = 15
_ONES, _HIGH, _DECAY, _TOP = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000), np.uint64(0x00FF00FF00FF00FF), np.uint64(48)
_FULL = np.uint64((1 << 48) - 1)
#: Events: a hit of order 2, 1 or 0, then five classes of ids with their smallest id and plain bits.
_FLOOR = np.array([0, 0, 0, 0, 512, 1024, 2048, 10240], np.int32)
_WIDTH = np.array([0, 0, 0, 9, 9, 10, 13, 16], np.int32)
_CLASS = np.searchsorted(_FLOOR[4:], np.arange(1 << 16), "right") + 3
_ADD = np.array([[1 << 16 * (e & 3) if e >> 2 == w else 0 for e in range(8)] for w in range(2)], np.uint64)
#: How a table's confidence moves, by hit * 4 + confidence.
_DELTA = np.array([0, -1, -1, -1, 1, 1, 1, 0], np.int32)


class _Coder:
    """Range coder state of all lanes; encodes if ``words`` is None."""

    def __init__(self, lanes: int, words: np.ndarray | None):
        self.range = np.full(lanes, 1 << 48, np.uint64)
        self.low = np.zeros(lanes, np.uint64)
        self.encoding = words is None
        self.width = BLOCK // 2 + 8 if words is None else words.shape[1]
        self.at = np.arange(lanes) * self.width  # places in the flat array of words
        if words is None:
            self.out = np.zeros(lanes * self.width, np.uint16)
            self.at += 1  # below the first word, so that a carry never meets another lane
        else:
            self.out = words.ravel()
            for _ in range(3):
                self.low = self.low << np.uint64(16) | self.out[self.at]
                self.at += 1

    def divide(self) -> None:
        self.unit = self.range >> np.uint64(_BITS)

    def place(self) -> np.ndarray:
        """Decoding: where in [0, 2**_BITS) each lane's value lies."""
        return np.minimum(self.low // self.unit, np.uint64((1 << _BITS) - 1))

    def code(self, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow all lanes to [start, start + size) of 2**_BITS."""
        shift = self.unit * start
        self.range = self.unit * size
        if self.encoding:
            self.low += shift
            over = np.flatnonzero(self.low >> _TOP)
            if len(over):
                at = self.at[over] - 1
                while len(at):  # a carry runs on through words that are full
                    self.out[at] += np.uint16(1)
                    at = at[self.out[at] == 0] - 1
                self.low[over] &= _FULL
        else:
            self.low -= shift
        small = np.flatnonzero(self.range < np.uint64(1 << 32))
        if len(small):
            low, at = self.low.take(small), self.at.take(small)
            if self.encoding:
                self.out[at] = low >> np.uint64(32)
                self.low[small] = (low << np.uint64(16)) & _FULL
            else:
                self.low[small] = low << np.uint64(16) | self.out[at]
            self.range[small] <<= np.uint64(16)
            self.at[small] = at + 1

    def finish(self) -> list[np.ndarray]:
        """Encoding: each lane's words, with the last 48 bits of its low end."""
        for k in (32, 16, 0):
            self.out[self.at] = (self.low >> np.uint64(k)) & np.uint64(0xFFFF)
            self.at += 1
        return [self.out[i * self.width + 1 : end] for i, end in enumerate(self.at)]


def _walk(lanes: int, ids: np.ndarray | None, words: np.ndarray | None, raw: tuple[np.ndarray, np.ndarray] | None):
    """Code ``ids`` (lane, BLOCK) to (words, events), or decode ``words`` and plain bits (32-bit windows at every byte, each lane's first) to ids.

    Both walk through the same model."""
    every = np.arange(lanes)
    every4, half = every * 4, lanes * 4
    c = _Coder(lanes, words)
    encoding = ids is not None
    if encoding:
        source = np.ascontiguousarray(ids.T)
        events = np.zeros((BLOCK, lanes), np.uint8)
    else:
        out = np.zeros((BLOCK, lanes), np.uint16)
        bits = np.zeros(lanes, np.int64)
        window, window_at = raw
        cands = np.zeros((4, lanes), np.int32)
    # a table entry is an id and, in its low two bits, the confidence in it
    table = np.zeros(lanes * (_T2 + _T1), np.int32)
    base = np.stack([every * _T2, lanes * _T2 + every * _T1])
    # of every lane, two words for each context of either model
    counts = np.full(lanes * 80, 256 * int(_ONES), np.uint64)
    rows = np.stack([every * 32, lanes * 32 + every * 8])
    where = np.zeros((2, lanes), np.int64)
    ctx = np.zeros((2, 2, lanes), np.int64)
    weight = np.full(lanes, 8, np.uint64)
    p0, k0 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int8)
    mixed1, last1 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    event = np.zeros(lanes, np.int64)
    n4, n16, one, most = np.uint64(4), np.uint64(16), np.uint64(1), np.uint64(15)
    place = np.concatenate([np.arange(4), half + np.arange(4)])
    for t in range(BLOCK):
        np.bitwise_and((last1 + mixed1) >> 4, _T2 - 1, out=where[0])
        np.bitwise_and(last1 >> 5, _T1 - 1, out=where[1])
        where += base
        old = table.take(where)
        guess, sure = old >> 2, old & 3
        at = sure[0] * 8
        at += sure[1] * 2
        at += guess[0] == guess[1]
        np.add(rows[0], at, out=ctx[0, 0])
        np.add(rows[1], event, out=ctx[0, 1])
        np.add(ctx[0], lanes * 40, out=ctx[1])
        row = counts.take(ctx)
        mix = row[:, 0] * weight
        mix += row[:, 1] * (n16 - weight)
        cum = mix * _ONES
        first = cum << n16
        first[1] += (cum[0] >> _TOP) * _ONES
        c.divide()
        if encoding:
            x = source[t].astype(np.int32)
            event = _CLASS.take(x)
            event[x == p0] = 2
            hit = guess == x
            event[hit[1]] = 1
            event[hit[0]] = 0
            events[t] = event
        else:
            v = c.place() * _ONES | _HIGH
            event = np.bitwise_count((v - first) & _HIGH).sum(axis=0, dtype=np.int64) - 1
            w = _WIDTH.take(event)
            cands[0], cands[1], cands[2] = guess[0], guess[1], p0
            cands[3] = (window.take(window_at + (bits >> 3)) >> (32 - w - (bits & 7))) & ((1 << w) - 1)
            cands[3] += _FLOOR.take(event)
            bits += w
            x = cands.ravel().take(np.minimum(event, 3) * lanes + every)
            out[t] = x
            hit = guess == x
        at = place.take(event) + every4
        c.code(first.view(np.uint16).ravel().take(at).astype(np.uint64), mix.view(np.uint16).ravel().take(at).astype(np.uint64))
        # the models learn from what happened
        a, b = row[:, 0].ravel().view(np.uint16).take(at), row[:, 1].ravel().view(np.uint16).take(at)
        weight += a > b
        weight -= a < b
        np.minimum(np.maximum(weight, one), most, out=weight)
        lost = (row >> n4) & _DECAY
        row -= lost
        total = ((lost[0] + lost[1]) * _ONES) >> _TOP
        row[0] += total * _ADD[0].take(event)
        row[1] += total * _ADD[1].take(event)
        counts[ctx] = row
        state = hit * np.int32(4)
        state += sure
        old += _DELTA.take(state)
        np.copyto(old, x << 2, where=state == 0)
        table[where] = old
        same = p0 == x
        k0 += same
        k0 -= ~same
        gone = k0 < 0
        np.copyto(p0, x, where=gone)
        np.copyto(k0, 1, where=gone)
        np.minimum(k0, 100, out=k0)
        mixed1 = last1 * 3
        last1 = x.astype(np.int64) * 40503
    return (c.finish(), events.T) if encoding else out.T


def _plain(ids: np.ndarray, events: np.ndarray) -> list[bytes]:
    """The plain bits of each lane, from the top of 32-bit words."""
    out = []
    for a in range(0, len(ids), 64):
        e = events[a : a + 64]
        w = _WIDTH[e].astype(np.int64)
        end = np.cumsum(w, axis=1)
        base = np.concatenate([[0], np.cumsum(-(-end[:, -1] // 32))])
        start, some = end - w, w > 0
        word = (base[:-1, None] + (start >> 5))[some]
        x = (ids[a : a + 64].astype(np.int32) - _FLOOR[e])[some].astype(np.uint64) << (64 - w - (start & 31))[some].astype(np.uint64)
        n = int(base[-1])
        # bits of different ids never overlap, so sums are unions
        total = np.bincount(word, (x >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
        flat = total.astype(np.uint32).astype(">u4")
        out += [flat[base[i] : base[i + 1]].tobytes() for i in range(len(e))]
    return out


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Each block of ``ids`` (the last one is filled up with zeros): number of coded words, these, the plain bits."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return []
    full = np.zeros(n * BLOCK, np.uint16)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    words, events = _walk(n, full, None, None)
    return [len(w).to_bytes(2, "little") + w.astype("<u2").tobytes() + r for w, r in zip(words, _plain(full, events))]


def decode_blocks(coded: list[bytes]) -> np.ndarray:
    """(block, BLOCK) ids."""
    sizes = [int.from_bytes(x[:2], "little") for x in coded]
    if any(len(x) < 2 + 2 * s for x, s in zip(coded, sizes)):
        raise ValueError("a token block is damaged")
    words = np.zeros((len(coded), max(sizes) + 4), np.uint16)
    width = max(len(x) - 2 - 2 * s for x, s in zip(coded, sizes)) + 8
    raw = np.zeros((len(coded), width), np.uint8)
    for i, (x, s) in enumerate(zip(coded, sizes)):
        words[i, :s] = np.frombuffer(x, "<u2", s, 2)
        body = np.frombuffer(x, np.uint8, -1, 2 + 2 * s)
        raw[i, : len(body)] = body
    each = raw.ravel()
    window = each.astype(np.uint32)
    for k in (1, 2, 3):
        window <<= np.uint32(8)
        window[:-k] |= each[k:]
    return _walk(len(coded), None, words, (window, np.arange(len(coded)) * width))


_PIECE = np.dtype([("place", "<i8"), ("doc", "<i8"), ("null", "u1"), ("ends", "u1"), ("piece", "<u4"), ("n", "<u4")])


def pack(pieces: np.ndarray, coded: bytes) -> bytes:
    body = MAGIC + struct.pack("<II", len(pieces), int(pieces["n"].sum())) + pieces.tobytes() + coded
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    if len(data) < 16 or data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a token block is damaged")
    n, total = struct.unpack_from("<II", data, 4)
    pieces = np.frombuffer(data, _PIECE, n, 12)
    if int(pieces["n"].sum()) != total or total > BLOCK:
        raise ValueError("a token block's pieces don't add up")
    return pieces, data[12 + pieces.nbytes : -4]


# fixed values: lower-case letters, numbers and blanks below U+0100, and the endings that the vocabulary's pattern cuts off
_LETTER, _NUMBER, _BLANK = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
#: The vocabulary's own cuts, for lower-case text below U+0100.
_LATIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")
#: A letter and a number or mark after it, between which there is always a cut.
_AFTER = r"([a-zß-öø-ÿ])([!-&(-@\[-`{-~])"
_TOKENIZERS: dict[str, "_Words"] = {}
_TWO = [i.to_bytes(2, "little") for i in range(1 << 16)]


class _Words(dict):
    """The library's tokenizer, and the ids of the cuts that its model was asked for: of the last ones, and of those before them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.map = byte_characters()
        self.before: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            # the model reads bytes as characters; ASCII letters are their own
            if word.isascii() and word.isalpha():
                mapped = word
            else:
                cuts = _LATIN.findall(word.lower())
                if cuts != [word]:
                    return b"".join(map(self.__getitem__, cuts))
                mapped = word.encode().decode("latin-1").translate(self.map)
            ids = b"".join([_TWO[t.id] for t in self.model.tokenize(mapped)])
        if len(self) >= MOST_CACHED:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _words(path: str) -> _Words:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Words(path)
    return _TOKENIZERS[path]


def _is_latin(text: str) -> bool:
    """Below U+0100, and without what may be the name of a special token."""
    try:
        if not text.isascii():
            text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


def _spread(ids: np.ndarray, size: np.ndarray, which: np.ndarray, offsets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words ``which``, of which ``ids`` has ``size`` each in turn, and where those of each list of words begin (one more at the end)."""
    n = size[which]
    end = np.cumsum(n)
    place = np.repeat((np.cumsum(size) - size)[which] - (end - n), n)
    place += np.arange(len(place))
    return ids[place], np.concatenate([[0], end])[offsets.to_numpy()]


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 16-bit integers, without the end id.

    Text below U+0100 is in normal form and lower-cases letter by letter, and no cut crosses a blank. Arrow numbers its different words, and what these are of; each of that is cut here once,
    and the library's model is asked for new cuts only. Other text, and text that may hold the name of a special token, is left to the library as a whole."""
    w = _words(path)
    latin = [_is_latin(t) for t in texts]
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t if x else "" for t, x in zip(texts, latin)], pa.string())))
    words = split.values.dictionary_encode()
    halves = pc.ascii_split_whitespace(pc.replace_substring_regex(words.dictionary, _AFTER, r"\1 \2"))
    parts = halves.values.dictionary_encode()
    known = list(map(w.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False).tolist()))
    size = np.fromiter(map(len, known), np.int64, len(known)) // 2
    ids, bound = _spread(np.frombuffer(b"".join(known), "<u2"), size, parts.indices.to_numpy(), halves.offsets)
    ids, bound = _spread(ids, np.diff(bound), words.indices.to_numpy(), split.offsets)
    bound = bound.tolist()
    return [ids[a:b].tobytes() if x else w.encode(t) for t, x, a, b in zip(texts, latin, bound, bound[1:])]


def _write(path: str):
    @tidy
    def run(batches):
        part, block, place = TaskContext.get().partitionId(), 0, 0
        held, pieces, have = [], [], 0
        end = np.array([END], "<u2").tobytes()

        def flush(all_of_it: bool):
            nonlocal block, held, pieces, have
            ids = np.frombuffer(b"".join(held), "<u2")
            held = []
            release()  # what the words took is not there beside the coder's tables
            n = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
            coded = encode_blocks(ids[:n])
            table, rows = np.array(pieces, _PIECE), []
            sizes = table["n"].astype(np.int64)
            stop = np.cumsum(sizes)
            for i, words in enumerate(coded):
                a, b = i * BLOCK, min((i + 1) * BLOCK, n)
                first, last = np.searchsorted(stop, a, "right"), np.searchsorted(stop, b, "left")
                some = table[first : last + 1].copy()
                begin = stop[first : last + 1] - sizes[first : last + 1]
                some["n"] = np.minimum(stop[first : last + 1], b) - np.maximum(begin, a)
                some["piece"] += np.maximum(0, a // BLOCK - begin // BLOCK).astype(np.uint32)
                some["ends"] &= stop[first : last + 1] <= b
                rows.append(pack(some, words))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(range(block, block + len(rows)), pa.int64()), pa.array(rows, pa.binary())], names=["part", "block", "data"])
            block += len(rows)
            held, left = [ids[n:].tobytes()], []
            for p, e, s in zip(pieces, stop, sizes):
                if e > n:
                    p = list(p)
                    p[4] += max(0, n // BLOCK - (e - s) // BLOCK) if e - s < n else 0
                    p[5] = int(min(s, e - n))
                    left.append(tuple(p))
            pieces, have = left, len(ids) - n

        for whole in batches:
            for b in slices(whole, TEXT_BYTES):
                for doc, ids in zip(b.column(0).to_pylist(), token_ids(b.column(1).to_pylist(), path)):
                    ids += end
                    held.append(ids)
                    pieces.append((place, doc or 0, doc is None, 1, 0, len(ids) // 2))
                    place += 1
                    have += len(ids) // 2
                    if have >= LANES * BLOCK:
                        yield from flush(False)
        if have:
            yield from flush(True)

    return run


@tidy
def _read(batches):
    held = []

    def flush():
        ids = decode_blocks([w for _, _, w in held])
        parts, pieces, crcs = [], [], []
        for (part, table, _), row in zip(held, ids):
            at = 0
            row = row.astype("<u4")
            for n in table["n"].tolist():
                crcs.append(zlib.crc32(row[at : at + n]))
                at += n
            parts.append(np.full(len(table), part, np.int32))
            pieces.append(table)
        t = np.concatenate(pieces)
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(parts)), pa.array(t["place"]), pa.array(t["doc"], mask=t["null"] == 1), pa.array(t["piece"].astype(np.int64)), pa.array(t["n"].astype(np.int64)), pa.array(crcs, pa.int64())],
            names=["part", "place", "doc_id", "piece", "n", "crc"],
        )

    for b in batches:
        for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.append((part, *unpack(data)))
            if len(held) == LANES:
                yield flush()
    if held:
        yield flush()


_SHIFTS: dict[int, list[int]] = {}


def _shift(crc: int, n: int) -> int:
    """The CRC register after ``n`` more zero bytes: a linear map, by powers of two."""
    k = 0
    while n:
        if n & 1:
            if k not in _SHIFTS:
                if k == 0:
                    columns = []
                    for i in range(32):
                        x = 1 << i
                        for _ in range(8):
                            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
                        columns.append(x)
                    _SHIFTS[0] = columns
                else:
                    _fill(k)
            x, i, total = crc, 0, _SHIFTS[k]
            y = 0
            while x:
                if x & 1:
                    y ^= total[i]
                x >>= 1
                i += 1
            crc = y
        n >>= 1
        k += 1
    return crc


def _fill(k: int) -> None:
    if 0 not in _SHIFTS:
        _shift(1, 1)
    if k - 1 not in _SHIFTS:
        _fill(k - 1)
    half = _SHIFTS[k - 1]

    def apply(x: int) -> int:
        y = 0
        for i in range(32):
            if x >> i & 1:
                y ^= half[i]
        return y

    _SHIFTS[k] = [apply(x) for x in half]


@F.pandas_udf(LongType())
def _joined_crc(ns: pd.Series, crcs: pd.Series) -> pd.Series:
    out = []
    for n, c in zip(ns, crcs):
        total = int(c[0])
        for size, crc in zip(n[1:], c[1:]):
            total = _shift(total, 4 * int(size)) ^ int(crc)
        out.append(total)
    return pd.Series(out, dtype="int64")


def parts_of(size: int, cores: int) -> int:
    """How many parts ``size`` bytes of text are."""
    return max(1, -(-size // PART_BYTES), min(cores, -(-size // LEAST_BYTES)))


def write_store(docs: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """The table of blocks of docs(doc_id, text), written to the shared folder."""
    parts = parts or parts_of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, docs.sparkSession.sparkContext.defaultParallelism)
    d = docs.select(F.col("doc_id"), text_or_empty().alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    d = d.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stash(d.mapInArrow(_write(path), "part int, block long, data binary"), "tokens")


def read_store(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the blocks alone."""
    pieces = blocks.select("part", "data").mapInArrow(_read, "part int, place long, doc_id long, piece long, n long, crc long")
    docs = pieces.groupBy("part", "place").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("p"))
    # written before anything else is asked, so the blocks are read once
    docs = stash(docs.select("part", "place", "doc_id", "n_tokens", _joined_crc(F.col("p.n"), F.col("p.crc")).alias("ids_crc32")), "token-documents")
    totals = docs.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = totals.select(F.col("part").alias("q"), F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each part
    start = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    docs = docs.withColumn("start", start).join(base, F.col("part") == F.col("q"))
    return docs.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """What the files of docs say of each document; the files go when they are read."""
    blocks = write_store(docs, path)
    out = read_store(blocks)
    unstash(blocks)
    return out
