"""Exact substring dedup over sampled suffixes.

A byte goes if it lies in a ``length``-byte string that also starts in a document with a smaller doc_id. Sorting every suffix would move
many times the input, so each ``length``-byte string is represented by the suffix that starts at its smallest ``GRAM``-byte hash
(leftmost of ties): equal strings choose the same suffix, one of about sixteen bytes starts one, and consecutive strings that
choose the same suffix form a run.

1. Suffixes are range-partitioned by their leading ``LEAD`` bytes at splitters from a sample; equal leading bytes never straddle a splitter, so
   suffixes across a boundary differ. Within a task equal runs are merged before they are sent: all but those of the smallest doc_id are
   repeats already, so a passage that many documents share costs one record a task. Each bucket sorts its suffixes by multikey quicksort: eight
   leading bytes a key, ties refined by the next eight and then by hashes of ``GRAM`` bytes and of the run. Neighbours are compared: a run that is
   equal to one of a smaller doc_id is repeated as a whole.
2. Suffixes that start different runs in several documents may share some of their strings only. These runs are sent with their bytes,
   partitioned the same way, and each bucket sorts the strings by multikey quicksort over all their bytes and compares neighbours.
3. Removed strings return to their documents, which are read once more for what is left.

The number of buckets and of document groups follows the bytes of text, so a task's memory doesn't grow with the corpus. Nothing depends on a hash alone
but the run comparison of step 1 (16 leading bytes, 16 bits of the suffix's hash and 40 bits of the run's must agree).

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; a null doc_id is smaller than all others (it is the
smallest long, should that be an id); rows of one doc_id never remove from each other, and are told apart by 32 bits of a hash of their text; equal rows get equal
results; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INV, _TABLE, _powers, mix64, slices, stash, text_or_empty, tidy, unstash

LENGTH, GRAM, LEAD = 50, 20, 16
#: Documents that a sample for splitters reads at most, and splitters a bucket is chosen from.
MOST_SAMPLED, PER_BUCKET, MOST_BUCKETS = 4_000, 50, 20_000
#: Bytes of text for each bucket and each group of documents.
BUCKET_BYTES, HOME_BYTES = 16 << 20, 16 << 20
_DOC = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("first", "<u4")])
_RUN = np.dtype([("lead", f"S{LEAD}"), ("key", "<u2"), ("run", "u1", 5), ("serial", "u1", 3)])
_PART = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("q", "<u4"), ("n", "u1"), ("off", "u1"), ("key", "<u8")])
_BACK = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("at", "<u4"), ("kind", "u1")])
#: Kinds of returned rows: a run that is repeated and one to compare, both by number in the document; a repeated string, by place.
_GONE, _OPEN, _STRING = range(3)


class Suffixes:
    """The sampled suffixes of a batch of texts: place, first and last string of each one's run, and its document."""

    def __init__(self, texts: list, length: int = LENGTH):
        raw = [b"" if t is None else t.encode() for t in texts]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.data = data = np.frombuffer(b"".join([*raw, bytes(LEAD)]), np.uint8)
        n, window = int(self.begin[-1]), length - GRAM + 1
        self.at = self.q1 = self.q2 = self.doc = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        self.length = length
        if n < length:
            return
        with np.errstate(over="ignore"):
            self.sum = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[data[:n]] * _powers(n, _BASE, "up"), out=self.sum[1:])
            h = mix64((self.sum[GRAM:] - self.sum[:-GRAM]) * _powers(n, _BASE_INV, "down")[: n + 1 - GRAM])
        packed = (h & ~np.uint64((1 << 24) - 1)) if n < 1 << 24 else (h >> np.uint64(32) << np.uint64(32))
        packed |= np.arange(len(h), dtype=np.uint64)
        least, span = packed, 1
        while span * 2 <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
        low = np.uint64((1 << 24) - 1) if n < 1 << 24 else np.uint64((1 << 32) - 1)
        start = (least & low).astype(np.int64)  # for the string at each place, where its suffix starts
        valid = np.zeros(len(start) + 1, bool)
        for a, s in zip(self.begin[:-1], self.sizes):
            if s >= length:
                valid[a : a + s - length + 1] = True
        valid = valid[: len(start)]
        change = np.ones(len(start), bool)
        change[1:] = (start[1:] != start[:-1]) | ~valid[:-1]
        self.q1 = np.flatnonzero(change & valid)
        stop = np.ones(len(start), bool)
        stop[:-1] = (start[1:] != start[:-1]) | ~valid[1:]
        self.q2 = np.flatnonzero(stop & valid)
        self.at = start[self.q1]
        self.key = h[self.at]
        self.doc = np.searchsorted(self.begin, self.q1, "right") - 1

    def runs(self) -> np.ndarray:
        """A hash of each run's bytes and where in it the suffix starts."""
        with np.errstate(over="ignore"):
            h = (self.sum[self.q2 + self.length] - self.sum[self.q1]) * _powers(len(self.data), _BASE_INV, "down")[self.q1]
            return mix64(h + ((self.q2 - self.q1) * 64 + self.at - self.q1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def leads(self, which=slice(None)) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.data, LEAD)[self.at[which]].copy().view(f"S{LEAD}").ravel()


def _bytes(x: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n]


def _number(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view("<u8").ravel()


def _ids(column) -> np.ndarray:
    return np.array([-(1 << 63) if x is None else x for x in column.to_pylist()], np.int64)


def home(doc: np.ndarray, homes: int) -> np.ndarray:
    """The bucket of a document's rows; as the SQL in ``_homes``."""
    return np.mod(doc ^ (doc >> np.int64(17)), homes)


def _homes(homes: int):
    x = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 17)), F.lit(homes)).cast("int")


def _blob(docs: np.ndarray, rows: np.ndarray) -> bytes:
    return len(docs).to_bytes(4, "little") + docs.tobytes() + rows.tobytes()


def _unblob(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, _DOC, n, 4), np.frombuffer(data, _RUN, -1, 4 + n * _DOC.itemsize)


def _out(bucket, kind, blobs):
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "data"])


def _send(splits: np.ndarray, homes: int, length: int):
    """Step 1, map side."""

    @tidy
    def run(batches):
        for whole in batches:
            for b in slices(whole, column=2):
                s = Suffixes(b.column(2).to_pylist(), length)
                if not len(s.at):
                    continue
                docs = _ids(b.column(0))
                tags = np.array(b.column(1).to_pylist(), np.int64).astype(np.uint64).astype(np.uint32)
                run_, doc = s.runs(), docs[s.doc]
                order = np.lexsort((doc, run_, s.key))
                k, r, d = s.key[order], run_[order], doc[order]
                new = np.ones(len(order), bool)
                new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
                smallest = d[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                gone = order[d > smallest]
                if len(gone):
                    back = np.zeros(len(gone), _BACK)
                    back["doc"], back["tag"] = docs[s.doc[gone]], tags[s.doc[gone]]
                    back["at"], back["kind"] = gone - np.searchsorted(s.doc, s.doc[gone]), _GONE
                    yield from _returns(back, homes, -1)
                kept = np.sort(order[d == smallest])
                lead = s.leads(kept)
                bucket = np.searchsorted(splits, lead, "right")
                by = np.argsort(bucket, kind="stable")
                kept, bucket, lead = kept[by], bucket[by], lead[by]
                ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
                first = np.searchsorted(s.doc, np.arange(len(docs)))  # of each document, the number of its first suffix
                names, blobs = [], []
                for a, e in zip(np.concatenate([[0], ends[:-1]]), ends):
                    some = kept[a:e]
                    rows = np.zeros(len(some), _RUN)
                    rows["lead"], rows["key"], rows["run"], rows["serial"] = lead[a:e], s.key[some] >> np.uint64(48), _bytes(run_[some], 5), _bytes(some, 3)
                    of = np.unique(s.doc[some])
                    table = np.zeros(len(of), _DOC)
                    table["doc"], table["tag"], table["first"] = docs[of], tags[of], first[of]
                    names.append(int(bucket[a]))
                    blobs.append(_blob(table, rows))
                yield _out(names, [0] * len(names), blobs)

    return run


def _returns(back: np.ndarray, homes: int, kind: int):
    """Rows for documents, one for each home; kind -1 passes through the buckets (home in place of the bucket)."""
    at = home(back["doc"], homes)
    order = np.argsort(at, kind="stable")
    at, back = at[order], back[order]
    ends = np.flatnonzero(np.diff(at, append=-1)) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(int)
    if len(back):
        yield _out([int(at[a]) for a in starts], [kind] * len(starts), [back[a:e].tobytes() for a, e in zip(starts, ends)])


def _settle(homes: int):
    """Step 1, bucket side: (home, 0, data) of whole runs that are repeated and runs to compare byte by byte."""

    def run(key, table):
        kinds, blobs = table["kind"].to_pylist(), table["data"].to_pylist()
        passed = b"".join(x for x, k in zip(blobs, kinds) if k == -1)
        out = [_out([key[0].as_py()], [0], [passed])] if passed else []
        docs, tags, serials, keys = [], [], [], []
        for x, k in zip(blobs, kinds):
            if k == 0:
                t, rows = _unblob(x)
                serial = _number(rows["serial"]).astype(np.int64)
                i = np.searchsorted(t["first"], serial, "right") - 1
                docs.append(t["doc"][i])
                tags.append(t["tag"][i])
                serials.append(serial - t["first"][i])
                lead = np.ascontiguousarray(rows["lead"]).view(">u8").reshape(-1, LEAD // 8).astype(np.uint64)
                keys.append(np.column_stack([lead, rows["key"].astype(np.uint64), _number(rows["run"])]))
        if docs:
            d, t, s, k = map(np.concatenate, (docs, tags, serials, keys))
            order, new = multikey_order(k)
            d, t, s, k = d[order], t[order], s[order], k[order]
            runs = np.flatnonzero(new)
            smallest = np.minimum.reduceat(d, runs)[np.cumsum(new) - 1]
            gone = d > smallest
            new_key = np.ones(len(d), bool)
            new_key[1:] = (k[1:, :-1] != k[:-1, :-1]).any(axis=1)
            # of each suffix: several runs, several documents
            group = np.cumsum(new_key) - 1
            starts = np.flatnonzero(new_key)
            several = (np.add.reduceat(new.astype(np.int64), starts) > 1) & (np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts))
            which = gone | several[group]
            back = np.zeros(int(which.sum()), _BACK)
            back["doc"], back["tag"], back["at"], back["kind"] = d[which], t[which], s[which], np.where(gone[which], _GONE, _OPEN)
            out += _returns(back, homes, 0)
        return pa.Table.from_batches(out, schema=_out([], [], []).schema)

    return run


def _matched(docs: pa.Table, rows: pa.Table, kinds: tuple[int, ...]):
    """Each document with its returned rows: (position, places or numbers by kind)."""
    ids = _ids(docs["doc_id"])
    tags = np.array(docs["tag"].to_pylist(), np.int64).astype(np.uint64).astype(np.uint32)
    back = np.frombuffer(b"".join(rows["data"].to_pylist()), _BACK)
    back = back[np.isin(back["kind"], kinds)]
    back = back[np.lexsort((back["tag"], back["doc"]))]
    first, last = np.searchsorted(back["doc"], ids, "left"), np.searchsorted(back["doc"], ids, "right")
    for i in range(len(ids)):
        part = back[first[i] : last[i]]
        part = part[part["tag"] == tags[i]]
        yield i, {k: at for k in kinds if len(at := part["at"][part["kind"] == k])}


def _contents(splits: np.ndarray, length: int):
    """Step 2, document side: the bytes of runs that must be compared."""

    def run(key, docs, rows):
        out, parts, bodies, leads = [], [], [], []
        if rows.num_rows:
            ids = _ids(docs["doc_id"])
            tags = np.array(docs["tag"].to_pylist(), np.int64).astype(np.uint64).astype(np.uint32)
            for i, some in _matched(docs, rows, (_OPEN,)):
                if not some:
                    continue
                s = Suffixes([docs["text"][i].as_py()], length)
                which = np.unique(some[_OPEN]).astype(np.int64)
                p = np.zeros(len(which), _PART)
                p["doc"], p["tag"], p["q"], p["n"], p["off"], p["key"] = ids[i], tags[i], s.q1[which], s.q2[which] - s.q1[which] + 1, s.at[which] - s.q1[which], s.key[which]
                parts.append(p)
                leads.append(s.leads(which))
                bodies += [s.data[a : b + length].tobytes() for a, b in zip(s.q1[which], s.q2[which])]
        if parts:
            p, bucket = np.concatenate(parts), np.searchsorted(splits, np.concatenate(leads), "right")
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
            for a, e in zip(np.concatenate([[0], ends[:-1]]), ends):
                some = order[a:e]
                out.append(_out([int(bucket[some[0]])], [0], [len(some).to_bytes(4, "little") + p[some].tobytes() + b"".join(bodies[j] for j in some)]))
        return pa.Table.from_batches(out, schema=_out([], [], []).schema)

    return run


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian 8-byte keys, and for each place in it whether its row differs from the one before.

    Only rows that tie on all keys so far are sorted by the next, as multikey quicksort does."""
    order = np.argsort(keys[:, 0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order[1:], 0] != keys[order[:-1], 0]
    for k in range(1, keys.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group, rows = np.cumsum(new)[at], order[at]
        by = np.lexsort((keys[rows, k], group))
        rows, group = rows[by], group[by]
        order[at] = rows
        first = np.ones(len(at), bool)
        first[1:] = (group[1:] != group[:-1]) | (keys[rows[1:], k] != keys[rows[:-1], k])
        new[at] = first
    return order, new


def _compare(homes: int, length: int):
    """Step 2, bucket side: strings of a suffix that also start in a smaller doc_id."""

    def run(key, table):
        parts, bodies = [], []
        for x in table["data"].to_pylist():
            n = int.from_bytes(x[:4], "little")
            parts.append(np.frombuffer(x, _PART, n, 4))
            bodies.append(np.frombuffer(x, np.uint8, -1, 4 + n * _PART.itemsize))
        p, body = np.concatenate(parts), np.concatenate(bodies)
        size = p["n"].astype(np.int64) + length - 1
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        found = []
        off, n = p["off"].astype(np.int64), p["n"].astype(np.int64)
        for o in range(length - GRAM + 1):  # strings that start o bytes before their suffix
            has = np.flatnonzero((off >= o) & (off - n < o))
            if len(has) < 2:
                continue
            at = begin[has] + off[has] - o
            width = -(-length // 8) * 8
            text = np.zeros((len(has), width), np.uint8)
            text[:, :length] = body[at[:, None] + np.arange(length)]
            order, new = multikey_order(text.view(">u8").astype(np.uint64))
            doc = p["doc"][has][order]
            smallest = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
            gone = has[order[doc > smallest]]
            back = np.zeros(len(gone), _BACK)
            back["doc"], back["tag"], back["at"], back["kind"] = p["doc"][gone], p["tag"][gone], p["q"][gone] + off[gone] - o, _STRING
            found.append(back)
        out = list(_returns(np.concatenate(found), homes, 0)) if found else []
        return pa.Table.from_batches(out, schema=_out([], [], []).schema)

    return run


def _finish(length: int, texts: bool):
    def run(key, docs, rows):
        result = []
        for i, some in _matched(docs, rows, (_GONE, _STRING)):
            text = docs["text"][i].as_py()
            raw = text.encode()
            edge = np.zeros(len(raw) + 1, np.int32)
            if _GONE in some:
                s = Suffixes([text], length)
                which = some[_GONE]
                np.add.at(edge, s.q1[which], 1)
                np.add.at(edge, s.q2[which] + length, -1)
            if _STRING in some:
                np.add.at(edge, some[_STRING], 1)
                np.add.at(edge, some[_STRING].astype(np.int64) + length, -1)
            if some:
                cut = np.cumsum(edge[:-1]) > 0
                removed, spans = int(cut.sum()), int((np.diff(cut.astype(np.int8), prepend=0) == 1).sum())
                left = np.frombuffer(raw, np.uint8)[~cut].tobytes()
            else:
                removed, spans, left = 0, 0, raw
            result.append((docs["doc_id"][i].as_py(), len(raw), removed, spans, hashlib.sha256(left).hexdigest(), left if texts else None))
        columns = list(zip(*result)) or [[]] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _sample(length: int, share: float):
    """Leading bytes of suffixes, each kept by a hash with probability ``share``."""

    @tidy
    def run(batches):
        for whole in batches:
            for b in slices(whole, column=0):
                found = Suffixes(b.column(0).to_pylist(), length)
                leads = np.unique(found.leads()[(found.key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) < share * 2**53])
                yield pa.RecordBatch.from_arrays([pa.array([bytes(x) for x in leads], pa.binary())], names=["lead"])

    return run


def splitters(docs: DataFrame, n: int, buckets: int, length: int) -> np.ndarray:
    """Leading bytes that part the suffixes of a sample evenly: about ``buckets * PER_BUCKET`` of them come to the driver, 16 bytes each."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // MOST_SAMPLED))) == 0).select("text")
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, buckets * PER_BUCKET * (length - GRAM + 2) / 2 / max(1, size))
    leads = np.array(sorted(bytes(r[0]) for r in some.mapInArrow(_sample(length, share), "lead binary").distinct().collect()), f"S{LEAD}")
    return np.unique(leads[[len(leads) * i // buckets for i in range(1, buckets)]]) if len(leads) else leads


def dedup(docs: DataFrame, length: int = LENGTH, buckets: int | None = None, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs(doc_id, text), as a written table; kept only if ``texts``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", text_or_empty().alias("text"))
    n, size = d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    homes = max(parts, size // HOME_BYTES) | 1
    buckets = buckets or min(MOST_BUCKETS, max(2 * parts, size // BUCKET_BYTES))
    splits = splitters(d, n, buckets, length)
    d = d.select("doc_id", F.xxhash64("text").alias("tag"), "text", _homes(homes).alias("home"))
    sent = d.select("doc_id", "tag", "text").mapInArrow(_send(splits, homes, length), "bucket int, kind int, data binary")
    shape = "bucket int, kind int, data binary"
    settled = stash(sent.groupBy("bucket").applyInArrow(_settle(homes), shape), "suffixes")
    by_home = d.groupBy("home")
    contents = by_home.cogroup(settled.groupBy("bucket")).applyInArrow(_contents(splits, length), shape)
    compared = contents.groupBy("bucket").applyInArrow(_compare(homes, length), shape)
    back = settled.union(compared)
    out = stash(by_home.cogroup(back.groupBy("bucket")).applyInArrow(_finish(length, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"), "deduplicated")
    unstash(settled)
    return out


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("kept")
