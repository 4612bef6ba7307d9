"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers read blank + text, so that both see a word's blank. A task aligns each of its documents (``_Pair.links``, a few NumPy steps over its tokens):

1. The sums of token lengths are the tokens' ends. An end that both sides have is a cut: the join on document and end, as ends meet at their byte.
2. Counts of cuts number the groups (from the document's end). Between two ends next to each other lies one token of A and one of B, and every pair of
   tokens that share bytes owns exactly one such interval: the range join of A and B inside a group has as many rows as links and never all pairs of a long group.
3. ``links`` makes them rows; ``digest`` takes a document's digest and distinct pairs from the same arrays, so neither texts nor tokens are shuffled for it.

The rest is the corpus and Spark's: an id pair is counted once a document by a grouping over all documents' pairs, a window finds each A id's highest count, and counts
meet the documents' distinct pairs again by broadcast while there are at most ``MOST_PAIRS`` of them, else by shuffle with the most frequent pairs apart.

Pairs are counted in partitions of about ``PART_BYTES`` links, ``MOST_PARTS`` of them at most.

Defined cases: null and empty texts, and texts whose tokens' bytes aren't blank + text (U+2581 is a blank to B), have no tokens: zeros and ''. Each row with the same
doc_id and text counts as a document; null doc_ids are ids like others. An empty table gives an empty result; other columns are not read. Very long texts: a
document's text, ids and links (some arrays of 8 bytes a link) must fit in a task.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _LATIN, byte_characters
from .common import join_counted, keyed, slices, stash, text_or_empty, tidy, unstash

PART_BYTES, MOST_PARTS = 3 << 20, 20_000
#: Counted pairs that may be broadcast: 16 bytes each.
MOST_PAIRS = 1_000_000
#: Bytes of cut texts and ids that a side's cache holds, and of one cut that is worth keeping.
CACHE_BYTES, CUT_BYTES = 48 << 20, 256
#: Characters of a text that sentencepiece encodes as a whole.
WHOLE = 1 << 18
_WORD = re.compile(r"\n| *[^ \n]+| +(?=\n)| +\Z")
_TWO = [i.to_bytes(2, "little") for i in range(1 << 16)]
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class _Side(dict):
    """Ids, as 16-bit integers, of texts that the tokenizer always cuts off; ``tokens`` holds each id's bytes."""

    tokens: list[bytes]

    def __init__(self):
        self.held = 0

    def ids_of(self, cuts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def learn(self, cuts: list[str]) -> dict[str, bytes | None]:
        """Ids of new cuts, None where they don't spell the cut: then the whole text has no tokens."""
        found = {}
        for cut, ids in zip(cuts, self.ids_of(cuts)):
            found[cut] = b"".join(map(_TWO.__getitem__, ids)) if b"".join(map(self.tokens.__getitem__, ids)) == cut.encode() else None
        short = {x: ids for x, ids in found.items() if len(x) <= CUT_BYTES}
        size = sum(len(x) + 200 for x in short)
        if self.held + size > CACHE_BYTES:
            self.clear()
            self.held = 0
        if size <= CACHE_BYTES:
            self.update(short)
            self.held += size
        return found

    def join(self, cuts: list[str]) -> bytes | None:
        try:
            return b"".join(map(self.__getitem__, cuts))
        except KeyError:
            have = {x: self[x] for x in set(cuts) if x in self}
            have |= self.learn([x for x in dict.fromkeys(cuts) if x not in have])
        except TypeError:  # one of them is None
            return None
        return None if None in have.values() else b"".join(map(have.__getitem__, cuts))


class ByteSide(_Side):
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model, self.map = self.library.model, byte_characters()
        back = {c: b for b, c in self.map.items()}
        vocabulary = self.library.get_vocab(True)
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        # cuts below U+0100 are known for this pre-tokenizer only
        kind = self.library.pre_tokenizer
        self.plain = self.library.normalizer is None and type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space

    def ids_of(self, cuts: list[str]) -> list[list[int]]:
        return [[t.id for t in self.model.tokenize(x if x.isascii() and x.isalpha() else x.encode().decode("latin-1").translate(self.map))] for x in cuts]

    def encode(self, text: str) -> bytes | None:
        if self.plain:
            try:
                text.encode("latin-1")
                return self.join(_LATIN.findall(text))
            except UnicodeEncodeError:
                pass
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u2").tobytes() if b"".join(map(self.tokens.__getitem__, ids)) == text.encode() else None


class PieceSide(_Side):
    """A sentencepiece model that adds the blank in front itself. Where no piece has a blank after another character, long texts are encoded word by word."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.tokens = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) and self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # no merge then crosses a blank after another character, nor a line end, which is a byte of its own
        self.by_word = not any(re.search("[^▁]▁|\n", p) for p in pieces) and len(self.sp.encode("\nx")) > 2

    def ids_of(self, cuts: list[str]) -> list[list[int]]:
        # the model puts a blank in front of everything: a cut that begins with one leaves it out, the others follow a line end
        ids = self.sp.encode([x[1:] if x[0] == " " and x != " " else "\n" + x for x in cuts], num_threads=1)
        return [i if x[0] == " " and x != " " else i[2:] for x, i in zip(cuts, ids)]

    def encode(self, text: str) -> bytes | None:
        """``text`` begins with the blank, which the model adds itself."""
        if self.by_word and len(text) > WHOLE:
            return self.join(_WORD.findall(text))
        ids = self.sp.encode(text[1:])
        return np.array(ids, "<u2").tobytes() if b"".join(map(self.tokens.__getitem__, ids)) == text.encode() else None


_SIDES: dict[tuple[type, str], _Side] = {}


def side(kind: type, path: str) -> _Side:
    """One a worker process."""
    if (kind, path) not in _SIDES:
        _SIDES[kind, path] = kind(path)
    return _SIDES[kind, path]


class _Pair:
    """Both sides with the sizes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = side(ByteSide, a_path), side(PieceSide, b_path)
        if max(len(self.a.tokens), len(self.b.tokens)) > 65_536:
            raise ValueError("ids are kept in 16 bits")
        self.sizes = [np.array([len(x) for x in y.tokens], np.int64) for y in (self.a, self.b)]

    def links(self, text: str | None):
        """(end, a, b, ends, g) of a text's links in text order, as ``links`` names them; none where it has no tokens."""
        x = y = None
        if text:
            x, y = self.a.encode(" " + text), self.b.encode(" " + text)
        if x is None or y is None:
            x = y = b""
        a, b = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        # equal ends meet at their byte
        at = np.zeros(int(end_a[-1]) + 1 if len(a) else 0, np.uint8)
        at[end_a] = 1
        at[end_b] += 2
        end = np.flatnonzero(at)
        ends = at[end].astype(np.int64)
        # the token of either side that covers the interval before an end
        own_a, own_b, cut = ends & 1, ends >> 1, ends == 3
        return end, a[np.cumsum(own_a) - own_a].astype(np.int64), b[np.cumsum(own_b) - own_b].astype(np.int64), ends, np.cumsum(cut[::-1])[::-1]


def _lists(found: list[np.ndarray], kind) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found), kind))


_LINKS = {"end": pa.int64(), "a": pa.int32(), "b": pa.int32(), "ends": pa.int32(), "g": pa.int32()}


def _aligned(a_path: str, b_path: str):
    @tidy
    def run(batches):
        both = _Pair(a_path, b_path)
        for whole in batches:
            for part in slices(whole, column=2):
                found = list(zip(*map(both.links, part.column(2).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[_lists(x, kind) for x, kind in zip(found, _LINKS.values())]], names=["k", "h", *_LINKS])

    return run


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Of docs(doc_id, text): (k, h, end, a, b, ends, g), a row for each link, with the end of the bytes both share, which of the two tokens end there (1: a, 2: b, 3: both)
    and the number of its group, counted from the document's end; rows of a document are together, in text order."""
    kinds = ", ".join(f"{n} array<{'long' if n == 'end' else 'int'}>" for n in _LINKS)
    made = keyed(docs).select("k", "h", "text").mapInArrow(_aligned(a_path, b_path), f"k long, h long, {kinds}")
    once = made.groupBy("k", "h").agg(F.first(F.arrays_zip(*_LINKS)).alias("x"))
    return once.select("k", "h", F.posexplode("x").alias("pos", "x")).select("k", "h", "x.*")


@contextlib.contextmanager
def by_document(spark: SparkSession, parts: int):
    """Settings under which ``links`` makes one shuffle of ``parts`` partitions; the session's own come back."""
    own = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


_TEXT: dict[str, list[str]] = {}
#: Ids written at a time.
_AT_ONCE = 1 << 20


def _written(a: np.ndarray, b: np.ndarray, ends: np.ndarray, g: np.ndarray, digest) -> None:
    """Add ``a1,a2|b1;a3|b2`` of some whole groups, in text order, to a digest; g falls."""
    if not _TEXT:
        for x in ",|;":
            _TEXT[x] = [f"{i}{x}" for i in range(65_536)]
        _TEXT["all"] = _TEXT[","] + _TEXT["|"] + _TEXT[";"]
    own_a, own_b = (ends & 1) > 0, (ends & 2) > 0
    # order: group, then side, then place
    place = np.concatenate([(g[0] - g[own_a]) * 2, (g[0] - g[own_b]) * 2 + 1])
    order = np.argsort(place, kind="stable")
    ids, place = np.concatenate([a[own_a], b[own_b]])[order], place[order]
    mark = np.full(len(place), 2)
    mark[:-1] = np.where(place[1:] == place[:-1], 0, np.where(place[:-1] & 1, 2, 1))
    digest.update("".join(map(_TEXT["all"].__getitem__, (ids + (mark << 16)).tolist())).encode())


class _TrimmedDigest:
    """SHA-256 of what it is given without the last byte."""

    def __init__(self):
        self.of, self.last = hashlib.sha256(), b""

    def update(self, x: bytes) -> None:
        self.of.update(self.last)
        self.of.update(x[:-1])
        self.last = x[-1:]


def _document(p: np.ndarray, g: np.ndarray):
    """(n_a, n_b, n_groups, n_links, digest, pairs, times) of a document's packed links in text order."""
    ends = p & 3
    a, b = p >> 19, (p >> 2) & 0x1FFFF
    digest, i = _TrimmedDigest(), 0
    while i < len(p):
        j = len(p)
        if j - i > _AT_ONCE:  # on to the end of a group
            j = i + int(np.searchsorted(-g[i:], -g[i + _AT_ONCE], "right"))
        _written(a[i:j], b[i:j], ends[i:j], g[i:j], digest)
        i = j
    pairs, times = np.unique((a << 16) | b, return_counts=True)
    if not len(p):
        return 0, 0, 0, 0, "", pairs, times
    return int(((ends & 1) > 0).sum()), int(((ends & 2) > 0).sum()), int((ends == 3).sum()), len(p), digest.of.hexdigest(), pairs, times


def _digests(a_path: str, b_path: str):
    """A row for each text, with what ``_document`` says of its links."""

    @tidy
    def run(batches):
        both = _Pair(a_path, b_path)
        for whole in batches:
            for part in slices(whole):
                docs = []
                for t in part.column(1).to_pylist():
                    _, a, b, ends, g = both.links(t)
                    docs.append(_document(a << 19 | b << 2 | ends, g))
                columns = list(zip(*docs))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(columns[i], pa.int64()) for i in range(4)], pa.array(columns[4]), _lists(columns[5], pa.int64()), _lists(columns[6], pa.int32())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


_DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: a row for each row of docs, numbered (row), with its distinct pairs, a << 16 | b, and how often it has each; and one for each pair
    (pair, count, best) of the corpus."""
    spark = docs.sparkSession
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_digests(a_path, b_path), _DIGEST)
    texts = stash(made.withColumn("row", F.monotonically_increasing_id()), "aligned")
    size = texts.agg(F.sum("n_links")).first()[0] or 0
    counts = texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")).withColumn("a", F.shiftright("pair", 16))
    best = F.max("count").over(Window.partitionBy("a"))  # a row for each id of B at most
    with by_document(spark, min(MOST_PARTS, 1 + size // PART_BYTES)):
        return texts, stash(counts.select("pair", "count", (F.col("count") == best).alias("best")), "pairs")


def digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    texts, counts = align(docs, a_path, b_path)
    each = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("of"), F.col("x.times").alias("times"))
    if counts.count() <= MOST_PAIRS:
        each = each.join(F.broadcast(counts), F.col("of") == F.col("pair"))
    else:
        each = join_counted(each, counts, {"of": "pair"}, "count")
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = texts.drop("pairs", "times").join(sums.hint("merge"), "row", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    done = stash(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zeros, "groups_sha256"), "alignment")
    for x in (texts, counts):
        unstash(x)
    return done
