"""Byte-level BPE with a sentencepiece model that is serialised directly from a rank file, without training.

Every byte becomes one printable character; a vocabulary entry becomes the piece of its mapped bytes with score
``-rank``, so sentencepiece's best-score-first merging follows the ranks. Normalisation is the identity. A text is cut into
pre-tokens by the tokenizer's pattern, each is encoded separately, and ids are decoded by the inverse mapping.

Defined cases: null and empty texts give no ids and decode to nothing; text that looks like a special token is ordinary text;
rows are independent, so repeated rows, ties and null ids need no rule.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import release, slices, text_or_empty, tidy

#: Pre-tokens whose ids a Python worker remembers.
MOST_CACHED = 150_000
# fixed values: Unicode's White_Space; letters and numbers below U+0100
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_L1_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_L1_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_L1_SPACE = r"\t-\r \x85\xa0"
# the same cuts for text below U+0100, where the classes are short; no two alternatives that change places can match at the same position
_LATIN = re.compile(rf" ?[{_L1_LETTER}]+| ?[{_L1_NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_L1_SPACE}{_L1_LETTER}{_L1_NUMBER}]+|[{_L1_SPACE}]+(?![^{_L1_SPACE}])|[{_L1_SPACE}]+")
_CODERS: dict[tuple[str, str], "Coder"] = {}


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself where it prints, else the next free one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model whose piece ids are the ranks; the unknown piece that the format wants comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    to = byte_characters()
    m = pb.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        m.pieces.add(piece="".join(to[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    m.trainer_spec.model_type = pb.TrainerSpec.BPE
    m.trainer_spec.vocab_size = len(m.pieces)
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = len(m.pieces) - 1, -1, -1, -1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.remove_extra_whitespaces = m.normalizer_spec.escape_whitespaces = False
    return m.SerializeToString()


class Coder:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.tokens = {str(i): t for t, i in ranks.items()}
        self.ranks = {t: str(i) for t, i in ranks.items()}
        # \s means White_Space, which in Python also has four control characters
        self.pattern = regex.compile(pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"(?!\S)", rf"(?![^{_SPACE}])").replace(r"\s", rf"[{_SPACE}]"))
        self.fast = _LATIN if pattern == _public_pattern() else None
        self.map = {b: c for b, c in byte_characters().items()}
        self.cache: dict[str, str] = {}

    def cut(self, text: str) -> list[str]:
        if self.fast is not None:
            try:
                text.encode("latin-1")
                return self.fast.findall(text)
            except UnicodeEncodeError:
                pass
        return self.pattern.findall(text)

    def learn(self, parts: list[str]) -> None:
        new = {p for p in parts if p not in self.cache}
        if len(self.cache) + len(new) > MOST_CACHED:
            self.cache.clear()
            new = set(parts)
        rest = []
        for p in new:
            whole = self.ranks.get(p.encode())  # a pre-token that is an entry itself is that entry
            if whole is not None:
                self.cache[p] = whole
            else:
                rest.append(p)
        for p, ids in zip(rest, self.sp.encode([p.encode().decode("latin-1").translate(self.map) for p in rest], num_threads=1)):
            self.cache[p] = " ".join(map(str, ids))

    def encode(self, text: str) -> str:
        """The ids of ``text`` in decimal, joined by blanks."""
        parts = self.cut(text)
        try:
            return " ".join(map(self.cache.__getitem__, parts))
        except KeyError:
            self.learn(parts)
            return " ".join(map(self.cache.__getitem__, parts))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.split(" "))) if ids else b""


def _public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def coder(path: str, pattern: str) -> Coder:
    """One coder a worker process."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def _coded(path: str, pattern: str, at: int):
    """Batches with the text at column ``at`` replaced by what its ids decode to, the ids, and their number."""

    @tidy
    def run(batches):
        for whole in batches:
            for b in slices(whole, column=at):
                c, ids, n, back = coder(path, pattern), [], [], []
                for t in b.column(at).to_pylist():
                    x = c.encode(t or "")
                    ids.append(np.fromstring(x, np.int32, sep=" ") if x else np.zeros(0, np.int32))
                    n.append(len(ids[-1]))
                    back.append(None if t is None else c.decode(x).decode())
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                columns = [pa.array(back, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, flat, pa.array(n, pa.int64())], names=[*b.schema.names, "ids", "n_tokens"])

    return run


def digest_column(text: Column, path: str, pattern: str) -> Column:
    """Encode, decode and digest in one pass; the decoded bytes come from the ids alone."""

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        c, rows = coder(path, pattern), []
        for t in s:
            ids = c.encode(t)
            rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        release()
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(F.coalesce(text, F.lit("")))


def stage(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ids and n_tokens (in place of columns with these names); text is what the ids decode to (null texts stay null)."""
    d = docs.drop("ids", "n_tokens")
    kept = StructType([StructField(f.name, f.dataType) for f in d.schema.fields])
    return d.mapInArrow(_coded(path, pattern, d.columns.index("text")), kept.add("ids", ArrayType(IntegerType())).add("n_tokens", LongType()))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    d = docs.select("doc_id", digest_column(text_or_empty(), path, pattern).alias("x"))
    return d.select("doc_id", "x.n_tokens", "x.ids_sha256", "x.decoded_sha256")
