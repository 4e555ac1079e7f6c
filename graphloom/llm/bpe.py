"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can
never be merged, so a text may be cut there. Texts are cut where such a pair also
is a border of pre-tokens (a character that is no white space, then ASCII white
space), and long runs of ideographs, which are one pre-token, between two
ideographs whose touching bytes are such a pair. The parts are encoded apart,
each distinct part once, and the ids are put together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import arrow, read, without
from graphloom.llm._words import blocks, utf8
from graphloom.llm.token_counts import vocabulary

VOCABULARY = "byte_bpe_50k.json"
BATCH_BYTES = 1 << 20
REMEMBERED = 250_000
#: White space outside the six ASCII ones, and control characters that some tables hold for white space: with what follows it may be one pre-token.
_ODD = (rb"[\x1c-\x1f]", rb"\xc2[\x85\xa0]", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", rb"\xe2\x81\x9f", rb"\xe3\x80\x80")
#: First bytes of ideographs U+5000 to U+8FFF, all letters of three bytes; parts longer than this are cut between them.
_IDEOGRAPHS = range(0xE5, 0xE9)
LONG_PART = 48


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies use for bytes: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return letters


class ForcedBpe:
    """Encodes as the ``tokenizers`` library does with a byte-level vocabulary, part by part."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        letters = byte_letters()
        added = {t["id"]: t["content"].encode() for t in parts["added_tokens"]}
        plain = {i: bytes(letters[c] for c in token) for token, i in parts["model"]["vocab"].items() if i not in added}
        self.table = [b""] * (1 + max([*plain, *added]))
        for i, token in {**plain, **added}.items():
            self.table[i] = token
        joined = np.zeros((256, 256), bool)
        for token in plain.values():
            t = np.frombuffer(token, np.uint8)
            joined[t[:-1], t[1:]] = True
        self.forced = ~joined
        # A part ends where a character outside white space meets ASCII white space, if that pair is forced.
        space = [9, 10, 11, 12, 13, 32]
        some = lambda found: b"[" + b"".join(rb"\x%02x" % x for x in found) + b"]"
        open_ = [b for b in range(256) if b not in space and joined[b, space].any()]
        stays = b"|".join(rb"(?<=" + x + b")" for x in [*([some(open_)] if open_ else []), *_ODD])
        self.part = re.compile(rb"\s*\S+(?:(?:" + stays + rb")\s+\S*)*|\s+")
        # Between two ideographs: last byte of the one, first byte of the other.
        last = {lead: [b for b in range(0x80, 0xC0) if self.forced[b, lead]] for lead in _IDEOGRAPHS}
        kind = some(_IDEOGRAPHS)
        self.inner = re.compile(b"|".join(rb"(?<=" + kind + rb"[\x80-\xbf]" + some(ends) + rb")(?=\x%02x)" % lead for lead, ends in last.items() if ends) or rb"(?!)")
        self.known: dict[bytes, bytes] = {}
        self.room = remembered

    def parts(self, text: bytes) -> list[bytes]:
        """``text`` cut at forced boundaries."""
        found = self.part.findall(text)
        if text.isascii() or max(map(len, found), default=0) <= LONG_PART:
            return found
        return [x for p in found for x in (self.inner.split(p) if len(p) > LONG_PART else (p,))]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        pieces = [self.parts(t) for t in texts]
        known = self.known
        fresh = list({p for ps in pieces for p in ps if p not in known})
        extra: dict[bytes, bytes] = {}
        if fresh:
            found = self.tokenizer.encode_batch_fast([p.decode() for p in fresh], add_special_tokens=False)
            pairs = {p: np.asarray(e.ids, "<u4").tobytes() for p, e in zip(fresh, found, strict=True)}
            short = {p: ids for p, ids in pairs.items() if len(p) <= 64}
            if len(known) + len(short) <= self.room:
                known.update(short)
            extra = pairs
        return [b"".join([known[p] if p in known else extra[p] for p in ps]) for ps in pieces]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8, special tokens included; broken sequences become U+FFFD."""
        whole = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            whole.decode()
        except UnicodeDecodeError:
            return whole.decode(errors="replace").encode()
        return whole


_CODERS: dict[str, ForcedBpe] = {}


def coder_of(path: str) -> ForcedBpe:
    """One coder for each vocabulary and Python worker."""
    if path not in _CODERS:
        _CODERS[path] = ForcedBpe(path)
    return _CODERS[path]


def _columns(df: DataFrame, text: str, added: dict[str, T.DataType]) -> tuple[list[str], T.StructType, DataFrame]:
    data = without(df, *added)
    rest = [c for c in data.columns if c != text]
    schema = T.StructType([*[data.schema[c] for c in rest], *[T.StructField(k, v) for k, v in added.items()]])
    return rest, schema, data.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"))


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None, digests: bool = False) -> DataFrame:
    """All rows of ``df`` without the text, with ``n_tokens`` and ``ids`` (little-endian 32-bit integers in one binary).

    With ``digests``, ids are decoded again and replaced by ``ids_sha256`` and
    ``decoded_sha256``. A null text is empty and has no ids. Every row stands for
    itself; columns named like an added one are replaced. Texts are taken in
    batches balanced by bytes.
    """
    path = path or vocabulary(VOCABULARY)
    added: dict[str, T.DataType] = {"n_tokens": T.LongType()} | ({"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digests else {"ids": T.BinaryType()})
    _, schema, data = _columns(df, text, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        coder = coder_of(path)
        for batch in batches:
            *others, column = batch.columns
            bytes_, offsets = utf8(column)
            done = 0
            for a, b in blocks(offsets, BATCH_BYTES):
                ids = coder.encode([bytes_[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)])
                n = [len(x) // 4 for x in ids]
                more = [[sha256(x).hexdigest() for x in ids], [sha256(coder.decode(x)).hexdigest() for x in ids]] if digests else [ids]
                yield pa.RecordBatch.from_arrays([*[o.slice(done, b - a) for o in others], pa.array(n, pa.int64()), *[pa.array(x, pa.string() if digests else pa.binary()) for x in more]], names=[f.name for f in schema])
                done = b

    return arrow(data, run, schema)


def decode_ids(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """All rows of ``df`` without the ids, with their ``text``; null ids give the empty text."""
    path = path or vocabulary(VOCABULARY)
    _, schema, data = _columns(df, ids, {"text": T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            *others, column = batch.columns
            texts = [coder.decode(x.as_py() or b"").decode() for x in column]
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string())], names=[f.name for f in schema])

    return arrow(data, run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op9_bpe": op9_bpe}
ORACLE: dict[str, str] = {}
