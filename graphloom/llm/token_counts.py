"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import arrow, read, without
from graphloom.llm._words import blocks, utf8

LIMIT = 2048
#: Bytes encoded at a time, and pieces whose length a worker remembers.
BATCH_BYTES = 1 << 20
REMEMBERED = 400_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts tokens of UTF-8 texts with a ``tokenizers`` vocabulary.

    A text is cut before each ASCII white space that follows another character,
    where the pre-tokenizer, the normaliser and the special tokens all begin
    anew, and the pieces are encoded apart. Pieces seen before are looked up;
    the others of a batch are encoded at once.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}
        self.room = remembered

    def count(self, texts: list[bytes]) -> list[int]:
        pieces = [t.split() for t in texts]  # bytes.split cuts at the six ASCII white spaces only
        known = self.known
        fresh = list({p for ps in pieces for p in ps if p not in known})
        extra: dict[bytes, int] = {}
        if fresh:
            found = self.tokenizer.encode_batch_fast([p.decode() for p in fresh], add_special_tokens=False)
            pairs = {p: len(e.ids) for p, e in zip(fresh, found, strict=True)}
            if len(known) + len(pairs) <= self.room:
                known.update(pairs)
            else:
                extra = pairs
        if extra:
            return [sum([known[p] if p in known else extra[p] for p in ps]) for ps in pieces]
        get = known.__getitem__
        return [sum(map(get, ps)) for ps in pieces]


_COUNTERS: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """One counter for each vocabulary and Python worker, so that what it remembers serves later tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """All rows of ``df`` without the text, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    The vocabulary must drop white space and let no token span it (as
    ``word_bpe_49k.json``). A null text counts as empty: 0 tokens. Each row is
    judged alone, so repeated rows give repeated results. Columns of ``df`` named
    like an added one are replaced. Only lengths leave Python; texts are taken in
    batches of about ``batch_bytes``, one text at least, and each text is cut at
    safe boundaries, so the length of a text does not matter.
    """
    path = path or vocabulary()
    added = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    data = without(df, *added)
    rest = [c for c in data.columns if c != text]
    # Ordinals, not names, so that columns may have any name.
    schema = T.StructType([*[data.schema[c] for c in rest], *[T.StructField(k, v) for k, v in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            *others, column = batch.columns
            bytes_, offsets = utf8(column)
            counts: list[int] = []
            for a, b in blocks(offsets, batch_bytes):
                counts += counter.count([bytes_[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)])
            n = np.asarray(counts, np.int64)
            yield pa.RecordBatch.from_arrays([*others, pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[f.name for f in schema])

    return arrow(data.select(*[F.col(f"`{c}`") for c in rest], F.col(text)), run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE: dict[str, str] = {}
