"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never end up inside one
output token, so a text may be cut there with certainty.  All such cuts, and
the pre-token boundaries, are found on the whole text with numpy; the fragments
between cuts are encoded independently (each distinct fragment once per worker)
and their ids concatenated.

Defined results: a null text is an empty text and gives no ids; empty texts give
zero ids; repeated rows are encoded row by row; an empty table gives an empty
table; extra columns are not carried (join on the id column).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._bytebpe import ByteVocab, byte_starts, cut_pretokens, joined_points, load_vocab
from corvane.llm._shared import slices, text_chunks

#: Distinct fragments a worker remembers; when full, it starts anew (speed only).
CACHE_ENTRIES = 1 << 17


class ForcedBoundaryEncoder:
    def __init__(self, vocab: ByteVocab):
        self.vocab = vocab
        inside = np.zeros((256, 256), bool)
        for token in vocab.token_bytes.values():
            raw = np.frombuffer(token, np.uint8)
            inside[raw[:-1], raw[1:]] = True
        #: forced[a, b]: no token holds byte a right before byte b
        self.forced = ~inside
        self.cache: dict[bytes, bytes] = {}
        self._piece = self._piece_encoder()

    def _piece_encoder(self):
        import tiktoken

        # Lowest merged id first equals lowest merge first: ByteVocab has checked
        # that ids follow the order of the merges.
        core = tiktoken.Encoding("corvane", pat_str=r"[\s\S]+", mergeable_ranks=self.vocab.rank_of, special_tokens={})._core_bpe
        return core.encode_single_piece

    def fragment(self, raw: bytes) -> bytes:
        got = self.cache.get(raw)
        if got is None:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            got = self.cache[raw] = np.array(self._piece(raw), "<u4").tobytes()
        return got

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens, as little-endian uint32 bytes."""
        big, points, first, lens = joined_points(texts)
        if not len(points):
            return [b""] * len(texts)
        raw = big.encode("utf-8")
        data = np.frombuffer(raw, np.uint8)
        offset = byte_starts(points)
        cut = np.zeros(len(data), bool)
        cut[offset[:-1][cut_pretokens(points, first)]] = True
        cut[1:] |= self.forced[data[:-1], data[1:]]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        cached, miss = self.cache.get, self.fragment
        pieces = [cached(raw[a:b]) or miss(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        doc_lo = offset[np.cumsum(lens) - lens]
        bounds = np.append(np.searchsorted(starts, doc_lo), len(starts)).tolist()
        return [b"".join(pieces[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        for lo, hi in text_chunks(texts):
            plain, at = [], []
            for i in range(lo, hi):
                t = texts[i] or ""
                if self.vocab.has_special(t):
                    parts = self.vocab.segments(t)
                    coded = iter(self._encode_plain([p for p in parts if isinstance(p, str)]))
                    out[i] = b"".join(next(coded) if isinstance(p, str) else np.array([p], "<u4").tobytes() for p in parts)
                else:
                    plain.append(t)
                    at.append(i)
            for i, ids in zip(at, self._encode_plain(plain), strict=True):
                out[i] = ids
        return out

    def decode(self, ids: bytes | None) -> str:
        """Text of little-endian uint32 ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.vocab.decode_table
        return b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(load_vocab(path))


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids``): ids as a binary of little-endian unsigned 32-bit integers."""
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        coder = encoder(tokenizer_path)
        for batch in slices(batches):
            ids = coder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids`` binary, ``decoded`` string): the text read back from its ids."""
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        coder = encoder(tokenizer_path)
        for batch in slices(batches):
            ids = coder.encode(batch.column(1).to_pylist())
            decoded = [coder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")


def n_ids(ids: Column) -> Column:
    return F.expr("0L") + F.floor(F.octet_length(ids) / 4).cast("long")


def decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ``decoded``) of a column as :func:`encode` makes it; null ids decode to ''."""
    source = df.select(F.col(id_col), F.col(ids_col).alias("__ids"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        coder = encoder(tokenizer_path)
        for batch in slices(batches):
            texts = [coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, decoded string")
