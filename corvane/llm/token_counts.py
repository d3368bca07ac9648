"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged numpy array of symbols.
In each round every sequence merges its own lowest-rank pair, all sequences at
once; sequences without a mergeable pair leave with their number of symbols.
Only pairs next to a merge are looked up again.

Defined results: a null text counts as empty (0 tokens, 0 bytes); repeated rows
are counted row by row; an empty table gives an empty table; extra columns are
not carried.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._bytebpe import ByteVocab, cut_pretokens, joined_points, load_vocab
from corvane.llm._shared import slices, text_chunks

CACHE_ENTRIES = 1 << 20
_NONE = np.int64(1) << 40


class RankSynchronousCounter:
    def __init__(self, vocab: ByteVocab):
        self.vocab = vocab
        left, right, made = vocab.merges.T
        self.stride = int(vocab.size) + 1
        key = left * self.stride + right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.cache: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.stride + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols each non-empty piece ends with."""
        out = np.zeros(len(pieces), np.int64)
        if not pieces:
            return out
        sym = self.vocab.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        who = np.arange(len(pieces))
        last = np.zeros(len(sym), bool)
        last[np.cumsum(lens) - 1] = True
        rank = np.full(len(sym), _NONE)
        rank[:-1] = self._rank(sym[:-1], sym[1:])
        rank[last] = _NONE
        while len(who):
            starts = np.cumsum(lens) - lens
            low = np.minimum.reduceat(rank, starts)
            live = low < _NONE
            if not live.all():
                out[who[~live]] = lens[~live]
                keep = np.repeat(live, lens)
                sym, rank, last = sym[keep], rank[keep], last[keep]
                who, lens, low = who[live], lens[live], low[live]
                if not len(who):
                    break
            hit = rank == np.repeat(low, lens)
            # of overlapping pairs (a a a) the left one goes first: keep every other of a run
            at = np.flatnonzero(hit)
            fresh = np.ones(len(at), bool)
            fresh[1:] = np.diff(at) > 1
            run_head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_head) % 2 == 0]
            sym[at] = self.made[rank[at]]
            last[at] = last[at + 1]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            seq = np.repeat(np.arange(len(who)), lens)
            lens = lens - np.bincount(seq[at], minlength=len(who))
            new_at = (np.cumsum(stay) - 1)[at]
            sym, rank, last = sym[stay], rank[stay], last[stay]
            touched = np.unique(np.concatenate([new_at, np.maximum(new_at - 1, 0)]))
            inner = touched[~last[touched]]
            rank[touched] = _NONE
            rank[inner] = self._rank(sym[inner], sym[inner + 1])
        return out

    def _count_plain(self, texts: list[str]) -> list[int]:
        big, points, first, lens = joined_points(texts)
        if not len(points):
            return [0] * len(texts)
        starts = np.flatnonzero(cut_pretokens(points, first))
        ends = np.append(starts[1:], len(points))
        words = [big[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if len(self.cache) >= CACHE_ENTRIES:
            self.cache.clear()
        cache = self.cache
        miss = [w for w in dict.fromkeys(words) if w not in cache]
        cache.update(zip(miss, self.count([w.encode() for w in miss]).tolist(), strict=True))
        each = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(cache.__getitem__, words), np.int64, len(words)), out=each[1:])
        lo = np.cumsum(lens) - lens
        bounds = np.append(np.searchsorted(starts, lo), len(starts))
        return np.diff(each[bounds]).tolist()

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        for lo, hi in text_chunks(texts):
            plain, at = [], []
            for i in range(lo, hi):
                t = texts[i] or ""
                if self.vocab.has_special(t):
                    parts = self.vocab.segments(t)
                    out[i] = sum(self._count_plain([p for p in parts if isinstance(p, str)])) + sum(not isinstance(p, str) for p in parts)
                else:
                    plain.append(t)
                    at.append(i)
            for i, n in zip(at, self._count_plain(plain), strict=True):
                out[i] = n
        return out


class PieceModelCounter:
    """Vocabularies of ``sentencepiece`` have no pre-tokens; the library counts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(x) for x in self.model.encode([t or "" for t in texts], num_threads=1)] if texts else []


@functools.lru_cache(maxsize=2)
def counter(path: str):
    return PieceModelCounter(path) if path.endswith(".model") else RankSynchronousCounter(load_vocab(path))


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text."""
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow.compute as pc

        model = counter(tokenizer_path)
        for batch in slices(batches):
            text = batch.column(1)
            n = pa.array(model.counts(text.to_pylist()), pa.int64())
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
