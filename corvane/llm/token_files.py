"""Flat token-id files with 64-bit document offsets, written and memory-mapped.

Texts are encoded where they are read; only their ids, of 16 bits where the vocabulary
allows, move to the part of their document id, whose bounds are quantiles of all
document ids.  There are as many parts as hold about ``PART_BYTES`` of text each, and
the session's shuffle partitions at least.  Each task sorts its part and writes two files:

``part-NNNNNN.bin``  the ids of its documents one after the other, as unsigned
                     16-bit (vocabularies below 65,536) or 32-bit integers,
                     little-endian, no header;
``part-NNNNNN.idx``  little-endian int64: number of documents n, then n+1 token
                     offsets within the part, then n document ids, then n bytes
                     that are 1 where the document id is null.

Tasks report only their sizes; prefix sums over those (one row a part) give each
part its base, i.e. the number of ids before it.  A task writes under a name of
its own and renames at the end, so a task that is run again after a lost executor
replaces its files as a whole.

Encoding is that of the ``tokenizers`` library: for plain byte-level vocabularies
the library's model encodes each distinct pre-token once per worker, else the library whole texts.

Defined results: a null text is an empty text (only the end id); rows with a null
id come first; rows that share an id keep their own entries, in a fixed order that
follows from their ids, and may be split over parts; an empty table gives no parts and
reads back empty; extra columns are not carried.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._bytebpe import ByteVocab, cut_pretokens, joined_points, load_vocab
from corvane.llm._shared import slices, small_batches, text_chunks

CACHE_ENTRIES = 1 << 20

#: Text of a part, in bytes, beyond which there are more parts.
PART_BYTES = 1 << 28
#: Ids read at once from a part's file.
READ_IDS = 1 << 22


class _Learned(dict):
    """Ids of pre-tokens, both as bytes.  As they are pre-tokens already, the library's model is
    asked without the library's other steps."""

    def __init__(self, model, vocab: ByteVocab):
        self.tokenize, self.shown = model.tokenize, vocab.shown

    def __missing__(self, word: bytes) -> bytes:
        ids = [t.id for t in self.tokenize(word.decode("latin-1").translate(self.shown))]
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class LibraryEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        try:
            self.vocab = load_vocab(path)
        except ValueError:
            self.vocab = None
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.cache = _Learned(self.library.model, self.vocab) if self.vocab else {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        big, points, first, lens = joined_points(texts)
        if not len(points):
            return [b""] * len(texts)
        starts = np.flatnonzero(cut_pretokens(points, first))
        raw = np.frombuffer(big.encode(), np.uint8)
        at = np.flatnonzero(raw & 0xC0 != 0x80)[starts]
        # no UTF-8 text holds the byte 255
        words = np.insert(raw, at[1:], 255).tobytes().split(b"\xff")
        if len(self.cache) >= CACHE_ENTRIES:
            self.cache.clear()
        coded = list(map(self.cache.__getitem__, words))
        bounds = np.append(np.searchsorted(starts, np.cumsum(lens) - lens), len(starts)).tolist()
        return [b"".join(coded[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        if self.vocab is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        out: list[bytes] = [b""] * len(texts)
        for lo, hi in text_chunks(texts):
            plain, at = [], []
            for i in range(lo, hi):
                t = texts[i] or ""
                if self.vocab.has_special(t):
                    out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    plain.append(t)
                    at.append(i)
            for i, ids in zip(at, self._plain(plain), strict=True):
                out[i] = ids
        return out


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _rename(fs, src: str, dst: str) -> None:
    try:
        fs.move(src, dst)
    except OSError:
        fs.delete_file(dst)
        fs.move(src, dst)


def _id_width(tokenizer_path: str, end_id: int | None) -> str:
    return "<u2" if max(library_encoder(tokenizer_path).size, (end_id or 0) + 1) <= 1 << 16 else "<u4"


def _bounds(docs: DataFrame, parts: int | None) -> tuple[int, int, np.ndarray]:
    """(parts, how many hold only null ids, upper bounds of the ids in each later part but the last)."""
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows, known = docs.agg(F.count("*"), F.count("id")).first()
    first = (rows - known) * (parts - 1) // max(rows, 1)
    later = parts - first
    asked = [i / later for i in range(1, later)]
    found = docs.agg(F.percentile_approx("id", asked, max(10_000, 10 * parts))).first()[0] if asked else None
    return parts, first, np.array(found or [], np.int64)


def write_token_files(df: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> list[dict]:
    """Write the files; returns the manifest, one entry a part with its bases.

    The manifest holds one small entry per written part (never per document).
    """
    spark = df.sparkSession
    width = _id_width(tokenizer_path, end_id)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts, first, bounds = _bounds(docs, parts)

    def encode(batches):
        coder = library_encoder(tokenizer_path)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            coded = [np.frombuffer(x + tail, "<u4").astype(width) for x in coder.encode(batch.column(1).to_pylist())]
            n = np.fromiter(map(len, coded), np.int64, len(coded))
            coded = [x.tobytes() for x in coded]
            # an id that spans several parts is dealt to them by hash, in the order of the hashes
            tie = np.fromiter(map(xxhash.xxh3_64_intdigest, coded), np.uint64, len(coded)) >> np.uint64(32)
            tie = tie.astype(np.int64)
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            low = np.where(null, 0, first + np.searchsorted(bounds, ids, side="left"))
            high = np.where(null, first, first + np.searchsorted(bounds, ids, side="right"))
            part = low + (tie * (high - low + 1) >> 32)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column(0), pa.array(tie), pa.array(n), pa.array(coded, pa.binary())], ["part", "id", "tie", "n", "ids"])

    coded = docs.mapInArrow(encode, "part int, id long, tie long, n long, ids binary")
    source = coded.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "ids")

    def run(batches):
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        part = head.column(0)[0].as_py()
        name, own = f"{root}/part-{part:06d}", uuid.uuid4().hex
        sizes, ids, nulls = [np.zeros(1, np.int64)], [], []
        with fs.open_output_stream(f"{name}.bin.{own}") as out:
            for batch in itertools.chain([head], batches):
                for x in batch.column(4):
                    out.write(x.as_buffer())
                sizes.append(batch.column(3).to_numpy())
                col = batch.column(1)
                ids.append(col.fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(col.is_null().to_numpy(zero_copy_only=False))
        offsets = np.cumsum(np.concatenate(sizes))
        n = len(offsets) - 1
        with fs.open_output_stream(f"{name}.idx.{own}") as out:
            out.write(np.array([n], "<i8").tobytes() + offsets.astype("<i8").tobytes())
            out.write(np.concatenate(ids).astype("<i8").tobytes() + np.concatenate(nulls).astype("u1").tobytes())
        _rename(fs, f"{name}.bin.{own}", f"{name}.bin")
        _rename(fs, f"{name}.idx.{own}", f"{name}.idx")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([int(offsets[-1])], pa.int64()), pa.array([width])], ["part", "n_docs", "n_tokens", "width"])

    with small_batches(spark):
        rows = source.mapInArrow(run, "part long, n_docs long, n_tokens long, width string").collect()
    manifest, docs, tokens = [], 0, 0
    for r in sorted(rows, key=lambda r: r["part"]):
        manifest.append({"path": f"{folder}/part-{r['part']:06d}", "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "width": r["width"], "base_docs": docs, "base_tokens": tokens})
        docs, tokens = docs + r["n_docs"], tokens + r["n_tokens"]
    return manifest


def _mapped(fs, path: str, width: str, count: int, offset: int = 0) -> np.ndarray:
    """``count`` numbers of the file: memory-mapped where it is local, else read."""
    if not count:
        return np.zeros(0, width)
    if fs.type_name == "local":
        return np.memmap(path, dtype=width, mode="r", offset=offset, shape=count)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return np.frombuffer(f.read(count * np.dtype(width).itemsize), width)


def read_token_files(spark: SparkSession, manifest: list[dict], id_col: str = "doc_id", rows_a_batch: int = 2000) -> DataFrame:
    """(id, start, n_tokens, ids) of every document; ids as little-endian uint32 binary."""
    schema = "path string, n_docs long, n_tokens long, width string, base_docs long, base_tokens long"
    parts = spark.createDataFrame([tuple(m[k] for k in ("path", "n_docs", "n_tokens", "width", "base_docs", "base_tokens")) for m in manifest], schema)

    def run(batches):
        for batch in batches:
            for m in batch.to_pylist():
                fs, path = _file_system(m["path"])
                n = m["n_docs"]
                index = _mapped(fs, f"{path}.idx", "<i8", 1 + 2 * n + 1)
                offsets, ids = index[1 : n + 2], index[n + 2 : 2 * n + 2]
                nulls = _mapped(fs, f"{path}.idx", "u1", n, 8 * (2 * n + 2)).astype(bool)
                hi = 0
                while hi < n:
                    lo, far = hi, int(np.searchsorted(offsets, offsets[hi] + READ_IDS, side="right")) - 1
                    hi = min(n, lo + rows_a_batch, max(lo + 1, far))
                    cut = offsets[lo : hi + 1]
                    raw = _mapped(fs, f"{path}.bin", m["width"], int(cut[-1] - cut[0]), int(cut[0]) * np.dtype(m["width"]).itemsize).astype("<u4").tobytes()
                    at = (cut - cut[0]).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(ids[lo:hi]), mask=nulls[lo:hi]), pa.array(cut[:-1] + m["base_tokens"], pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)], pa.binary())],
                        [id_col, "start", "n_tokens", "ids"],
                    )

    return parts.repartition(max(1, len(manifest))).mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids binary")
