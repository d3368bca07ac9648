"""Quality classifier: interpolated modified Kneser-Ney language models of trusted text.

Models are over characters (order ``ORDER``), one a language, counted on all
trusted documents of the table: those labelled of good quality and not toxic,
without every ``HELD_OUT``-th by hash.  No count is cut off or sampled.  A model has
symbols of its own: one for each of the commonest signs of its trusted text, and a
sequence of several for each rarer one, so no two of these signs are merged.  Signs
that this text does not hold have no counts, whichever they are, and share a symbol.

1. Map tasks count their own n-grams; counts meet by n-gram.  Lower orders count
   distinct symbols to the left.  Only the distinct signs, counts of counts and the two
   lowest orders, which Unicode and the symbols bound, come to the driver.
2. Documents are read in blocks of ``BLOCK`` rows of a file.  Each block gives its
   distinct n-grams, which meet the counts in shards dealt by language and the third
   and second symbol from the end, so a shard holds all of an n-gram's orders from 3 up
   and yields its probability; these go back to the blocks.
3. A second read of each block adds up its documents' bits, hence no text is shuffled;
   ``keep_good`` reads a third time and takes the rows that passed by their numbers.

A document is kept when its perplexity a character lies between two quantiles of its
language: the upper one of the trusted documents held out, the lower one of all trusted
documents, since those counted score lower.  Where n documents hold no such quantile
(fewer than 199 for 0.995), it is read off an exponential tail: the farthest value,
moved on by the mean distance from the median on that side times ln(1 / ((n + 1)(1 - q))).

Defined results: null and empty texts have no perplexity and are rejected; a null
language, or one with fewer than ``min_trusted`` trusted documents, takes the model
and the quantiles of all languages together; without any trusted document every
text is kept with a null perplexity; repeated rows are scored row by row; a repeated
label counts once; an empty table gives an empty table; extra columns are not carried
by ``classify`` and are kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._shared import delete_path, free_name, shared_path, slices, small_batches, staged, text_chunks
from corvane.llm.token_files import _file_system

ORDER = 5
#: Signs of a model that are one symbol each: the commonest ones; rarer ones take several.
ALPHABET = 250
#: Languages with a model of their own: the commonest ones; all others share the pooled one.
LANGUAGES = 500
#: Rows of a file that are looked up together.
BLOCK = 16_384
#: Rows of counts and n-grams that a shard takes, about.
SHARD_ROWS = 1_000_000
HELD_OUT = 5
POOLED = "*"
_START, _UNSEEN = 251, 252
#: First symbols of rarer signs, and how many digits of base ``ALPHABET`` follow each.
_LEADS = ((250, 1), (253, 1), (254, 2), (255, 3))
_LENGTH = np.ones(256, np.int64)
for _lead, _digits in _LEADS:
    _LENGTH[_lead] += _digits
#: A key is the language's number above the five symbols of an n-gram.
_SIGNS = (1 << 40) - 1


class Symbols:
    """Code point to symbols, by pages of 256; the signs are given commonest first."""

    def __init__(self, signs):
        signs = np.asarray(signs, np.int64)
        word, rest = np.arange(len(signs)), np.arange(len(signs)) - ALPHABET
        for lead, digits in _LEADS:  # the lead is the lowest byte, then come the digits
            here = (rest >= 0) & (rest < ALPHABET**digits)
            word[here] = lead + sum((rest[here] // ALPHABET**k % ALPHABET) << 8 * (digits - k) for k in range(digits))
            rest = np.where(here, -1, rest - ALPHABET**digits)
        page, at = np.unique(signs >> 8, return_inverse=True)
        self.page = np.zeros(0x110000 >> 8, np.int64)
        self.page[page] = 256 * np.arange(1, len(page) + 1)
        self.word = np.full(256 * (len(page) + 1), _UNSEEN, np.uint64)
        self.word[256 * (at + 1) + (signs & 255)] = word
        self.single = len(signs) <= ALPHABET

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        word = self.word[self.page[points >> 8] + (points & 255)]
        if self.single:
            return word
        many = _LENGTH[word & np.uint64(255)]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(word, many) >> (8 * nth).astype(np.uint64) & np.uint64(255)


class _Tables(dict):
    """The symbols of each model, made when first asked for."""

    def __init__(self, alphabets: dict[int, np.ndarray]):
        self.alphabets = alphabets

    def __missing__(self, number: int) -> Symbols:
        self[number] = symbol_table(self.alphabets[number])
        return self[number]


def _codes(text: str, table: Symbols) -> np.ndarray:
    """The n-grams of a text as integers of one byte a symbol."""
    sym = table.of(text)
    padded = np.concatenate([np.full(ORDER - 1, _START, np.uint64), sym])
    code = np.zeros(len(sym), np.uint64)
    for k in range(ORDER):
        code = (code << np.uint64(8)) | padded[k : k + len(sym)]
    return code


def symbol_table(alphabet) -> Symbols:
    """The symbols of the signs of an alphabet; all other signs are unseen."""
    return Symbols(alphabet)


def _cuts(many: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of n-grams counted 1 to 4 times."""
    y = many[0] / (many[0] + 2 * many[1]) if many[0] else 0.0
    cut = np.zeros(4)
    for r in (1, 2, 3):
        if many[r - 1]:
            cut[r] = min(max(r - (r + 1) * y * many[r] / many[r - 1], 0.0), r - 0.01)
        else:
            cut[r] = cut[r - 1]
    return cut


class KneserNey:
    """Interpolated modified Kneser-Ney over codes of the highest order.

    ``cuts`` and ``base`` (the lowest levels) are given where the codes are one shard
    of a model; otherwise both come from the codes.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, cuts: dict[int, np.ndarray] | None = None, base: list | None = None):
        order = np.argsort(codes)
        grams = [(codes[order], counts[order].astype(np.int64))]
        self.levels = list(base or [])
        for n in range(ORDER - 1, len(self.levels), -1):  # continuation counts: distinct signs to the left
            grams.append(np.unique(grams[-1][0] & np.uint64((1 << (8 * n)) - 1), return_counts=True))
        for n, (c, k) in enumerate(reversed(grams), len(self.levels) + 1):
            self.levels.append(self.level(c, k, cuts[n] if cuts else _cuts([int(np.count_nonzero(k == r)) for r in (1, 2, 3, 4)])))
        self.floor = 1.0 / (ALPHABET + 2)

    @staticmethod
    def level(code: np.ndarray, count: np.ndarray, cut: np.ndarray) -> dict:
        lost = cut[np.minimum(count, 3)]
        context, first = np.unique(code >> np.uint64(8), return_index=True)
        total = np.add.reduceat(count, first) if len(code) else np.zeros(0)
        back = np.add.reduceat(lost, first) if len(code) else np.zeros(0)
        per = np.repeat(total, np.diff(np.append(first, len(code))))
        return {"code": code, "own": (count - lost) / np.maximum(per, 1), "context": context, "back": back / np.maximum(total, 1)}

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), self.floor)
        for n, level in enumerate(self.levels, 1):
            code = codes & np.uint64((1 << (8 * n)) - 1)
            p = self._at(level["code"], level["own"], code, 0.0) + self._at(level["context"], level["back"], code >> np.uint64(8), 1.0) * p
        return p


@dataclass
class QualityModel:
    """Counts in a table of the shared folder; the rest is bounded by Unicode and languages."""

    #: The signs of each model's trusted text, commonest first.
    alphabets: dict[int, np.ndarray]
    languages: dict[str, int]
    grams: DataFrame | None = None
    cuts: dict[int, dict[int, np.ndarray]] = field(default_factory=dict)
    base: dict[int, list] = field(default_factory=dict)
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)
    #: The frame that the model was fitted on, and its scores.
    fitted: tuple | None = None


def _language(languages: dict[str, int], lang: str | None) -> str:
    return lang if lang in languages else POOLED


def kept(limits: dict[str, tuple[float, float]], model: str, text: str | None, perplexity: float | None) -> bool:
    if not text:
        return False
    low, high = limits.get(model, (0.0, float("inf")))
    return perplexity is None or low <= perplexity <= high


def _trusted(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()


def _trusted_folder(docs: DataFrame, trusted: DataFrame) -> str:
    """Write each block's trusted ids below a folder of the shared one: ids meet, no text moves."""
    path = shared_path(docs.sparkSession, "trusted_blocks")
    found = docs.select("id", F.col("__block").alias("block")).join(trusted, "id", "left_semi").select("block", "id").distinct()
    found.repartition("block").write.partitionBy("block").parquet(path)
    return path


def _read_block(fs, root: str, block: int, columns: list[str]):
    """A block's table, or None where it has none."""
    import pyarrow.dataset as ds

    path = f"{root}/block={block}"
    if fs.get_file_info(path).type.name == "NotFound":
        return None
    found = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=columns, use_threads=False)
    pa.default_memory_pool().release_unused()
    return found


class _Trusted:
    """Picks the trusted texts of batches of (id, lang, text, block)."""

    def __init__(self, folder: str):
        self.fs, self.root = _file_system(folder)
        self.block, self.ids = None, np.zeros(0, np.int64)

    def texts(self, batch: pa.RecordBatch) -> tuple[list, list]:
        ids, blocks = batch.column(0), batch.column(3).to_numpy()
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        value = ids.fill_null(0).to_numpy()
        mark = np.zeros(batch.num_rows, bool)
        for lo, hi in _runs(blocks):
            if self.block != blocks[lo]:
                found = _read_block(self.fs, self.root, int(blocks[lo]), ["id"])
                self.block, self.ids = blocks[lo], found.column("id").to_numpy() if found else np.zeros(0, np.int64)
            mark[lo:hi] = np.isin(value[lo:hi], self.ids) & valid[lo:hi]
        some = batch.filter(pa.array(mark))
        return some.column(1).to_pylist(), some.column(2).to_pylist()


def _fold(old: tuple[np.ndarray, np.ndarray], new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Add occurrences to sorted codes and counts."""
    code, back = np.unique(np.concatenate([old[0], *new]), return_inverse=True)
    weight = np.concatenate([old[1], np.ones(len(back) - len(old[1]), np.int64)])
    return code, np.bincount(back, weights=weight, minlength=len(code)).astype(np.int64)


def _keys(texts: list, langs: list, tables: _Tables, languages: dict[str, int]) -> list[np.ndarray]:
    """Keys of all n-grams of each text."""
    numbers = [languages.get(lang, 0) for lang in langs]
    return [_codes(t, tables[n]) | np.uint64(n << 40) for t, n in zip(texts, numbers, strict=True)]


def _keyed(texts: list, langs: list, tables: _Tables, languages: dict[str, int]) -> np.ndarray:
    """Keys of all n-grams of the texts, one text after another."""
    parts = _keys(texts, langs, tables, languages)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _count_signs(docs: DataFrame, folder: str) -> DataFrame:
    def run(batches):
        trusted = _Trusted(folder)
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(*trusted.texts(batch), strict=True):
                at, k = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)
                total.setdefault(lang or POOLED, np.zeros(0x110000 + 1, np.int64))[at] += k
                total[lang or POOLED][0x110000] += 1
        for lang, k in total.items():
            at = np.flatnonzero(k)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(k[at])], ["lang", "sign", "n"])

    return docs.mapInArrow(run, "lang string, sign int, n long").groupBy("lang", "sign").agg(F.sum("n").alias("n"))


def _count_grams(docs: DataFrame, folder: str, alphabets: dict[int, np.ndarray], languages: dict[str, int]) -> DataFrame:
    """Counts of each text's n-grams in the symbols of its own language and of the pooled model."""

    def run(batches):
        trusted = _Trusted(folder)
        tables = _Tables(alphabets)
        sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        new, size = [], 0
        for batch in slices(batches):
            langs, texts = trusted.texts(batch)
            for lo, hi in text_chunks(texts):
                own = [i for i in range(lo, hi) if langs[i] in languages]
                new.append(_keyed(texts[lo:hi], [None] * (hi - lo), tables, {}))
                new.append(_keyed([texts[i] for i in own], [langs[i] for i in own], tables, languages))
                size += len(new[-1]) + len(new[-2])
                if size > 1 << 19:
                    sums, new, size = _fold(sums, new), [], 0
        code, k = _fold(sums, new)
        pa.default_memory_pool().release_unused()
        for lo in range(0, len(code), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(code[lo : lo + 50_000].view(np.int64)), pa.array(k[lo : lo + 50_000])], ["key", "n"])

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _build(docs: DataFrame, trusted: DataFrame, min_trusted: int) -> QualityModel:
    folder = _trusted_folder(docs, trusted)
    docs = docs.where("text <> ''").select("id", "lang", "text", "__block")
    with small_batches(docs.sparkSession):
        signs = staged(_count_signs(docs, folder), "signs")
    real = signs.where(F.col("sign") < 0x110000)
    top = real.groupBy("sign").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sign").toArrow()
    if not top.num_rows:
        return QualityModel({}, {})
    own = signs.where((F.col("sign") == 0x110000) & (F.col("n") >= min_trusted) & (F.col("lang") != POOLED)).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    model = QualityModel({0: top.column("sign").to_numpy()}, {r["lang"]: k for k, r in enumerate(own, 1)})
    found = real.where(F.col("lang").isin(list(model.languages))).toArrow()  # distinct signs of a language
    number = np.array([model.languages[x] for x in found.column("lang").to_pylist()], np.int64)
    sign, n = found.column("sign").to_numpy(), found.column("n").to_numpy()
    order = np.lexsort((sign, -n, number))
    bounds = np.searchsorted(number[order], np.arange(1, len(model.languages) + 2))
    for k in model.languages.values():
        model.alphabets[k] = sign[order[bounds[k - 1] : bounds[k]]]

    with small_batches(docs.sparkSession):
        model.grams = staged(_count_grams(docs, folder, model.alphabets, model.languages), "grams")
    levels = {ORDER: model.grams}
    for n in range(ORDER - 1, 0, -1):
        short = F.col("key").bitwiseAND(F.lit(~_SIGNS | ((1 << (8 * n)) - 1)))
        levels[n] = staged(levels[n + 1].groupBy(short.alias("key")).agg(F.count("*").alias("n")), f"level{n}")
    many: dict[int, dict[int, list[int]]] = {}
    for n, level in levels.items():
        for r in level.where("n <= 4").groupBy(F.shiftright("key", 40).alias("lang"), "n").agg(F.count("*").alias("k")).collect():
            many.setdefault(r["lang"], {j: [0] * 4 for j in levels})[n][r["n"] - 1] = r["k"]
    for number in (0, *model.languages.values()):
        model.cuts[number] = {n: _cuts(k) for n, k in many.get(number, {j: [0] * 4 for j in levels}).items()}
        model.base[number] = []
    for n in (1, 2):  # at most 256 ** n rows a language
        low = levels[n].toArrow()
        key, k = low.column("key").to_numpy().view(np.uint64), low.column("n").to_numpy()
        order = np.argsort(key)
        key, k = key[order], k[order]
        for number, cuts in model.cuts.items():
            at = key >> np.uint64(40) == number
            model.base[number].append(KneserNey.level(key[at] & np.uint64(_SIGNS), k[at], cuts[n]))
    return model


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of Parquet files, filtered or projected at most."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName().startswith(("LogicalRelation", "Relation")) and "parquet" in node.toString().lower() and "_metadata" not in df.columns


def _blocks(df: DataFrame) -> DataFrame:
    """``df`` with a ``__block`` and a ``__row`` (a number in its file) that a row keeps
    however the table is read; what is not a scan of Parquet files is written first."""
    found = df if _is_scan(df) else staged(df, "documents")
    block, row = (free_name(df, x) for x in ("__block", "__row"))
    return found.select("*", F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK)).alias(block), F.col("_metadata.row_index").alias(row))


def _distinct_grams(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(block, key): the n-grams of each block, once a map task."""
    alphabets, languages = model.alphabets, model.languages

    def run(batches):
        tables = _Tables(alphabets)
        block, known, new, size = None, np.zeros(0, np.uint64), [], 0

        def given():
            keys = np.unique(np.concatenate([known, *new]))
            for lo in range(0, len(keys), 50_000):
                part = keys[lo : lo + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part)], ["block", "key"])

        for batch in slices(batches):
            langs, texts, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for lo, hi in _runs(ids):
                if ids[lo] != block:
                    if block is not None:
                        yield from given()
                    block, known, new, size = ids[lo], known[:0], [], 0
                for a, b in text_chunks(texts[lo:hi]):
                    new.append(np.unique(_keyed(texts[lo + a : lo + b], langs[lo + a : lo + b], tables, languages)))
                    size += len(new[-1])
                    if size > 1 << 19:
                        known, new, size = np.unique(np.concatenate([known, *new])), [], 0
        if block is not None:
            yield from given()

    return docs.where("text <> ''").select("lang", "text", "__block").mapInArrow(run, "block long, key long")


def _runs(ids: np.ndarray):
    """Bounds of runs of equal values."""
    ends = [*(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)] if len(ids) else []
    return zip([0, *ends[:-1]], ends, strict=True) if ends else ()


def _written(df: DataFrame, path: str, *by: str) -> None:
    """Write sorted keys as differences."""
    out = df.write.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "v2")
    (out.partitionBy(*by) if by else out).parquet(path)


#: The shard of a key: its language and the third and second symbol from the end.
_CELL = "shiftright(key, 40) * 65536 + (shiftright(key, 8) & 65535)"


def _looked_up(asked: DataFrame, model: QualityModel, spark: SparkSession) -> DataFrame:
    """(block, key, bits) of every asked key, from the shards of the counts.

    A shard meets the counts of its cells first, which the symbols bound, and then
    answers what is asked batch by batch.  Cells that are asked for more than
    ``SHARD_ROWS`` times are split, and their counts go to each part.
    """
    cell = F.expr(_CELL).alias("cell")
    often = asked.groupBy(cell).agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS)
    often = F.broadcast(staged(often.select("cell", F.ceil(F.col("n") / SHARD_ROWS).alias("parts")), "often"))  # at most 256 ** 2 rows a language
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    counts = model.grams.select("key", "n", cell).join(often, "cell", "left").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(None).cast("long").alias("block"), "key", "n")
    wanted = asked.select("block", "key", cell).join(often, "cell", "left").select("cell", F.pmod(F.xxhash64("block", "key"), parts).alias("part"), "block", "key", F.lit(0).cast("long").alias("n"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (model.grams.count() + asked.count()) // SHARD_ROWS + 1)
    small = spark.sparkContext.broadcast((model.cuts, model.base))

    def run(batches):
        cuts, base = small.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shards: dict[int, KneserNey] = {}

        def shard(number):
            if number not in shards:
                key, count = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *held, strict=True))
                key, first = np.unique(key, return_index=True)  # parts of a cell can share a task
                own = key >> np.uint64(40) == number
                shards[number] = KneserNey(key[own] & np.uint64(_SIGNS), count[first][own], cuts[number], base[number])
            return shards[number]

        for batch in batches:
            key, count = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            known = int(np.count_nonzero(count))  # counts come first
            if known:
                held.append((key[:known].copy(), count[:known].copy()))
            if known == len(key):
                continue
            asks = key[known:]
            lang, bits = asks >> np.uint64(40), np.empty(len(asks), np.float32)
            for number in np.unique(lang).tolist():
                at = lang == number
                bits[at] = -np.log2(shard(number).probability(asks[at] & np.uint64(_SIGNS)))
            rest = batch.slice(known)
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.array(bits)], ["block", "key", "bits"])

    dealt = counts.unionByName(wanted).repartition(n, "cell", "part").sortWithinPartitions(F.col("n") == 0)
    return dealt.select("block", "key", "n").mapInArrow(run, "block long, key long, bits float")


def _block_tables(docs: DataFrame, model: QualityModel) -> str:
    """Write the bits of each block's n-grams below a folder of the shared one."""
    spark = docs.sparkSession
    asked, path = shared_path(spark, "asked"), shared_path(spark, "bits")
    with small_batches(spark):
        _written(_distinct_grams(docs, model), asked)
    found = _looked_up(spark.read.schema("block long, key long").parquet(asked), model, spark)
    _written(found.repartition("block", F.pmod(F.xxhash64("key"), F.lit(32))).sortWithinPartitions("block", "key"), path, "block")
    delete_path(spark, asked)
    return path


class _Bits:
    """The bits of one block's n-grams at a time."""

    def __init__(self, folder: str):
        self.fs, self.root = _file_system(folder)
        self.block = None

    def load(self, block: int) -> None:
        if block != self.block:
            found = _read_block(self.fs, self.root, block, ["key", "bits"])
            if found is None:
                raise RuntimeError("a block is missing: the documents changed between two reads")
            key, bits = found.column("key").to_numpy(), found.column("bits").to_numpy()
            key, first = np.unique(key, return_index=True)
            self.key, self.bits, self.block = key.view(np.int64), bits[first], block

    def of(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.int64)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        if not np.array_equal(self.key[at], keys):
            raise RuntimeError("an n-gram is missing: the documents changed between two reads")
        return self.bits[at]


def _perplexities(langs: list, texts: list, blocks: np.ndarray, tables: _Tables, languages: dict[str, int], bits: _Bits) -> list[float | None]:
    out: list[float | None] = [None] * len(texts)
    for start, end in _runs(blocks):
        some = [i for i in range(start, end) if texts[i]]
        if not some:
            continue
        bits.load(int(blocks[start]))
        for lo, hi in text_chunks([texts[i] for i in some]):
            at = some[lo:hi]
            keys = _keys([texts[i] for i in at], [langs[i] for i in at], tables, languages)
            each = bits.of(np.concatenate(keys))
            sums = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
            ends = np.cumsum([len(k) for k in keys]).tolist()
            for i, k, e in zip(at, keys, ends, strict=True):
                out[i] = 2.0 ** float((sums[e] - sums[e - len(k)]) / len(texts[i]))
    return out


def _plain(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))


def _scored(docs: DataFrame, model: QualityModel, folder: str) -> DataFrame:
    """(id, lang, model, perplexity, empty, block, row) of every row of blocks."""
    alphabets, languages = model.alphabets, model.languages

    def run(batches):
        tables, bits = _Tables(alphabets), _Bits(folder)
        for batch in slices(batches):
            langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            ppl = _perplexities(langs, texts, batch.column(3).to_numpy(), tables, languages, bits)
            names = [_language(languages, x) for x in langs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(ppl, pa.float64()), pa.array([not t for t in texts], pa.bool_()), batch.column(3), batch.column(4)], ["id", "lang", "model", "perplexity", "empty", "block", "row"])

    return docs.select("id", "lang", "text", "__block", "__row").mapInArrow(run, "id long, lang string, model string, perplexity double, empty boolean, block long, row long")


def _scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    folder = _block_tables(docs, model)
    with small_batches(docs.sparkSession):
        return staged(_scored(docs, model, folder), "scores")


def _tail(known: DataFrame, q: float) -> dict[str, float]:
    """The quantile q of each model's perplexities, and of all together (None)."""
    p, far = F.col("perplexity"), max(q, 1 - q)
    known = known.select(F.explode(F.array("model", F.lit(None).cast("string"))).alias("model"), "perplexity")
    middle = known.groupBy("model").agg(F.count("*").alias("n"), F.percentile_approx(p, 0.5, 10_000).alias("median"), F.percentile_approx(p, q, 10_000).alias("cut")).withColumnRenamed("model", "of")
    beyond = F.log(p / F.col("median")) if q > 0.5 else F.log(F.col("median") / p)
    met = known.join(F.broadcast(middle), F.col("model").eqNullSafe(F.col("of"))).select("model", "n", "cut", beyond.alias("x"))  # a row a model
    rows = met.groupBy("model").agg(F.first("n").alias("n"), F.first("cut").alias("cut"), F.coalesce(F.avg(F.when(F.col("x") > 0, F.col("x"))), F.lit(0.0)).alias("mean")).collect()
    side = 1.0 if q > 0.5 else -1.0
    return {r["model"]: r["cut"] * float(np.exp(side * r["mean"] * max(0.0, -np.log((r["n"] + 1) * (1 - far))))) for r in rows}


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantiles: tuple[float, float] = (0.005, 0.995), min_trusted: int = 20) -> QualityModel:
    """Count the trusted text, score all documents, and take each language's limits."""
    trusted = staged(_trusted(labels, id_col), "trusted")
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(HELD_OUT))
    docs = _blocks(_plain(df, id_col, text_col, lang_col))
    model = _build(docs, trusted.where(fold > 0), min_trusted)
    if not model.alphabets:
        return model
    scores = _scores(docs, model)
    model.fitted = df, scores
    known = staged(scores.where("perplexity is not null").join(trusted, "id", "left_semi").select("id", "model", "perplexity"), "known")
    low, high = _tail(known, quantiles[0]), _tail(known.where(fold == 0), quantiles[1])
    if high:
        model.limits = {x: (low.get(x, low[None]), high.get(x, high[None])) for x in (*model.languages, POOLED)}
    return model


def _judged(df: DataFrame, scores: DataFrame, model: QualityModel) -> DataFrame:
    limits = df.sparkSession.createDataFrame([(lang, *x) for lang, x in model.limits.items()], "model string, low double, high double")
    out = scores.join(F.broadcast(limits), "model", "left")  # a row a language
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("keep", ~F.col("empty") & inside)


def classify(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, perplexity, low, high, keep) of every document."""
    if not model.alphabets:
        none = F.lit(None).cast("double")
        return _plain(df, id_col, text_col, lang_col).select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), none.alias("perplexity"), none.alias("low"), none.alias("high"), F.coalesce(F.col("text") != "", F.lit(False)).alias("keep"))
    scores = model.fitted[1] if model.fitted and model.fitted[0] is df else _scores(_blocks(_plain(df, id_col, text_col, lang_col)), model)
    return _judged(df, scores, model).select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "perplexity", "low", "high", "keep")


def keep_good(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that the classifier keeps, all columns as they are."""
    if not model.alphabets:
        return df.where(F.col(text_col) != "")
    blocks = _blocks(df)
    scores = model.fitted[1] if model.fitted and model.fitted[0] is df and _is_scan(df) else _scores(_blocks_as(blocks, id_col, text_col, lang_col), model)
    folder = shared_path(df.sparkSession, "kept_rows")
    _judged(df, scores, model).where("keep").select("block", "row").repartition("block").write.partitionBy("block").parquet(folder)
    n = len(df.columns)

    def run(batches):
        fs, root = _file_system(folder)
        block, rows = None, np.zeros(0, np.int64)
        for batch in slices(batches):
            ids, row, mark = batch.column(n).to_numpy(), batch.column(n + 1).to_numpy(), np.zeros(batch.num_rows, bool)
            for lo, hi in _runs(ids):
                if ids[lo] != block:
                    found = _read_block(fs, root, int(ids[lo]), ["row"])
                    block, rows = ids[lo], found.column("row").to_numpy() if found else np.zeros(0, np.int64)
                mark[lo:hi] = np.isin(row[lo:hi], rows)
            yield batch.filter(pa.array(mark)).select(list(range(n)))

    # by place, since a name with a dot can't be passed on
    placed = blocks.toDF(*(f"c{k}" for k in range(n + 2)))
    return placed.mapInArrow(run, placed.select(*placed.columns[:n]).schema).toDF(*df.columns)


def _blocks_as(blocks: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return blocks.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(blocks.columns[-2]).alias("__block"), F.col(blocks.columns[-1]).alias("__row"))
