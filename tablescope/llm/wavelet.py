"""Token files as wavelet matrices.

A shard holds the ids of consecutive documents as bit planes, highest bit first; each plane is ordered by the bits above
it and has a directory of counts, so that access, counting and finding occurrences need a few words of each plane.  Shards
are rows of a Parquet table: Spark's writer commits a task's shards as a whole, on any store, also when executors are lost.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescope.llm.common import text_groups
from tablescope.llm.counts import byte_alphabet

#: Ids after which a shard is closed, at the next end of a document.
SHARD_IDS = 262_144
#: Bits between two entries of a plane's directory.
RANK_BITS = 512
MOST_CHUNKS = 800_000
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
GROUP = 20_000

SHARD_SCHEMA = (
    "part int, seq long, n_ids long, doc_ids array<long>, doc_ends array<long>, width int, "
    "zeros array<long>, planes array<binary>, ranks array<binary>"
)


class WaveletMatrix:
    """Rank and select over a sequence of non-negative ids."""

    def __init__(self, n: int, width: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.width, self.zeros = n, width, zeros
        self.planes, self.ranks = planes, [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        row = ids.astype(np.uint16 if width <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in reversed(range(width)):
            one = (row >> level & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            padded = np.zeros(-(-len(packed) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
            padded[: len(packed)] = packed
            sums = np.bitwise_count(padded.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(1, dtype=np.uint32)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32).tobytes())
            low = row.take(np.flatnonzero(~one))
            zeros.append(len(low))
            row = np.concatenate([low, row.take(np.flatnonzero(one))])
        return cls(len(ids), width, zeros, planes, ranks)

    def ids(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        row = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            one = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(row)
            up[np.flatnonzero(~one)] = row[:z]
            up[np.flatnonzero(one)] = row[z:] | row.dtype.type(1 << level)
            row = up
        return row

    def _ones(self, level: int, i: int) -> int:
        """Set bits among the first i of a plane."""
        block = i // RANK_BITS
        start = block * (RANK_BITS // 8)
        rest = int.from_bytes(self.planes[level][start : i // 8 + 1], "little") & ((1 << (i - start * 8)) - 1)
        return int(self.ranks[level][block]) + rest.bit_count()

    def _find(self, level: int, k: int, one: bool) -> int:
        """Place of the k-th (from 0) set or clear bit of a plane."""
        counts = self.ranks[level].astype(np.int64)
        if not one:
            counts = np.arange(len(counts), dtype=np.int64) * RANK_BITS - counts
        block = int(np.searchsorted(counts, k, "right")) - 1
        start = block * (RANK_BITS // 8)
        bits = np.unpackbits(np.frombuffer(self.planes[level][start : start + RANK_BITS // 8], np.uint8), bitorder="little")
        return start * 8 + int(np.flatnonzero(bits == one)[k - int(counts[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            bit = self.planes[level][i >> 3] >> (i & 7) & 1
            ones = self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """First and last place below the lowest plane of the occurrences of value before end."""
        a, b = 0, end
        if value >> self.width:
            return 0, 0
        for level in range(self.width):
            ones_a, ones_b = self._ones(level, a), self._ones(level, b)
            if value >> (self.width - 1 - level) & 1:
                a, b = self.zeros[level] + ones_a, self.zeros[level] + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return a, b

    def rank(self, value: int, end: int) -> int:
        """Occurrences of value among the first ``end`` ids."""
        a, b = self._range(value, min(end, self.n))
        return b - a

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence of value, from 0."""
        a, b = self._range(value, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(self.width)):
            one = bool(value >> (self.width - 1 - level) & 1)
            i = self._find(level, i - self.zeros[level] if one else i, one)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.rank(value, self.n))]


class LibraryEncoder:
    """Ids of the tokenizers library for many texts.

    Where the file drops white space, what stands between two spaces is encoded on its own and remembered, since most
    of it comes again; texts with special strings, and all texts of other files, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["normalized"])}
        self.by_chunk = bool(spec["model"].get("end_of_word_suffix")) and len(self.special) == len(spec["added_tokens"]) > 0
        top = max(max(spec["model"]["vocab"].values()), *self.special.values(), 0)
        self.dtype = np.uint16 if top < 1 << 16 else np.uint32
        self.known: dict[str, bytes] = {}
        # byte -> its character in the vocabulary, for texts whose bytes were read as Latin-1
        self.wide = {b: c for c, b in byte_alphabet().items()}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _learn(self, chunks: set[str], latin: bool) -> None:
        """``latin``: all chunks come from lower-cased Latin-1 texts."""
        known = self.known
        words: set[str] = set()
        rest: list[str] = []
        ended: list[tuple[str, str]] = []
        for c in chunks:
            base = c.rstrip(MARKS)
            if base.isalpha() and (latin or base.islower() and max(base) < "\u0100"):
                if base not in known:
                    words.add(base)
                if len(base) < len(c):  # marks behind letters are always a piece of their own
                    ended.append((c, base))
            else:
                rest.append(c)
        self._keep_words(list(words))
        rest += {c[len(base) :] for c, base in ended}.difference(known, rest)
        for i in range(0, len(rest), GROUP):
            self._keep(rest[i : i + GROUP])
        for c, base in ended:
            known[c] = known[base] + known[c[len(base) :]]

    def _keep_words(self, words: list[str]) -> None:
        """Lower-case words of letters go to the library's model as they are: nothing in front of it would change them."""
        tokenize, wide, known = self.tokenizer.model.tokenize, self.wide, self.known
        width = self.dtype().itemsize
        for i in range(0, len(words), GROUP):
            some = words[i : i + GROUP]
            found = [tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(wide)) for w in some]
            raw = np.array([t.id for tokens in found for t in tokens], self.dtype).tobytes()
            a = 0
            for w, tokens in zip(some, found, strict=True):
                b = a + len(tokens) * width
                known[w] = raw[a:b]
                a = b

    def _keep(self, chunks: list[str]) -> None:
        """Encodes chunks in one text, kept apart by a special string, which is a token of its own."""
        mark, mark_id = next(iter(self.special.items()))
        ids = self._whole([mark.join(chunks)])[0]
        raw, width = ids.tobytes(), ids.itemsize
        cuts = (np.flatnonzero(ids == mark_id) * width).tolist()
        for chunk, a, b in zip(chunks, [0, *(c + width for c in cuts)], [*cuts, len(raw)], strict=True):
            self.known[chunk] = raw[a:b]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        split: list[tuple[int, list[str], list[bytes | None]]] = []
        missing: set[str] = set()
        latin = True
        if len(self.known) > MOST_CHUNKS:
            self.known.clear()
        get = self.known.get
        for i, text in enumerate(texts):
            if not self.by_chunk or any(s in text for s in self.special):
                out[i] = self._whole([text])[0]
                continue
            try:
                text.encode("latin-1")
                text = text.lower()  # one character stays one, and no accents combine
            except UnicodeEncodeError:
                latin = False
            chunks = text.replace("\n", " ").split(" ")
            found = list(map(get, chunks))
            if None in found:
                missing.update([c for c, f in zip(chunks, found, strict=True) if f is None])
            split.append((i, chunks, found))
        if missing:
            self._learn(missing, latin)
        known = self.known
        for i, chunks, found in split:
            if None in found:
                found = [known[c] if f is None else f for c, f in zip(chunks, found, strict=True)]
            out[i] = np.frombuffer(b"".join(found), self.dtype)
        return out


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder per worker process, so that its memory serves one task after the other."""
    return LibraryEncoder(path)


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, key: str = "doc_id", text: str = "text"
) -> None:
    """Encodes every text with the file ``tokenizer`` and writes shards to ``path`` in ascending order of the key.

    Documents are dealt out by ranges of the key once, as text; each task encodes its range in order and closes shards as
    it goes, so it holds one shard's ids.  ``end_id`` is put behind every document.  Null text is an empty document, a
    null key comes first, repeated keys are ordered by text, other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer)
        part = TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], encode.dtype)
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        ends: list[int] = []
        seq = size = 0

        def shard() -> pa.RecordBatch:
            m = WaveletMatrix.build(np.concatenate(held) if held else np.array([], encode.dtype))
            values = [part, seq, m.n, keys, ends, m.width, m.zeros, m.planes, [r.tobytes() for r in m.ranks]]
            types = [
                pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(),
                pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()),
            ]
            names = ["part", "seq", "n_ids", "doc_ids", "doc_ends", "width", "zeros", "planes", "ranks"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            ids = batch.column(0)
            for at, texts in text_groups(batch.column(1)):
                for i, found in enumerate(encode(texts), at):
                    held += [found, end]
                    size += len(found) + len(end)
                    keys.append(ids[i].as_py())
                    ends.append(size)
                    if size >= SHARD_IDS:
                        yield shard()
                        held, keys, ends, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield shard()

    writer = rows.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd")
    # rows are large: look at the size of a row group after every few of them
    for name, value in (("parquet.block.size", 16 << 20), ("parquet.page.size.row.check.min", 2), ("parquet.page.size.row.check.max", 8)):
        writer = writer.option(name, value)
    writer.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the shards: doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    The ids come back from the bit planes.  Starts are running sums within a part and over the parts' totals, which are
    one row per task of the writer.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = shards.select("part", "seq", "n_ids")
    of_part = Window.partitionBy("part").orderBy("seq")
    inner = sizes.withColumn("before", F.sum("n_ids").over(of_part) - F.col("n_ids"))
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    starts = inner.join(bases, "part").select("part", "seq", (F.col("before") + F.col("base")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                m = WaveletMatrix(one["n_ids"], one["width"], one["zeros"], one["planes"], one["ranks"])
                raw = memoryview(m.ids().astype("<u4").tobytes())
                ends = one["doc_ends"]
                begins = [0, *ends[:-1]]
                k = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([one["part"]] * k, pa.int32()), pa.array([one["seq"]] * k, pa.int64()),
                        pa.array(one["doc_ids"], pa.int64()), pa.array(begins, pa.int64()),
                        pa.array([b - a for a, b in zip(begins, ends, strict=True)], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = shards.mapInArrow(run, "part int, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, position in the document) of every occurrence of a token, by rank and select on each shard."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                m = WaveletMatrix(one["n_ids"], one["width"], one["zeros"], one["planes"], one["ranks"])
                at = np.array(m.occurrences(token), np.int64)
                doc = np.searchsorted(np.array(one["doc_ends"], np.int64), at, "right")
                begins = np.array([0, *one["doc_ends"][:-1]], np.int64)
                ids = [one["doc_ids"][d] for d in doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(at - begins[doc] if len(at) else at, pa.int64())], names=["doc_id", "position"]
                )

    return shards.mapInArrow(run, "doc_id long, position long")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """One row: n, how often a token occurs in all shards, by rank alone."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                m = WaveletMatrix(one["n_ids"], one["width"], one["zeros"], one["planes"], one["ranks"])
                yield pa.RecordBatch.from_arrays([pa.array([m.rank(token, m.n)], pa.int64())], names=["n"])

    counts = shards.mapInArrow(run, "n long")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
