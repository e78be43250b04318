"""Token files: concatenated ids with Elias-Fano coded document boundaries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stormline.llm.tokens import memo

SAMPLE = 64  # every so many boundaries, the place of its bit is kept
BLOCK_IDS, BLOCK_DOCS, CHUNK = 1 << 18, 1024, 128
# A file row: the partition, the ids of the partition before this block, document identifiers, the concatenated
# ids (16-bit little-endian), and the boundaries: low bits, high bits in unary, and select samples.
FILE = ("part int, before long, n_docs int, n_ids long, keys binary, ids binary, low_bits int, low binary, "
        "high binary, samples binary")
ROW = "part int, doc_id long, local long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A rising sequence in about 2 + log2(universe / count) bits a value, with random access."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.low_bits = low_bits
        self.low = np.frombuffer(low, dtype="u1")
        self.high = np.frombuffer(high, dtype="u1")
        self.samples = np.frombuffer(samples, dtype="<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype="<u8")
        bits = max(0, int(int(values[-1]) // len(values)).bit_length() - 1)
        low = np.zeros(0, dtype="u1")
        if bits:
            low = np.packbits(((values[:, None] >> np.arange(bits, dtype="<u8")) & 1).astype("u1").ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)) + np.arange(len(values), dtype="<u8")
        unary = np.zeros(int(ones[-1]) + 1, dtype="u1")
        unary[ones.astype("<i8")] = 1
        return cls(bits, low.tobytes(), np.packbits(unary, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The place of the i-th one bit: from the sample before it, over at most SAMPLE ones."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, width = at // 8, 32
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte:byte + width], bitorder="little")[at % 8:])
            if len(ones) > left:
                return at + int(ones[left])
            width *= 4

    def __getitem__(self, i: int) -> int:
        low = 0
        if self.low_bits:
            first = i * self.low_bits
            end = first + self.low_bits
            low = int.from_bytes(self.low[first // 8:(end + 7) // 8].tobytes(), "little") >> (first % 8)
            low &= (1 << self.low_bits) - 1
        return ((self.select(i) - i) << self.low_bits) | low

    def first(self, count: int) -> np.ndarray:
        """The first ``count`` values, all at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:count]
        values = (ones - np.arange(count)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[:count * self.low_bits].reshape(count, self.low_bits)
            values |= bits.astype("<i8") @ (1 << np.arange(self.low_bits))
        return values


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write the ids in ascending doc_id order.

    Spark range-partitions and sorts by doc_id; each task encodes its texts, a distinct
    piece of text once as long as it is remembered, and writes blocks of bounded size
    through Spark's committer, so a lost executor repeats tasks and leaves no half file.
    Blocks know the ids before them in their partition, so a reader needs one number per
    partition to place them.

    Null texts count as empty and hold only the end. Null identifiers come first; equal
    ones keep each its own entry. Other columns are ignored; an empty table gives an
    empty file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before, held = TaskContext.get().partitionId(), 0, memo(tokenizer)
        end = np.array([end_id], dtype="<u2").tobytes()
        keys, lists, size = [], [], 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([0] + [len(one) // 2 for one in lists])
            marks = EliasFano.of(ends)
            known = np.array([0 if k is None else k for k in keys], dtype="<i8").tobytes()
            null = np.array([k is None for k in keys], dtype="u1").tobytes()
            row = [task, before, len(keys), int(ends[-1]), known + null, b"".join(lists), marks.low_bits,
                   marks.low.tobytes(), marks.high.tobytes(), marks.samples.tobytes()]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(),
                     pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds)],
                                              names=[f.split()[0] for f in FILE.split(", ")])

        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                for key, ids in zip(part.column(0).to_pylist(), held.encode(part.column(1).to_pylist())):
                    keys.append(key)
                    lists.append(ids + end)
                    size += len(ids) // 2 + 1
                    if size >= BLOCK_IDS or len(keys) >= BLOCK_DOCS:
                        yield block()
                        before, keys, lists, size = before + size, [], [], 0
        if keys:
            yield block()

    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(encode, FILE).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; the checksum is over the ids as
    little-endian unsigned 32-bit integers.
    """
    files = spark.read.schema(FILE).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                count = row["n_docs"]
                marks = EliasFano(row["low_bits"], row["low"], row["high"], row["samples"])
                edges = marks.first(count + 1)
                ids = memoryview(np.frombuffer(row["ids"], dtype="<u2").astype("<u4").tobytes())
                ends = (4 * edges).tolist()
                keys = np.frombuffer(row["keys"], dtype="<i8", count=count)
                null = np.frombuffer(row["keys"], dtype="u1", offset=8 * count).astype(bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * count, type=pa.int32()), pa.array(keys, type=pa.int64(), mask=null),
                    pa.array(row["before"] + edges[:-1], type=pa.int64()),
                    pa.array(np.diff(edges), type=pa.int64()),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])], type=pa.int64()),
                ], names=["part", "doc_id", "local", "n_tokens", "ids_crc32"])

    # One row per partition of the writer.
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return files.mapInArrow(decode, ROW).join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
