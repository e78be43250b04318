"""Token counts from distinct pre-tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stormline.llm.tokens import encoder, pieces

BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 8192
# One schema for all rows that travel: the distinct pieces of a block, their counts, or the block's documents.
ROW = "route long, block long, bucket int, kind string, data binary"
DOCS = "docs"


def _deflate(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _inflate(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


class _Block:
    """Documents of one stretch of a partition and their pieces."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.sizes, self.distinct, self.bytes = [], [], [], 0
        self.places, self.times = [], []

    def add(self, doc_id, text: str | None) -> None:
        found, seen = Counter(pieces(text)), self.vocabulary
        self.places.append(np.array([seen.setdefault(p, len(seen)) for p in found], dtype="<u4"))
        self.times.append(np.fromiter(found.values(), dtype="<u4", count=len(found)))
        size = len((text or "").encode())
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.bytes += size

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        words = list(self.vocabulary)
        home = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), dtype="<i4", count=len(words))
        order = np.argsort(home, kind="stable")
        place = np.empty(len(words), dtype="<u4")
        place[order] = np.arange(len(words), dtype="<u4")
        edges = np.searchsorted(home[order], np.arange(buckets + 1))
        for bucket in np.unique(home):
            own = [words[i] for i in order[edges[bucket]:edges[bucket + 1]]]
            yield bucket, block, int(bucket), "pieces", _deflate(b"\n".join(own))
        # Documents hold their pieces in ascending place, as steps, which compress well.
        steps, times, lengths = [], [], []
        for own, often in zip(self.places, self.times):
            at = place[own]
            turn = np.argsort(at)
            steps.append(np.diff(at[turn].astype("<i8"), prepend=0).astype("<u4"))
            times.append(often[turn])
            lengths.append(len(at))
        null = np.array([i is None for i in self.ids], dtype="u1")
        ids = np.array([0 if i is None else i for i in self.ids], dtype="<i8")
        data = _pack(ids, null, np.array(self.sizes, dtype="<i8"), np.array(lengths, dtype="<i8"),
                         np.concatenate(steps), np.concatenate(times))
        yield -1 - block, block, -1, DOCS, data


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], dtype="<i8").tobytes()
    return _deflate(sizes + b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, out, at = _inflate(data), [], 8 * len(kinds)
    for size, kind in zip(np.frombuffer(raw, dtype="<i8", count=len(kinds)), kinds):
        out.append(np.frombuffer(raw, dtype=kind, offset=at, count=int(size) // np.dtype(kind).itemsize))
        at += int(size)
    return out


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit; ``tokenizer`` is the vocabulary's path.

    A pre-token is a run between ASCII white space, which the library never crosses. Each
    block of documents sends its distinct pre-tokens, by hash, to the task that counts
    the pieces of each distinct pre-token once and returns the counts; they meet the
    block's per-document frequencies, and each document's count is a sum of products. No
    ids are kept. A frequent pre-token comes once from each block, however many documents
    hold it, so no bucket is hot; a block is bounded by its bytes and documents.

    Null texts count as empty: 0 bytes, 0 tokens. A null doc_id stays null; repeated rows
    stay. Other columns are ignored; an empty table gives no rows.
    """
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, block = TaskContext.get().partitionId(), 0, _Block()

        def closed() -> pa.RecordBatch:
            rows = list(block.rows((task << 32) + made, buckets))
            return pa.RecordBatch.from_arrays(
                [pa.array(column, type=kind) for column, kind in zip(
                    zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()))],
                names=["route", "block", "bucket", "kind", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                block.add(doc_id.as_py(), text.as_py())
                if block.bytes >= BLOCK_BYTES or len(block.ids) >= BLOCK_DOCS:
                    yield closed()
                    made, block = made + 1, _Block()
        if block.ids:
            yield closed()

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["kind"].iloc[0] == DOCS:
            return rows
        lists = [_inflate(data).split(b"\n") for data in rows["data"]]
        known = {piece: len(ids) // 2 for piece, ids in encoder(tokenizer).ids(set().union(*lists)).items()}
        rows = rows.assign(kind="counts", route=-1 - rows["block"])
        rows["data"] = [_deflate(np.array([known[p] for p in own], dtype="<u4").tobytes()) for own in lists]
        return rows

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        replies = rows[rows["kind"] != DOCS].sort_values("bucket")["data"]
        counts = np.concatenate([np.zeros(0, dtype="<u4"), *[np.frombuffer(_inflate(d), dtype="<u4") for d in replies]])
        parts = []
        for data in rows.loc[rows["kind"] == DOCS, "data"]:
            ids, null, sizes, lengths, steps, times = _unpack(data, "<i8", "u1", "<i8", "<i8", "<u4", "<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            run = np.cumsum(steps.astype("<i8"))
            # Steps are sums from each document's first piece on.
            base = np.concatenate([[0], run])[starts]
            products = counts[run - np.repeat(base, lengths)].astype("<i8") * times
            sums = np.concatenate([[0], np.cumsum(products)])
            tokens = sums[ends] - sums[starts]
            parts.append(pd.DataFrame({"doc_id": pd.array(np.where(null, 0, ids), dtype="Int64"), "n_bytes": sizes,
                                       "n_tokens": tokens}))
            parts[-1].loc[null.astype(bool), "doc_id"] = pd.NA
        return pd.concat(parts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.mapInArrow(cut, ROW).groupBy("route").applyInPandas(count, ROW)
    done = sent.groupBy("block").applyInPandas(total, "doc_id long, n_bytes long, n_tokens long")
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
