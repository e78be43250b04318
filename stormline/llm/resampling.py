"""Importance resampling to a target distribution of hashed words and runs of words."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stormline.session import pinned

WORDS = 65_536  # entries of the automaton; a word beyond them is hashed where it stands, with the same result
LONGEST = 64  # bytes of a word that may enter the automaton, which bounds its memory
FLUSH = 200_000
# Every byte as the word rule sees it: letters A-Z in lower case, what parts words as a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def spaced(text: str | None) -> bytes:
    """The words of a text (runs of ASCII letters and digits and whatever lies beyond ASCII), a space before, between and after."""
    words = (text or "").encode("utf-8", "replace").translate(_BYTES).split()
    return b" " + b" ".join(words) + b" " if words else b""


class Splices:
    """CRC-32 of joined strings from the parts' CRCs and the second part's length.

    crc(a + b) is crc(b) xor the crc of a carried over len(b) zero bytes, which is linear in
    its bits. ``tables[j]`` carries over 2 ** j zero bytes, a byte of the crc at a time.
    """

    def __init__(self):
        basis = [zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0") for i in range(32)]
        self.tables: list[np.ndarray] = []
        self._next = basis

    def _table(self, j: int) -> np.ndarray:
        while len(self.tables) <= j:
            table = np.zeros((4, 256), dtype=np.uint32)
            for byte in range(4):
                for bit in range(8):
                    table[byte, np.arange(256) >> bit & 1 == 1] ^= np.uint32(self._next[8 * byte + bit])
            self.tables.append(table)
            self._next = [int(v) for v in self._carried(np.array(self._next, dtype=np.uint32), table)]
        return self.tables[j]

    @staticmethod
    def _carried(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = np.zeros(len(crc), dtype=np.uint32)
        for byte in range(4):
            out ^= table[byte][(crc >> np.uint32(8 * byte)) & np.uint32(255)]
        return out

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """crc(a + b) of crcs a, crcs b and the lengths of b in bytes."""
        carried = first.astype(np.uint32)
        for j in range(int(length.max(initial=0)).bit_length()):
            has = np.flatnonzero(length >> j & 1)
            carried[has] = self._carried(carried[has], self._table(j))
        return carried ^ second.astype(np.uint32)


class Lexicon:
    """An Aho-Corasick automaton of delimited words, each with its CRC, its bytes and its characters as payload."""

    def __init__(self, words: list[str]):
        raw = [w.encode() for w in words]
        self.crc = np.array([zlib.crc32(w) for w in raw], dtype=np.uint32)
        self.size = np.array([len(w) for w in raw], dtype=np.int64)
        self.chars = np.array([len(w) for w in words], dtype=np.int64)
        self.automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            self.automaton.add_word(f" {word} ", i)
        if words:
            self.automaton.make_automaton()
        self.splices = Splices()

    def payloads(self, line: bytes) -> tuple[np.ndarray, np.ndarray]:
        """CRCs and byte lengths of the words of a ``spaced`` text, in order."""
        text = line.decode("utf-8", "replace")
        found = np.zeros((0, 2), dtype=np.int64)
        if text and len(self.crc):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        ends, ids = found[:, 0], found[:, 1]
        crc, size = self.crc[ids], self.size[ids]
        # Between the delimiter that ends a match and the one that opens the next stand words that aren't in the automaton.
        opens, closes = np.append(ends - self.chars[ids] - 1, len(text) - 1), np.insert(ends, 0, 0)
        gaps = np.flatnonzero(opens > closes)
        if len(gaps):
            rest = [(g, w.encode()) for g in gaps for w in text[closes[g] + 1:opens[g]].split(" ")]
            at = [g for g, _ in rest]
            crc = np.insert(crc, at, np.array([zlib.crc32(w) for _, w in rest], dtype=np.uint32))
            size = np.insert(size, at, [len(w) for _, w in rest])
        return crc, size

    def features(self, crc: np.ndarray, size: np.ndarray, low: int, high: int) -> np.ndarray:
        """CRCs of all runs of ``low`` to ``high`` consecutive words joined by one space, from the payloads of neighbours."""
        out, runs, space = [], crc, np.uint32(zlib.crc32(b" "))
        for n in range(1, high + 1):
            if n > 1:
                runs = runs[:len(crc) - n + 1]
                gap = self.splices.joined(runs, np.full(len(runs), space), np.ones(len(runs), dtype=np.int64))
                runs = self.splices.joined(gap, crc[n - 1:], size[n - 1:])
            if n >= low:
                out.append(runs)
        return np.concatenate(out)


def lexicon_words(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> list[str]:
    """The most frequent words of all texts, ``words`` of them at most and none above ``LONGEST`` bytes.

    Words are cut off at a step of the logarithm of their count, found on a count per step, so
    that no task sends a list of its own to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            fit = {w: n for w, n in held.items() if len(w) <= LONGEST}
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in fit], type=pa.string()),
                                               pa.array(fit.values(), type=pa.int64())], names=["word", "times"])

        for batch in batches:
            for text in batch.column(0):
                held.update(spaced(text.as_py()).split())
                if len(held) >= FLUSH:
                    yield sent()
                    held.clear()
        yield sent()

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, times long")
    step = F.floor(64 * F.log2(F.sum("times"))).cast("int")
    found = pinned(found.groupBy("word").agg(step.alias("step")))
    taken, lowest = 0, None
    for row in found.groupBy("step").count().orderBy(F.desc("step")).collect():  # some thousand steps at most
        if taken + row["count"] > words:
            break
        taken, lowest = taken + row["count"], row["step"]
    if lowest is None:
        return []
    return sorted(r["word"] for r in found.where(F.col("step") >= lowest).select("word").collect())


def hashed_features(docs: DataFrame, words: list[str], buckets: int, low: int, high: int, id_col: str,
                    text_col: str) -> DataFrame:
    """id, n_words and the buckets (unsigned CRC-32 mod ``buckets``) of a text's features, four bytes each, low first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = None
        for batch in batches:
            lexicon = lexicon or Lexicon(words)
            counts, packed = [], []
            for text in batch.column(1):
                crc, size = lexicon.payloads(spaced(text.as_py()))
                counts.append(len(crc))
                packed.append((lexicon.features(crc, size, low, high) % np.uint32(buckets)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, type=pa.int64()), pa.array(packed, type=pa.binary())],
                names=["id", "n_words", "places"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, n_words long, places binary")


def bucket_counts(hashed: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs over all rows. Tasks add up before anything moves; one number a bucket returns."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for places in batch.column(0):
                total += np.bincount(np.frombuffer(places.as_py(), dtype="<u4"), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, type=pa.int32()), pa.array(total[full])], names=["bucket", "times"])

    counts = np.zeros(buckets, dtype=np.int64)
    found = hashed.select("places").mapInArrow(add, "bucket int, times long")
    for row in found.groupBy("bucket").agg(F.sum("times").alias("times")).collect():
        counts[row["bucket"]] = row["times"]
    return counts


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed share of a bucket in the target over its share in the corpus))."""
    buckets, all_have, all_want = len(have), float(have.sum()), float(want.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (all_have + buckets)) / ((s + 1.0) * (all_want + buckets))))
                     for s, t in zip(have.tolist(), want.tolist())], dtype=np.int64)


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, percent: int = 10,
             min_words: int = 20, seed: int = 2024, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    Features are all runs of ``low`` to ``high`` consecutive words, hashed into buckets. A
    bucket's gain compares its smoothed shares in the target and in all documents; a
    document's weight is the floored mean gain of its features (0 without any). The score
    adds Gumbel noise from a hash of the doc_id, so that the highest scores are a weighted
    draw without replacement: of the N documents with at least ``min_words`` words,
    floor(percent * N / 100) are drawn and ranked from 1, ties to the smaller doc_id.

    One automaton of the most frequent words scans every text; each match gives the word's
    CRC and length, and CRCs of runs are composed of neighbours' payloads. Words outside the
    automaton are hashed where they stand, so its size changes no result. Very long texts are
    scanned whole and hold four bytes a feature.

    Scores are whole numbers in a range that the constants fix (some 100,000 values), so the
    cut is found on a count per score, and documents are sorted only within equal scores.
    Null texts have no words. Null identifiers hash as empty text and go last among equal
    scores. Repeated rows have equal weights and scores and ranks of their own. Other columns
    are ignored. An empty target or corpus leaves all its shares equal; an empty table gives
    no rows.
    """
    entries = lexicon_words(docs, text_col, words)
    hashed = pinned(hashed_features(docs, entries, buckets, low, high, id_col, text_col))
    wanted = hashed_features(target.select(F.col(target_col).alias("id"), F.col(target_col).alias("text")),
                             entries, buckets, low, high, "id", "text")
    gain = gains(bucket_counts(hashed, buckets), bucket_counts(wanted, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights, scores = [], [], []
            for key, places in zip(batch.column(0), batch.column(2)):
                own = np.frombuffer(places.as_py(), dtype="<u4")
                weight = int(gain[own].sum()) // len(own) if len(own) else 0
                name = "" if key.as_py() is None else str(key.as_py())
                noise = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
                sizes.append(len(own))
                weights.append(weight)
                scores.append(weight + math.floor(-1000 * math.log(-math.log((noise + 0.5) / 4294967296))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(v, type=pa.int64()) for v in (sizes, weights, scores)]],
                names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind = hashed.schema["id"].dataType.simpleString()
    scored = pinned(hashed.mapInArrow(
        weigh, f"doc_id {kind}, n_words long, n_features long, weight long, score long"))
    fit = F.col("n_words") >= min_words
    # Few rows whatever the input: one per score.
    levels = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("score")).collect()
    draw, above, cut = percent * sum(r["rows"] for r in levels) // 100, 0, []
    for level in levels:
        if above >= draw:
            break
        cut.append((level["score"], above))
        above += level["rows"]
    lowest = cut[-1][0] if cut else None
    starts = F.broadcast(scored.sparkSession.createDataFrame(cut, "score long, above long"))
    taken = fit & (F.col("score") >= F.lit(lowest)) if cut else F.lit(False)
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features", "n_words")
    place = F.row_number().over(order) + F.col("above")
    ranked = scored.where(taken).join(starts, "score").select(
        *scored.columns, F.when(place <= draw, place.cast("long")).alias("rank"))
    return ranked.unionByName(scored.where(~taken).withColumn("rank", F.lit(None).cast("long")))
