"""N-gram Jaccard join: a grouped prefix join and its classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from stormline.llm.common import row_key, without
from stormline.llm.components import components
from stormline.llm.shingles import forget, shingles
from stormline.session import pinned

SLOT_BITS = 24  # the table of how common shingles are has 2 ** 24 bytes, whatever the input
FLUSH = 2 << 20
BROADCAST_ROWS = 1_000_000


def _routes(spark) -> int:
    """Bits of a shingle's hash that name its counting task."""
    return min(SLOT_BITS, max(0, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def commonness(docs: DataFrame, k: int, text_col: str) -> bytes:
    """For each slot of hashes the binary logarithm of the highest document count of a shingle in it.

    Counts are exact and over all documents: each stretch of a partition counts its
    shingles once (the upper half of the hash), and the task that owns a range of hashes
    adds them up. Only the table, of fixed size, comes to the driver.
    """
    bits = _routes(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits))
            edges = np.append(edges, len(values))
            full = np.flatnonzero(np.diff(edges))
            pack = [(values[edges[r]:edges[r + 1]].astype("<u4").tobytes(), times[edges[r]:edges[r + 1]].astype("<u4").tobytes())
                    for r in full]
            return pa.RecordBatch.from_arrays(
                [pa.array(full, type=pa.int32()), pa.array([p[0] for p in pack], type=pa.binary()),
                 pa.array([p[1] for p in pack], type=pa.binary())], names=["route", "marks", "times"])

        for batch in batches:
            for text in batch.column(0):
                own = shingles(text.as_py(), k) >> np.uint64(32)
                held.append(own)
                size += len(own)
                if size >= FLUSH:
                    yield sent()
                    held, size = [], 0
        if size:
            yield sent()
        forget()

    def add(rows):
        marks = np.concatenate([np.frombuffer(m, dtype="<u4") for m in rows["marks"]])
        times = np.concatenate([np.frombuffer(t, dtype="<u4") for t in rows["times"]])
        order = np.argsort(marks, kind="stable")
        marks, first = np.unique(marks[order], return_index=True)
        total = np.add.reduceat(times[order].astype("<i8"), first)
        table = np.zeros(1 << (SLOT_BITS - bits), dtype="u1")
        slots = (marks >> np.uint32(32 - SLOT_BITS)) & np.uint32((1 << (SLOT_BITS - bits)) - 1)
        np.maximum.at(table, slots, np.floor(np.log2(total)).astype("u1"))
        return rows.iloc[:1][["route"]].assign(table=[table.tobytes()])

    # As Arrow: the pickled rows of a plain collect would hold the table several times in the driver.
    parts = (docs.select(F.col(text_col).cast("string").alias("text"))
             .mapInArrow(count, "route int, marks binary, times binary").groupBy("route")
             .applyInPandas(add, "route int, table binary").toArrow())
    table = np.zeros(1 << SLOT_BITS, dtype="u1")
    width = 1 << (SLOT_BITS - bits)
    for route, part in zip(parts.column("route"), parts.column("table")):
        first = route.as_py() * width
        table[first:first + width] = np.frombuffer(part.as_buffer(), dtype="u1")
    del parts
    return table.tobytes()


def _summaries(rows: DataFrame, k: int, num: int, den: int, table) -> DataFrame:
    """key, n, node (hash of the set), rare (shingles of one or few documents) and prefix of each text."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(table.value, dtype="u1")
        for batch in batches:
            keys, sizes, nodes, rares, prefixes = [], [], [], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                own = shingles(text.as_py(), k)
                n = len(own)
                level = common[own >> np.uint64(64 - SLOT_BITS)]
                first = own[np.argsort(level, kind="stable")[:n - -(-num * n // den) + 1 if n else 0]]
                keys.append(key.as_py())
                sizes.append(n)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63))
                rares.append(int((level < 3).sum()))
                prefixes.append(first.view("<i8"))
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0] + [len(p) for p in prefixes]), type=pa.int32()),
                pa.array(np.concatenate(prefixes), type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.array(nodes, type=pa.int64()),
                 pa.array(rares, type=pa.int64()), lists], names=["key", "n", "node", "rare", "prefix"])
        forget()

    return rows.select("key", "text").mapInArrow(sum_up, "key long, n long, node long, rare long, prefix array<bigint>")


def _sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The shingles of the wanted nodes (node, key of one of its texts)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                own = [shingles(t.as_py(), k).view("<i8") for t in part.column(1)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0] + [len(p) for p in own]), type=pa.int32()),
                    pa.array(np.concatenate(own), type=pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["node", "marks"])
        forget()

    few = wanted.count() <= BROADCAST_ROWS
    found = rows.select("key", "text").join(F.broadcast(wanted) if few else wanted, "key")
    sets = pinned(found.select("node", "text").mapInArrow(cut, "node long, marks array<bigint>"))
    # Repeated rows give the same set again; without them, the sets need not move here.
    return sets if sets.count() == wanted.count() else pinned(sets.dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("marks").alias("a_marks"))
    right = sets.select(F.col("node").alias("b"), F.col("marks").alias("b_marks"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("a_marks", "b_marks"))
    return both.where(den * shared >= num * (F.size("a_marks") + F.size("b_marks") - shared)).select("a", "b")


def ngram_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_copies, key.

    A document's set holds its distinct k-word shingles (A-Z lower-cased, words between
    ASCII white space), or all its words as one if they are fewer. Two link when their
    Jaccard similarity is at least num/den; component_id is the smallest doc_id that can
    be reached. n_copies counts the documents with the same set, itself included.

    1. Texts with equal sets are one node.
    2. Shingles are ordered by how common they are (counted over all documents, kept as
       logarithms in a table of fixed size), then by hash. Linked sets share a shingle of
       their prefixes. Nodes with the same prefix and size are one group.
    3. Groups meet on prefix shingles. First each group is paired with one leader of the
       shingle and size band, the one with fewest rare shingles, which is the source of a
       family of edited copies; members are expanded, verified, and linked into classes.
       This takes as many pairs as there are rows.
    4. Every other pair of groups that shares a prefix shingle, passes the length and
       positional filters and may join different classes is expanded and verified. The
       members of the class that is most frequent on a shingle are not paired among
       themselves, as that could join nothing. So no link between classes is lost, and a
       large family doesn't give all its pairs.

    Null and empty texts have no set and are alone; the class of rows with null doc_id
    only is null. Repeated rows are copies of each other. Other columns are ignored; an
    empty table gives no rows. Sets and shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       row_key(id_col, text_col).alias("key"))
    table = spark.sparkContext.broadcast(commonness(docs, k, text_col))
    base = pinned(_summaries(rows, k, num, den, table).select(
        "key", "n", "node", "rare", F.xxhash64("n", "prefix").alias("gid"), "prefix"))
    table.destroy()
    nodes = pinned(base.where("n > 0").groupBy("node").agg(
        F.first("gid").alias("gid"), F.first("n").alias("n"), F.min("rare").alias("rare"), F.min("key").alias("key")))
    groups = base.where("n > 0").groupBy("gid").agg(
        F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min(F.struct("rare", "node")).alias("lead"))

    # Prefix shingles that more than one group has.
    tokens = groups.select("gid", "n", F.col("lead.rare").alias("rare"), F.col("lead.node").alias("lead"),
                           F.posexplode("prefix").alias("place", "token"))
    tokens = tokens.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("met > 1").drop("met")
    step = -float(np.log(num / den)) or 1.0
    for name, shift in (("one", 0.0), ("two", 0.5)):
        band = Window.partitionBy("token", F.floor(F.ln("n") / step + shift))
        tokens = tokens.withColumn(name, F.min(F.struct("rare", "lead")).over(band)["lead"])
    tokens = pinned(tokens)

    own = base.where("n > 0").groupBy("gid").agg(F.min(F.struct("rare", "node"))["node"].alias("b"))
    stars = tokens.select("gid", F.explode(F.array("one", "two")).alias("b")).distinct().unionByName(own)
    stars = nodes.select(F.col("node").alias("a"), "gid", "n").join(stars, "gid").where("a <> b")
    stars = stars.select("a", "b", F.col("n").alias("a_n")).join(
        nodes.select(F.col("node").alias("b"), F.col("n").alias("b_n")), "b")
    fits = (den * F.least("a_n", "b_n") >= num * F.greatest("a_n", "b_n"))
    pairs = pinned(stars.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(rows, pinned(nodes.join(ends, "node", "left_semi").select("node", "key")), k)
    links = pinned(_verified(pairs, sets, num, den))
    classes = pinned(nodes.join(components(links), "node", "left").select(
        "node", "gid", "n", "key", F.coalesce("root", "node").alias("root")))

    # The rest: pairs of groups that could join different classes.
    held = classes.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    marked = tokens.select("token", "gid", "n", "place").join(held, "gid")
    by_token = Window.partitionBy("token")
    marked = marked.withColumn("mixed", F.min("low").over(by_token) != F.max("high").over(by_token)).where("mixed")
    marked = marked.withColumn("size", F.when(F.col("low") == F.col("high"), F.count(F.lit(1)).over(
        Window.partitionBy("token", "low", "high"))).otherwise(0))
    marked = pinned(marked.withColumn("main", F.max(F.struct("size", "low")).over(by_token)).select(
        "token", "gid", "n", "place", "low", "high",
        ((F.col("low") == F.col("high")) & (F.col("low") == F.col("main.low")) & (F.col("size") > 0)).alias("usual")))
    x, y = marked.where("not usual").alias("x"), marked.alias("y")
    # A linked pair passes on its first shared shingle: all that it shares stands there or later.
    need = (num * (F.col("x.n") + F.col("y.n"))) / (num + den)
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.gid") != F.col("y.gid"))
                 & ((F.col("x.low") != F.col("y.low")) | (F.col("x.low") != F.col("x.high")) | (F.col("y.low") != F.col("y.high")))
                 & (F.col("y.usual") | (F.col("x.gid") < F.col("y.gid")))
                 & (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n"))
                 & (F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= need - 1e-6))
    met = met.select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")).distinct().union(
        held.where("low <> high").select("gid", "gid"))
    a = classes.select(F.col("gid").alias("ga"), F.col("node").alias("a"), F.col("root").alias("a_root"))
    b = classes.select(F.col("gid").alias("gb"), F.col("node").alias("b"), F.col("root").alias("b_root"))
    rest = met.join(a, "ga").join(b, "gb").where("a_root <> b_root")
    rest = pinned(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(
        pairs, ["a", "b"], "left_anti"))
    ends = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    more = _sets(rows, pinned(classes.join(ends, "node", "left_semi").select("node", "key")), k)
    links = links.union(_verified(rest, more, num, den))

    labelled = nodes.select("node").join(components(links), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
    ids = rows.select("doc_id", "key").join(base.select("key", "n", "node").dropDuplicates(["key"]), "key")
    ids = pinned(ids.select("doc_id", "key", "n", "node"))
    by_node = ids.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    by_node = by_node.join(labelled, "node")
    by_root = by_node.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = by_node.join(by_root, "root").select("node", "component_id", "n_copies")
    alone = ids.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                      F.lit(1).cast("long").alias("n_copies"), "key")
    return ids.where("n > 0").join(by_node, "node").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_copies", "key").unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each class, that with the smallest doc_id; columns as they were."""
    found = ngram_join(docs, k, num, den)
    return without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))
