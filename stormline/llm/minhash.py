"""Near-duplicate classes by HyperMinHash sketches, banding, corrected estimates and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from stormline.llm.common import row_key, without
from stormline.llm.components import components
from stormline.llm.shingles import forget, mixed, shingles
from stormline.session import pinned

BANDS, ROWS = 40, 6  # a link at similarity 0.85 is in no common band with odds of 6e-9, one at 0.8 with 5e-6
MANTISSA = 10  # bits that a register keeps after the leading one
CLASH = 0.169919487159739  # fixed value: share of registers per 2 ** -MANTISSA that agree by chance (HyperMinHash)
SURE = 5.0  # standard errors that an estimate may miss the threshold by before a pair is dropped
BROADCAST_ROWS = 1_000_000
NODE = "decimal(38,0)"


class Sketches:
    """Registers of sets of 64-bit hashes.

    The hash range is cut into equal buckets; a register keeps the smallest hash of its
    bucket as the count of leading zeros (6 bits) and the bits after the leading one. A bucket
    without a hash borrows from the non-empty bucket that a fixed random order of its own
    names first, the same in all documents, so that registers of small sets still agree with
    the similarity of the sets as probability.
    """

    def __init__(self, size: int):
        self.size = size
        self.order = mixed(np.arange(1, size * size + 1, dtype=np.uint64)).reshape(size, size) >> np.uint64(32)

    def registers(self, own: np.ndarray) -> tuple[np.ndarray, int]:
        """Registers of sorted distinct hashes, and how many buckets held one."""
        wide = (own >> np.uint64(32)) * np.uint64(self.size)
        filled, first = np.unique((wide >> np.uint64(32)).astype(np.int64), return_index=True)
        least = (wide[first] & np.uint64(0xFFFFFFFF)).astype(np.float64)
        part, bits = np.frexp(least)  # part in [0.5, 1), or 0
        after = np.where(least > 0, np.floor((2 * part - 1) * (1 << MANTISSA)), 0)
        code = ((32 - bits) * (1 << MANTISSA) + after).astype("<u2")
        out = np.zeros(self.size, dtype="<u2")
        if len(filled):
            out[filled] = code
            empty = np.setdiff1d(np.arange(self.size), filled, assume_unique=True)
            if len(empty):
                out[empty] = code[np.argmin(self.order[np.ix_(empty, filled)], axis=1)]
        return out, len(filled)


def node_of(own: np.ndarray) -> bytes:
    """126 bits of the hash of a set, as a little-endian whole number of 16 bytes."""
    value = xxhash.xxh3_128_intdigest(own.tobytes()) >> 2
    return value.to_bytes(16, "little")


def _nodes(values: list[bytes]) -> pa.Array:
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(values), [None, pa.py_buffer(b"".join(values))])


def sketched(docs: DataFrame, k: int, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key, n (size of the set), node (its hash), filled and sketch (registers) of every row."""
    size = bands * rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketches(size)
        for batch in batches:
            sizes, nodes, fills, packed = [], [], [], []
            for text in batch.column(2):
                own = shingles(text.as_py(), k)
                out, filled = maker.registers(own)
                sizes.append(len(own))
                nodes.append(node_of(own))
                fills.append(filled)
                packed.append(out.tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, type=pa.int64()), _nodes(nodes),
                 pa.array(fills, type=pa.int32()), pa.array(packed, type=pa.binary())],
                names=["doc_id", "key", "n", "node", "filled", "sketch"])
        forget()

    source = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"),
                         F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(sketch, f"doc_id {kind}, key long, n long, node {NODE}, filled int, sketch binary")


def estimate(a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, less the agreement that compressed registers reach by chance."""
    ratio = a_n / b_n
    chance = CLASH * (4 * ratio / (1 + ratio) ** 2) / (1 << MANTISSA)
    return ((a == b).mean(1) - chance) / (1 - chance)


def _likely(pairs: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose estimate doesn't rule out a similarity of ``share``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1)
                    for c in (2, 3)]
            a_n, b_n, filled = [batch.column(c).to_numpy().astype(np.float64) for c in (4, 5, 6)]
            floor = share - SURE * np.sqrt(share * (1 - share) / filled)
            good = pa.array(estimate(a, b, a_n, b_n) >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    both = pairs
    for side in "ab":
        both = both.join(nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"{side}_sketch"),
                                      F.col("n").alias(f"{side}_n"), F.col("filled").alias(f"{side}_filled")), side)
    both = both.select("a", "b", "a_sketch", "b_sketch", "a_n", "b_n", F.least("a_filled", "b_filled").alias("filled"))
    return both.mapInArrow(check, f"a {NODE}, b {NODE}")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """node, marks (whole set) of the wanted nodes (node, key of one of its rows)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                own = [shingles(t.as_py(), k) for t in part.column(1)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0] + [len(p) for p in own]), type=pa.int32()),
                    pa.array(np.concatenate(own).view("<i8"), type=pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), _nodes([node_of(p) for p in own]), lists],
                                                 names=["node", "found", "marks"])
        forget()

    few = wanted.count() <= broadcast_rows
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(wanted) if few else wanted, "key").select("node", "text")
    sets = rows.mapInArrow(cut, f"node {NODE}, found {NODE}, marks array<bigint>")
    # Rows of another text with the same key have another set; repeated rows give the same set again.
    sets = pinned(sets.where("node = found").drop("found"))
    return sets if sets.count() == wanted.count() else pinned(sets.dropDuplicates(["node"]))


def _verified(likely: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    both = likely
    for side in "ab":
        both = both.join(sets.select(F.col("node").alias(side), F.col("marks").alias(f"{side}_marks")), side)
    shared = F.size(F.array_intersect("a_marks", "b_marks"))
    return pinned(both.where(den * shared >= num * (F.size("a_marks") + F.size("b_marks") - shared)).select("a", "b"))


def _shared_at_most(sets: DataFrame, num: int, den: int) -> DataFrame:
    """node and top, the shingles it has in common with any other node of ``sets``, of nodes that may still link.

    What a node alone has is in no intersection and in every union, so too much of it rules
    out every link. Nodes that leave take shingles with them that were shared with them only,
    so this goes twice.
    """
    left = sets.select("node", F.size("marks").alias("n"), "marks")
    for _ in range(2):
        alone = left.select("node", F.explode("marks").alias("mark")).groupBy("mark").agg(
            F.count(F.lit(1)).alias("nodes"), F.min("node").alias("node")).where("nodes = 1")
        alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
        left = left.drop("top").join(alone, "node", "left").withColumn("top", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
        left = pinned(left.where(den * F.col("top") >= num * F.col("n")))
    return left.select("node", "top")


def _hubs(active: DataFrame) -> DataFrame:
    """The hub of each band, the node that meets most others over all its bands, and that of another class."""
    best = active.groupBy("band", "root").agg(F.max(F.struct("reach", "node"))["node"].alias("node"),
                                              F.max("reach").alias("reach"))
    order = Window.partitionBy("band").orderBy(F.desc("reach"), F.desc("root"))
    best = best.withColumn("place", F.row_number().over(order)).where("place <= 2")
    return best.groupBy("band").agg(*[F.max(F.when(F.col("place") == i, F.struct("root", "node"))).alias(f"hub{i}") for i in (1, 2)])


def _stars(active: DataFrame, hubs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of each node with the hubs of its bands that are of another class than its own, as many as rows."""
    hub = F.when(F.col("root") != F.col("hub1.root"), F.col("hub1.node")).otherwise(F.col("hub2.node"))
    pairs = active.join(hubs, "band").select("node", "n", hub.alias("hub")).where("hub is not null").distinct()
    sizes = active.select(F.col("node").alias("hub"), F.col("n").alias("hub_n")).distinct()
    fits = den * F.least("n", "hub_n") >= num * F.greatest("n", "hub_n")
    return pairs.join(sizes, "hub").where(fits).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _around_hubs(active: DataFrame, hubs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, hub (the one it meets most often) and inside, the shingles it has in common with it."""
    own = active.select("band", "node").join(hubs.select("band", F.col("hub1.node").alias("hub")), "band")
    own = own.groupBy("node", "hub").count().groupBy("node").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    both = own.join(sets, "node").join(sets.toDF("hub", "hub_marks"), "hub")
    return both.select("node", "hub", F.size(F.array_intersect("marks", "hub_marks")).alias("inside"))


def _with_roots(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.drop("root").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(met: DataFrame) -> DataFrame:
    """Rows of the bands in which more than one class still meets."""
    classes = met.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return met.join(classes.select("band"), "band")


def minhash_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS,
                  id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, key.

    A document's set holds its distinct k-word shingles (A-Z lower-cased, words between ASCII
    white space), or all its words as one if they are fewer. Two link when their Jaccard
    similarity is at least num/den; component_id is the smallest doc_id that can be reached,
    kept tells whether it is the document's own.

    1. Texts with equal sets (126 bits of a hash) are one node with one HyperMinHash sketch.
    2. The registers are cut into bands; nodes meet where a whole band is equal. In each
       meeting the node that meets most nodes over all its bands is the hub: in a family of
       edited copies that is the text they come from. Nodes are paired with their hubs.
    3. A pair is dropped when its collision-corrected estimate lies ``SURE`` standard errors
       below the threshold, where the error follows the number of filled buckets; small sets
       are hardly ever dropped. The rest is verified on whole sets, and links give classes.
    4. Where several classes still meet, nodes are counted out that have too many shingles of
       their own to link with any other there; then hubs once more, among those left.
    5. Every other pair that shares a band, could join two classes and isn't ruled out by what
       both share with their hub is estimated and verified too. The most frequent class of a
       meeting isn't paired within itself.

    No two equal bands are ever capped or skipped; a link is missed only if it shares no band
    or its estimate is off by ``SURE`` errors (below 1e-6 at the threshold for texts of some
    length, about 1e-4 for sets of under ten shingles).

    Null and empty texts have no set and are alone; the class of rows with null doc_id only is
    null, and kept is true. Repeated rows are copies of each other. Very long texts are read
    whole; their sketch has the size of any other. Other columns are ignored; an empty table
    gives no rows.
    """
    base = pinned(sketched(docs, k, id_col, text_col, bands, rows))
    own = base.where("n > 0")
    first = own.groupBy("node").agg(F.min("key").alias("key"))
    nodes = pinned(own.join(first, ["node", "key"], "left_semi").dropDuplicates(["node"]).select(
        "node", "key", "n", "filled", "sketch"))
    width = 2 * rows
    places = nodes.select("node", "n", F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda i: F.xxhash64(i, F.substring("sketch", i * width + 1, F.lit(width)))).alias("bands"))
    met = places.select("node", "n", F.explode("bands").alias("band"))
    crowd = met.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = pinned(met.join(crowd, "band"))
    reach = met.groupBy("node").agg(F.sum("size").alias("reach"))
    met = pinned(met.select("band", "node", "n").join(reach, "node").withColumn("root", F.col("node")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = pinned(nodes.select("node", "key").join(wanted.select("node").distinct(), "node", "left_semi"))
        return _sets(docs, wanted, k, id_col, text_col, broadcast_rows)

    tried = pinned(_stars(met, _hubs(met), num, den))
    likely = pinned(_likely(tried, nodes, num / den))
    links = _verified(likely, sets_of(likely.select(F.explode(F.array("a", "b")).alias("node"))), num, den)

    met = pinned(_open(_with_roots(met, links)))
    sets = sets_of(met)
    met = pinned(_open(met.join(_shared_at_most(sets, num, den), "node")))
    hubs = pinned(_hubs(met))
    again = pinned(_stars(met, hubs, num, den).join(tried, ["a", "b"], "left_anti"))
    links = links.union(_verified(pinned(_likely(again, nodes, num / den)), sets, num, den))

    met = _open(_with_roots(met.join(_around_hubs(met, hubs, sets), "node"), links))
    met = pinned(met.select("band", "node", "root", "n", "top", "hub", "inside", (F.col("top") - F.col("inside")).alias("outside")))
    usual = met.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("band").agg(
        F.max(F.struct("size", "root"))["root"].alias("usual"))
    marked = met.join(usual, "band").withColumn("main", F.col("root") == F.col("usual"))
    marked = marked.join(places.select("node", "bands"), "node").withColumn("before", F.array_position("bands", F.col("band")).cast("int") - 1)
    x, y = marked.where("not main").alias("x"), marked.alias("y")
    # What two nodes can share: inside their common hub, and outside of it what others have as well.
    most = F.when(F.col("x.hub") == F.col("y.hub"), F.least("x.inside", "y.inside") + F.least("x.outside", "y.outside"))
    most = F.least("x.top", "y.top", most)
    # A pair is made where it first meets.
    met_before = F.exists(F.zip_with(F.slice("x.bands", F.lit(1), F.col("x.before")), F.slice("y.bands", F.lit(1), F.col("x.before")),
                                     lambda a, b: a == b), lambda same: same)
    rest = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.root") != F.col("y.root"))
                  & (F.col("y.main") | (F.col("x.node") < F.col("y.node")))
                  & (den * most >= num * (F.col("x.n") + F.col("y.n") - most)) & ~met_before)
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    rest = pinned(rest.join(tried.union(again), ["a", "b"], "left_anti"))
    links = links.union(_verified(pinned(_likely(rest, nodes, num / den)), sets, num, den))

    groups = _with_roots(own.groupBy("node").agg(F.min("doc_id").alias("least")), links)
    groups = groups.join(groups.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    alone = base.where("n = 0").withColumn("component_id", F.col("doc_id"))
    found = own.join(groups, "node").select(*alone.columns).unionByName(alone)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "key")


def keep_least(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each class, that with the smallest doc_id; columns as they were."""
    return without(docs, minhash_dedup(docs, k, num, den).where("not kept"))
