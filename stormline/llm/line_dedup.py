"""Near-duplicate lines by an exact set-similarity join."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stormline.llm.common import ascii_lower, packed, row_key, whole_text
from stormline.session import pinned

BROADCAST_ROWS = 1_000_000
SLOTS = 22  # bits; words are counted in so many slots, by hash
HASH = 26  # bits of a word's mark beside its level
HOT = 22  # words of this level and above, of 2,048 lines and more, have every line compared with the first ones before all others
# Room for the distinct words of a file, so that each is written once.
DICTIONARY = {"parquet.dictionary.page.size": str(8 << 20)}


def _words(line: Column) -> Column:
    """Sorted hashes of the distinct words, lower-cased as ``ascii_lower`` does."""
    for space in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(space), F.lit(" "))

    def number(word: Column) -> Column:
        # On ASCII alone the general function gives the same and is far faster.
        plain = F.octet_length(word) == F.char_length(word)
        return F.xxhash64(F.when(plain, F.lower(word)).otherwise(ascii_lower(word)))

    found = F.array_distinct(F.transform(F.split(line, " "), number))
    return F.sort_array(F.array_remove(found, F.xxhash64(F.lit(""))))


def _held(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, n_lines, line_no from 0, tokens, n, node: every line by its words, so that texts are read once."""
    parts = F.split(whole_text(text_col), "\n")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.size(parts).alias("n_lines"),
                       parts.alias("parts"))
    rows = rows.select("doc_id", "key", "n_lines", F.posexplode("parts").alias("line_no", "line"))
    rows = rows.select("doc_id", "key", "n_lines", "line_no", _words(F.col("line")).alias("tokens"))
    return pinned(rows.select("*", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("node")), **DICTIONARY)


def _placed(held: DataFrame) -> DataFrame:
    """``held`` with ``at``, one number a line in order of doc_id, key and line_no."""
    ids = held.where("line_no = 0").select("doc_id", "key").distinct().repartitionByRange("doc_id", "key")
    ids = pinned(ids.sortWithinPartitions("doc_id", "key").select(
        "key", F.spark_partition_id().cast("long").alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")))
    n, most = ids.agg(F.count(F.lit(1)), F.max("row")).first()
    ids = ids.select("key", F.shiftleft("part", (most or 0).bit_length()).bitwiseOR(F.col("row")).alias("no"))
    at = F.shiftleft("no", 31).bitwiseOR(F.col("line_no").cast("long"))
    return held.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, "key").select("key", "line_no", at.alias("at"), "n", "node", "tokens")


def _slot(token: Column) -> Column:
    return token.bitwiseAND((1 << SLOTS) - 1).cast("int")


def _levels(held: DataFrame) -> np.ndarray:
    """Twice the logarithm of each slot's count of lines; 0 where one line alone has a word of it.

    A slot counts its words together, so a word's own count is never larger.
    """
    counts = held.select(F.explode("tokens").alias("token")).groupBy(_slot(F.col("token")).alias("slot")).count()
    found = counts.where("count > 1").toArrow()
    levels = np.zeros(1 << SLOTS, dtype=np.int8)
    levels[found["slot"].to_numpy()] = np.floor(2 * np.log2(found["count"].to_numpy()))
    return levels


def _level(mark: Column) -> Column:
    return F.shiftright(mark, HASH) + 32


def _nodes(lines: DataFrame, levels: np.ndarray, num: int, den: int, min_words: int) -> DataFrame:
    """Lines of equal sets as one: node, n, at (the first), times, parity, place, marks.

    ``marks`` are the words of the prefix that other lines may have too, rare ones first, the first at
    ``place``; ``parity`` has a bit for each of 64 classes of words that is set if their number is odd.
    """
    spark = lines.sparkSession
    name = f"levels_{uuid.uuid4().hex}"
    table = spark.createDataFrame(pa.table({"levels": pa.array([levels], pa.list_(pa.int8()))}))
    spark.sql(f"DECLARE VARIABLE {name} ARRAY<TINYINT>")
    try:
        # A variable and no subquery, which the lambda can't hold, and no list of values, which every plan would print.
        spark.sql(f"SET VAR {name} = (SELECT levels FROM {{table}})", table=table)

        def mark(token: Column) -> Column:
            level = F.get(F.col(f"session.{name}"), _slot(token)).cast("int") - 32
            found = F.shiftleft(level, HASH).bitwiseOR(F.shiftrightunsigned(token, 64 - HASH).cast("int"))
            return F.coalesce(found, F.lit(0))  # never null, so that whole numbers are sorted and not objects

        n = F.col("n")
        sets = lines.where(n >= min_words).select(
            "at", "n", "node",
            F.expr("aggregate(tokens, 0L, (found, token) -> found ^ shiftleft(1L, cast(token & 63 as int)))").alias("parity"),
            F.slice(F.sort_array(F.transform("tokens", mark)), 1, n - F.ceil(n * num / den).cast("int") + 1).alias("prefix"))
        sets = sets.select("at", "n", "node", "parity", F.size("prefix").alias("length"),
                           F.filter("prefix", lambda found: found >= (1 - 32) << HASH).alias("marks"))
        nodes = sets.groupBy("node", "n", "parity", "length", "marks").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("times"))
        return pinned(nodes.select("node", "n", "at", "times", "parity", (F.col("length") - F.size("marks")).alias("place"), "marks"))
    finally:
        spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")


def duplicate_lines(docs: DataFrame, num: int = 80, den: int = 100, min_words: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, key, n_lines, removed (sorted numbers of lines to remove, from 0).

    A line goes if a line before it, in order of doc_id and line number, has a Jaccard
    similarity of at least num/den; lines are compared as sets of words, and lines of fewer
    than ``min_words`` words stay.

    Lines with equal sets are one node with its first place. Words are ordered from rare to
    frequent (by the logarithm of their count in all lines, then a hash). Nodes meet on the
    words of their prefixes and are candidates if they pass the length, positional and parity
    filters. On a frequent word a node first meets the earliest node of the word and size
    band: of a family of many variants nearly all are settled so, by as many pairs as there
    are rows; nodes not yet settled then meet every earlier node. Of a node's candidates the
    most alike is verified on whole sets first, the others if it fails. Equal lines never meet
    in one task.

    Null texts have one empty line. Null identifiers come first. Repeated rows are one
    document: they lose the same lines. Other columns are ignored; an empty table gives
    no rows.
    """
    held = _held(docs, id_col, text_col)
    lines = _placed(held)
    nodes = _nodes(lines, _levels(held), num, den, min_words)
    marks = nodes.select("at", "n", "parity", "place", F.posexplode("marks").alias("nth", "mark")).select(
        "mark", "at", "n", "parity", (F.col("place") + F.col("nth")).alias("place"))

    def alike(x: str, y: str) -> tuple[Column, Column]:
        """Whether node x, met by y on a mark, may be linked to it, and in how many classes of words they differ."""
        a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
        # A linked pair passes on its first shared word: all that it shares stands there or later.
        need = F.ceil(num * (a("n") + b("n")) / (num + den) - 1e-6)
        apart = F.bit_count(a("parity").bitwiseXOR(b("parity")))
        return ((b("at") < a("at")) & (den * F.least(a("n"), b("n")) >= num * F.greatest(a("n"), b("n")))
                & (F.least(a("n") - a("place"), b("n") - b("place")) >= need)
                & (apart <= a("n") + b("n") - 2 * need)), apart

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        linked, apart = alike("x", "y")
        both = x.alias("x").join(y.alias("y"), (F.col("x.mark") == F.col("y.mark")) & linked)
        return both.select(F.col("x.at").alias("b"), F.col("y.at").alias("a"), apart.alias("apart"))

    rare = marks.where(_level(F.col("mark")) < HOT)
    hot = marks.where(_level(F.col("mark")) >= HOT)
    step = 0.2231  # a size band spans a factor of 0.8
    hot = hot.repartition("mark")
    for name, shift in (("one", 0.0), ("two", 0.5)):
        band = Window.partitionBy("mark", F.floor(F.ln("n") / step + shift))
        hot = hot.withColumn(name, F.min(F.struct("at", "n", "parity", "place")).over(band))
    hot = hot.select(F.struct("at", "n", "parity", "place").alias("own"), "mark", "one", "two")
    for name in ("one", "two"):
        linked, apart = alike("own", name)
        hot = hot.withColumn(name, F.when(linked, F.struct(F.col(f"{name}.at").alias("a"), apart.alias("apart"))))
    hot = pinned(hot.select("mark", "own.*", "one", "two"))
    stars = hot.select(F.col("at").alias("b"), F.explode(F.array("one", "two")).alias("star")).where("star is not null")
    pairs = pinned(met(rare, rare).union(stars.select("b", "star.*")).distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pinned(pairs.select(F.explode(F.array("a", "b")).alias("at")).distinct())
        n = ends.count()
        found = lines.select("at", "tokens").join(F.broadcast(ends) if n <= BROADCAST_ROWS else ends, "at", "left_semi")
        sets = pinned(found, **DICTIONARY)
        # Repeated rows give the same line again.
        sets = sets if sets.count() == n else pinned(sets.dropDuplicates(["at"]), **DICTIONARY)
        both = pairs.join(sets.select(F.col("at").alias("a"), F.col("tokens").alias("a_tokens")), "a").join(
            sets.select(F.col("at").alias("b"), F.col("tokens").alias("b_tokens")), "b")
        shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
        return both.where(den * shared >= num * (F.size("a_tokens") + F.size("b_tokens") - shared)).select("b").distinct()

    first = pinned(pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("least")).select("b", "least.a"))
    settled = pinned(verified(first))
    rest = met(hot.join(settled.withColumnRenamed("b", "at"), "at", "left_anti"), hot).union(
        pairs.join(settled, "b", "left_anti"))
    rest = pinned(rest.select("b", "a").distinct().join(first, ["b", "a"], "left_anti"))
    gone = settled.union(verified(rest)).select(F.col("b").alias("first"), F.lit(True).alias("gone"))

    # A line goes with its node, or if it isn't the node's first.
    firsts = nodes.select("node", "n", F.col("at").alias("first"), "times").join(gone, "first", "left").where(
        "gone or times > 1")
    removed = lines.drop("tokens").join(firsts, ["node", "n"]).where(
        F.col("gone").isNotNull() | (F.col("at") > F.col("first")))
    removed = removed.groupBy("key").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    return held.where("line_no = 0").select("doc_id", "key", "n_lines").join(removed, "key", "left").select(
        "doc_id", "key", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def remove_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that ``duplicate_lines`` found; other columns as they were, whatever their names.

    A null text stays null. Repeated rows lose the same lines. An empty table stays empty.
    """
    marks = found.where(F.size("removed") > 0).select("key", "removed").dropDuplicates(["key"])
    rows = packed(docs, key=row_key(id_col, text_col)).join(marks, "key", "left")
    text = F.col("row").getField(text_col)
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("removed", i)), "\n")
    cut = F.when(F.col("removed").isNull(), text).otherwise(kept).alias(text_col)
    return rows.select(*[cut if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
