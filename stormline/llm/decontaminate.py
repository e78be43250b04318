"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stormline.llm.common import ascii_lower, row_key, whole_text, without
from stormline.session import pinned

# Fixed value: the word rule; letters and digits of ASCII, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, GRAM = 10, 5  # shared words that must be found; words of a fingerprint
PLACE_BITS = 30  # a packed fingerprint holds its hash above and its place below
# Fixed value: the packed entry that stands for the document itself.
SELF = 2 ** 63 - 1
BROADCAST_ROWS = 500_000  # beyond this many benchmark fingerprints or windows, they are shuffled


def _packed(mark: Column, place: Column) -> Column:
    return F.shiftleft(mark, PLACE_BITS).bitwiseOR(place.cast("long"))


def _winnowed(gram: str, span: int, k: int) -> Column:
    """The smallest packed k-gram of every run of ``span`` words; every shared run of that length shares one."""
    return F.when(F.size(gram) >= span - k + 1, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(gram) - (span - k + 1)),
        lambda i: F.least(*[F.get(gram, i + j) for j in range(span - k + 1)])))).otherwise(F.array().cast("array<bigint>"))


def _grams(n: int) -> Column:
    """Packed hashes of all runs of n words."""
    return F.when(F.size("marks") >= n, F.transform(
        F.sequence(F.lit(0), F.size("marks") - n),
        lambda i: _packed(F.xxhash64(F.lit(n), *[F.get("marks", i + j) for j in range(n)]), i),
    )).otherwise(F.array().cast("array<bigint>"))


def _with_words(rows: DataFrame, text_col: str) -> DataFrame:
    words = F.regexp_extract_all(ascii_lower(whole_text(text_col)), F.lit(WORD), F.lit(0))
    return rows.withColumn("words", words).withColumn("marks", F.transform("words", lambda w: F.xxhash64(w)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, key.

    A window is ``span`` consecutive words of an item, or a whole shorter item. Both sides
    keep the smallest ``gram``-word hash of each run of ``span`` words (winnowing), so a
    shared window always shares a fingerprint. Documents are joined with the benchmark's
    fingerprints; a hit is extended to the windows around it, and those are compared with
    the benchmark's windows word by word. Items shorter than ``span`` have no such
    guarantee, so documents also give all runs of the (few) lengths that such items have.

    Nothing of a document moves before the fingerprints are joined: the benchmark's side
    is broadcast if it is counted to be small. A passage in many documents is a hit in
    each and meets nowhere. Only the hits and one narrow row per document are shuffled.

    Null texts have no words and so no hits; items without words have no windows. A null
    item identifier is written as empty text. Repeated rows each get the same result;
    repeated items count once. Other columns are ignored. An empty benchmark gives rows
    without hits, an empty table no rows.
    """
    items = _with_words(benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")), "text")
    items = items.where(F.size("words") > 0).withColumn("span", F.least(F.size("words"), F.lit(span)))
    windows = pinned(items.select("item", "span", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("words") - F.col("span")),
        lambda i: F.array_join(F.slice("words", i + 1, F.col("span")), " "))).alias("window")).distinct())
    shorts = sorted(r[0] for r in windows.where(F.col("span") < span).select("span").distinct().collect())

    def fingerprints(rows: DataFrame, lengths: list[int]) -> DataFrame:
        rows = rows.withColumn("grams", _grams(gram))
        return rows.withColumn("prints", F.concat(_winnowed("grams", span, gram), *[_grams(n) for n in lengths]))

    # Outer, as an inner explode would have its array computed again in a filter below it.
    long_items = fingerprints(items.where(F.col("span") == span), []).select("span", F.explode_outer("prints").alias("print"))
    short_items = [items.where(F.col("span") == n).select("span", F.explode_outer(_grams(n)).alias("print")) for n in shorts]
    prints = long_items
    for one in short_items:
        prints = prints.union(one)
    own = docs.sparkSession.range(1).select(F.lit(0).alias("span"), F.lit(SELF).alias("print"))
    prints = pinned(prints.union(own).select(F.shiftright("print", PLACE_BITS).alias("mark"), "span").distinct())

    rows = _with_words(docs.select(
        F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")),
        "text").drop("text")
    rows = fingerprints(rows, shorts).select(
        "doc_id", "key", F.size("words").alias("n_words"), "words",
        F.explode_outer(F.concat("prints", F.array(F.lit(SELF)))).alias("print"))
    rows = rows.withColumn("mark", F.shiftright("print", PLACE_BITS)).withColumn(
        "place", F.col("print").bitwiseAND(F.lit(2 ** PLACE_BITS - 1)).cast("int"))
    small = prints.count() <= BROADCAST_ROWS
    if small:
        found = rows.join(F.broadcast(prints), "mark").where((F.col("span") > 0) | (F.col("print") == SELF))
    else:
        # The documents' own rows, which all have one mark, take no part in the shuffle by marks.
        own_rows = rows.where(F.col("print") == SELF).withColumn("span", F.lit(0))
        met = rows.where(F.col("print") != SELF).drop("words").join(prints.where("span > 0"), "mark")
        texts = own_rows.select("key", "words").dropDuplicates(["key"])
        found = own_rows.unionByName(met.join(texts, "key"))
    # The windows that hold a fingerprint; the document's own row keeps one empty window.
    first = F.greatest(F.lit(0), F.when(F.col("span") == span, F.col("place") - (span - gram)).otherwise(F.col("place")))
    last = F.least(F.col("place"), F.col("n_words") - F.col("span"))
    around = F.when(F.col("span") == 0, F.array(F.struct(F.lit(-1).alias("start"), F.lit("").alias("window")))).otherwise(
        F.transform(F.sequence(first, last), lambda s: F.struct(
            s.alias("start"), F.array_join(F.slice("words", s + 1, F.col("span")), " ").alias("window"))))
    found = found.select("doc_id", "key", "n_words", "span", F.explode(around).alias("at")).select(
        "doc_id", "key", "n_words", "span", "at.start", "at.window")
    known = windows.select("window").distinct()
    if known.count() <= BROADCAST_ROWS:
        known = known.union(docs.sparkSession.range(1).select(F.lit("").alias("window")))
        found = pinned(found.join(F.broadcast(known), "window"))
    else:
        found = pinned(found)
        found = pinned(found.where("start < 0").unionByName(found.where("start >= 0").join(known, "window").select(*found.columns)))

    hits = found.where("start >= 0")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("span")).alias("end")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words")),
        lambda s, w: F.struct(
            F.greatest(s["end"], w["end"]).alias("end"),
            (s["words"] + F.greatest(F.lit(0), w["end"] - F.greatest(s["end"], w["start"]))).alias("words")))["words"]
    n_hit = hits.groupBy("key", "n_words").agg(covered.alias("n_hit"))
    met = hits.select("key", "n_words", "window").distinct().join(windows.select("window", "item"), "window")
    met = met.groupBy("key", "n_words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(
        "key", "n_words", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("list"))
    out = found.where("start < 0").join(n_hit.join(met, ["key", "n_words"]), ["key", "n_words"], "left")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit; columns and values as they were, whatever their names.

    Null texts have no hit and stay. Repeated rows stay or go together; an empty table stays empty.
    """
    return without(docs, decontaminate(docs, benchmark).where("contaminated"))
