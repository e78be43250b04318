"""Toxicity by class-conditional Kneser-Ney models of expressions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stormline.llm.common import packed
from stormline.session import pinned

ORDER, DISCOUNT, LETTERS = 5, 0.75, 300  # characters of a gram, absolute discount, size of the uniform floor
LEAST = 2  # a gram seen in fewer words of documents keeps only the shared backoff
SAMPLE = 20_000  # most labelled rows that the two weights of the decision are fitted on
BROADCAST_ROWS = 1_000_000
MODEL_ROWS = 2_000_000  # a larger model is joined by shuffles instead
FLUSH = 200_000
TOGETHER = 100_000  # words that are looked up at once
START, STOP, REST = "\x02", "\x03", "\x04"
_SPACES = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def expressions(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and whatever lies beyond ASCII, each between a start and a stop."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()
    return [START + w.decode() + STOP for w in words]


def _fold(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text, toxic and fold of the rows that may be learned from."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("_id is not null and toxic is not null").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    marks = pinned(marks.withColumn("fold", _fold("_id")).where("fold > 0"))
    few = marks.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(marks) if few else marks, "_id").select("_id", "text", "toxic", "fold")


def _gram_counts(rows: DataFrame) -> DataFrame:
    """Per gram (context and next character of a word) in how many documents' words it stands, by class.

    a0, a1 are the ordinary and toxic counts of folds 1 to 3, b0, b1 those of all folds.
    """
    columns = "a0 long, a1 long, b0 long, b1 long"

    def flushed(held: dict, name: str) -> pa.RecordBatch:
        counts = np.array(list(held.values()), dtype="<i8").reshape(-1, 4)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), type=pa.string()), *[pa.array(counts[:, k]) for k in range(4)]],
            names=[name, "a0", "a1", "b0", "b1"])

    def words(batches):
        held = defaultdict(lambda: [0, 0, 0, 0])
        for batch in batches:
            for text, toxic, fold in zip(*[column.to_pylist() for column in batch.columns]):
                for word in set(expressions(text)):
                    counts = held[word]
                    counts[2 + toxic] += 1
                    if fold < 4:
                        counts[toxic] += 1
                if len(held) >= FLUSH:
                    yield flushed(held, "word")
                    held.clear()
        yield flushed(held, "word")

    def grams(batches):
        held = defaultdict(lambda: [0, 0, 0, 0])
        for batch in batches:
            for word, *counts in zip(*[column.to_pylist() for column in batch.columns]):
                for i in range(1, len(word)):
                    own = held[word[max(0, i - ORDER + 1):i + 1]]
                    for k in range(4):
                        own[k] += counts[k]
                if len(held) >= FLUSH:
                    yield flushed(held, "gram")
                    held.clear()
        yield flushed(held, "gram")

    def added(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(name).agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")])

    toxic = (F.col("toxic") > 0).cast("int").alias("toxic")
    by_word = added(rows.select("text", toxic, "fold").mapInArrow(words, f"word string, {columns}"), "word")
    return added(by_word.mapInArrow(grams, f"gram string, {columns}"), "gram").where(F.col("b0") + F.col("b1") >= LEAST)


def _entries(grams: DataFrame) -> DataFrame:
    """gram, a, b: log of the toxic over the ordinary probability, for both sets of folds.

    The highest orders are counted by class. Below them both classes share one backoff,
    whose counts are continuation counts: in how many different grams a shorter one
    goes on. A context's own entry (its text and REST) is the ratio of the two backoff
    weights, which is what a character never seen after it gets.
    """
    grams = pinned(grams)
    level = grams.where(F.length("gram") == ORDER).select("gram", F.lit(0).cast("long").alias("more"))
    levels = {ORDER: level}
    for size in range(ORDER - 1, 0, -1):
        goes = levels[size + 1].groupBy(F.substring("gram", 2, ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("more"))
        own = grams.where(F.length("gram") == size).select("gram", F.lit(0).cast("long").alias("more"))
        levels[size] = pinned(goes.union(own).groupBy("gram").agg(F.sum("more").alias("more")))
    shared = None
    for size in range(1, ORDER):
        here = levels[size].withColumn("context", F.substring("gram", 1, size - 1))
        sums = here.where("more > 0").groupBy("context").agg(F.sum("more").alias("total"), F.count(F.lit(1)).alias("kinds"))
        here = here.join(sums, "context", "left")
        if shared is None:
            here = here.withColumn("base", F.lit(1.0 / LETTERS))
        else:
            here = here.withColumn("rest", F.substring("gram", 2, ORDER)).join(
                shared.select(F.col("gram").alias("rest"), F.col("p").alias("base")), "rest")
        p = F.when(F.col("total").isNull(), F.col("base")).otherwise(
            (F.greatest(F.col("more") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("base")) / F.col("total"))
        here = pinned(here.select("gram", p.alias("p")))
        shared = here if shared is None else shared.union(here)
    kinds = [F.sum(c).alias(f"{c}_total") for c in ("a0", "a1", "b0", "b1")]
    kinds += [F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("a0", "a1", "b0", "b1")]
    whole = grams.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    contexts = whole.groupBy("context").agg(*kinds)
    rest = shared.select(F.col("gram").alias("rest"), F.col("p").alias("base"))
    whole = whole.join(contexts, "context").withColumn("rest", F.substring("gram", 2, ORDER)).join(rest, "rest")

    def weight(c: str) -> Column:
        total = F.col(f"{c}_total")
        return F.when(total > 0, DISCOUNT * F.col(f"{c}_kinds") / total).otherwise(1.0)

    def chance(c: str) -> Column:
        total = F.col(f"{c}_total")
        kept = F.when(total > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / total).otherwise(0.0)
        return kept + weight(c) * F.col("base")

    def ratio(of) -> list[Column]:
        return [F.ln(of(f"{x}1") / of(f"{x}0")).alias(x) for x in "ab"]

    return whole.select("gram", *ratio(chance)).union(
        contexts.select(F.concat("context", F.lit(REST)).alias("gram"), *ratio(weight)))


class _Ratios:
    """Log ratios of words, from sorted hashes of grams and their values.

    Sixteen bytes a gram; words already measured are remembered for the time of a task,
    and forgotten when too many are held.
    """

    most = 300_000

    def __init__(self, marks: np.ndarray, values: np.ndarray):
        self.marks, self.values = marks, values
        self.words: dict[str, float] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Measure the words of some texts that aren't known yet, all at once."""
        words = set().union(*texts)
        new = list(words - self.words.keys())
        if len(self.words) + len(new) > self.most:
            self.words.clear()
            new = list(words)
        if new:
            self.words.update(zip(new, self._measured(new)))

    def _measured(self, words: list[str]) -> list[float]:
        grams = [w[max(0, i - ORDER + 1):i + 1] for w in words for i in range(1, len(w))]
        held = self._looked_up(set(grams))
        held.update(self._rests(set(grams) - held.keys()))
        values = np.array([held.get(g, 0.0) for g in grams])
        return np.add.reduceat(values, np.cumsum([0] + [len(w) - 1 for w in words[:-1]])).tolist()

    def _rests(self, grams: set[str]) -> dict[str, float]:
        """What unseen grams get from the backoff weights of their contexts."""
        known = self._looked_up({g[:-1] + REST for g in grams})
        return {g: known[g[:-1] + REST] for g in grams if g[:-1] + REST in known}

    def _looked_up(self, grams: set[str]) -> dict[str, float]:
        """Values of the grams that the model has."""
        if not len(self.marks) or not grams:
            return {}
        asked = list(grams)
        marks = np.array([xxhash.xxh64_intdigest(g.encode(), seed=42) for g in asked], dtype=np.uint64)
        order = np.argsort(marks)  # in order, so that the search stays near where it was
        marks = marks[order]
        at = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
        hits = np.flatnonzero(self.marks[at] == marks)
        return {asked[i]: value for i, value in zip(order[hits].tolist(), self.values[at[hits]].tolist())}


def _scanned(rows: DataFrame, text: str, entries: DataFrame, which: str, small: bool) -> DataFrame:
    """``rows`` with _mean and _top: the mean log ratio of the text's expressions, and the highest."""
    if small:
        # Spark's hash of a text is xxHash64 with seed 42.
        # As Arrow: a plain collect would make a Python row of every gram.
        got = entries.select(F.xxhash64("gram").alias("mark"), F.col(which).alias("value")).toArrow()
        marks, values = got["mark"].to_numpy().view(np.uint64), got["value"].to_numpy()
        order = np.argsort(marks)
        shared = rows.sparkSession.sparkContext.broadcast((marks[order], values[order]))
        del got, marks, values, order

        @F.pandas_udf("mean double, top double")
        def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            known = _Ratios(*shared.value)
            for texts in batches:
                out, held, size = [], [], 0

                def weigh() -> None:
                    known.learn(held)
                    for words in held:
                        values = [known.words[w] for w in words]
                        out.append((sum(values) / len(values), max(0.0, max(values))) if values else (0.0, 0.0))

                for one in texts:
                    held.append(expressions(one))
                    size += len(held[-1])
                    if size >= TOGETHER:
                        weigh()
                        held, size = [], 0
                weigh()
                yield pd.DataFrame(out, columns=["mean", "top"])

        return rows.withColumn("_m", measure(F.col(text).cast("string"))).withColumns(
            {"_mean": F.col("_m.mean"), "_top": F.col("_m.top")}).drop("_m")

    # The same by shuffles: the words of every text, the grams of every distinct word.
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(expressions)

    keyed = pinned(rows.withColumn("_key", F.xxhash64(*[F.col(c) for c in rows.columns])))
    words = keyed.dropDuplicates(["_key"]).select("_key", F.explode(cut(F.col(text).cast("string"))).alias("word"))
    words = words.groupBy("_key", "word").agg(F.count(F.lit(1)).alias("times"))
    grams = words.select("word").distinct().withColumn("i", F.explode(F.sequence(F.lit(2), F.length("word"))))
    first = F.greatest(F.lit(1), F.col("i") - ORDER + 1)
    grams = grams.select("word", F.substr("word", first, F.col("i") - first + 1).alias("gram"),
                         F.concat(F.substr("word", first, F.col("i") - first), F.lit(REST)).alias("rest"))
    seen = entries.select("gram", F.col(which).alias("own"))
    grams = grams.join(seen, "gram", "left").join(seen.select(F.col("gram").alias("rest"), F.col("own").alias("other")),
                                                  "rest", "left")
    ratios = grams.groupBy("word").agg(F.sum(F.coalesce("own", "other", F.lit(0.0))).alias("ratio"))
    texts = words.join(ratios, "word").groupBy("_key").agg(
        (F.sum(F.col("ratio") * F.col("times")) / F.sum("times")).alias("_mean"),
        F.greatest(F.lit(0.0), F.max("ratio")).alias("_top"))
    return keyed.join(texts, "_key", "left").drop("_key").fillna(0.0, ["_mean", "_top"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression by Newton's steps."""
    middle, width = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - middle) / width]
    hold = ridge * np.array([1e-3] + [1.0] * x.shape[1])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -35, 35)))
        b -= np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(hold + 1e-9), z.T @ (p - y) + hold * b)
    slope = b[1:] / width
    return np.r_[b[0] - slope @ middle, slope]


@dataclass
class ToxicityModel:
    entries: DataFrame
    small: bool
    weights: tuple[float, float, float]

    def scored(self, rows: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``rows`` with one more column, the score."""
        c, mean, top = self.weights
        out = _scanned(rows, text_col, self.entries, "b", self.small)
        logit = F.lit(c) + mean * F.col("_mean") + top * F.col("_top")
        return out.withColumn(name, 1 / (1 + F.exp(-logit))).drop("_mean", "_top")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 model_rows: int = MODEL_ROWS) -> ToxicityModel:
    """Learn from labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    Two Kneser-Ney models, toxic and ordinary, spell an expression (a word) character by
    character. An expression's log ratio compares its likelihoods under both; a document
    is judged by two length-normalised numbers: the mean over all its expressions and
    that of its most toxic expression. Their weights come from a logistic regression on
    at most ``SAMPLE`` rows of fold 4, scored by models of folds 1 to 3; the counts of the
    final models are of all rows of folds 1 to 4.

    Rows with a null label or identifier teach nothing; of repeated labels the highest
    counts. Without rows of both classes the score falls back to fixed weights.
    """
    rows = _labelled(docs, labels, id_col, text_col)
    entries = pinned(_entries(_gram_counts(rows)))
    small = entries.count() <= model_rows
    held = rows.where("fold = 4").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("text", "toxic")
    sample = _scanned(held, "text", entries, "a", small).select("_mean", "_top", "toxic").toArrow()
    y = (sample["toxic"].to_numpy() > 0).astype(float)
    weights = np.array([-9.0, 0.0, 1.0])
    if 0 < y.sum() < len(y):
        weights = _logistic(np.c_[sample["_mean"].to_numpy(), sample["_top"].to_numpy()], y)
    return ToxicityModel(entries, small, tuple(float(w) for w in weights))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             model_rows: int = MODEL_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Only the text enters the score. Null and empty texts have no expressions and get the
    score of a text without evidence. Repeated rows get equal scores. A null doc_id counts
    as held out. Other columns are ignored; an empty table gives no rows.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, model_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return model.scored(rows).select(
        "doc_id", (_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score below 0.5; columns and values as they were, whatever their names.

    Null and empty texts score as texts without evidence. Repeated rows stay or go together;
    an empty table stays empty.
    """
    rows = packed(docs, text=F.col(text_col).cast("string"))
    return fit_toxicity(docs, labels, id_col, text_col).scored(rows).where("score < 0.5").select("row.*")
