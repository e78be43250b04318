"""What the driver holds while the pipeline's operators run."""

from __future__ import annotations

from pyspark.sql.classic.dataframe import DataFrame

from stormline.llm import mixing
from stormline.llm.components import components
from stormline.llm.ngram_join import SLOT_BITS, commonness
from stormline.llm.toxicity import fit_toxicity

WORDS = ("alder", "birch", "cedar", "elder", "hazel", "larch", "maple", "rowan")


def collected(monkeypatch) -> list[int]:
    """Fills with the rows and bytes that plain collects bring to the driver."""
    seen, plain = [], DataFrame.collect

    def collect(frame):
        rows = plain(frame)
        seen.append(len(rows) + sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(DataFrame, "collect", collect)
    return seen


def test_shingle_table_is_not_pickled_by_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "alder birch cedar " * 2 + f"w{i}") for i in range(20)], "doc_id long, text string")
    seen = collected(monkeypatch)
    table = commonness(docs, 3, "text")
    assert len(table) == 1 << SLOT_BITS
    # Three shingles of the shared start stand in all 20 texts: 2 ** 4 <= 20. Others stand once.
    assert sum(v == 4 for v in table) == 3 and max(table) == 4
    assert max(seen, default=0) < 1000


def test_toxicity_model_is_not_collected_by_rows(spark, monkeypatch):
    texts = [(i, " ".join(WORDS[(i + k) % 8] for k in range(5)) + (" zyxvile" if i % 3 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    seen, arrow = collected(monkeypatch), "spark.sql.execution.arrow.pyspark.enabled"
    spark.conf.set(arrow, "false")  # as in a session with Spark's defaults
    try:
        scores = fit_toxicity(docs, labels).scored(docs)
    finally:
        spark.conf.set(arrow, "true")
    # More grams are in the model than rows may come.
    assert max(seen, default=0) < 60
    got = {r["doc_id"]: r["score"] for r in scores.collect()}
    assert min(got[i] for i in got if i % 3 == 0) > max(got[i] for i in got if i % 3)


def test_plans_of_raking_hold_one_round(spark, monkeypatch):
    cells = spark.createDataFrame([(s, g, t, 10 * i + 3) for i, (s, g, t) in enumerate(
        (s, g, t) for s in "ab" for g in "xy" for t in ("one", None))], "source string, lang string, topic string, tokens long")
    plans, write = [], mixing.pinned

    def pinned(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return write(frame)

    monkeypatch.setattr(mixing, "pinned", pinned)
    raked = mixing.rake(write(cells)).collect()
    assert len(raked) == 8
    assert abs(sum(r["weight"] for r in raked) - sum(r["tokens"] for r in raked)) < 1e-6
    assert max(plan.count("Window [") for plan in plans) <= len(mixing.SIDES)
    # A target takes its sums (one of all cells, one by value, one of their shares) from the given cells.
    assert max(plan.count("Aggregate [") for plan in plans) <= 4 * len(mixing.SIDES)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
