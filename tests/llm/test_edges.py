"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stormline.llm.chat import format_chats, read_chats
from stormline.llm.decontaminate import decontaminate, drop_contaminated
from stormline.llm.exact_dedup import exact_dedup
from stormline.llm.line_dedup import duplicate_lines, remove_lines
from stormline.llm.mixing import mix, sample_mix
from stormline.llm.ngram_join import keep_one, ngram_join
from stormline.llm.queries import vocabulary
from stormline.llm.sharding import shard_documents
from stormline.llm.token_counts import token_counts
from stormline.llm.token_files import read_token_files, write_token_files
from stormline.llm.toxicity import reject_toxic, toxicity
from tests.llm.fixtures import awkward, nothing


def benchmark(spark):
    return spark.createDataFrame([("i1", "one two"), ("i2", None), (None, "w1 w2"), ("i1", "one two")], "item_id string, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (4, 0)], "doc_id long, toxic int")


OPERATORS = {
    "ngram_join": lambda s, d: ngram_join(d),
    "toxicity": lambda s, d: toxicity(d, labels(s)),
    "token_counts": lambda s, d: token_counts(d, vocabulary()),
    "sharding": lambda s, d: shard_documents(d, [1.0, 2.0, 1.0]),
    "line_dedup": lambda s, d: duplicate_lines(d),
    "decontamination": lambda s, d: decontaminate(d, benchmark(s)),
    "mixing": lambda s, d: mix(d),
    "exact_dedup": lambda s, d: exact_dedup(d),
}
FILTERS = {
    "near_duplicates": lambda s, d: keep_one(d),
    "reject_toxic": lambda s, d: reject_toxic(d, labels(s)),
    "drop_contaminated": lambda s, d: drop_contaminated(d, benchmark(s)),
    "sample_mix": lambda s, d: sample_mix(d),
    "remove_lines": lambda s, d: remove_lines(d, duplicate_lines(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_one_result(spark, name):
    docs = awkward(spark)
    result = OPERATORS[name](spark, docs)
    assert sorted((r[0] is None, r[0] or 0) for r in result.select("doc_id").collect()) == sorted(
        (r[0] is None, r[0] or 0) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, nothing(spark)).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_the_columns(spark, name):
    docs = awkward(spark)
    kept = FILTERS[name](spark, docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    # Whole rows, so that no value of a clashing column has changed; only line removal edits texts.
    values = [c for c in docs.columns if c != "text" or name != "remove_lines"]
    assert kept.select(*values).exceptAll(docs.select(*values)).count() == 0
    assert FILTERS[name](spark, nothing(spark)).count() == 0


def test_token_files_stand_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    for name, rows in (("some", docs), ("none", nothing(spark))):
        write_token_files(rows, f"{tmp_path}/{name}", vocabulary())
        assert read_token_files(spark, f"{tmp_path}/{name}").count() == rows.count()


def test_chats_stand_awkward_rows(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", "<|end|>&lt;[INST]"), (1, 1, "assistant", None), (1, 1, "assistant", ""), (1, 2, "assistant", "b"),
         (2, None, None, None), (2, 3, "a\nb", "x" * 100_000), (None, 0, "assistant", "&amp;amp;"), (None, 0, "assistant", "&amp;amp;")],
        "conv_id int, turn int, role string, text string").withColumn("items", F.lit(1)).withColumn("cuts", F.lit(1))
    back = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss_text"]) for r in read_chats(format_chats(rows)).collect()}
    assert back[1] == ([("user", "<|end|>&lt;[INST]"), ("assistant", ""), ("assistant", ""), ("assistant", "b")], "b")
    assert back[2] == ([("", ""), ("a\nb", "x" * 100_000)], "")
    assert back[None] == ([("assistant", "&amp;amp;")] * 2, "&amp;amp;" * 2)
    assert read_chats(format_chats(rows.where("conv_id > 9"))).count() == 0
