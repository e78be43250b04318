"""Results against plain versions on the same rows."""

from __future__ import annotations

import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stormline.llm import common, decontaminate, line_dedup as line_dedup_module, ngram_join as ngram_module, toxicity as toxicity_module
from stormline.llm.line_dedup import duplicate_lines
from stormline.llm.ngram_join import keep_one, ngram_join
from stormline.llm.queries import op2_toxicity, vocabulary
from stormline.llm.sharding import shard_documents
from stormline.llm.token_counts import token_counts
from stormline.llm.token_files import read_token_files, write_token_files
from stormline.session import CLEANUP, pinned
from tests.llm.fixtures import awkward, awkward_rows
from tests.test_queries import SF_DIR


def variants(seed: int, families: int, members: int) -> list[str]:
    """Families of texts with ever more words changed, on both sides of the threshold."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        for _ in range(members):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words[rng.randint(0, 1):]))
    return texts


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_classes(docs, k, num):
    sets = [shingle_set(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)), key=lambda x: docs[x][0])
                root[b] = a
    return {d: (len(sets[i]), docs[top(i)][0]) for i, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("k,num,seed", [(3, 90, 1), (3, 90, 2), (5, 80, 3)])
def test_ngram_join(spark, k, num, seed):
    texts = variants(seed, 12, 15) + [t for _, _, _, t, *_ in awkward_rows()]
    docs = list(enumerate(texts))
    random.Random(seed).shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(frame, k=k, num=num).collect()}
    assert found == plain_classes(docs, k, num)
    kept = {r["doc_id"] for r in keep_one(frame, k=k, num=num).collect()}
    assert kept == {c for _, c in found.values()}


def test_line_dedup(spark):
    lines = variants(5, 10, 12)
    random.Random(5).shuffle(lines)
    docs = [(i, "\n".join(lines[4 * i:4 * i + 4])) for i in range(30)] + [(30, "a b\na b"), (31, None), (32, "x y z\nz y x x")]
    found = {r["doc_id"]: list(r["removed"]) for r in duplicate_lines(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    seen, expected = [], {}
    for doc_id, text in docs:
        expected[doc_id] = []
        for no, line in enumerate((text or "").split("\n")):
            own = line.split()
            if len(own) < 3 or len(set(own)) < 3:
                continue
            if any(100 * len(set(own) & s) >= 80 * len(set(own) | s) for s in seen):
                expected[doc_id].append(no)
            seen.append(set(own))
    assert found == expected


def plain_removed(docs, min_words=3):
    """Sorted numbers of the lines to remove, by comparing every line with all before it."""
    seen, expected = [], {}
    for doc_id, text in docs:
        expected[doc_id] = []
        for no, line in enumerate(text.split("\n")):
            own = set(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line)))
            if len(own) < min_words:
                continue
            if any(100 * len(own & s) >= 80 * len(own | s) for s in seen):
                expected[doc_id].append(no)
            seen.append(own)
    return expected


@pytest.mark.parametrize("hot", [0, line_dedup_module.HOT])
def test_frequent_words_give_the_same_lines(spark, monkeypatch, hot):
    """Words of many lines, whose nodes meet their first ones before all others, marks of any kind and other letters."""
    monkeypatch.setattr(line_dedup_module, "HOT", hot)
    rng = random.Random(11)
    lines = variants(8, 6, 20) + ["\u00c9t\u00e9 A b\tc\x0bd", "\u00e9t\u00e9 a B c d", "\u00c9t\u00e9  a  B c D", "x\x0c y\rz  w", "W z y x", "  ", "one two"]
    lines += rng.sample(lines, 20)
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[3 * i:3 * i + 3])) for i in range(len(lines) // 3 + 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: list(r["removed"]) for r in duplicate_lines(frame).collect()}
    assert found == plain_removed(docs)


def test_shuffle_files_go_with_the_query_that_is_pinned(spark):
    before = spark.conf.get(CLEANUP)
    shuffles = lambda: {p.name for p in Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
                                             .diskBlockManager().localDirs()[0].getPath()).rglob("shuffle_*.data")}
    held = shuffles()
    rows = pinned(spark.range(1000).repartition(3, "id"))
    for _ in range(50):
        if not (left := shuffles() - held):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == before
    assert rows.count() == 1000


def test_tokens_and_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    docs = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}
    counts = {r["doc_id"]: tuple(r)[1:] for r in token_counts(docs, vocabulary()).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert counts == {d: (len(t.encode()), len(ids[d]), len(ids[d]) > 2048) for d, t in rows}
    write_token_files(docs, f"{tmp_path}/files", vocabulary())
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_token_files(spark, f"{tmp_path}/files").collect()}
    at = 0
    for d, _ in rows:
        own = [*ids[d], 1]
        assert found[d] == (at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
        at += len(own)


def test_shards(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'t' as text")
    rows = shard_documents(docs, [1.0] * 7 + [3.0]).collect()
    for shard in range(8):
        slots = sorted((r["doc_id"], r["slot"]) for r in rows if r["shard"] == shard)
        assert [s for _, s in slots] == list(range(len(slots)))
        assert abs(len(slots) - 500 * (3 if shard == 7 else 1)) < 200
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 8 for r in moved) and abs(len(moved) - 5000 / 11) < 150
    grown = {r["doc_id"]: r["shard"] for r in shard_documents(docs, [1.0] * 7 + [3.0, 1.0]).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in rows)


def test_toxicity_on_held_out_rows(spark):
    marks = {r["doc_id"]: int(r["toxic"]) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = op2_toxicity(spark, SF_DIR).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in held) >= 0.85 * len(held)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        rows = pinned(stage(spark, docs, SF_DIR))
        if name == "sharding":
            assert sorted(r[0] for r in rows.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
            break
        assert rows.columns == columns and 0 < rows.count() <= before
        assert rows.exceptAll(docs).count() == 0
        if name == "near_duplicates":
            plain = plain_classes([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
            assert {r["doc_id"] for r in rows.collect()} == {c for _, c in plain.values()}
        docs, before = rows, rows.count()


@pytest.mark.parametrize("module,build", [
    (decontaminate, lambda s, d: decontaminate.decontaminate(d, s.createDataFrame(
        [("i1", "w1 w2"), ("i2", d.where("doc_id = 5").first()["text"]), ("i3", "")], "item_id string, text string"))),
    (ngram_module, lambda s, d: ngram_join(d, k=3, num=85)),
    (common, lambda s, d: keep_one(d)),
    (toxicity_module, lambda s, d: toxicity_module.toxicity(
        d, s.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")).select("doc_id", F.round("score", 9))),
])
def test_both_ways_of_a_join_agree(spark, monkeypatch, module, build):
    """What is broadcast when it is counted to be small is shuffled when it isn't."""
    docs = awkward(spark)
    order = lambda frame: sorted(map(repr, frame.collect()))
    small = order(build(spark, docs))
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert order(build(spark, docs)) == small


def test_the_model_is_joined_where_it_is_too_large_to_send(spark):
    docs, marks = awkward(spark), spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    scores = [sorted((repr(r["doc_id"]), round(r["score"], 9)) for r in toxicity_module.toxicity(docs, marks, model_rows=rows).collect())
              for rows in (2_000_000, 0)]
    assert scores[0] == scores[1]


def test_toxic_expressions_are_learned(spark):
    rng = random.Random(9)
    plain, foul = [f"{a}{b}" for a in ("lan", "ter", "mov", "sil") for b in ("der", "ing", "ost", "ar")], ["grukhed", "zwikker", "vrakzul"]
    docs, marks = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(foul)
        docs.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows = toxicity_module.toxicity(spark.createDataFrame(docs, "doc_id long, text string"),
                                    spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    held = [(r["predicted"], marks[r["doc_id"]][1]) for r in rows if r["held_out"]]
    caught, toxic, called = sum(p and t for p, t in held), sum(t for _, t in held), sum(p for p, _ in held)
    assert toxic > 20 and caught >= 0.95 * toxic and caught >= 0.95 * called


def test_one_key_of_own_rows_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs = spark.range(50).selectExpr("id as doc_id", "concat('only ', id, ' words') as text")
    bench = spark.createDataFrame([("i", "nothing of this is there")], "item_id string, text string")
    found = decontaminate.decontaminate(docs, bench)
    assert found.count() == 50 and found.where("n_hit > 0").count() == 0
