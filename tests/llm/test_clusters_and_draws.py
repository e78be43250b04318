"""Clustering, resampling and MinHash deduplication against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormline.llm.clustering import Bisectors, centroid_clusters, clustered
from stormline.llm.minhash import Sketches, estimate, keep_least, minhash_dedup
from stormline.llm.resampling import Lexicon, Splices, resample, spaced
from stormline.llm.shingles import shingles
from tests.llm.fixtures import awkward, awkward_rows, nothing
from tests.llm.test_brute_force import plain_classes, variants


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance int, vector string, id long, place int")


def plain_clusters(rows, k, rounds, scale, seed):
    kept = [(i, [math.floor(scale * v) if abs(v) < 1e15 else int(v) * scale for v in x]) for i, x in rows]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in kept[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for n in set(own):
            members = [x for (_, x), m in zip(kept, own) if m == n]
            centroids[n] = [sum(column) // len(members) for column in zip(*members)]
    return centroids, [(i, near(x)) for i, x in kept]


@pytest.mark.parametrize("wide", [1.0, 1e9, 1e30])
def test_clusters_equal_plain_ones(spark, wide):
    rng = random.Random(3)
    good = [(i, [rng.choice((rng.gauss(0, 1), 0.25, -0.5)) * wide for _ in range(4)]) for i in range(150)]
    good += [(200, good[0][1]), (201, good[0][1]), (5, good[5][1]), (None, good[7][1]), (None, good[9][1])]
    bad = [(300, None), (301, [1.0, 2.0, 3.0]), (302, [1.0, None, 3.0, 4.0]), (303, [float("nan"), 1.0, 1.0, 1.0]),
           (304, [float("inf"), 0.0, 0.0, 0.0]), (305, [])]
    frame = vectors(spark, [(i, x, "x", 1, "v", 9, 3) for i, x in good + bad]).repartition(3)
    centroids, expected = plain_clusters(good, 9, 3, 256, 2)
    found = centroid_clusters(frame, k=9, rounds=3, dim=4)
    assert found.centroids == centroids
    rows = clustered(frame, k=9, rounds=3, dim=4).collect()
    fits = lambda v: v if v < 2 ** 63 else None
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert order((r["vec_id"], r["cluster"], r["distance"]) for r in rows) == order((i, n, fits(d)) for i, (d, n) in expected)
    if wide == 1.0:
        sums = Counter()
        for _, (d, n) in expected:
            sums[n] += d
        for r in rows:
            text = ",".join(map(str, centroids[r["cluster"]]))
            assert (r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (
                sums[r["cluster"]], sum(sums.values()), hashlib.sha256(text.encode()).hexdigest())


def test_clusters_of_few_or_no_vectors(spark):
    rows = [(i, [1.0, 2.0], "x", 1, "v", 9, 3) for i in range(3)]
    assert {(r["cluster"], r["distance"]) for r in clustered(vectors(spark, rows), k=5, dim=2).collect()} == {(0, 0)}
    assert clustered(vectors(spark, rows), k=5, dim=3).count() == 0
    assert clustered(vectors(spark, []), k=5, dim=2).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_a_tie_goes_to_the_smaller_number():
    numbers, distances = Bisectors([[0, 2], [2, 0], [0, -2], [-2, 0], [5, 5]], 2).nearest(np.array([[0.0, 0.0], [1.0, -1.0]]))
    assert numbers.tolist() == [0, 1] and distances.tolist() == [4, 2]


def test_crcs_of_joined_strings():
    rng = random.Random(1)
    parts = [(rng.randbytes(rng.randint(0, 40)), rng.randbytes(rng.choice([0, 1, 7, 300, 70_000]))) for _ in range(60)]
    joined = Splices().joined(np.array([zlib.crc32(a) for a, _ in parts], dtype=np.uint32),
                              np.array([zlib.crc32(b) for _, b in parts], dtype=np.uint32), np.array([len(b) for _, b in parts]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in parts]


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("entries", [[], ["a"], ["a", "b", "ab", "é你", "w1"]])
def test_payloads_compose_to_runs(entries):
    lexicon = Lexicon(entries)
    for text in [None, "", " ", "a", "A b", "ab a  b-ab,xyz é你 a", "zz a zz zz b", "b a\x7fa\x00b", "w1 " * 50 + "end"]:
        words = plain_words(text)
        crc, size = lexicon.payloads(spaced(text))
        assert crc.tolist() == [zlib.crc32(w.encode()) for w in words] and size.tolist() == [len(w.encode()) for w in words]
        runs = [zlib.crc32(" ".join(words[i:i + n]).encode()) for n in range(2, 5) for i in range(len(words) - n + 1)]
        assert lexicon.features(crc, size, 2, 4).tolist() == runs


def plain_draw(docs, target, low, high, buckets, percent, min_words, seed):
    def places(text):
        words = plain_words(text)
        runs = [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    have, want = Counter(b for _, t in docs for b in places(t)[1]), Counter(b for t in target for b in places(t)[1])
    all_have, all_want = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (all_have + buckets) / ((have[b] + 1) * (all_want + buckets))))
            for b in range(buckets)]
    rows = []
    for key, text in docs:
        n, own = places(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for rank, row in enumerate(fit[:percent * len(fit) // 100], 1):
        row[5] = rank
    return rows


@pytest.mark.parametrize("low,high,percent,words", [(1, 1, 10, 65_536), (1, 2, 50, 5), (2, 3, 100, 0), (1, 1, 0, 3)])
def test_draws_equal_plain_ones(spark, low, high, percent, words):
    rng = random.Random(4)
    docs = [(r[0], r[3]) for r in awkward_rows()] + [
        (100 + i, " ".join(rng.choice(["alpha", "beta", "Gamma", "é"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    target = ["alpha beta beta", None, "w1 w2 é"]
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: tuple((v is None, v or 0) for v in r))
    found = resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                     spark.createDataFrame([(t,) for t in target], "text string"), low, high, 1000, percent, 20, 7, words)
    assert order(found.collect()) == order(plain_draw(docs, target, low, high, 1000, percent, 20, 7))


def test_draws_stand_awkward_rows(spark):
    docs, target = awkward(spark), spark.createDataFrame([("one two",)], "text string")
    found = resample(docs, target)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and found.count() == docs.count()
    assert resample(nothing(spark), target).count() == 0
    assert resample(docs, target.where("text is null")).where("weight > 100000").count() == 0


@pytest.mark.parametrize("k,num,seed,few", [(3, 85, 1, 1_000_000), (3, 85, 2, 0), (5, 80, 3, 1_000_000)])
def test_minhash_classes(spark, k, num, seed, few):
    texts = variants(seed, 12, 15) + [t for _, _, _, t, *_ in awkward_rows()]
    docs = list(enumerate(texts))
    random.Random(seed).shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = minhash_dedup(frame, k=k, num=num, broadcast_rows=few).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert found == plain_classes(docs, k, num)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_minhash_filter_keeps_rows_as_they_were(spark):
    docs = awkward(spark)
    kept = keep_least(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and 0 < kept.count() < docs.count()
    assert keep_least(nothing(spark)).count() == 0 and minhash_dedup(nothing(spark)).count() == 0
    found = minhash_dedup(docs)
    assert sorted((r[0] is None, r[0] or 0) for r in found.select("doc_id").collect()) == sorted(
        (r[0] is None, r[0] or 0) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("words", [12, 100, 3000])
def test_registers_agree_with_the_similarity(words):
    rng, maker = random.Random(words), Sketches(240)
    errors = []
    for _ in range(30):
        base = [f"w{rng.random()}" for _ in range(words)]
        other = list(base)
        for _ in range(max(1, words // 40)):
            other[rng.randrange(words)] = "changed"
        a, b = (shingles(" ".join(t), 3) for t in (base, other))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        near = estimate(*[maker.registers(s)[0][None] for s in (a, b)], np.array([len(a)]), np.array([len(b)]))[0]
        errors.append(near - exact)
    assert abs(float(np.mean(errors))) < 0.05 and float(np.std(errors)) < 0.12
