"""A small table with the awkward rows that every operator must stand."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, source string, lang string, text string, key string, n long, node string, token string, "
          "words string, part long, shard string, score string, _key string, _id string, _m string, _mean string, "
          "_score string, _removed string, row string, removed string")
EXTRA = ("k", 1, "x", "t", "w", 2, "s", "r", "q", "i", "m", "n", "o", "p", "u", "v")


def awkward_rows() -> list[tuple]:
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(60)]
    near = [*base[:-1], "other"]
    texts = [None, "", " ", "one", "one two", " ".join(base), " ".join(near), " ".join(base).upper(),
             "  ".join(base), " ".join(["same"] * 40), "café 你好 \U0001f600 line\n\nline\tend",
             " ".join(rng.choice(vocab) for _ in range(20_000))]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 80))) for _ in range(20)]
    texts += [" ".join(base)] * 8
    rows = [(i, f"s{i % 2}" if i % 5 else None, "en" if i % 3 else None, t, *EXTRA) for i, t in enumerate(texts)]
    # A repeated row, and rows without an identifier.
    return [*rows, rows[5], (None, "s0", "en", "no identifier here", *EXTRA), (None, None, None, None, *EXTRA)]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
