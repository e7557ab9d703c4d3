"""Awkward documents that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, n int"

_rng = random.Random(5)
WORDS = ["".join(_rng.choice("abcdeilnorst") for _ in range(_rng.randint(2, 9))) for _ in range(300)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, repeated rows and ids, ties, special tokens."""
    long = prose(1, 40_000)
    base = prose(2, 60)
    texts = [
        None, "", " \n\t ", "x", "!!! ###", base, base, base + " more", long, "Zażółć gęślą jaźń 日本語 😀 é́",
        "a<|endoftext|>b <|startoftext|>", "one two\none two\n\none two", "\x1c\x85\u3000 tab\tend", "ΣΑΣ İstanbul ǅ", "same " * 50,
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", None, "s1"][i % 3], i, 1.5, "f", 7) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, "en", "s0", None, None, None, None), (None, None, None, None, None, None, None, None), (3, "another text", "en", "s0", 1, 0.0, "", 1)]
    return rows


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
