"""Correspondence analysis of words and groups: where each lies by how its profile departs from the average.

The table of words and groups is sparse and long; groups are few (``trends.MOST_GROUPS`` at most).  With P the shares of all
tokens, r and c their sums by word and group, the matrix to decompose is (P - rc') / sqrt(rc').  Its Gram matrix over the
groups is sum(p p' / r) / sqrt(cc') - sqrt(cc'), which needs one pass over the words: every task sums its part in numpy, and one small matrix
is all that leaves.  Its eigenvectors give the groups' coordinates, and a word's are averages of them.

Defined results: tokens without a group and words without occurrences have no part; axes are signed so that the group farthest out lies
on the positive side; axes without inertia are left out, so fewer than three groups give fewer than two."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.storage import stored

from .trends import group_values

#: An axis with less of the whole inertia is rounding.
NOTHING = 1e-12


def _gram(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((k, k))
    for b in batches:
        x = np.asarray(b.column(0).flatten()).reshape(-1, k)
        total += (x / x.sum(axis=1, keepdims=True)).T @ x
    yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])


def analyse(tokens: DataFrame, group: str, unit: str = "lemma", include_function_words: bool = False, axes: int = 2, min_freq: int = 5) -> tuple[DataFrame, list[float]]:
    """(kind, name, freq, mass, axis_1, axis_2, ...) for groups and words, and each axis's share of the inertia."""
    spark = tokens.sparkSession
    chosen = tokens if include_function_words else tokens.where(~F.col("is_function"))
    counts = chosen.where(F.col(group).isNotNull() & F.col(unit).isNotNull()).groupBy(F.col(unit).alias("word"), F.col(group).cast("string").alias("group")).agg(F.count("*").alias("n"))
    kept = counts.groupBy("word").agg(F.sum("n").alias("freq")).where(F.col("freq") >= min_freq)
    counts = stored(counts.join(kept, "word"), "words-by-group")
    groups = group_values(counts.groupBy("group").agg(F.sum("n").alias("size")))
    names, sizes = [g for g, _ in groups], np.array([float(n) for _, n in groups])
    n, k = sizes.sum(), len(groups)
    rows = counts.groupBy("word").agg(F.max("freq").alias("freq"), F.array(*(F.coalesce(F.sum(F.when(F.col("group") == g, F.col("n"))), F.lit(0)).cast("double") for g in names)).alias("x"))
    schema = "kind string, name string, freq long, mass double" + "".join(f", axis_{a + 1} double" for a in range(axes))
    if k < 2:
        return spark.createDataFrame([], schema), []
    parts = rows.select("x").mapInArrow(lambda it: _gram(it, k), "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # groups, squared
    gram = np.zeros((k, k))
    for r in sums:
        gram[r["i"], r["j"]] = r["v"] / n
    c = sizes / n
    root = np.sqrt(np.outer(c, c))
    values, vectors = np.linalg.eigh(gram / root - root)
    order = [i for i in np.argsort(-values) if values[i] > NOTHING * max(1.0, np.trace(gram / root - root))][: min(axes, k - 1)]
    inertia = float(np.clip(values, 0, None).sum())
    found = vectors[:, order] / np.sqrt(c)[:, None]
    found *= np.where(found[np.abs(found).argmax(axis=0), range(len(order))] < 0, -1.0, 1.0) if len(order) else 1.0
    at = found * np.sqrt(values[order])
    none = [None] * (axes - len(order))
    own = spark.createDataFrame([("group", g, int(s), float(s / n), *map(float, at[i]), *none) for i, (g, s) in enumerate(groups)], schema)
    place = [F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, found[:, a]))), lambda x, v: x * v), F.lit(0.0), lambda s, x: s + x) / F.col("freq") for a in range(len(order))]
    words = rows.select(F.lit("word").alias("kind"), F.col("word").alias("name"), F.col("freq").cast("long").alias("freq"), (F.col("freq") / n).alias("mass"), *(p.alias(f"axis_{a + 1}") for a, p in enumerate(place)), *(F.lit(None).cast("double").alias(f"axis_{a + 1}") for a in range(len(order), axes)))
    return own.unionByName(words), [float(values[i] / inertia) for i in order]
