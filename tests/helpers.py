"""Literal corpora and comparisons with another engine."""

import os
from collections import Counter

import duckdb
import pandas as pd

from wordloom import schema


def make_tokens(spark, docs, function=(), sentence=lambda d, p: 0):
    rows = [(d, sentence(d, p), p, w, w, "FUNC" if w in function else "WORD", w in function) for d, ws in enumerate(docs) for p, w in enumerate(ws)]
    return schema.conform(spark.createDataFrame(rows, "doc_id long, sentence_id long, position long, surface string, lemma string, pos string, is_function boolean"))


def rows(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        p = f"{sf}/{f}"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(v):
    if v is not pd.NA and hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return None if v is None or v is pd.NA or v != v else v


def same(pdf, sql_pdf):
    assert sorted(pdf.columns) == sorted(sql_pdf.columns)
    cols = sorted(pdf.columns)
    a, b = (Counter(tuple(map(norm, r)) for r in x[cols].itertuples(index=False)) for x in (pdf, sql_pdf))
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
