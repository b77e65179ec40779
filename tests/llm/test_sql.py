"""Registered text queries have the rows that DuckDB gets from their SQL."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vialume.llm import op7_substring, op10_jaccard, queries

SF = "/root/testdata/sf0.001"


def same(ours: pd.DataFrame, theirs: pd.DataFrame):
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    rows = lambda x: sorted((tuple(None if pd.isna(v) else v for v in r) for r in x[columns].astype(object).itertuples(index=False)), key=repr)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df())


def test_odd_texts(spark):
    """Null, empty, short and repeated texts, odd spaces and letters beyond A-Z."""
    passage = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \n\t", "one", "ONE", "one two", "a b c", "A B C", "É é x", "é é x", "a b c d", passage, passage + " end", "start " + passage, passage.upper(), passage + "\x0b" + passage, "z " * 60, "z " * 61]
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    docs = spark.createDataFrame([(int(i), t) for i, t in enumerate(texts)], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", frame)
    same(op7_substring.digests(docs).toPandas(), con.sql(op7_substring.digests_sql()).df())
    same(op10_jaccard.linked(docs).toPandas(), con.sql(op10_jaccard.linked_sql()).df())
    none = docs.filter(F.lit(False))
    con.execute("CREATE TABLE nothing (doc_id BIGINT, text VARCHAR)")
    same(op7_substring.digests(none).toPandas(), con.sql(op7_substring.digests_sql("nothing")).df())
    same(op10_jaccard.linked(none).toPandas(), con.sql(op10_jaccard.linked_sql("nothing")).df())
