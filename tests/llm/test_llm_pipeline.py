"""The registered queries and the pipeline on the smallest tables."""

import collections
import random

import duckdb

import corpus_pipeline
from corpus_catalog.llm import decontaminate, near_dups, quality, queries, substrings

SF_DIR = "/root/testdata/sf0.001"


def test_leaks_equal_sql(spark):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    found = queries.QUERIES["op8_leaks"](spark, SF_DIR).select("doc_id", "item_id", "n_shared", "n_item").collect()
    assert sorted(map(tuple, found)) == sorted(duck.sql(queries.ORACLE_SQL["op8_leaks"]).fetchall())


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "quality_rules":
            assert quality.statistics(docs).filter("n_words < 50").count() == 0
        if name == "near_duplicates":
            assert near_dups.near_duplicates(docs).filter("not kept").count() == 0
        if name == "substring_dedup":
            assert substrings.repeated_paragraphs(docs).count() == 0
        if name == "decontamination":
            assert decontaminate.leaks(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).count() == 0
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).select("doc_id").distinct().count() == sizes[-1]


def test_rows_without_or_with_one_id(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    text = lambda seed, n=120: " ".join(random.Random(seed).choices(words, k=n))
    item = text(99, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    repeat = text(50, 60)
    rows = [
        (None, text(1)), (None, text(2)), (None, "too short"), (None, text(1)), (7, text(3)), (7, "short"), (7, text(4)), (8, text(3)),
        (9, text(5)), (9, text(5)), (9, text(5)), (10, text(6)), (None, text(6)), (None, f"{text(7)} {item}"), (11, text(8)), (11, f"{text(9)} {item}"),
        (12, f"{repeat}\n{text(10)}"), (12, f"{text(11)}\n{repeat}"), (None, f"{repeat}\n{text(12)}"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    # Of the two rows of 12 that hold the repeat, either may be the first.
    # The item is itself a passage of two texts: the later one loses it and stays, the earlier one goes with it.
    kept = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (9, text(5)), (10, text(6)), (11, text(8)), (None, text(12)), (None, text(7))]
    either = [[(12, f"{repeat}\n{text(10)}"), (12, text(11))], [(12, text(10)), (12, f"{text(11)}\n{repeat}")]]
    assert left in [collections.Counter(kept + x) for x in either]
