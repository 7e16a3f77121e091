import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.operators.curate import generation_gate
from textquarry.operators.report import nested, overridden, placed, wide
from textquarry.sources import readers, writers
from textquarry.storage import Scratch, shared_dir, small_enough, spread
from textquarry.streaming import flows


def test_jsonl_readers(spark, tmp_path):
    lines = ['{"title": "a", "word_count": 3}', "", "   ", "{broken", '{"title": "b"}', '{"other": 1}']
    (tmp_path / "wiki_gen-x.jsonl").write_bytes("\n".join(lines).encode() + b'\n{"title": "c\xff"}\n')
    got = readers.jsonl_tolerant(spark, str(tmp_path), readers.PAIRS).collect()
    assert [r.title for r in got][:3] == ["a", "b", None] and got[3].title.startswith("c")
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, str(tmp_path), readers.PAIRS).collect()
    assert {r.generator for r in readers.with_file_part(spark, f"{tmp_path}/*.jsonl", readers.PAIRS).collect()} == {"gen-x"}


def test_text_csv_and_metadata(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\n\n  \ntwo\n")
    assert [r.text for r in readers.text_lines(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]
    (tmp_path / "c.csv").write_text('ID,Text\n1,"a ""quoted""\nline"\n2,\\N\n3,""\n')
    rows = readers.csv(spark, str(tmp_path / "c.csv"), T.StructType.fromDDL("ID int, Text string"), "\\N").collect()
    assert [r.Text for r in rows] == ['a "quoted"\nline', None, ""]
    assert readers.csv_quota(spark, str(tmp_path / "c.csv"), 1).collect()[0].text.startswith("a ")
    (tmp_path / "m.json").write_text(json.dumps({"detector_name": "D", "huggingface_link": "see https://huggingface.co/org/model-x?y"}))
    assert readers.metadata_links(spark, str(tmp_path / "m.json")).first().model_id == "org/model-x"
    assert readers.table_or_none(spark, str(tmp_path / "none.parquet")) is None


def test_selection_and_assembly(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "Num int, kind string")
    assert readers.resolve(df, ["num", "KIND"]).columns == ["num", "KIND"]
    assert readers.selected(df, {"Num": ["1", "3"]}, {"kind": ["a"]}).collect() == [(3, None)]
    with pytest.raises(ValueError):
        readers.selected(df, {"Num": ["9"]})
    a = spark.createDataFrame([("x", None)], "texts string, attacks string")
    b = spark.createDataFrame([("y", "s")], "texts string, sources string")
    assert {tuple(r) for r in readers.assemble([a, b]).select("texts", "attacks", "sources").collect()} == {("x", "none", "-"), ("y", "none", "s")}


def test_writers(spark, tmp_path):
    scores = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "id int, score double")
    assert not writers.finite_only(scores, str(tmp_path / "s")) and writers.finite_only(scores.filter("id = 1"), str(tmp_path / "s"))
    at = str(tmp_path / "u.parquet")
    writers.upsert_table(spark, at, spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), ["k"])
    writers.upsert_table(spark, at, spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(at).collect()) == [("a", 1), ("b", 9), ("c", 3)]


def test_reports(spark):
    m = spark.createDataFrame([("d1", "x", 0.9), ("d1", "y", float("nan")), ("d2", "x", 0.7)], "det string, set string, ba double")
    assert [r.det for r in placed(m.filter("set = 'x'"), "ba").orderBy("place").collect()] == ["d1", "d2"]
    assert wide(m, "det", "set", "ba", ["x", "y"]).orderBy("det").collect()[1].y is None
    assert set(nested(m, "det", "set", ["ba"]).orderBy("det").first().sets) == {"x", "y"}
    row = spark.range(1).select(overridden(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("9"))).alias("m")).first()
    assert row.m == {"a": "1", "b": "9"}


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    good = "A fine sentence with words. " * 60
    rows = [(1, good, "2025-01-01 00:00:00"), (2, "short", "2025-01-01 00:00:01"), (3, good, "2025-01-01 00:00:02"), (4, None, "2025-01-01 00:00:03")]
    spark.createDataFrame(rows, "id int, text string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(src)
    stream = spark.readStream.schema("id int, text string, at timestamp").parquet(src)
    flows.append_jsonl(flows.gated(stream, "text", generation_gate), out, str(tmp_path / "c1")).awaitTermination(60)
    assert sorted(r.id for r in spark.read.schema("id int").json(out).collect()) == [1, 3]
    seen = []
    once = flows.first_within(stream.filter("text IS NOT NULL"), F.col("text"), "at")
    flows.upsert_batches(once, lambda df: seen.extend(r.id for r in df.collect()), str(tmp_path / "c2")).awaitTermination(60)
    assert sorted(seen) in ([1, 2], [2, 3])


def test_storage(spark):
    assert shared_dir(spark) == shared_dir(spark)
    s = Scratch(spark, "x")
    df = s.save(spark.range(10), "t")
    assert df.count() == 10 and small_enough(df, 10) and not small_enough(df, 9)
    s.drop(df)
    assert spread(spark.range(5).coalesce(1)).rdd.getNumPartitions() >= 4
