import gzip
import os

import pytest
from pyspark.sql import functions as F

from lodestrand.sources import readers, sinks
from lodestrand.streaming import scoring


def put(path, data):
    with (gzip.open if str(path).endswith(".gz") else open)(path, "wb") as f:
        f.write(data.encode())
    return str(path)


@pytest.mark.parametrize("d", [",", "\t", ";", "|"])
def test_delimiters(spark, tmp_path, d):
    p = put(tmp_path / "x.csv", d.join(["id ", "smiles", "id "]) + "\n" + d.join(["1", "", "a b"]) + "\n")
    assert readers.sniff_delimiter(p) == d
    df = readers.read_library(spark, p)
    assert df.columns == ["id", "smiles", "id__dup_1"]


def test_plain_text_and_gzip(spark, tmp_path):
    p = put(tmp_path / "x.tsv.gz", "a\tb\n1\tNaN\n2\t\n")
    df = readers.read_library(spark, p)
    got = [tuple(r) for r in df.orderBy("a").collect()]
    assert got == [("1", "NaN"), ("2", "")] and dict(df.dtypes) == {"a": "string", "b": "string"}


def test_smi(spark, tmp_path):
    p = put(tmp_path / "x.smi", "# head\nCCO ethanol the drink\n\nC1CC1\n")
    assert [tuple(r) for r in readers.read_library(spark, p).collect()] == [(2, "CCO", "ethanol", "the drink"), (4, "C1CC1", None, None)]


def test_optional_and_required(spark, tmp_path):
    empty = put(tmp_path / "e.csv", "")
    schema = spark.createDataFrame([], "a string, b double").schema
    assert readers.read_optional(spark, empty, schema).count() == 0 and readers.read_optional(spark, str(tmp_path / "no.csv"), schema).columns == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        readers.read_required(spark, str(tmp_path / "no.csv"), ["a"])
    p = put(tmp_path / "x.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_required(spark, p, ["c"])
    with pytest.raises(ValueError):
        readers.read_library(spark, str(tmp_path / "x.doc"))


def test_row_ids(spark):
    df = spark.createDataFrame([("CCO", "x1"), ("CC", ""), ("C", None)], "s string, i string")
    got = {r["s"]: r for r in readers.with_row_ids(df, "lib", "/p", ["s"], "i").collect()}
    assert sorted(r["row_number"] for r in got.values()) == [1, 2, 3] and got["CCO"]["item_id"] == "x1" and got["C"]["item_id"].startswith("lib__row_")


def test_union_of_folders(spark, tmp_path):
    for n, cols in (("a", "m,rmse\nx,1\n"), ("b", "m,mae\ny,2\n")):
        (tmp_path / n).mkdir()
        put(tmp_path / n / "metrics.csv", cols)
    df = readers.union_results(spark, str(tmp_path), ["best.csv", "metrics.csv"])
    assert {"m", "rmse", "mae", "source_folder"} == set(df.columns)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.125, "a"), (2, 2.5, "b")], "id int, v double, k string")
    assert [r["v"] for r in sinks.rounded_numbers(df, 2).orderBy("id").collect()] == [0.12, 2.5]
    out = str(tmp_path / "t")
    sinks.write_table(df, out, by=["k"])
    assert sorted(os.listdir(out))[-2:] == ["k=a", "k=b"]
    sinks.write_json({"b": float("nan"), "a": df.first()}, str(tmp_path / "r.json"))
    assert sinks.read_json(str(tmp_path / "r.json")) == {"a": {"id": 1, "v": 0.125, "k": "a"}, "b": None}
    assert sinks.read_json(str(tmp_path / "none.json")) == {}
    (tmp_path / "rel" / "x").mkdir(parents=True)
    put(tmp_path / "rel" / "x" / "f.txt", "hello")
    m = sinks.manifest(spark, str(tmp_path / "rel")).collect()
    assert [tuple(r) for r in m] == [("x/f.txt", 5, "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824")]
    assert os.path.getsize(sinks.archive(str(tmp_path / "rel"), str(tmp_path / "r.zip"))) > 0
    assert os.path.getsize(sinks.archive(str(tmp_path / "rel"), str(tmp_path / "r.tar.gz"))) > 0
    assert sinks.tree(str(tmp_path / "rel")).splitlines() == ["rel/", "  x/", "    f.txt"]


def test_stream(spark, tmp_path, data):
    src = f"{data}/events.parquet"
    schema = spark.read.parquet(src).schema
    (tmp_path / "in").mkdir()
    os.symlink(src, tmp_path / "in" / "a.parquet")
    q = scoring.score_stream(scoring.file_stream(spark, str(tmp_path / "in"), schema), lambda b: b.withColumn("score", F.col("value") * 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(src).count()


def test_windowed_stream(spark, tmp_path, data):
    src = f"{data}/events.parquet"
    (tmp_path / "in").mkdir()
    os.symlink(src, tmp_path / "in" / "a.parquet")
    stream = scoring.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(src).schema)
    q = scoring.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM win").first()[0] == spark.read.parquet(src).count()
