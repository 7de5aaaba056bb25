"""Configuration, discovery, copies and reports."""

from dataclasses import dataclass, field
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrand.config import ConfigError, load_config, typed
from lodestrand.sources import readers, release, sinks


@dataclass
class Split:
    train: float = 0.7
    sizes: list[int] = field(default_factory=list)


@dataclass
class Config:
    name: str
    out: Path
    split: Split = field(default_factory=Split)
    limit: int | None = None
    flags: dict[str, bool] = field(default_factory=dict)


def test_typed_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("name: a\nout: results/x\nsplit: {train: 1, sizes: [50, 100]}\nflags: {one: true}\n")
    got = load_config(str(tmp_path / "c.yaml"), Config)
    assert got == Config("a", Path(tmp_path / "results/x"), Split(1.0, [50, 100]), None, {"one": True})
    (tmp_path / "c.json").write_text('{"name": "a", "out": "/abs", "limit": null}')
    assert load_config(str(tmp_path / "c.json"), Config).out == Path("/abs")
    for bad, text in (({"name": "a"}, "missing keys out"), ({"name": 1, "out": "x"}, "name: 1 is no str"), ({"name": "a", "out": "x", "q": 1}, "unknown keys q"), ({"name": "a", "out": "x", "split": {"sizes": [True]}}, r"split.sizes\[0\]"), ({"name": "a", "out": "x", "limit": "3"}, "limit")):
        with pytest.raises(ConfigError, match=text):
            typed(bad, Config)


def test_release_of_a_folder(spark, tmp_path):
    root = tmp_path / "r"
    (root / "models").mkdir(parents=True)
    (root / "models" / "step07_a.pkl").write_bytes(b"x" * 3_000_000)
    (root / "step10_table.csv").write_text("a,b\n1,2\n")
    found = {r["path"]: r for r in release.discover(spark, str(root), [("models/", "model"), (".csv", "table")], [("step07", "7"), ("step10", "10")]).collect()}
    assert {p: (r["category"], r["step"], r["size"]) for p, r in found.items()} == {"models/step07_a.pkl": ("model", "7", 3_000_000), "step10_table.csv": ("table", "10", 8)}
    copied = release.copy_assets(spark, str(root), str(tmp_path / "to"), ["step10_table.csv", "models/step07_a.pkl", "gone"]).collect()
    assert sorted((r["path"], r["status"]) for r in copied) == [("gone", "missing"), ("models/step07_a.pkl", "copied"), ("step10_table.csv", "copied")]
    assert (tmp_path / "to" / "models" / "step07_a.pkl").stat().st_size == 3_000_000
    assert sinks.manifest(spark, f"file://{root}").count() == 2
    df = spark.createDataFrame([("/a/b/c",), ("/x/y",)], "p string")
    assert [r[0] for r in df.select(release.relative_path(F.col("p"), "/a/b")).collect()] == ["c", "/x/y"]
    assert release.versions(["pyspark", "no-such-package"])["no-such-package"] == "not installed"
    got = release.report("t", {"n": float("nan"), "one": spark.range(1), "many": spark.range(5)}, most=3)
    assert got["n"] is None and got["one"] == {"id": 0} and got["many"]["complete"] is False and len(got["many"]["rows"]) == 3


def test_files_of_a_shared_system(spark, tmp_path):
    assert readers.file_size(str(tmp_path / "no")) is None and readers.file_size(f"file://{tmp_path}") == -1
    for x in ("a", "b/c"):
        (tmp_path / x).mkdir(parents=True)
        (tmp_path / x / "res.csv").write_text("k,v\n1,2\n")
    got = readers.union_results(spark, str(tmp_path), ["best.csv", "res.csv"]).collect()
    assert sorted(r["source_folder"] for r in got) == ["a", "b/c"]
