"""Bucketed tables: what is read back, and that untouched buckets keep their files."""

from __future__ import annotations

from pathlib import Path

from kelpline.operators import bucketed


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(f"p{i % 40}", i, "old") for i in range(400)] + [(None, 1, "old")], "k string, n long, state string")
    bucketed.create(df, path, "k", 16)
    before = files(path)
    assert sorted(map(tuple, bucketed.read(spark, path, df.schema).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    new = spark.createDataFrame([("p7", 1, "new"), ("p7", 2, "new"), ("brand", 3, "new")], df.schema)
    changed = spark.createDataFrame([("p7",), ("p8",), ("brand",), (None,)], "k string")
    touched = bucketed.replace(spark, path, "k", 16, changed, new)
    after = files(path)
    folder = lambda f: int(f.split("/")[0].split("=")[1])
    assert touched and len(touched) <= 4
    assert {f for f in before if folder(f) not in touched} == {f for f in after if folder(f) not in touched}
    assert not {f for f in before & after if folder(f) in touched}
    want = [(f"p{i % 40}", i, "old") for i in range(400) if i % 40 not in (7, 8)] + [("p7", 1, "new"), ("p7", 2, "new"), ("brand", 3, "new")]
    assert sorted(map(tuple, bucketed.read(spark, path, df.schema).collect())) == sorted(want)
    assert bucketed.replace(spark, path, "k", 16, changed.limit(0), new.limit(0)) == [] and files(path) == after


def test_a_bucket_can_lose_all_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n long")
    bucketed.create(df, path, "k", 4)
    assert len(bucketed.replace(spark, path, "k", 4, df.select("k"), df.limit(0))) == 1
    assert bucketed.read(spark, path, df.schema).collect() == [] and not files(path)
