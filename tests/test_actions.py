import datetime

import pytest
from brindle.operators import actions
from brindle.operators.merge import smart_rename
from brindle.sources.scan import scan_files
from pyspark.sql import functions as F


def test_undo_keeps_the_latest():
    stack = actions.UndoStack(3)
    for i in range(5):
        stack.push({"n": i})
    assert [stack.pop()["n"] for _ in range(3)] == [4, 3, 2] and stack.pop() is None and len(stack) == 0


def test_scan_reads_names_and_sizes(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.tar.gz").write_bytes(b"12345")
    (tmp_path / "a" / "b" / "plain").write_bytes(b"1")
    rows = {r.path: r for r in scan_files(spark, str(tmp_path), "v").collect()}
    assert set(rows) == {"/a/x.tar.gz", "/a/b/plain"}
    assert (rows["/a/x.tar.gz"].extension, rows["/a/x.tar.gz"].size_bytes, rows["/a/x.tar.gz"].allocated_bytes) == ("gz", 5, 4096)
    assert (rows["/a/b/plain"].extension, rows["/a/b/plain"].allocated_bytes) == (None, 4096)


def test_capabilities(spark):
    now = datetime.datetime(2024, 1, 1)
    rows = [(1, datetime.datetime(2025, 1, 1), ["read"], False), (2, datetime.datetime(2023, 1, 1), ["read"], False), (3, datetime.datetime(2025, 1, 1), ["write"], False), (4, datetime.datetime(2025, 1, 1), ["read"], True)]
    df = spark.createDataFrame(rows, "id int, e timestamp, p array<string>, r boolean")
    assert [r.id for r in df.where(actions.may(F.col("e"), F.col("p"), "read", F.col("r"), F.lit(now))).collect()] == [1]


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        actions.bulk_tag("rename", "t", None, None)
    with pytest.raises(ValueError):
        smart_rename(spark.range(1), "no placeholder")
