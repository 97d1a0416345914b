"""Streams over tables that are folders of several files, and over none."""

import pytest

from scangrove.plans.queries import QUERIES
from scangrove.streaming import scan as stream

ROWS = [(i, f"{'eval(x)' if i % 3 else 'nothing'}\ncvv = '123'", "en", f"src{i % 2}", 9) for i in range(40)]


@pytest.fixture(params=["folder", "file"])
def tables(request, spark, tmp_path):
    """``documents`` as a folder of three files, or as one file."""
    at = tmp_path / "tables"
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    if request.param == "folder":
        docs.repartition(3).write.parquet(str(at / "documents.parquet"))
        assert len(list((at / "documents.parquet").glob("*.parquet"))) == 3
    else:
        at.mkdir()
        docs.toPandas().to_parquet(at / "documents.parquet")
    return str(at)


def test_stream_counters_of_a_table_in_parts(spark, tables):
    found = QUERIES["n1_stream_scan"](spark, tables).groupBy("repo").count().collect()
    counted = QUERIES["n3_stream_counters"](spark, tables).groupBy("repo").sum("findings").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, counted)) and sum(r["count"] for r in found) >= len(ROWS)


def test_stream_progress_of_a_table_in_parts(spark, tables):
    got = QUERIES["n3_stream_progress"](spark, tables).collect()
    assert sorted((r.repo, r.files_known, r.files_scanned) for r in got) == [("src0", 20, 20), ("src1", 20, 20)]


def empty_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    schema = spark.createDataFrame([], "repo string, file_ord long, path string, language string, size_bytes long, content string").schema
    return stream.arriving_files(spark, str(tmp_path / "none"), schema)


def test_counters_where_nothing_arrives(spark, tmp_path):
    counts = stream.run_to_table(stream.running_counts(stream.stream_findings(empty_files(spark, tmp_path))), "counts", "complete")
    assert counts.columns == ["repo", "severity", "findings"] and counts.count() == 0


def test_progress_where_nothing_arrives(spark, tmp_path):
    known = spark.createDataFrame([("r", "a"), ("r", "b")], "repo string, path string")
    row, = stream.run_progress(empty_files(spark, tmp_path), "progress", known).collect()
    assert (row.repo, row.files_known, row.files_scanned, row.critical) == ("r", 2, 0, 0)
