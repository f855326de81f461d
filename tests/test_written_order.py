"""Sorted reports keep their order in the files they are written to."""

from pathlib import Path

import duckdb

from matchlens.catalog import all_queries

SF_DIR = "/root/testdata/sf0.001"


def _written(spark, tmp_path, name):
    """Rows as they stand in the files, file by file."""
    found = all_queries()[name](spark, SF_DIR)
    found.write.parquet(str(tmp_path / name))
    rows = []
    for path in sorted(Path(tmp_path / name).glob("part-*.parquet")):
        columns = duckdb.sql(f"SELECT * FROM read_parquet('{path}', file_row_number = true) ORDER BY file_row_number")
        rows += [dict(zip(columns.columns, row, strict=True)) for row in columns.fetchall()]
    assert len(rows) > 10
    return rows


def test_milestones_are_written_in_time_order(spark, tmp_path):
    rows = _written(spark, tmp_path, "events_in_time_order")
    order = [(r["match_id"], r["t_us"], r["player"], r["label"]) for r in rows]
    assert order == sorted(order) and len({r["match_id"] for r in rows}) > 1


def test_types_are_written_by_frequency(spark, tmp_path):
    rows = _written(spark, tmp_path, "action_types_by_frequency")
    order = [(r["match_id"], -r["n"], r["type"]) for r in rows]
    assert order == sorted(order) and len({r["match_id"] for r in rows}) > 1
