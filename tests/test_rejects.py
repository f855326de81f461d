"""Reads that split off what cannot be read; names that are missing."""

from pathlib import Path

import pytest
from pyspark.sql import Observation

from golden import golden_tables
from matchlens.operators import activity, series
from matchlens.plans import variants
from matchlens.sources.rejects import read_rejecting
from matchlens.sources.scratch import shared_folder
from matchlens.sources.tables import write_table


def test_lines(spark):
    actions = variants.without_player(golden_tables(spark).actions, 99)
    read = read_rejecting(spark, "actions", variants.damaged_lines(actions), "json")
    n = actions.filter("seq % 100 NOT IN (13, 14, 15)").count()
    assert read.rows.count() == n and read.rows.columns == [*actions.columns, "source_file"]
    assert read.rejects.count() == actions.count() - n
    kept = sorted(map(str, read.rows.drop("source_file").collect()))
    assert kept == sorted(map(str, actions.filter("seq % 100 NOT IN (13, 14, 15)").collect()))


@pytest.mark.parametrize("fmt, lines, bad", [
    ("json", ['{"match_id":1,"duration_us":5}', "", "garbage", "[1", '{"duration_us":5}', '{"match_id":"x"}', '{"match_id":2}'],
     [("[1", "malformed"), ("garbage", "malformed"), ('{"duration_us":5}', "no match_id"), ('{"match_id":"x"}', "malformed")]),
    ("csv", ["1,5,3,map,v", "x,5,3,map,v", ",5,3,map,v", "2,6,,,"],
     [(",5,3,map,v", "no match_id"), ("x,5,3,map,v", "malformed")]),
])
def test_reasons(spark, tmp_path, fmt, lines, bad):
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("")
    read = read_rejecting(spark, "matches", str(tmp_path), fmt)
    assert sorted(r.match_id for r in read.rows.collect()) == [1, 2]
    assert sorted((r.record, r.reason) for r in read.rejects.collect()) == bad
    assert all(r.source_file.endswith("a.txt") for r in read.rejects.collect())
    assert read.rows.select("match_id").count() == read.rows.count() == 2


def test_parquet_files(spark, tmp_path):
    actions = golden_tables(spark).actions
    write_table(actions, str(tmp_path / "t"))
    write_table(actions.filter("false").coalesce(1), str(tmp_path / "t"), mode="append")
    (Path(tmp_path) / "t" / "broken.parquet").write_bytes(b"PAR1 this is no table")
    read = read_rejecting(spark, "actions", str(tmp_path / "t"), "parquet")
    assert read.rows.count() == actions.count()
    rejects = read.rejects.collect()
    assert [(Path(r.source_file).name, r.record) for r in rejects] == [("broken.parquet", None)]
    assert rejects[0].reason.startswith("malformed")
    with pytest.raises(ValueError, match="fmt"):
        read_rejecting(spark, "actions", str(tmp_path), "orc")


def test_players_without_a_name_stay_and_are_counted(spark):
    tables = golden_tables(spark)
    plain = activity.apm_timeseries(tables.actions)
    known = plain.select("player").distinct().orderBy("player").collect()
    some = tables.players.filter(tables.players.player != known[0].player)
    missing = Observation("names")
    named = activity.apm_timeseries(tables.actions, names=some, missing=missing)
    rows = named.collect()
    assert sorted(map(str, named.drop("name").collect())) == sorted(map(str, plain.collect()))
    lost = {(r.match_id, r.player) for r in rows if r.name is None}
    assert lost and missing.get["unnamed"] == len(lost)
    assert sorted(map(str, series.with_names(plain, some).select(named.columns).collect())) == sorted(map(str, rows))


class _Session:
    """What ``shared_folder`` asks of a session."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})()


def test_folder_for_intermediate_tables():
    assert shared_folder(_Session("hdfs:///x/", "yarn")) == "hdfs:///x"
    local = _Session(None, "local[2]")
    assert shared_folder(local) == shared_folder(local) and shared_folder(local).startswith("file:///")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(_Session(None, "spark://host:7077"))
