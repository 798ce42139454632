import datetime as dt
from unittest import mock

import pytest
from helpers import as_set

from fleetledger.session import scratch_path, sizing, written_once
from fleetledger.sources.snapshots import append_snapshot, read_latest_snapshot, union_history, write_results, write_snapshot
from fleetledger.sources.tables import FINANCIALS_SCHEMA, load_financials_csv, load_table

SCHEMA = "k string, v int"
DAY1, DAY2 = dt.date(2024, 1, 31), dt.date(2024, 2, 29)


def test_no_archive_is_an_empty_history(spark, rows, tmp_path):
    schema = rows([], SCHEMA).schema
    got = read_latest_snapshot(spark, str(tmp_path / "none"), schema)
    assert got.count() == 0 and got.schema == schema
    assert read_latest_snapshot(spark, str(tmp_path / "none"), schema, before=DAY1).count() == 0


def test_latest_snapshot(spark, rows, tmp_path):
    path, schema = str(tmp_path), rows([], SCHEMA).schema
    write_snapshot(rows([("a", 1)], SCHEMA), path, DAY2)
    write_snapshot(rows([("b", 2)], SCHEMA), path, DAY1)
    assert as_set(read_latest_snapshot(spark, path, schema)) == {("a", 1)}
    assert as_set(read_latest_snapshot(spark, path, schema, before=DAY2)) == {("b", 2)}
    assert read_latest_snapshot(spark, path, schema, before=DAY1).count() == 0


def test_union_history_prefers_current_rows(rows):
    current = rows([("a", 1), (None, 5)], SCHEMA)
    history = rows([("a", 9, "old"), ("b", 2, "old"), ("b", 3, "new"), (None, 4, "x")], "k string, v int, note string")
    assert as_set(union_history(current, history, ["k"])) == {("a", 1, None), ("b", 3, "new"), (None, 5, None)}


def test_append_snapshot_can_be_repeated(rows, tmp_path):
    path = str(tmp_path)
    append_snapshot(rows([("a", 1)], SCHEMA), path, DAY1, ["k"])
    for _ in range(2):
        got = append_snapshot(rows([("b", 2)], SCHEMA), path, DAY2, ["k"])
        assert as_set(got) == {("a", 1), ("b", 2)}
    # A corrected rerun replaces its own rows and leaves the older snapshot alone.
    got = append_snapshot(rows([("b", 7)], SCHEMA), path, DAY2, ["k"])
    assert as_set(got) == {("a", 1), ("b", 7)}


def test_history_keeps_columns_that_a_run_no_longer_has(rows, tmp_path):
    path = str(tmp_path)
    append_snapshot(rows([("a", 1, 5)], "k string, v int, old_type int"), path, DAY1, ["k"])
    got = append_snapshot(rows([("b", 2, 6)], "k string, v int, new_type int"), path, DAY2, ["k"])
    assert as_set(got.select("k", "v", "old_type", "new_type")) == {("a", 1, 5, None), ("b", 2, None, 6)}


def test_a_rerun_without_rows_replaces_its_date(spark, rows, tmp_path):
    path = str(tmp_path)
    append_snapshot(rows([("a", 1)], SCHEMA), path, DAY1, ["k"])
    assert append_snapshot(rows([], SCHEMA), path, DAY1, ["k"]).count() == 0
    assert read_latest_snapshot(spark, path, rows([], SCHEMA).schema).count() == 0


def test_csv_columns_are_found_by_name(spark, tmp_path):
    place = tmp_path / "shuffled.csv"
    place.write_text("Contract,unit_serial,billings,cost,ic_cost,unit_period,extra\nc,u,2,1,3,2023-01-01,x\n")
    got = load_financials_csv(spark, str(place), names={"contract_number": "Contract"})
    assert [tuple(r) for r in got.collect()] == [(dt.date(2023, 1, 1), "u", "c", 1.0, 2.0, 3.0)]
    with pytest.raises(ValueError, match="contract_number"):
        load_financials_csv(spark, str(place))


def test_named_results_and_csv(spark, rows, tmp_path):
    day = dt.date(2023, 1, 1)
    data = [(day, "u", "c", 1.5, None, 2.0)]
    frame = spark.createDataFrame(data, FINANCIALS_SCHEMA)
    places = write_results({"fin": frame}, str(tmp_path), "csv")
    assert as_set(load_financials_csv(spark, places["fin"])) == set(data)
    (tmp_path / "bad.csv").write_text("unit_period,unit_serial,contract_number,cost,billings,ic_cost\n2023-01-01,u,c,x,1,1\n")
    with pytest.raises(Exception):
        load_financials_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_load_table_from_a_catalog(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    rows([("a", 1)], SCHEMA).write.parquet(path)
    rows([("a", 1)], SCHEMA).createOrReplaceTempView("some_view")
    catalog = {
        "gl_accounts": {"path": path},
        "geo_metadata": {"table": "some_view"},
        "service_case": {"format": "parquet", "path": path, "schema": "k string"},
    }
    assert as_set(load_table(spark, "gl_accounts", catalog)) == {("a", 1)}
    assert as_set(load_table(spark, "geo_metadata", catalog)) == {("a", 1)}
    assert as_set(load_table(spark, "service_case", catalog)) == {("a",)}
    with pytest.raises(KeyError):
        load_table(spark, "unknown", catalog)


def test_scratch_follows_the_checkpoint_setting(spark, rows):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path != scratch_path(spark, "x")
    if root:
        assert path.startswith(f"{root.rstrip('/')}/x-")
    frame = rows([("a", 1)], SCHEMA)
    kept = written_once(frame, "t")
    assert as_set(kept) == {("a", 1)} and kept.schema == frame.schema
    assert all("/t-" in name for name in kept.inputFiles())


def test_a_cluster_session_needs_a_shared_folder():
    class Conf:
        @staticmethod
        def get(name, default):
            return default

    class Session:
        conf = Conf
        sparkContext = mock.MagicMock(master="yarn")

    Session.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session, "x")


def test_sizing_bounds_partitions_and_uses_all_cores():
    assert sizing(100 << 40, 4000)["spark.sql.shuffle.partitions"] == str((100 << 40) // (128 << 20))
    assert sizing(1 << 20, 8)["spark.sql.shuffle.partitions"] == "16"


def test_a_write_that_dies_before_publishing_leaves_the_old_snapshot(spark, rows, tmp_path):
    from fleetledger.sources.snapshots import publish_snapshot, stage_snapshot

    path = str(tmp_path / "safe")
    schema = "k string, v int"
    write_snapshot(rows([("a", 1)], schema), path, DAY1)
    # The job dies after staging the same date and a later one, before publishing either.
    stage_snapshot(rows([("a", 2)], schema), path)
    stage_snapshot(rows([("b", 3)], schema), path)
    latest = read_latest_snapshot(spark, path, rows([], schema).schema)
    assert as_set(latest) == {("a", 1)}
    # A run that completes replaces the date.
    attempt = stage_snapshot(rows([("a", 4)], schema), path)
    publish_snapshot(spark, path, DAY1, attempt)
    assert as_set(read_latest_snapshot(spark, path, rows([], schema).schema)) == {("a", 4)}
