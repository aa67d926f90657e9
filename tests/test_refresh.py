"""The stream of report files: failures anywhere, repeats, later lines."""

import json

import pytest
from pyspark.errors import StreamingQueryException

from ebbmark.streaming import refresh as R


def line(code, date, long, name="GOLD"):
    return {"report_date_as_yyyy_mm_dd": date, "cftc_contract_market_code": code, "market_and_exchange_names": f"{name} - X", "open_interest_all": "100", "noncomm_positions_long_all": str(long), "noncomm_positions_short_all": "1", "traders_noncomm_long_all": "2", "traders_noncomm_short_all": "3"}


class Folder:
    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        (path / "in").mkdir()
        self.contracts = spark.createDataFrame([("1", "gold", "gold"), ("2", "oil", "oil")], "code string, alias string, expect_name_contains string")

    def add(self, name, *lines):
        (self.path / "in" / name).write_text("\n".join(map(json.dumps, lines)))

    def run(self):
        R.refresh(self.spark, f"{self.path}/in", f"{self.path}/store", f"{self.path}/checkpoint", self.contracts).awaitTermination()

    def rows(self):
        return sorted((r.code, str(r.date), r.noncomm_positions_long_all) for r in R.read_refreshed(self.spark, f"{self.path}/store").collect())


@pytest.fixture
def folder(spark, tmp_path):
    return Folder(spark, tmp_path)


FIRST = [line("1", "2024-01-02", 5), line("1", "2024-01-09", 6), line("2", "2024-01-02", 7, "OIL")]
LATER = [line("1", "2024-01-16", 8), line("1", "2024-01-09", 99), line("2", "2024-01-09", 9, "OIL")]
ALL = [("1", "2024-01-02", 5.0), ("1", "2024-01-09", 6.0), ("1", "2024-01-16", 8.0), ("2", "2024-01-02", 7.0), ("2", "2024-01-09", 9.0)]


@pytest.mark.parametrize("after", [False, True])
def test_a_batch_that_fails_about_its_commit_runs_again_to_the_same_store(folder, monkeypatch, after):
    folder.add("a.json", *FIRST)
    folder.run()
    before, commit = folder.rows(), R._commit

    def failing(spark, store, name):
        if after:
            commit(spark, store, name)
        raise RuntimeError("lost")

    folder.add("b.json", *LATER)
    monkeypatch.setattr(R, "_commit", failing)
    with pytest.raises(StreamingQueryException):
        folder.run()
    assert folder.rows() == (ALL if after else before)
    monkeypatch.undo()
    folder.run()
    assert folder.rows() == ALL
    folder.run()
    assert folder.rows() == ALL


def test_data_half_written_do_not_hide_the_rest(folder, monkeypatch):
    write = R._write_data

    def half(rows, path):
        write(rows.filter("code = '1' and date >= '2024-01-09'"), path)
        raise RuntimeError("lost")

    folder.add("a.json", *FIRST)
    monkeypatch.setattr(R, "_write_data", half)
    with pytest.raises(StreamingQueryException):
        folder.run()
    assert folder.rows() == []
    monkeypatch.undo()
    folder.run()
    assert folder.rows() == [ALL[0], ALL[1], ALL[3]]


def test_a_checkpoint_begun_anew_adds_nothing_twice(folder):
    folder.add("a.json", *FIRST)
    folder.run()
    folder.add("b.json", *LATER)
    folder.run()
    R.refresh(folder.spark, f"{folder.path}/in", f"{folder.path}/store", f"{folder.path}/other", folder.contracts).awaitTermination()
    assert folder.rows() == ALL


def test_the_later_line_wins_over_splits_and_wrong_names_stay_out(folder, spark):
    folder.add("a.json", *(line("1", f"2024-01-{1 + i % 28:02d}", i) for i in range(400)), line("2", "2024-01-02", 1, "GAS"), {"report_date_as_yyyy_mm_dd": "no date"})
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        folder.run()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    last = {1 + i % 28: float(i) for i in range(400)}
    assert folder.rows() == [("1", f"2024-01-{d:02d}", last[d]) for d in range(1, 29)]
