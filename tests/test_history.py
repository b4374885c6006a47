from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from wirelens.schema import RUN_RECORDS
from wirelens.sources import history


def record(run, **changes):
    made = {"run_id": run, "schema_version": 1, "analyzer_version": "1.0", "environment": "lab", "parse_status": "complete", "counts": [("m", 3)], "durations": [("d", timedelta(seconds=2))], "findings": [("x", "m", 1, None, [(4,)])]}
    return tuple((made | changes)[f.name] for f in RUN_RECORDS)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RUN_RECORDS)


def held(spark, path):
    return sorted(map(str, history.read(spark, path).collect()))


def test_a_rerun_changes_nothing_and_another_record_is_refused(spark, tmp_path):
    path = str(tmp_path / "h")
    assert held(spark, path) == []
    assert history.append(frame(spark, record("a"), record("b"), record("b"), record(None)), path) == 3
    first, files = held(spark, path), sorted(p.name for p in (tmp_path / "h").rglob("*"))
    assert history.append(frame(spark, record("b"), record("a"), record(None)), path) == 0
    assert held(spark, path) == first and sorted(p.name for p in (tmp_path / "h").rglob("*")) == files
    assert history.append(frame(spark, record("b"), record("c")), path) == 1
    after = held(spark, path)
    assert len(after) == 4
    for rows in ([record("d"), record("a", environment="field")], [record("d"), record("d", counts=[("m", 4)])], [record(None, counts=[])]):
        with pytest.raises(ValueError, match="1 run ids"):
            history.append(frame(spark, *rows), path)
        assert held(spark, path) == after
    assert history.append(frame(spark), path) == 0


def test_a_job_that_fails_leaves_no_row(spark, tmp_path):
    path = str(tmp_path / "h")
    history.append(frame(spark, record("a")), path)
    before = held(spark, path)
    rows = frame(spark, *(record(f"r{k}") for k in range(40))).repartition(8)
    breaks = rows.withColumn("schema_version", F.when(F.col("run_id") == "r7", F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("schema_version")))
    with pytest.raises(Exception, match="killed"):
        history.append(breaks, path)
    assert held(spark, path) == before
    # What a driver that died left behind is in no commit and so no part of the history.
    rows.write.parquet(f"{path}/data-left")
    assert held(spark, path) == before and history.append(rows, path) == 40


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer commits between the check and the commit: the check is made again."""
    path, commit = str(tmp_path / "h"), history._Folder.commit

    def late(other):
        def meets(self, number, data):
            monkeypatch.setattr(history._Folder, "commit", commit)
            history.append(other, path)
            return commit(self, number, data)

        return meets

    monkeypatch.setattr(history._Folder, "commit", late(frame(spark, record("a"), record("b"))))
    assert history.append(frame(spark, record("b"), record("c")), path) == 1
    assert len(held(spark, path)) == 3
    monkeypatch.setattr(history._Folder, "commit", late(frame(spark, record("d"))))
    with pytest.raises(ValueError):
        history.append(frame(spark, record("d", counts=[])), path)
    assert len(held(spark, path)) == 4


def test_files_of_an_older_history_stay(spark, tmp_path):
    path = str(tmp_path / "h")
    frame(spark, record("a")).write.parquet(path)
    assert history.append(frame(spark, record("a"), record("b")), path) == 1
    assert len(held(spark, path)) == 2
