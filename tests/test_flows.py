"""Files, models, streams, the batch job, and the SQL statements at the smallest scale."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

import parity
from curbsight import settings as S
from curbsight.functions import storage
from curbsight.functions.lineage import cut, new_table_path, scratch
from curbsight.learning import prepare, scoring, train
from curbsight.learning.registry import ModelRegistry
from curbsight.learning.store import ModelStore
from curbsight.operators import cleaning
from curbsight.plans import catalog, oracles
from curbsight.plans.job import IncidentJob
from curbsight.sources import files
from curbsight.sources.incidents import as_of_column
from curbsight.streaming import incidents as ST


def test_dirty_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,a,b\n1,"x\ny","say ""hi"""\n2,short\n3,p,q,surplus\n4,"NULL",nan\n5,,None\n')
    read = files.read_csv_text(spark, str(path), multi_line=True)
    assert files.bad_lines(read).first().skipped == 1
    out = files.ingest(spark, str(path), multi_line=True).orderBy("ordinal").collect()
    assert [(r.id, r.a, r.b) for r in out] == [
        ("1", "x\ny", 'say "hi"'), ("2", "short", None), ("4", None, None), ("5", None, None)]
    manifest = files.ingest_manifest(spark, str(path), multi_line=True).first()
    assert (manifest.n_rows, manifest.n_cols, manifest.source_file) == (4, 3, "in.csv")
    assert len(manifest.sha256) == 64 and manifest.n_bytes == path.stat().st_size
    with pytest.raises(Exception):
        files.ingest(spark, str(tmp_path / "missing.csv"))


def test_input_order_over_several_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_text("id\n" + "\n".join(str(i * 10 + j) for j in range(5)) + "\n")
    out = files.ingest(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [int(r.id) for r in out] == [i * 10 + j for i in range(3) for j in range(5)]
    assert [r.ordinal for r in out] == list(range(15))


def test_dropped_lines_leave_distinct_ordered_ordinals(spark, tmp_path):
    for name in "ab":
        lines = [f"{name}{j}" + (",surplus" if name == "a" and j in (2, 5) else "") for j in range(10)]
        (tmp_path / f"{name}.csv").write_text("id\n" + "\n".join(lines) + "\n")
    out = files.ingest(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.id for r in out] == [f"a{j}" for j in range(10) if j not in (2, 5)] + [
        f"b{j}" for j in range(10)]
    assert len({r.ordinal for r in out}) == 18


def test_split_is_stable_stratified_and_free_of_leaks(spark, sf):
    table = prepare.label_table(catalog.features_of(spark, sf), "closure")
    one = prepare.split(table, "closure").filter("is_test").select("id").toPandas()
    two = prepare.split(table.repartition(7), "closure").filter("is_test").select("id").toPandas()
    assert set(one.id) == set(two.id)
    shares = prepare.split(table, "closure").groupBy("label").agg(
        F.avg(F.col("is_test").cast("double")).alias("s")).collect()
    assert all(abs(r.s - 0.2) < 0.02 for r in shares)
    for task, spec in S.TASKS.items():
        names = sum(prepare.feature_names(task, catalog.features_of(spark, sf).columns), [])
        assert not set(names) & set(spec["leakage"]) and spec["target"] not in names


def test_train_register_load_score(spark, sf):
    known = catalog.features_of(spark, sf)
    forest = {"numTrees": 4, "maxDepth": 3}
    run = train.train_task(known, "closure", forest=forest)
    assert 0 < run["threshold"] < 1 and set(train.evaluate_task(run)) >= {"roc", "pr", "report"}
    registry = ModelRegistry(spark, new_table_path(spark, "registry"))
    registry.log_run(run)
    registry.log_run({**run, "best_model": "newer"})
    meta = registry.metadata("closure")
    assert meta["best_model"] == "newer" and meta["n_features"] == len(run["features"])
    again = {"closure": {**run, "model": registry.load("closure")}}
    a = scoring.score(known, {"closure": run}).select("id", "closure_proba").toPandas()
    b = scoring.score(known.drop("cell_repeat_count"), again).select("id", "closure_proba").toPandas()
    assert len(a) == len(b) == known.count()
    unseen = known.limit(1).withColumn("zone", F.lit("Nowhere"))
    assert scoring.score(unseen, again).count() == 1
    with pytest.raises(FileNotFoundError):
        registry.load("priority")


def test_full_training_with_selection_and_search(spark, sf):
    known = catalog.features_of(spark, sf)
    table = train.training_table(known, "resolution").filter("NOT is_test").drop("is_test")
    params, score, model = train.random_search(
        table, "resolution", "random_forest", draws=2, k=2,
        space={"numTrees": [2, 3], "maxDepth": [2]}, selector={"numTrees": 3, "maxDepth": 3})
    assert params["maxDepth"] == 2 and score < 1
    assert len(train.feature_slots(model)) == S.TOP_FEATURES
    assert train.importances(model, spark).count() == S.TOP_FEATURES


def test_requests_out_of_range_are_kept_apart(spark):
    rows = [("a", "accident", 0, 12.6, 77.2), ("b", "accident", 99, 13.0, 77.5),
            ("c", None, 23, 13.4, 77.9), ("d", "fog", None, None, None)]
    df = spark.createDataFrame(
        rows, "id string, event_cause string, hour int, latitude double, longitude double")
    got = {r.id: r.reason for r in scoring.validate_requests(df).collect()}
    assert got == {"a": "", "b": "hour out of range", "c": "event_cause missing", "d": ""}


def test_other_header_is_refused(spark, tmp_path):
    for name, header in (("a", "id,x,y"), ("b", "id,y,x")):
        (tmp_path / f"{name}.csv").write_text(f"{header}\n{name}1,2,3\n{name}2,3,4\n")
    with pytest.raises(ValueError, match="header differs"):
        files.ingest(spark, str(tmp_path))


def test_fingerprint_is_that_of_the_bytes_however_they_are_split(spark, tmp_path):
    lines = [f"{i},{'x' * (i % 90)}" for i in range(5000)]

    def prints(name, text):
        (tmp_path / name).write_bytes(text.encode())
        return files.file_fingerprints(spark, str(tmp_path / name)).first()

    whole = prints("a.csv", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5
        assert prints("b.csv", "\n".join(lines) + "\n").sha256 == whole.sha256
        changed = ["\n".join(lines), "\n".join([lines[1], lines[0], *lines[2:]]) + "\n",
                   "\n".join([*lines[:-1], lines[-1] + "x"]) + "\n", "\r\n".join(lines) + "\n"]
        digests = {prints(f"c{i}.csv", text).sha256 for i, text in enumerate(changed)}
        assert len(digests | {whole.sha256}) == len(changed) + 1
        assert prints("empty.csv", "") is None  # Spark does not list files without content
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_streams_equal_batch(spark, sf):
    raw = catalog.raw_of(spark, sf)
    prepared = cleaning.prepare(raw, as_of_column())
    want = prepared.groupBy(*S.DEDUPE_KEY).agg(F.min_by("id", "ordinal").alias("id"))
    got = catalog.stream_dedupe(spark, sf)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    days = catalog.stream_daily_counts(spark, sf)
    batch = prepared.groupBy(
        F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(S.LOCAL_ZONE), "start_datetime")).alias("date"),
        "event_cause").agg(F.count(F.lit(1)).alias("n"))
    assert days.exceptAll(batch).count() == 0 and days.count() == batch.count()
    assert days.agg(F.sum("n")).first()[0] == raw.count()


def test_earlier_report_replaces_a_later_one(spark):
    schema = "latitude double, longitude double, start_datetime timestamp_ntz, event_cause string, ordinal long, id string"
    path, out, state = (new_table_path(spark, n) for n in ("reports", "out", "state"))
    spec = spark.createDataFrame([], schema).schema
    for ordinal in (7, 3, 5):
        spark.sql(f"SELECT 1D AS latitude, 1D AS longitude, timestamp_ntz'2024-01-10 00:00:00' AS start_datetime,"
                  f" 'a' AS event_cause, {ordinal}L AS ordinal, 'r{ordinal}' AS id").write.mode("append").parquet(path)
        stream = ST.dedupe_stream(ST.read_slices(spark, path, spec))
        result = ST.run_to_end(stream, out, state, S.DEDUPE_KEY)
    assert [(r.id, r.ordinal) for r in result.collect()] == [("r3", 3)]


def test_stream_and_batch_score_alike(spark, sf):
    run = train.train_task(catalog.features_of(spark, sf), "closure", forest={"numTrees": 4, "maxDepth": 3})
    scored, rejected = catalog._streamed_requests(spark, sf, {"closure": run})
    batch = scoring.score(catalog._enriched(spark, sf), {"closure": run}).select("id", "closure_proba")
    got = scored.select("id", "closure_proba")
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0
    assert rejected.count() + got.count() == catalog._requests(spark, sf).count()
    assert rejected.filter("reason = ''").count() == 0


def test_late_rows_are_dropped(spark):
    schema = "latitude double, longitude double, start_datetime timestamp_ntz, event_cause string"
    path = new_table_path(spark, "late")
    frame = lambda rows: spark.sql("SELECT 1D AS latitude, 1D AS longitude, * FROM VALUES " + rows
                                   + " AS t(start_datetime, event_cause)")
    slices = ["(timestamp_ntz'2024-01-10 00:00:00', 'a')", "(timestamp_ntz'2024-01-20 00:00:00', 'b')",
              "(timestamp_ntz'2024-01-01 00:00:00', 'late')"]
    spec = spark.createDataFrame([], schema).schema
    out, state = new_table_path(spark, "out"), new_table_path(spark, "state")
    for rows in slices:
        frame(rows).coalesce(1).write.mode("append").parquet(path)
        stream = ST.dedupe_stream(ST.read_slices(spark, path, spec)).select("event_cause")
        result = ST.run_to_end(stream, out, state)
    assert sorted(r.event_cause for r in result.collect()) == ["a", "b"]


def test_job_builds_what_is_missing_and_exports(spark, sf, tmp_path):
    job = catalog.job_for(spark, sf)
    assert job.run(only=["quality", "allocation"]) == ["quality", "allocation"]
    plan = job.table("allocation").toPandas()
    assert plan[list(S.FLEET)].sum().to_dict() == S.FLEET
    job.export(str(tmp_path))
    assert os.path.isdir(tmp_path / "resource_allocation")
    spots = spark.read.json(str(tmp_path / "hotspots_geojson"))
    assert spots.select("type").distinct().first()[0] == "Feature"


def test_second_run_follows_new_features(spark, sf, tmp_path):
    job = IncidentJob(spark, str(tmp_path / "job"), None, as_of_column(), models=["naive"])
    whole = catalog.features_of(spark, sf)
    for features in (whole, whole.filter("xxhash64(id) % 2 = 0")):
        job._write(features, "features")
        assert job.run(only=["forecasts"]) == ["forecasts"]
        series = job.table("series").filter(F.col("scope") == S.CITY_SCOPE)
        assert series.agg(F.sum("y")).first()[0] == features.count()


def test_tables_follow_their_sources_and_failed_builds_change_nothing(spark, tmp_path, monkeypatch):
    rows = catalog.raw_of(spark, sf=parity_folder())
    half = rows.filter("ordinal % 4 < 2")
    state = {"raw": half, "version": "1"}
    root = str(tmp_path / "job")
    job = IncidentJob(spark, root, lambda: state["raw"], as_of_column(), source_version=lambda: state["version"])
    first = job.table("clean").count()
    assert job.current("clean") and job.table("clean").count() == first
    kept = job.version("clean")
    state.update(raw=rows, version="2")
    assert not job.current("clean")
    monkeypatch.setattr(cleaning, "clean", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        job.table("clean")
    assert job.version("clean") == kept and spark.read.parquet(job.path("clean")).count() == first
    monkeypatch.undo()
    assert job.table("clean").count() > first and job.version("clean") != kept


def parity_folder():
    import conftest

    return conftest.SF


def test_scratch_deletes_its_tables_also_after_an_error(spark):
    seen = []

    def write():
        path = new_table_path(spark, "gone")
        spark.range(3).write.parquet(path)
        seen.append(path)

    with scratch(spark):
        write()
        with pytest.raises(ZeroDivisionError), scratch(spark):
            write()
            raise ZeroDivisionError
        assert storage.exists(spark, seen[0]) and not storage.exists(spark, seen[1])
    assert not storage.exists(spark, seen[0])


def test_model_store_trains_once(spark, sf, tmp_path, monkeypatch):
    known = catalog.features_of(spark, sf)
    store = ModelStore(spark, str(tmp_path / "trained"))
    options = {"forest": {"numTrees": 3, "maxDepth": 3}}
    one = store.run(known, "closure", **options)
    monkeypatch.setattr(train, "train_task", lambda *a, **o: 1 / 0)
    two = store.run(known.repartition(3), "closure", **options)
    assert one["metrics"] == two["metrics"] and two["threshold"] == one["threshold"]
    assert two["importances"] and two["held_out"].count() == two["n_test"]
    with pytest.raises(ZeroDivisionError):
        store.run(known.filter("ordinal > 10"), "closure", **options)
    with pytest.raises(ZeroDivisionError):
        store.run(known, "closure", forest={"numTrees": 4, "maxDepth": 3})
    monkeypatch.setattr("curbsight.learning.store.code_version", lambda: "other code")
    with pytest.raises(ZeroDivisionError):
        store.run(known, "closure", **options)
    assert sorted(os.listdir(tmp_path / "trained")) == sorted(
        p for p in os.listdir(tmp_path / "trained") if p.startswith("closure-"))


def test_fits_of_large_tables_get_more_tasks_and_wait_for_each_other(spark):
    assert [train.partitions_for(n) for n in (0, 1_000, 600_000, 6_000_000)] == [2, 2, 6, 18]
    assert train.few_partitions(spark.range(0, 200_000, 1, 8)).rdd.getNumPartitions() == 4
    all_four, running, most = threading.Barrier(4), [], []

    def alone():
        running.append(1)
        most.append(len(running))
        time.sleep(0.1)
        running.pop()

    assert sorted(train.side_by_side([lambda: all_four.wait(20)] * 4, 1_000)) == [0, 1, 2, 3]
    train.side_by_side([alone] * 4, 5_000_000)
    assert most == [1, 1, 1, 1]


def test_folds_hold_every_class_within_one_row(spark, sf):
    table = prepare.label_table(catalog.features_of(spark, sf), "closure")
    counts = prepare.folds(table.repartition(5), 5, task="closure").groupBy("label", "fold").count().collect()
    for label in (0.0, 1.0):
        own = [r["count"] for r in counts if r.label == label]
        assert len(own) == 5 and max(own) - min(own) <= 1


def test_inner_tables_are_built_with_their_stage(spark, monkeypatch):
    built = []
    monkeypatch.setattr(IncidentJob, "build", lambda self, name: built.append(name))
    IncidentJob(spark, "", None, None).run(only=["hotspots", "forecasts"])
    assert built == ["labelled", "hotspots", "series", "tested", "forecast_metrics", "forecasts"]


def test_lineage_folder_comes_from_the_session(spark):
    assert new_table_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir", "/"))
    assert cut(spark.range(3)).count() == 3


QUICK = sorted(set(oracles.statements()) - {"spatial_impute", "clean", "dbscan_labels", "hotspots_all"})


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, name):
    con = parity.connect(sf)
    assert parity.compare(catalog.QUERIES[name](spark, sf), con, oracles.statements()[name]) is None
