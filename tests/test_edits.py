import datetime as dt

from pyspark.sql import functions as F

from jobloom.operators import edits

def now():
    return F.lit("2024-01-02").cast("timestamp")


def test_rename_leaves_unknown_ids(spark):
    s = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, country string")
    n = spark.createDataFrame([(2, "c"), (3, "d")], "id int, name string")
    assert sorted(tuple(r) for r in edits.rename_searches(s, n).collect()) == [(1, "a", "x"), (2, "c", "y")]
    assert [r.id for r in edits.unknown_keys(n, s, "id").collect()] == [3]


def test_one_active_run(spark):
    at = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(1, "a", "running", at), (2, "b", "completed", at)], "run_id int, definition string, status string, started_at timestamp")
    wanted = spark.createDataFrame([(3, "a"), (5, "b"), (4, "b")], "run_id int, definition string")
    out = edits.start_runs(runs, wanted, now()).filter("run_id > 2").collect()
    assert [(r.run_id, r.definition) for r in out] == [(4, "b")]


def test_sweep_and_seeds(spark):
    jobs = spark.createDataFrame([(1, "running", None), (2, "done", dt.datetime(2024, 1, 1))], "id int, status string, finished_at timestamp")
    assert sorted((r.id, r.status, r.finished_at.day) for r in edits.sweep_interrupted(jobs, now()).collect()) == [(1, "failed", 2), (2, "done", 1)]
    d = spark.createDataFrame([("a", ["x"]), ("b", ["x"])], "key string, seed_urls array<string>")
    for seed in ("x", "y"):
        d = edits.append_seed(d, "a", seed)
    assert {r.key: r.seed_urls for r in d.collect()} == {"a": ["x", "y"], "b": ["x"]}
