"""The service's lifecycle, events and backend, log destinations, guarded stages."""

import os

import pytest
from pyspark.sql import functions as F

from mailweir.operators import processors
from mailweir.service import Backend, Events, Service
from mailweir.sinks import logs
from mailweir.sources import config
from mailweir.streaming import queries


def test_lifecycle():
    service, ran = Service(), []
    fails = [True]

    def second(_):
        ran.append(2)
        if fails[0]:
            raise OSError("no disk")

    service.on_start(lambda c: ran.append(1))
    service.on_start(second)
    with pytest.raises(RuntimeError, match="^no disk$"):
        service.start({})
    fails[0] = False
    service.start({})
    assert ran == [1, 2, 2]  # only what failed ran again
    service.on_stop(lambda: ran.append("stopped"))
    service.stop()
    service.stop()  # what stopped without an error isn't stopped again
    assert ran.count("stopped") == 1


def test_events():
    events, got = Events(), []
    events.publish("none")
    events.subscribe("t", got.append)
    events.publish("t", 1)
    events.unsubscribe("t", got.append)
    events.publish("t", 2)
    assert got == [1]


def test_backend_swaps_and_rolls_back(spark):
    service = Service()
    service.add_stage("Mark", lambda df: df.withColumn("mark", F.lit(1)))
    backend = Backend({"save_process": "mark|Debugger"}, service)
    df = spark.range(1)
    with pytest.raises(RuntimeError, match="initialized"):
        backend.process(df)
    backend.start()
    assert backend.process(df).columns == ["id", "mark"] and backend.process(df, "validate").columns == ["id"]
    assert not backend.swap({"save_process": "nothing there"}) and backend.state == "running" and backend.process(df).columns == ["id", "mark"]
    assert backend.swap({"save_process": ""}) and backend.process(df).columns == ["id"]


def test_log_destinations(tmp_path):
    path = str(tmp_path / "a.log")
    log = logs.logger(path, "info")
    assert logs.logger(path, "info") is log and logs.logger(path, "debug") is not log
    log.info("one")
    log.debug("hidden")
    os.rename(path, path + ".1")
    log.info("two")
    assert open(path).read().count("\n") == 1 and "one" in open(path + ".1").read()
    assert logs.logger("off").handlers and logs.logger(str(tmp_path / "no/dir/x.log")).handlers
    logs.write_pid(str(tmp_path / "pid"))
    assert (tmp_path / "pid").read_text() == str(os.getpid())


def test_a_stage_that_fails_on_a_message(spark):
    df = spark.createDataFrame([("a",), ("bad",)], "x string")

    def f(x):
        if x == "bad":
            raise ValueError("boom")
        return x.upper()

    assert [tuple(r["r"]) for r in df.coalesce(1).select(processors.guarded(f)("x").alias("r")).collect()] == [("A", None), (None, "storage failed: boom")]


def test_file_times_and_streams(spark, tmp_path):
    (tmp_path / "key").write_text("k")
    assert config.file_times(spark, [str(tmp_path / "key")]).first()["changed"] == int(os.path.getmtime(tmp_path / "key"))
    spark.range(5).selectExpr("id", "'x' as line").write.parquet(f"{tmp_path}/in")
    seen = []
    query = queries.start(queries.read_lines(spark, f"{tmp_path}/in", "id bigint, line string"), lambda df, batch: seen.append(df.count()), f"{tmp_path}/check")
    assert query.awaitTermination(60)
    queries.drain(query)
    assert sum(seen) == 5
