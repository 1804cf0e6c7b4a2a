import json
import time

from pyspark.sql import functions as F

from skylattice.sources import config
from skylattice.sources.writers import Progress, caption_counters, fetch_counters


def test_counters_and_rates_of_tables(spark):
    seen = Progress(clock=iter([10.0, 14.0, 14.0]).__next__)
    tiles = spark.createDataFrame([("ok",), ("ok",), ("failed",), ("not_found",)], "status string")
    answers = spark.createDataFrame([("success",), ("failed: x",)], "status string")
    for _ in range(2):
        seen.watch(tiles, "tiles", fetch_counters()).write.format("noop").mode("overwrite").save()
    seen.watch(answers, "answers", caption_counters()).collect()
    got = seen.snapshot()
    assert {n: x for n, x in got.items() if not n.endswith("_rate")} == {"fetched": 4, "missing": 4, "captioned": 1, "uncaptioned": 1}
    assert got["fetched_rate"] == 1.0 and got["captioned_rate"] == 0.25


def test_counters_of_a_stream(spark, tmp_path):
    source, seen = str(tmp_path / "in"), Progress()
    spark.range(30).select(F.when(F.col("id") % 3 == 0, "ok").otherwise("failed").alias("status")).repartition(3).write.parquet(source)
    spark.streams.addListener(seen)
    try:
        rows = spark.readStream.schema("status string").option("maxFilesPerTrigger", 1).parquet(source)
        seen.watch(rows, "tiles", fetch_counters()).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)
        for _ in range(100):  # events come after the query has ended
            if sum(seen.streamed.values()) == 30:
                break
            time.sleep(0.1)
        assert seen.streamed == {"fetched": 10, "missing": 20} and seen.snapshot()["fetched_rate"] > 0
    finally:
        spark.streams.removeListener(seen)


def test_effective_settings_as_yaml(tmp_path):
    settings = config.load_config(None, {"model.note": "a: b # c\n", "data.no": None, "empty": {}})
    out = config.save_latest(settings, str(tmp_path / "run.yaml"))
    text = open(out).read()
    assert out.endswith("run-latest.yaml") and "\nmodel:\n" in f"\n{text}" and "  vision_layers: [3, 4, 6, 3]\n" in text and '  note: "a: b # c\\n"\n' in text and '  "no": null\n' in text and "empty: {}\n" in text
    try:
        import yaml
    except ImportError:
        pass
    else:
        assert yaml.safe_load(text) == settings
    assert json.load(open(config.save_latest(settings, str(tmp_path / "run.json")))) == settings
    assert config.save_latest(settings, out) == out
