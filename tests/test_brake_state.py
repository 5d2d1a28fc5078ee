"""What the live brake keeps as state."""

from pyspark.sql import functions as F

from quietroom.sources.storage import new_folder
from quietroom.streaming import brake as B
from quietroom.streaming import live
from tests.test_live import VERDICTS, fed


def test_only_seconds_with_bans_or_resets_become_state(spark):
    rows = [(i, 10 * i, ("delete", "report", None, "ban", B.RESET)[i % 5]) for i in range(100)]
    path = new_folder(spark, "out")
    # the last row, a heartbeat, must move the watermark all the same
    stream = B.stream_brakes(fed(spark, VERDICTS, [rows, [(None, 5000, None)]]), 1, 60, late="1 second")
    query = live.start_offence_sink(stream, path, new_folder(spark, "cp"), True)
    query.awaitTermination()
    counted = [op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]
               if op["operatorName"] == "stateStoreSave"]
    assert sum(counted) == 40
    got = spark.read.parquet(path)
    assert got.filter("braked").count() == 20 and got.filter("NOT braked").count() == 20
    assert got.agg(F.max("ts_s")).first()[0] == 990
