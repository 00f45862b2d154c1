"""The guard over a stream of predictions, and a sink that writes each id once."""

from __future__ import annotations

from uuid import NAMESPACE_URL, uuid5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parse import action_to_json, parse_output
from ..functions.rules import guard_action, state_from_json
from ..operators.storage import stored
from ..sources.files import exists


def guarded(stream: DataFrame) -> DataFrame:
    """id, pred, guarded (JSON texts) of rows (id, raw, state as JSON text): no state is kept, so it serves batches and streams."""
    rows = stream.withColumn("act", parse_output(F.col("raw"))).withColumn("kept", guard_action(F.col("act"), state_from_json(F.col("state"))))
    return rows.select("id", action_to_json(F.col("act")).alias("pred"), action_to_json(F.col("kept")).alias("guarded"))


def append_once(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream's rows to JSON lines, each id once.

    Ids of earlier batches are in the checkpointed state, so no batch reads the sink. Ids that the sink has at the start are
    left out, whatever wrote them. A batch has a folder of its own and writes all of it, so one that is run again adds none.
    """
    spark = stream.sparkSession
    new = stream.dropDuplicates(["id"])
    if exists(spark, path):
        new = new.join(stored(spark.read.schema("id string").json(path).select("id"), "ids"), "id", "left_anti")
    run = uuid5(NAMESPACE_URL, checkpoint).hex

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").json(f"{path}/run={run}/batch={number}")

    writer = new.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()
