"""Check-and-explain over a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from redpen.functions.text import with_task_prefix
from redpen.operators.display import check
from redpen.operators.predict import Predictor, expand, predict_texts, tag
from redpen.session import materialize


def check_stream(
    texts: DataFrame,
    predictor: Predictor,
    out_path: str,
    checkpoint: str,
    text: str = "input_text",
    keys: tuple[str, ...] = ("sent_id",),
    available_now: bool = True,
) -> StreamingQuery:
    """Append checked texts to a parquet table, exactly once.

    The step is stateless: each micro-batch is one narrow stage, so late or
    repeated input needs no watermark.
    """
    writer = (
        check(texts, predictor, text, keys)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
    )
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def tag_stream(
    texts: DataFrame,
    predictor: Predictor,
    task_prefix: str,
    out_path: str,
    checkpoint: str,
    available_now: bool = True,
    predictions: str | None = None,
) -> StreamingQuery:
    """Predict each distinct input once: of a micro-batch, or, with ``predictions``, of the whole stream.

    ``predictions`` is a table of all inputs predicted so far. A batch predicts those it
    lacks, adds them as its own part, and looks up the rest. Every batch reads only the parts
    of batches before it and overwrites its own part and folder, so one that is repeated after a
    failure leaves no duplicates and predicts the same inputs again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{out_path}/batch={batch_id}"
        if predictions is None:
            tag(batch, predictor, task_prefix).write.mode("overwrite").parquet(target)
            return
        rows = batch.withColumn("model_input", with_task_prefix(F.col("input_text"), task_prefix))
        unique = materialize(rows.groupBy("model_input").agg(F.count("*").alias("n")), "inputs")
        missing, earlier = unique, None
        if batch_id:
            table = batch.sparkSession.read.schema("model_input STRING, prediction STRING, batch LONG").parquet(predictions)
            earlier = table.where(F.col("batch") < batch_id).drop("batch")
            missing = unique.join(earlier, "model_input", "left_anti")
        part = f"{predictions}/batch={batch_id}"
        predict_texts(missing, predictor).drop("n").write.mode("overwrite").parquet(part)
        known = batch.sparkSession.read.schema("model_input STRING, prediction STRING").parquet(part)
        if earlier is not None:
            known = known.unionByName(earlier.join(unique.select("model_input"), "model_input", "left_semi"))
        expand(rows, known, unique).write.mode("overwrite").parquet(target)

    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
