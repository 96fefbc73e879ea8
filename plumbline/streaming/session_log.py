"""Session messages as a stream, stored as append-only node batches.

Each micro-batch writes its own `batch=N` folders, so a batch that is repeated after a failure
replaces its own output and nothing else. What later batches need to know about a session is small
and append-only too: the next free number, whether it was sealed, and its calls by tool_use_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.local import inline_rows
from plumbline.operators.ordered import running_number
from plumbline.operators.sessions import (
    MESSAGE_SCHEMA,
    NODE_COLUMNS,
    flatten_messages,
    session_parts,
    sessions_from_parts,
    with_latest_call,
)
from plumbline.session import settle
from plumbline.sources.tables import path_exists

_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
_HEADS = "session_id string, next_seq bigint, started boolean, sealed boolean, batch bigint"
_CALLS = "session_id string, tool_use_id string, seq bigint, batch bigint"
_NODES = (
    "id string, session_id string, seq bigint, parent_id string, kind string, content string,"
    " meta string, ts timestamp_ntz, batch bigint"
)
_PARTS = (
    "session_id string, first_start bigint, start_payload string, started_at timestamp_ntz,"
    " ended_at timestamp_ntz, last_end bigint, end_payload string, last_result bigint,"
    " result_payload string, batch bigint"
)


def write_messages(messages: DataFrame, path: str) -> None:
    """Messages as JSON lines with full timestamps."""
    messages.write.option("timestampNTZFormat", _TIME).json(path)


def read_messages(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """Stream of JSON-lines message files."""
    reader = spark.readStream.schema(MESSAGE_SCHEMA).option("timestampNTZFormat", _TIME)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def _stored(spark: SparkSession, store: str, table: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of a stored table, of batches below `before` if given (a partition filter)."""
    path = f"{store}/{table}"
    if not path_exists(spark, path):
        return inline_rows(spark, schema, [])
    rows = spark.read.schema(schema).parquet(path)
    return rows if before is None else rows.filter(F.col("batch") < before)


def read_nodes(spark: SparkSession, store: str) -> DataFrame:
    return _stored(spark, store, "nodes", _NODES).select(*NODE_COLUMNS)


def read_sessions(spark: SparkSession, store: str) -> DataFrame:
    return sessions_from_parts(_stored(spark, store, "parts", _PARTS))


def read_rejects(spark: SparkSession, store: str) -> DataFrame:
    return _stored(spark, store, "rejects", f"{MESSAGE_SCHEMA}, reason string, batch bigint")


def write_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    """Number, link and store one micro-batch of messages.

    Messages of sealed sessions, repeated starts, messages behind an end and messages without session or
    number go to `rejects`. The batch is settled once, so a lost executor costs no second delivery.
    """
    spark = batch.sparkSession
    batch = settle(batch)
    touched = batch.select("session_id").distinct()
    heads = (
        _stored(spark, store, "heads", _HEADS, batch_id)
        .join(touched, "session_id", "left_semi")
        .groupBy("session_id")
        .agg(
            F.max("next_seq").alias("next_seq"),
            F.bool_or("started").alias("started"),
            F.bool_or("sealed").alias("sealed"),
        )
    )
    start, end = F.col("type") == "start", F.col("type") == "end"
    bounds = batch.groupBy("session_id").agg(
        F.min(F.when(start, F.col("msg_no"))).alias("first_start"),
        F.min(F.when(end, F.col("msg_no"))).alias("first_end"),
    )
    reason = (
        F.when(F.col("session_id").isNull() | F.col("msg_no").isNull(), "no session or number")
        .when(F.col("sealed"), "session is sealed")
        .when(start & F.col("started"), "session is already stored")
        .when(start & (F.col("msg_no") > F.col("first_start")), "repeated start")
        .when(F.col("msg_no") > F.col("first_end"), "behind the end")
    )
    judged = settle(
        batch.join(bounds, "session_id", "left")
        .join(heads, "session_id", "left")
        .withColumn("reason", reason)
    )
    columns = ["session_id", "msg_no", "ts", "type", "payload"]
    _put(judged.filter(F.col("reason").isNotNull()).select(*columns, "reason"), store, "rejects", batch_id)
    accepted = judged.filter(F.col("reason").isNull())
    offsets = accepted.select(
        "session_id", F.coalesce("next_seq", F.lit(0)).cast("bigint").alias("_offset")
    ).distinct()

    # Numbering reads its rows twice: payloads are parsed once.
    flat = settle(flatten_messages(accepted.select(*columns)))
    nodes = settle(
        running_number(flat, ["session_id"], ["msg_no", "block_no"], "_n")
        .join(offsets, "session_id")
        .withColumn("seq", F.col("_offset") + F.col("_n") - 1)
        .withColumn("id", F.concat_ws("#", "session_id", F.col("seq").cast("string")))
        .drop("_n", "_offset")
    )
    _put(_linked_with_stored(nodes, store, batch_id), store, "nodes", batch_id)
    calls = nodes.filter(F.col("kind") == "tool_call")
    _put(
        calls.select("session_id", F.coalesce("tool_use_id", F.lit("")).alias("tool_use_id"), "seq"),
        store, "calls", batch_id,
    )
    _put(session_parts(accepted.select(*columns)), store, "parts", batch_id)
    tops = nodes.groupBy("session_id").agg((F.max("seq") + 1).alias("top"))
    state = accepted.groupBy("session_id").agg(
        F.coalesce(F.max("next_seq"), F.lit(0)).alias("_before"),
        F.bool_or(start).alias("started"),
        F.bool_or(end).alias("sealed"),
    )
    _put(
        state.join(tops, "session_id", "left").select(
            "session_id",
            F.coalesce("top", "_before").cast("bigint").alias("next_seq"),
            "started",
            "sealed",
        ),
        store, "heads", batch_id,
    )


def _linked_with_stored(nodes: DataFrame, store: str, batch_id: int) -> DataFrame:
    """Parents as in a batch build, with calls of earlier batches as the fallback."""
    here = with_latest_call(nodes)
    wanted = (
        nodes.filter(F.col("kind") == "tool_result")
        .select("session_id", F.coalesce("tool_use_id", F.lit("")).alias("tool_use_id"))
        .distinct()
    )
    earlier = (
        _stored(nodes.sparkSession, store, "calls", _CALLS, batch_id)
        .join(wanted, ["session_id", "tool_use_id"], "left_semi")
        .groupBy("session_id", F.col("tool_use_id").alias("_use"))
        .agg(F.max("seq").alias("_stored"))
    )
    root = F.concat(F.col("session_id"), F.lit("#0"))
    latest = F.coalesce("_parent", "_stored")
    call = F.concat_ws("#", "session_id", latest.cast("string"))
    return (
        here.join(earlier, ["session_id", "_use"], "left")
        .withColumn(
            "parent_id",
            F.when(F.col("kind") == "tool_result", F.when(latest.isNotNull(), call).otherwise(root))
            .when(F.col("seq") > 0, root),
        )
        .select(*NODE_COLUMNS)
    )


def _put(rows: DataFrame, store: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{store}/{table}/batch={batch_id}")


def ingest(
    messages: DataFrame, store: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Start the ingestion; with `available_now` it stops after the present files.

    Redelivered messages are dropped by (session_id, msg_no), which the state store remembers; those
    without either are told apart by their content, so that each is rejected.
    """
    nameless = F.col("session_id").isNull() | F.col("msg_no").isNull()
    content = F.when(nameless, F.xxhash64("ts", "type", "payload"))
    writer = (
        messages.withColumn("_content", content)
        .dropDuplicates(["session_id", "msg_no", "_content"])
        .drop("_content")
        .writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, store))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
