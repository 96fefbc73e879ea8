"""Session log: messages to numbered, linked nodes, and one header row per session.

Messages are rows (session_id, msg_no, ts, type, payload): `type` is start, assistant, user,
result, custom or end, `payload` the JSON body. Order inside a session is msg_no, not arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import as_text, member
from plumbline.operators.ordered import running_max, running_number
from plumbline.session import settle

MESSAGE_SCHEMA = "session_id string, msg_no bigint, ts timestamp_ntz, type string, payload string"
NODE_COLUMNS = ("id", "session_id", "seq", "parent_id", "kind", "content", "meta", "ts")

_BODY = """
    question string, model string,
    content array<struct<type: string, thinking: string, id: string, name: string, input: string,
                         tool_use_id: string, content: string, is_error: boolean>>,
    nodes array<struct<kind: string, content: string, meta: string>>
"""
_KEEP_NULL = {"ignoreNullFields": "false"}


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), _KEEP_NULL)


def _with_raw(json: Column, field: str, raw: Column) -> Column:
    """The object text `json` with one more field whose value is already JSON."""
    return F.concat(F.regexp_replace(json, r"\}$", ""), F.lit(f',"{field}":'), raw, F.lit("}"))


def _node(kind: str, content: Column, meta: Column, tool_use_id: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        content.alias("content"),
        meta.alias("meta"),
        (F.lit(None).cast("string") if tool_use_id is None else tool_use_id).alias("tool_use_id"),
    )


def _block_node(b: Column) -> Column:
    none = F.lit("{}")
    call = _with_raw(_json(name=b["name"]), "input", F.coalesce(b["input"], none))
    return (
        F.when(b["type"] == "thinking", _node("thinking", _json(text=b["thinking"]), none))
        .when(b["type"] == "tool_use", _node("tool_call", call, _json(tool_use_id=b["id"]), b["id"]))
        .when(
            b["type"] == "tool_result",
            _node(
                "tool_result",
                _json(content=b["content"], is_error=b["is_error"]),
                _json(tool_use_id=b["tool_use_id"]),
                b["tool_use_id"],
            ),
        )
    )


def flatten_messages(messages: DataFrame) -> DataFrame:
    """One row per node: (session_id, msg_no, block_no, ts, kind, content, meta, tool_use_id).

    Assistant messages give thinking and tool_call nodes, user messages tool_result nodes, results a
    turn_result node, custom messages the nodes they list. Text blocks give none.
    """
    body, raw = F.col("body"), F.col("raw")
    blocks = F.filter(
        body["content"],
        lambda b: ((F.col("type") == "assistant") & b["type"].isin("thinking", "tool_use"))
        | ((F.col("type") == "user") & (b["type"] == "tool_result")),
    )
    models = F.array_sort(
        F.coalesce(
            F.map_keys(F.try_variant_get(raw, "$.model_usage", "map<string,variant>")),
            F.array().cast("array<string>"),
        )
    )
    result = _json(
        **{
            f: member(raw, f"$.{f}")
            for f in ("duration_ms", "duration_api_ms", "num_turns", "total_cost_usd", "usage")
        },
        models=models,
        terminal_reason=member(raw, "$.terminal_reason"),
    )
    nodes = (
        F.when(
            F.col("type") == "start",
            F.array(
                _node(
                    "session_root", _json(question=body["question"], model=body["model"]), F.lit("{}")
                )
            ),
        )
        .when(F.col("type").isin("assistant", "user"), F.transform(blocks, _block_node))
        .when(F.col("type") == "result", F.array(_node("turn_result", result, F.lit("{}"))))
        .when(
            F.col("type") == "custom",
            F.transform(
                body["nodes"],
                lambda n: F.struct(
                    n["kind"].alias("kind"),
                    F.coalesce(n["content"], F.lit("{}")).alias("content"),
                    F.coalesce(n["meta"], F.lit("{}")).alias("meta"),
                    F.lit(None).cast("string").alias("tool_use_id"),
                ),
            ),
        )
    )
    return (
        messages.withColumn("body", F.from_json("payload", _BODY))
        .withColumn("raw", F.when(F.col("type") == "result", F.try_parse_json("payload")))
        .select("session_id", "msg_no", "ts", F.posexplode(nodes).alias("block_no", "node"))
        .select("session_id", "msg_no", "block_no", "ts", "node.*")
    )


def numbered(flat: DataFrame) -> DataFrame:
    """Add seq (dense from 0 per session along msg_no, block_no) and id `session#seq`."""
    return running_number(flat, ["session_id"], ["msg_no", "block_no"], "seq").withColumn(
        "seq", F.col("seq") - 1
    ).withColumn("id", F.concat_ws("#", "session_id", F.col("seq").cast("string")))


def linked(nodes: DataFrame) -> DataFrame:
    """Add parent_id: a result's latest earlier call with its tool_use_id, else the root.

    An as-of lookup per (session, tool_use_id); other nodes hang from the root, the root from none.
    """
    root = F.concat(F.col("session_id"), F.lit("#0"))
    call = F.concat_ws("#", "session_id", F.col("_parent").cast("string"))
    return with_latest_call(nodes).withColumn(
        "parent_id",
        F.when(F.col("kind") == "tool_result", F.when(F.col("_parent").isNotNull(), call).otherwise(root))
        .when(F.col("seq") > 0, root),
    ).select(*NODE_COLUMNS)


def with_latest_call(nodes: DataFrame) -> DataFrame:
    """Add `_use` (the tool_use_id, empty if absent) and `_parent`, the number of the latest call with
    that id up to each node."""
    keyed = nodes.withColumn("_use", F.coalesce("tool_use_id", F.lit(""))).withColumn(
        "_call", F.when(F.col("kind") == "tool_call", F.col("seq"))
    )
    return running_max(keyed, ["session_id", "_use"], ["seq"], "_call", "_parent", inclusive=True)


def build_nodes(messages: DataFrame) -> DataFrame:
    """Messages to nodes. Flattened nodes are settled, so payloads are parsed once, and numbered ones too,
    so numbering is not repeated in each branch that links them. Messages without number come last."""
    return linked(settle(numbered(settle(flatten_messages(messages)))))


def with_custom_nodes(flat: DataFrame, custom: DataFrame) -> DataFrame:
    """Flattened messages plus nodes made elsewhere (see `observation_nodes`), before numbering."""
    extra = custom
    if "ts" not in extra.columns:
        extra = extra.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    return flat.unionByName(extra.withColumn("tool_use_id", F.lit(None).cast("string")))


def session_parts(messages: DataFrame) -> DataFrame:
    """Per session, what its header needs; parts of several batches combine by the same maxima."""
    kind = F.col("type")
    start, end, result = kind == "start", kind == "end", kind == "result"

    def at(flag: Column) -> Column:
        return F.when(flag, F.col("msg_no"))

    return messages.groupBy("session_id").agg(
        F.min(at(start)).alias("first_start"),
        F.min_by("payload", at(start)).alias("start_payload"),
        F.min(F.when(start, F.col("ts"))).alias("started_at"),
        F.max(F.when(end, F.col("ts"))).alias("ended_at"),
        F.max(at(end)).alias("last_end"),
        F.max_by("payload", at(end)).alias("end_payload"),
        F.max(at(result)).alias("last_result"),
        F.max_by("payload", at(result)).alias("result_payload"),
    )


def sessions_from_parts(parts: DataFrame) -> DataFrame:
    """(session_id, question, model, started_at, ended_at, status, meta), one row per session.

    Closed by an end message, aborted if that carries an error, else still open. Meta keeps
    turns, cost and reason of the last result, and the abort reason.
    """
    seen = parts.groupBy("session_id").agg(
        F.min_by("start_payload", "first_start").alias("_start"),
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.max("last_end").alias("_ended"),
        F.max_by("end_payload", "last_end").alias("_end"),
        F.max_by("result_payload", "last_result").alias("_result"),
    )
    result, ending = F.try_parse_json("_result"), F.try_parse_json("_end")
    error = as_text(member(ending, "$.error"))
    sealed = F.col("_ended").isNotNull()
    head = F.from_json("_start", "question string, model string")
    kept = {f: member(result, f"$.{f}") for f in ("num_turns", "total_cost_usd", "terminal_reason")}
    reason = _json(aborted_reason=error)
    meta = F.when(F.col("_result").isNotNull(), _json(**kept)).otherwise(F.lit("{}"))
    meta = (
        F.when(error.isNull(), meta)
        .when(F.col("_result").isNull(), reason)
        .otherwise(F.concat(F.regexp_replace(meta, r"\}$", ","), F.regexp_replace(reason, r"^\{", "")))
    )
    return seen.select(
        "session_id",
        head["question"].alias("question"),
        head["model"].alias("model"),
        "started_at",
        F.when(sealed, F.col("ended_at")).alias("ended_at"),
        F.when(~sealed, "open").when(error.isNotNull(), "aborted").otherwise("closed").alias("status"),
        F.when(sealed, meta).otherwise(F.lit("{}")).alias("meta"),
    )


def seal_sessions(messages: DataFrame) -> DataFrame:
    """Session headers straight from the messages."""
    return sessions_from_parts(session_parts(messages))


def refused_sessions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming session ids that are already stored, whatever their status."""
    return incoming.select("session_id").distinct().join(
        stored.select("session_id").distinct(), "session_id", "left_semi"
    )


def accepted_messages(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages of sessions that are not stored yet."""
    return incoming.join(stored.select("session_id").distinct(), "session_id", "left_anti")


def load_session(sessions: DataFrame, nodes: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    """(header row, nodes in order) of one session; timestamps come back as UTC instants."""
    header = sessions.filter(F.col("session_id") == session_id)
    if header.isEmpty():
        raise KeyError(session_id)
    instant = F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("+00:00")))
    body = (
        nodes.filter(F.col("session_id") == session_id)
        .withColumn("ts", instant)
        .withColumn("content", F.try_parse_json("content"))
        .withColumn("meta", F.try_parse_json("meta"))
        .orderBy("seq")
    )
    return header.withColumn("meta", F.try_parse_json("meta")), body


def single_session(sessions: DataFrame) -> str:
    """The only stored session id; none or several are errors."""
    ids = [r[0] for r in sessions.select("session_id").distinct().limit(2).collect()]
    if len(ids) != 1:
        raise ValueError("no session stored" if not ids else "several sessions stored: name one")
    return ids[0]
