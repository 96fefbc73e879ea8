"""Time, cost and call measures over the node table, for all sessions at once.

Unknown stays NULL and is never counted as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import (
    as_text,
    elements,
    entries,
    is_string,
    kind_of,
    member,
    number,
    quoted,
    shorten,
    spaced_json,
    spaced_json_length,
)
from plumbline.operators.extraction import parsed_turns
from plumbline.operators.ordered import running_max, running_number

_TOKENS = {
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cache_read_tokens": "cache_read_input_tokens",
    "cache_creation_tokens": "cache_creation_input_tokens",
}
# Allowance of written characters per column, and per extra turn.
CHARS_PER_COLUMN = 700
CHARS_PER_EXTRA_TURN = 150


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def _text_of(content: Column, field: str) -> Column:
    return F.get_json_object(content, f"$.{field}")


def turn_metrics(nodes: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One row per turn; with `sessions`, sessions without turns but with a known cost give one
    degraded turn that holds only that cost."""
    v = F.col("_v")
    duration = number(member(v, "$.duration_ms"), "bigint")
    api = number(member(v, "$.duration_api_ms"), "bigint")
    results = nodes.filter(F.col("kind") == "turn_result").select("session_id", "seq", "content")
    turns = running_number(results, ["session_id"], ["seq"], "turn").select(
        "session_id", "turn", F.try_parse_json("content").alias("_v")
    ).select(
        "session_id",
        "turn",
        duration.alias("duration_ms"),
        api.alias("duration_api_ms"),
        (duration - api).alias("non_api_ms"),
        number(member(v, "$.total_cost_usd")).alias("cost_usd"),
        *[number(member(v, f"$.usage.{src}"), "bigint").alias(name) for name, src in _TOKENS.items()],
        F.lit(False).alias("degraded"),
    )
    if sessions is None:
        return turns
    meta_cost = member(F.try_parse_json("meta"), "$.total_cost_usd")
    without = (
        sessions.filter(F.coalesce(kind_of(meta_cost) != "VOID", F.lit(False)))
        .join(results.select("session_id").distinct(), "session_id", "left_anti")
        .select(
            "session_id",
            F.lit(1).cast("bigint").alias("turn"),
            *[F.lit(None).cast("bigint").alias(c) for c in ("duration_ms", "duration_api_ms", "non_api_ms")],
            number(meta_cost).alias("cost_usd"),
            *[F.lit(None).cast("bigint").alias(c) for c in _TOKENS],
            F.lit(True).alias("degraded"),
        )
    )
    return turns.unionByName(without)


def tool_calls(nodes: DataFrame) -> DataFrame:
    """Every call with its last result: (session_id, id, seq, name, started, finished, duration_ms,
    is_error). Results are first reduced to one per call, then joined on the call's own id."""
    results = (
        nodes.filter(F.col("kind") == "tool_result")
        .groupBy(F.col("parent_id").alias("id"))
        .agg(F.max_by(F.struct("ts", "content"), "seq").alias("r"))
    )
    calls = nodes.filter(F.col("kind") == "tool_call").select(
        "session_id", "id", "seq", F.col("ts").alias("started"),
        F.coalesce(_text_of(F.col("content"), "name"), F.lit("?")).alias("name"),
    )
    return calls.join(results, "id", "left").select(
        "session_id", "id", "seq", "name", "started",
        F.col("r.ts").alias("finished"),
        (F.timestamp_diff("MICROSECOND", F.col("started"), F.col("r.ts")) / 1000.0).alias("duration_ms"),
        _text_of(F.col("r.content"), "is_error").cast("boolean").alias("is_error"),
    )


def calls_by_tool(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id", "name").agg(F.count(F.lit(1)).alias("n"))


def interval_union_ms(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, union_ms): time covered by the intervals of each group, overlaps counted once.

    Intervals are first reduced to the longest per start. In start order each then adds what lies
    beyond the largest end before it; the sum of these parts is the length of the union.
    """
    longest = (
        intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
        .groupBy(*keys, micros(F.col(start)).alias("_from"))
        .agg(F.max(micros(F.col(end))).alias("_to"))
    )
    # Buckets of a quarter hour of start time.
    before = running_max(longest, keys, ["_from"], "_to", "_reached", 900_000_000)
    added = F.greatest(
        F.lit(0).cast("bigint"), F.col("_to") - F.greatest(F.col("_from"), F.col("_reached"))
    )
    return before.groupBy(*keys).agg((F.sum(added) / 1000.0).alias("union_ms"))


def models_used(nodes: DataFrame) -> DataFrame:
    """(session_id, model), distinct over all turns."""
    models = F.from_json(F.get_json_object("content", "$.models"), "array<string>")
    return (
        nodes.filter(F.col("kind") == "turn_result")
        .select("session_id", F.explode(models).alias("model"))
        .distinct()
    )


def written_chars(nodes: DataFrame) -> DataFrame:
    """(session_id, prose_chars, thinking_chars); NULL where the session has no such node."""
    size = F.length(F.coalesce(_text_of(F.col("content"), "text"), F.lit("")))
    return nodes.groupBy("session_id").agg(
        F.sum(F.when(F.col("kind") == "agent_turn", size)).alias("prose_chars"),
        F.sum(F.when(F.col("kind") == "thinking", size)).alias("thinking_chars"),
    )


def wall_ms(nodes: DataFrame) -> DataFrame:
    """(session_id, wall_ms) from first to last node; one timestamp alone is no duration."""
    span = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1000.0
    return nodes.groupBy("session_id").agg(F.when(F.count("ts") >= 2, span).alias("wall_ms"))


def turn_totals(turns: DataFrame) -> DataFrame:
    """Per session: number of turns and sums of what is known. With turns of unknown cost, the total
    cost is a lower bound."""
    unknown = F.count_if(F.col("cost_usd").isNull())
    total = F.sum("cost_usd")
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        total.alias("total_cost_usd"),
        F.sum("duration_api_ms").alias("total_api_ms"),
        F.sum("non_api_ms").alias("total_non_api_ms"),
        unknown.alias("n_unknown_cost"),
        ((unknown > 0) & total.isNotNull()).alias("cost_is_lower_bound"),
        F.bool_or("degraded").alias("degraded"),
    )


def session_summary(sessions: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per session with every measure above.

    Several branches read `nodes`: pass the stored table (or settle it first).
    """
    calls = tool_calls(nodes)
    size = F.length(F.coalesce(_text_of(F.col("content"), "text"), F.lit("")))
    span = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1000.0
    base = nodes.groupBy("session_id").agg(
        F.when(F.count("ts") >= 2, span).alias("wall_ms"),
        F.count_if(F.col("kind") == "tool_call").alias("n_calls"),
        F.sum(F.when(F.col("kind") == "agent_turn", size)).alias("prose_chars"),
        F.sum(F.when(F.col("kind") == "thinking", size)).alias("thinking_chars"),
    )
    # Distinct model names per session: a handful, deduplicated before they are collected.
    models = models_used(nodes).groupBy("session_id").agg(
        F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models")
    )
    union = interval_union_ms(calls, ["session_id"], "started", "finished").withColumnRenamed(
        "union_ms", "total_tool_measured_ms"
    )
    return (
        sessions.select("session_id", "status")
        .join(base, "session_id", "left")
        .join(turn_totals(turn_metrics(nodes, sessions)), "session_id", "left")
        .join(union, "session_id", "left")
        .join(models, "session_id", "left")
        .select(
            "session_id", "status", "wall_ms", "total_cost_usd", "total_api_ms", "total_non_api_ms",
            "total_tool_measured_ms", F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
            F.coalesce("n_turns", F.lit(0)).alias("n_turns"),
            F.coalesce("n_unknown_cost", F.lit(0)).alias("n_unknown_cost"),
            F.coalesce("cost_is_lower_bound", F.lit(False)).alias("cost_is_lower_bound"),
            "prose_chars", "thinking_chars", F.coalesce("models", F.lit("")).alias("models"),
            F.coalesce("degraded", F.lit(False)).alias("degraded"),
        )
    )


def session_outline(sessions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session_id, line_no, line): header, thinking, calls with their results below, observations.

    Lines stay rows, so a session of any length is never held in one place.
    """
    content, meta = F.col("content"), F.col("meta")
    parsed = F.from_json(content, "name string, input string, text string, claim string, content string")
    args = spaced_json(F.coalesce(parsed["input"], F.lit("{}")))
    line = (
        F.when(F.col("kind") == "thinking", F.concat(F.lit("  ├─ 💭 "), shorten(F.coalesce(parsed["text"], F.lit("")))))
        .when(
            F.col("kind") == "tool_call",
            F.concat(
                F.lit("  ├─ 🔧 "), F.coalesce(parsed["name"], F.lit("?")), F.lit("("),
                shorten(args, 60), F.lit(")"),
            ),
        )
        .when(
            F.col("kind") == "tool_result",
            F.concat(F.lit("  │    └─ → "), shorten(F.coalesce(parsed["content"], F.lit("None")))),
        )
        .when(
            F.col("kind") == "observation",
            F.concat(
                F.lit("  ├─ ["), F.coalesce(_text_of(meta, "statut"), F.lit("None")), F.lit("] "),
                shorten(F.coalesce(parsed["claim"], F.lit(""))),
            ),
        )
    )
    # A result stands under its call: its parent's number is the tail of the parent id.
    parent_seq = F.substring_index("parent_id", "#", -1).cast("bigint")
    is_result = F.col("kind") == "tool_result"
    rows = nodes.filter(
        F.col("kind").isin("thinking", "tool_call", "observation") | (is_result & (parent_seq > 0))
    ).select(
        "session_id",
        F.when(is_result, parent_seq).otherwise(F.col("seq")).alias("_at"),
        F.when(is_result, F.col("seq")).otherwise(F.lit(-1)).alias("_under"),
        line.alias("line"),
    )
    header = sessions.select(
        "session_id",
        F.lit(0).cast("bigint").alias("line_no"),
        F.concat(
            F.lit("session "), "session_id", F.lit(" ["), "status", F.lit("] — "),
            F.coalesce(quoted(F.col("question")), F.lit("None")), F.lit(" (model="),
            F.coalesce("model", F.lit("None")), F.lit(")"),
        ).alias("line"),
    )
    body = running_number(rows, ["session_id"], ["_at", "_under"], "line_no")
    return header.unionByName(body.select("session_id", "line_no", "line"))


def _agent_turns(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "agent_turn").select(
        "session_id", "seq", F.coalesce(_text_of(F.col("content"), "text"), F.lit("")).alias("text")
    )


def output_attribution(nodes: DataFrame) -> DataFrame:
    """Per agent turn: characters of prose, of questions (as spaced JSON) and of the rest."""
    parsed = parsed_turns(_agent_turns(nodes), "text")
    message = F.length("message")
    asked = F.coalesce(spaced_json_length(F.col("questions")), F.lit(0))
    return parsed.select(
        "session_id",
        "seq",
        message.alias("prose"),
        asked.alias("questions"),
        F.greatest(F.lit(0), F.length("text") - message - asked).alias("delta"),
    )


def attribution_totals(attribution: DataFrame) -> DataFrame:
    """Per session: totals and the rest's share in percent."""
    total = F.sum("prose") + F.sum("questions") + F.sum("delta")
    return attribution.groupBy("session_id").agg(
        F.sum("prose").alias("prose"),
        F.sum("questions").alias("questions"),
        F.sum("delta").alias("delta"),
        F.when(total > 0, 100 * F.sum("delta") / total).otherwise(F.lit(0.0)).alias("delta_pct"),
    )


def _label_length(label: Column) -> Column:
    return F.when(is_string(label), F.length(as_text(label))).otherwise(spaced_json_length(F.to_json(label)))


def question_lengths(nodes: DataFrame) -> DataFrame:
    """(session_id, chars) per question: its text fields plus its option labels."""
    q = F.col("q")
    fields = F.map_values(entries(q))
    texts = F.aggregate(
        F.filter(fields, is_string), F.lit(0), lambda acc, v: acc + F.length(as_text(v))
    )
    options = F.map_values(entries(member(q, "$.options")))
    labels = F.aggregate(options, F.lit(0), lambda acc, v: acc + _label_length(v))
    return (
        parsed_turns(_agent_turns(nodes), "text")
        .select("session_id", F.explode(elements(F.try_parse_json("questions"))).alias("q"))
        .filter(fields.isNotNull())
        .select("session_id", (texts + F.coalesce(labels, F.lit(0))).alias("chars"))
    )


def question_length_median(lengths: DataFrame) -> DataFrame:
    """(session_id, median_chars), truncated to an integer.

    Lengths are first counted, so `percentile` keeps one counter per distinct length.
    """
    counted = lengths.groupBy("session_id", "chars").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("session_id").agg(
        F.floor(F.percentile("chars", F.lit(0.5), F.col("n"))).alias("median_chars")
    )


def delta_ratio(totals: DataFrame, written: DataFrame) -> DataFrame:
    """Characters outside prose and questions over the size of the written entry (session_id, chars)."""
    return totals.join(written, "session_id").select(
        "session_id", F.when(F.col("chars") > 0, F.col("delta") / F.col("chars")).alias("delta_ratio")
    )


def proof_counts(sessions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per session: status, human turns, validations, and dataset and hash of the first validation."""
    valid = F.when(F.col("kind") == "curation_validated", F.col("seq"))
    seen = nodes.groupBy("session_id").agg(
        F.count_if(F.col("kind") == "human_turn").alias("human_turns"),
        F.count(valid).alias("validations"),
        F.min_by(F.struct("content", "meta"), valid).alias("first"),
    )
    return sessions.select("session_id", "status").join(seen, "session_id", "left").select(
        "session_id",
        "status",
        F.coalesce("human_turns", F.lit(0)).alias("human_turns"),
        F.coalesce("validations", F.lit(0)).alias("validations"),
        _text_of(F.col("first.content"), "dataset").alias("dataset"),
        _text_of(F.col("first.meta"), "hash").alias("hash"),
    )


def chars_per_column(
    written: DataFrame, totals: DataFrame, columns: Column, extra_turns: Column
) -> DataFrame:
    """Written characters outside questions per column, against the allowance.

    `written` is `written_chars`, `totals` is `attribution_totals`; `columns` and `extra_turns`
    may be literals or columns of either.
    """
    out = F.coalesce("prose_chars", F.lit(0)) + F.coalesce("thinking_chars", F.lit(0))
    per_column = (out - F.coalesce("questions", F.lit(0))) / columns
    limit = CHARS_PER_COLUMN + CHARS_PER_EXTRA_TURN * extra_turns
    return written.join(totals.select("session_id", "questions"), "session_id", "left").select(
        "session_id",
        per_column.alias("chars_per_column"),
        limit.alias("threshold"),
        (per_column <= limit).alias("within"),
    )
