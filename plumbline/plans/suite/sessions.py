"""Session logs made from the given tables: events become calls, conversations become turns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import session_metrics as m
from plumbline.operators.sessions import (
    accepted_messages,
    build_nodes,
    flatten_messages,
    load_session,
    numbered,
    refused_sessions,
    seal_sessions,
)
from plumbline.plans.suite import query, table
from plumbline.session import settle, shared_folder, spread
from plumbline.streaming.session_log import ingest, read_messages, read_nodes, write_messages

# --- events as a log: one session per user ---------------------------------------------------------
# Per event: an assistant message (thinking, text, call), a result unless it is a view, then a turn
# result for purchases or an observation for clicks. Signup results name an unknown call.

_EV = """ev AS (SELECT 'u' || user_id AS session_id, user_id, event_id, ts, event_type, props,
    CAST(round(value * 100) AS BIGINT) AS cents FROM events),
  ends AS (SELECT session_id, min(ts) AS t0, max(ts) AS t1, max(event_id) AS last_event,
    any_value(user_id) AS user_id FROM ev GROUP BY 1),
  flat AS (
    SELECT session_id, -1 AS msg_no, 0 AS block_no, t0 AS ts, 'session_root' AS kind, NULL AS event_id FROM ends
    UNION ALL SELECT session_id, event_id * 4 + 1, 0, ts, 'thinking', event_id FROM ev
    UNION ALL SELECT session_id, event_id * 4 + 1, 1, ts, 'tool_call', event_id FROM ev
    UNION ALL SELECT session_id, event_id * 4 + 2, 0, ts + to_microseconds(cents * 10000), 'tool_result', event_id FROM ev WHERE event_type <> 'view'
    UNION ALL SELECT session_id, event_id * 4 + 3, 0, ts + to_microseconds(cents * 10000), 'turn_result', event_id FROM ev WHERE event_type = 'purchase'
    UNION ALL SELECT session_id, event_id * 4 + 3, 0, ts, 'observation', event_id FROM ev WHERE event_type = 'click'),
  nodes AS (SELECT f.*, row_number() OVER (PARTITION BY f.session_id ORDER BY msg_no, block_no) - 1 AS seq FROM flat f),
  calls AS (SELECT n.session_id, n.event_id, n.seq, n.ts AS started, e.event_type AS name, e.cents,
      CASE WHEN e.event_type NOT IN ('view', 'signup') THEN e.ts + to_microseconds(e.cents * 10000) END AS finished
    FROM nodes n JOIN ev e ON n.event_id = e.event_id WHERE n.kind = 'tool_call'),
  turns AS (SELECT n.session_id, n.seq, e.user_id, e.event_id, e.cents,
      row_number() OVER (PARTITION BY n.session_id ORDER BY n.seq) AS turn, cents * 10 AS duration_ms, cents * 6 AS duration_api_ms,
      CASE WHEN e.event_id % 5 <> 0 THEN cents / 1000.0 END AS cost_usd
    FROM nodes n JOIN ev e ON n.event_id = e.event_id WHERE n.kind = 'turn_result'),
  sess AS (SELECT session_id, user_id, t0 AS started_at, CASE WHEN user_id % 10 <> 0 THEN t1 END AS ended_at,
      CASE user_id % 10 WHEN 0 THEN 'open' WHEN 1 THEN 'aborted' ELSE 'closed' END AS status, last_event FROM ends)"""


def event_messages(spark, folder):
    """The log as messages."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    ev = table(spark, folder, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        "user_id", "event_id", "ts", "event_type", "props", cents.alias("cents"),
    )
    rows = ev
    ev = spread(ev, "event_id")
    later = F.timestamp_add("MICROSECOND", F.col("cents") * 10000, F.col("ts"))
    call = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    quoted = F.to_json(F.struct(F.col("props").alias("t")))
    text = F.regexp_replace(F.regexp_replace(quoted, r'^\{"t":', ""), r"\}$", "")
    assistant = F.concat(
        F.lit('{"content":[{"type":"thinking","thinking":'), text,
        F.lit('},{"type":"text","text":"dropped"},{"type":"tool_use","id":"'), call,
        F.lit('","name":"'), F.col("event_type"), F.lit('","input":'), F.col("props"), F.lit("}]}"),
    )
    result = F.concat(
        F.lit('{"content":[{"type":"tool_result","tool_use_id":"'),
        F.when(F.col("event_type") == "signup", F.lit("unknown")).otherwise(call),
        F.lit('","content":"v='), F.col("cents").cast("string"), F.lit('","is_error":'),
        F.when(F.col("event_type") == "error", F.lit("true")).otherwise(F.lit("false")), F.lit("}]}"),
    )
    turn = F.to_json(
        F.struct(
            (F.col("cents") * 10).alias("duration_ms"),
            (F.col("cents") * 6).alias("duration_api_ms"),
            F.lit(1).alias("num_turns"),
            F.when(F.col("event_id") % 5 != 0, F.col("cents") / 1000.0).alias("total_cost_usd"),
            F.struct(
                (F.col("event_id") % 1000).alias("input_tokens"),
                (F.col("event_id") % 77).alias("output_tokens"),
                F.lit(True).alias("cache_read_input_tokens"),
                F.lit("7").alias("cache_creation_input_tokens"),
            ).alias("usage"),
            F.create_map(F.lit("base"), F.lit(1), F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")), F.lit(1)).alias("model_usage"),
            F.lit("completed").alias("terminal_reason"),
        )
    )
    claim = F.concat(F.lit("claim "), F.col("cents").cast("string"))
    observation = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.lit("observation").alias("kind"),
                    F.struct(claim.alias("claim"), F.lit("n").alias("note")).alias("content"),
                    F.struct(F.lit("fait").alias("statut")).alias("meta"),
                )
            ).alias("nodes")
        )
    )

    def message(offset, ts, kind, payload):
        return F.struct(
            (F.col("event_id") * 4 + offset).alias("msg_no"), ts.alias("ts"),
            F.lit(kind).alias("type"), payload.alias("payload"),
        )

    per_event = F.filter(
        F.array(
            message(1, F.col("ts"), "assistant", assistant),
            F.when(F.col("event_type") != "view", message(2, later, "user", result)),
            F.when(F.col("event_type") == "purchase", message(3, later, "result", turn)),
            F.when(F.col("event_type") == "click", message(3, F.col("ts"), "custom", observation)),
        ),
        lambda x: x.isNotNull(),
    )
    body = ev.select("session_id", F.inline(per_event))
    ends = rows.groupBy("session_id", "user_id").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.max("event_id").alias("last")
    )
    start = ends.select(
        "session_id", F.lit(-1).cast("bigint").alias("msg_no"), F.col("t0").alias("ts"),
        F.lit("start").alias("type"),
        F.to_json(F.struct(F.concat(F.lit("q "), "session_id").alias("question"), F.lit("alias").alias("model"))).alias("payload"),
    )
    end = ends.filter(F.col("user_id") % 10 != 0).select(
        "session_id", (F.col("last") * 4 + 4).alias("msg_no"), F.col("t1").alias("ts"),
        F.lit("end").alias("type"),
        F.when(F.col("user_id") % 10 == 1, F.lit('{"error":"boom"}')).otherwise(F.lit('{"error":null}')).alias("payload"),
    )
    return start.unionByName(body).unionByName(end)


def event_nodes(spark, folder):
    return build_nodes(event_messages(spark, folder))


def stored_nodes(messages):
    """Nodes as measures find them: in a table, not in a plan that every branch runs again."""
    return settle(build_nodes(messages))


def _sql(select: str, more: str = "") -> str:
    return f"WITH {_EV}{more} {select}"


_NODE_SQL = _sql(
    """SELECT session_id || '#' || seq AS id, session_id, seq, kind,
    CASE WHEN seq = 0 THEN NULL WHEN kind = 'tool_result' AND parent IS NOT NULL THEN session_id || '#' || parent
      ELSE session_id || '#0' END AS parent_id, ts
    FROM (SELECT n.*, c.seq AS parent FROM nodes n LEFT JOIN calls c ON n.kind = 'tool_result' AND n.event_id = c.event_id AND c.finished IS NOT NULL)"""
)


@query("ses_nodes", _NODE_SQL)
def ses_nodes(spark, folder):
    return event_nodes(spark, folder).select("id", "session_id", "seq", "kind", "parent_id", "ts")


@query("ses_flat", _sql("SELECT kind, count(*) AS n, min(msg_no) AS first FROM flat GROUP BY 1"))
def ses_flat(spark, folder):
    return flatten_messages(event_messages(spark, folder)).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("msg_no").alias("first")
    )


@query("ses_node_ids", _sql("SELECT session_id || '#' || seq AS id, msg_no, block_no FROM nodes"))
def ses_node_ids(spark, folder):
    flat = settle(flatten_messages(event_messages(spark, folder)).select("session_id", "msg_no", "block_no"))
    return numbered(flat).select("id", "msg_no", "block_no")


@query(
    "ses_parent",
    _sql(
        """SELECT CASE WHEN e.event_type = 'signup' THEN 'root' ELSE 'call' END AS target, count(*) AS n
        FROM nodes n JOIN ev e ON n.event_id = e.event_id WHERE n.kind = 'tool_result' GROUP BY 1"""
    ),
)
def ses_parent(spark, folder):
    nodes = event_nodes(spark, folder).filter(F.col("kind") == "tool_result")
    at_root = F.endswith("parent_id", F.lit("#0"))
    return nodes.groupBy(F.when(at_root, "root").otherwise("call").alias("target")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "ses_custom",
    _sql(
        """SELECT n.session_id, n.seq, 'claim ' || e.cents AS claim, 'fait' AS statut
        FROM nodes n JOIN ev e ON n.event_id = e.event_id WHERE n.kind = 'observation'"""
    ),
)
def ses_custom(spark, folder):
    nodes = event_nodes(spark, folder).filter(F.col("kind") == "observation")
    return nodes.select(
        "session_id", "seq", F.get_json_object("content", "$.claim").alias("claim"),
        F.get_json_object("meta", "$.statut").alias("statut"),
    )


@query(
    "ses_sealed",
    _sql(
        """SELECT s.session_id, 'q ' || s.session_id AS question, 'alias' AS model, started_at, ended_at, status,
        CASE WHEN status = 'closed' THEN (SELECT arg_max(coalesce(t.cost_usd, -1), t.turn) FROM turns t WHERE t.session_id = s.session_id) END AS last_cost,
        CASE WHEN status = 'aborted' THEN 'boom' END AS aborted_reason FROM sess s"""
    ),
)
def ses_sealed(spark, folder):
    sealed = seal_sessions(event_messages(spark, folder))
    cost = F.coalesce(F.get_json_object("meta", "$.total_cost_usd").cast("double"), F.lit(-1.0))
    known = F.get_json_object("meta", "$.num_turns").isNotNull() & (F.col("status") == "closed")
    return sealed.select(
        "session_id", "question", "model", "started_at", "ended_at", "status",
        F.when(known, cost).alias("last_cost"),
        F.get_json_object("meta", "$.aborted_reason").alias("aborted_reason"),
    )


@query(
    "ses_refused",
    _sql("SELECT DISTINCT session_id FROM ev WHERE user_id % 3 = 0"),
)
def ses_refused(spark, folder):
    incoming = event_messages(spark, folder)
    number = F.substring("session_id", 2, 20).cast("bigint")
    stored = seal_sessions(incoming).filter(number % 3 == 0)
    return refused_sessions(incoming, stored)


@query(
    "ses_accepted",
    _sql("SELECT session_id, count(*) AS n FROM flat f JOIN (SELECT DISTINCT session_id, user_id FROM ev) USING (session_id) WHERE user_id % 3 <> 0 AND kind <> 'session_root' AND kind <> 'tool_call' GROUP BY 1"),
)
def ses_accepted(spark, folder):
    """Messages of new sessions; an assistant message counts once for its two nodes."""
    incoming = event_messages(spark, folder)
    number = F.substring("session_id", 2, 20).cast("bigint")
    stored = seal_sessions(incoming).filter(number % 3 == 0)
    kept = accepted_messages(incoming, stored).filter(~F.col("type").isin("start", "end"))
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ses_load",
    _sql("SELECT seq, kind, ts FROM nodes WHERE session_id = 'u1' ORDER BY seq"),
)
def ses_load(spark, folder):
    messages = event_messages(spark, folder)
    _, body = load_session(seal_sessions(messages), build_nodes(messages), "u1")
    return body.select("seq", "kind", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "ses_turns",
    _sql(
        """SELECT session_id, turn, duration_ms, duration_api_ms, duration_ms - duration_api_ms AS non_api_ms, cost_usd,
        event_id % 1000 AS input_tokens, event_id % 77 AS output_tokens,
        CAST(NULL AS BIGINT) AS cache_read_tokens, CAST(NULL AS BIGINT) AS cache_creation_tokens, false AS degraded FROM turns"""
    ),
)
def ses_turns(spark, folder):
    return m.turn_metrics(event_nodes(spark, folder))


@query(
    "ses_degraded",
    _sql(
        """SELECT s.session_id, 1 AS turn, arg_max(t.cost_usd, t.turn) AS cost_usd, true AS degraded FROM sess s JOIN turns t USING (session_id)
        WHERE s.status = 'closed' GROUP BY 1 HAVING arg_max(coalesce(t.cost_usd, -1), t.turn) >= 0"""
    ),
)
def ses_degraded(spark, folder):
    """Sessions whose turn nodes are gone fall back to the cost in their header."""
    messages = event_messages(spark, folder)
    nodes = stored_nodes(messages).filter(F.col("kind") != "turn_result")
    sealed = seal_sessions(messages).filter(F.col("status") == "closed")
    return m.turn_metrics(nodes, sealed).select("session_id", F.col("turn").cast("int"), "cost_usd", "degraded")


@query(
    "ses_tools",
    _sql(
        """SELECT session_id, session_id || '#' || seq AS id, name, CASE WHEN finished IS NOT NULL THEN CAST(cents * 10.0 AS DOUBLE) END AS duration_ms,
        CASE WHEN finished IS NOT NULL THEN name = 'error' END AS is_error FROM calls"""
    ),
)
def ses_tools(spark, folder):
    return m.tool_calls(stored_nodes(event_messages(spark, folder))).select(
        "session_id", "id", "name", "duration_ms", "is_error"
    )


@query("ses_calls", _sql("SELECT session_id, name, count(*) AS n FROM calls GROUP BY 1, 2"))
def ses_calls(spark, folder):
    return m.calls_by_tool(m.tool_calls(stored_nodes(event_messages(spark, folder))))


_UNION = """, iv AS (SELECT session_id, epoch_us(started) AS a, max(epoch_us(finished)) AS b FROM calls WHERE finished IS NOT NULL GROUP BY 1, 2),
  ru AS (SELECT session_id, a, b, max(b) OVER (PARTITION BY session_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM iv),
  isl AS (SELECT *, sum(CASE WHEN reached IS NULL OR a > reached THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY a) AS g FROM ru),
  uni AS (SELECT session_id, CAST(sum(w) AS BIGINT) / 1000.0 AS union_ms FROM (SELECT session_id, g, max(b) - min(a) AS w FROM isl GROUP BY 1, 2) GROUP BY 1)"""


@query("ses_union", _sql("SELECT session_id, union_ms FROM uni", _UNION))
def ses_union(spark, folder):
    calls = m.tool_calls(stored_nodes(event_messages(spark, folder)))
    return m.interval_union_ms(calls, ["session_id"], "started", "finished")


@query("ses_wall", _sql("SELECT session_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0 AS wall_ms FROM nodes GROUP BY 1"))
def ses_wall(spark, folder):
    return m.wall_ms(event_nodes(spark, folder))


@query("ses_models", _sql("SELECT DISTINCT session_id, unnest(['base', 'm' || event_id % 4]) AS model FROM turns"))
def ses_models(spark, folder):
    return m.models_used(event_nodes(spark, folder))


_TOTALS = """SELECT session_id, count(*) AS n_turns, round(sum(cost_usd), 6) AS total_cost_usd, CAST(sum(duration_api_ms) AS BIGINT) AS total_api_ms,
  CAST(sum(duration_ms - duration_api_ms) AS BIGINT) AS total_non_api_ms, count(*) FILTER (WHERE cost_usd IS NULL) AS n_unknown_cost,
  count(*) FILTER (WHERE cost_usd IS NULL) > 0 AND sum(cost_usd) IS NOT NULL AS cost_is_lower_bound, false AS degraded FROM turns GROUP BY 1"""


@query("ses_totals", _sql(_TOTALS))
def ses_totals(spark, folder):
    totals = m.turn_totals(m.turn_metrics(event_nodes(spark, folder)))
    return totals.withColumn("total_cost_usd", F.round("total_cost_usd", 6))


@query(
    "ses_summary",
    _sql(
        """SELECT s.session_id, s.status, w.wall_ms, t.total_cost_usd, t.total_api_ms, t.total_non_api_ms, u.union_ms AS total_tool_measured_ms,
        w.n_calls, coalesce(t.n_turns, 0) AS n_turns, coalesce(t.n_unknown_cost, 0) AS n_unknown_cost,
        coalesce(t.cost_is_lower_bound, false) AS cost_is_lower_bound, CAST(NULL AS BIGINT) AS prose_chars, w.thinking_chars,
        coalesce(md.models, '') AS models, false AS degraded
        FROM sess s JOIN (SELECT n.session_id, (epoch_us(max(n.ts)) - epoch_us(min(n.ts))) / 1000.0 AS wall_ms,
            count(*) FILTER (WHERE n.kind = 'tool_call') AS n_calls,
            CAST(sum(length(e.props)) FILTER (WHERE n.kind = 'thinking') AS BIGINT) AS thinking_chars
          FROM nodes n LEFT JOIN ev e ON n.event_id = e.event_id GROUP BY 1) w USING (session_id)
        LEFT JOIN (""" + _TOTALS + """) t USING (session_id) LEFT JOIN uni u USING (session_id)
        LEFT JOIN (SELECT session_id, string_agg(model, ',' ORDER BY model) AS models FROM
          (SELECT DISTINCT session_id, unnest(['base', 'm' || event_id % 4]) AS model FROM turns) GROUP BY 1) md USING (session_id)""",
        _UNION,
    ),
)
def ses_summary(spark, folder):
    messages = event_messages(spark, folder)
    out = m.session_summary(seal_sessions(messages), stored_nodes(messages))
    return out.withColumn("total_cost_usd", F.round("total_cost_usd", 6))


@query(
    "ses_outline",
    _sql(
        """SELECT session_id, 0 AS line_no, 'session ' || session_id || ' [' || status || '] — ''q ' || session_id || ''' (model=alias)' AS line FROM sess
        UNION ALL SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY at_seq, under) AS line_no, line FROM (
          SELECT n.session_id, n.seq AS at_seq, -1 AS under, CASE n.kind WHEN 'thinking' THEN '  ├─ 💭 ' || e.props
              WHEN 'tool_call' THEN '  ├─ 🔧 ' || e.event_type || '(' || e.props || ')'
              ELSE '  ├─ [fait] claim ' || e.cents END AS line
            FROM nodes n JOIN ev e ON n.event_id = e.event_id WHERE n.kind IN ('thinking', 'tool_call', 'observation')
          UNION ALL SELECT n.session_id, c.seq, n.seq, '  │    └─ → v=' || c.cents
            FROM nodes n JOIN calls c ON n.event_id = c.event_id WHERE n.kind = 'tool_result' AND c.finished IS NOT NULL)"""
    ),
)
def ses_outline(spark, folder):
    messages = event_messages(spark, folder)
    return m.session_outline(seal_sessions(messages), stored_nodes(messages))


@query("ses_ingest_stream", _NODE_SQL)
def ses_ingest_stream(spark, folder):
    """The same nodes by way of JSON message files and a structured stream."""
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    write_messages(event_messages(spark, folder), f"{base}/messages")
    stream = ingest(read_messages(spark, f"{base}/messages"), f"{base}/store", f"{base}/progress")
    stream.awaitTermination()
    return read_nodes(spark, f"{base}/store").select("id", "session_id", "seq", "kind", "parent_id", "ts")


# --- conversations as a log: agent and human turns -------------------------------------------------
# Assistant texts get a payload block behind them (0), none (1), one before them (2), or an
# illustration and a payload with two questions (3).

_LETTERS_SQL = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"
_TURN_SQL = f"""(SELECT 'c' || conv_id AS session_id, conv_id, turn, role, text, (conv_id + turn) % 4 AS shape, s,
  CASE (conv_id + turn) % 4
    WHEN 0 THEN text || chr(10) || '```json' || chr(10) || '{{"fiche_delta":{{"columns":{{"c' || turn || '":{{"sens":"' || s || '"}}}}}},"questions":[{{"n":' || turn || ',"colonne":"c' || turn || '","constat":"' || s || '"}}],"proposes_completion":false}}' || chr(10) || '```'
    WHEN 1 THEN text
    WHEN 2 THEN '```json' || chr(10) || '{{"fiche_delta":null,"proposes_completion":true}}' || chr(10) || '```' || chr(10) || text
    ELSE '```yaml' || chr(10) || 'a: b' || chr(10) || '```' || chr(10) || text || chr(10) || '```json' || chr(10) || '{{"fiche_delta":{{}},"questions":[{{"n":1,"constat":"' || s || '","enjeu":"e","options":{{"a":"x","b":"yy"}}}},{{"constat":"z"}},5]}}' || chr(10) || '```' || chr(10) || 'Fin.'
  END AS body FROM (SELECT *, {_LETTERS_SQL} AS s FROM conversations))"""


def agent_texts(spark, folder):
    """Every conversation row with its assembled `body`."""
    s = F.regexp_replace("text", "[^A-Za-z ]", "")
    rows = table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"),
        "conv_id", "turn", "role", "text", s.alias("s"), F.col("turn").cast("string").alias("t"),
    )
    fence = F.lit("\n```")
    delta = F.concat(
        "text", F.lit('\n```json\n{"fiche_delta":{"columns":{"c'), "t", F.lit('":{"sens":"'), "s",
        F.lit('"}}},"questions":[{"n":'), "t", F.lit(',"colonne":"c'), "t", F.lit('","constat":"'), "s",
        F.lit('"}],"proposes_completion":false}'), fence,
    )
    before = F.concat(F.lit('```json\n{"fiche_delta":null,"proposes_completion":true}\n```\n'), "text")
    two = F.concat(
        F.lit("```yaml\na: b\n```\n"), "text",
        F.lit('\n```json\n{"fiche_delta":{},"questions":[{"n":1,"constat":"'), "s",
        F.lit('","enjeu":"e","options":{"a":"x","b":"yy"}},{"constat":"z"},5]}'), fence, F.lit("\nFin."),
    )
    shape = (F.col("conv_id") + F.col("turn")) % 4
    body = F.when(shape == 0, delta).when(shape == 1, F.col("text")).when(shape == 2, before).otherwise(two)
    return rows.withColumn("body", body).drop("t")


def conversation_messages(spark, folder):
    rows = agent_texts(spark, folder)
    kind = F.when(F.col("role") == "assistant", "agent_turn").when(F.col("role") == "user", "human_turn").otherwise("thinking")
    text = F.when(F.col("role") == "assistant", F.col("body")).otherwise(F.col("text"))
    node = F.struct(kind.alias("kind"), F.struct(text.alias("text")).alias("content"))
    ts = F.timestamp_add("SECOND", F.col("turn"), F.lit("2024-01-01").cast("timestamp_ntz"))
    turns = rows.select(
        "session_id", F.col("turn").alias("msg_no"), ts.alias("ts"), F.lit("custom").alias("type"),
        F.to_json(F.struct(F.array(node).alias("nodes"))).alias("payload"),
    )
    ends = rows.groupBy("session_id", "conv_id").agg(F.max("turn").alias("last"))
    start = ends.select(
        "session_id", F.lit(-1).cast("bigint").alias("msg_no"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
        F.lit("start").alias("type"), F.lit('{"question":"q"}').alias("payload"),
    )
    valid = F.struct(
        F.lit("curation_validated").alias("kind"),
        F.struct(F.col("session_id").alias("dataset")).alias("content"),
        F.struct(F.md5("session_id").alias("hash")).alias("meta"),
    )
    proof = ends.filter(F.col("conv_id") % 2 == 0).select(
        "session_id", (F.col("last") + 1).alias("msg_no"), F.lit("2024-01-02").cast("timestamp_ntz").alias("ts"),
        F.lit("custom").alias("type"), F.to_json(F.struct(F.array(valid).alias("nodes"))).alias("payload"),
    )
    end = ends.select(
        "session_id", (F.col("last") + 2).alias("msg_no"), F.lit("2024-01-02").cast("timestamp_ntz").alias("ts"),
        F.lit("end").alias("type"), F.lit("{}").alias("payload"),
    )
    return start.unionByName(turns).unionByName(proof).unionByName(end)


def conversation_nodes(spark, folder):
    return stored_nodes(conversation_messages(spark, folder))


_AGENT = f"(SELECT * FROM {_TURN_SQL} WHERE role = 'assistant')"
# Parts of each shape by their known texts.
_PARTS = f"""(SELECT session_id, conv_id, turn, shape, length(body) AS total,
  CASE shape WHEN 3 THEN length(trim(text || chr(10) || chr(10) || chr(10) || 'Fin.', chr(10) || chr(9) || chr(13) || ' '))
    ELSE length(trim(text, chr(10) || chr(9) || chr(13) || ' ')) END AS prose,
  CASE shape WHEN 0 THEN length('[{{"n": ' || turn || ', "colonne": "c' || turn || '", "constat": "' || s || '"}}]')
    WHEN 3 THEN length('[{{"n": 1, "constat": "' || s || '", "enjeu": "e", "options": {{"a": "x", "b": "yy"}}}}, {{"constat": "z"}}, 5]') ELSE 0 END AS questions, s FROM {_AGENT})"""


@query("ses_chars", f"""SELECT session_id, CAST(sum(length(body)) FILTER (WHERE role = 'assistant') AS BIGINT) AS prose_chars,
  CAST(sum(length(text)) FILTER (WHERE role = 'system') AS BIGINT) AS thinking_chars FROM {_TURN_SQL} GROUP BY 1""")
def ses_chars(spark, folder):
    return m.written_chars(conversation_nodes(spark, folder))


@query(
    "ses_attribution",
    f"""SELECT session_id, turn, CAST(prose AS INTEGER) AS prose, CAST(questions AS INTEGER) AS questions,
    CAST(greatest(0, total - prose - questions) AS INTEGER) AS delta FROM {_PARTS}""",
)
def ses_attribution(spark, folder):
    out = m.output_attribution(conversation_nodes(spark, folder))
    return out.withColumn("turn", F.col("seq") - 1).drop("seq")


_ATTR = f"""SELECT session_id, CAST(sum(prose) AS BIGINT) AS prose, CAST(sum(questions) AS BIGINT) AS questions, CAST(sum(delta) AS BIGINT) AS delta,
  100 * sum(delta) / (sum(prose) + sum(questions) + sum(delta)) AS delta_pct
  FROM (SELECT *, greatest(0, total - prose - questions) AS delta FROM {_PARTS}) GROUP BY 1"""


@query("ses_attribution_totals", _ATTR)
def ses_attribution_totals(spark, folder):
    return m.attribution_totals(m.output_attribution(conversation_nodes(spark, folder)))


_LENGTHS = f"""(SELECT session_id, unnest(CASE shape WHEN 0 THEN [length('c' || turn) + length(s)]
  WHEN 3 THEN [length(s) + 1 + 3, 1] ELSE [] END) AS chars FROM {_PARTS})"""


@query("ses_question_median", f"SELECT session_id, CAST(floor(median(chars)) AS BIGINT) AS median_chars FROM {_LENGTHS} GROUP BY 1")
def ses_question_median(spark, folder):
    return m.question_length_median(m.question_lengths(conversation_nodes(spark, folder)))


@query("ses_delta_ratio", f"SELECT session_id, delta / (500 + length(session_id)) AS delta_ratio FROM ({_ATTR})")
def ses_delta_ratio(spark, folder):
    totals = m.attribution_totals(m.output_attribution(conversation_nodes(spark, folder)))
    written = totals.select("session_id", (F.lit(500) + F.length("session_id")).alias("chars"))
    return m.delta_ratio(totals, written)


@query(
    "ses_proof",
    f"""SELECT session_id, 'closed' AS status, count(*) FILTER (WHERE role = 'user') AS human_turns,
    CAST(CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS validations, CASE WHEN conv_id % 2 = 0 THEN session_id END AS dataset,
    CASE WHEN conv_id % 2 = 0 THEN md5(session_id) END AS hash FROM {_TURN_SQL} GROUP BY session_id, conv_id""",
)
def ses_proof(spark, folder):
    messages = conversation_messages(spark, folder)
    return m.proof_counts(seal_sessions(messages), build_nodes(messages))


@query(
    "ses_chars_per_column",
    f"""SELECT session_id, (coalesce(p, 0) + coalesce(t, 0) - coalesce(q, 0)) / 36 AS chars_per_column, 850 AS threshold,
    (coalesce(p, 0) + coalesce(t, 0) - coalesce(q, 0)) / 36 <= 850 AS within FROM
    (SELECT session_id, sum(length(body)) FILTER (WHERE role = 'assistant') AS p, sum(length(text)) FILTER (WHERE role = 'system') AS t FROM {_TURN_SQL} GROUP BY 1)
    LEFT JOIN (SELECT session_id, sum(questions) AS q FROM {_PARTS} GROUP BY 1) USING (session_id)""",
)
def ses_chars_per_column(spark, folder):
    nodes = conversation_nodes(spark, folder)
    totals = m.attribution_totals(m.output_attribution(nodes))
    return m.chars_per_column(m.written_chars(nodes), totals, F.lit(36), F.lit(1))
