"""Session log: nodes, links, seals, measures, streaming."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import session_metrics as m
from plumbline.operators.sessions import (
    MESSAGE_SCHEMA,
    build_nodes,
    load_session,
    seal_sessions,
    single_session,
)
from plumbline.sources.local import inline_rows
from plumbline.streaming.session_log import (
    ingest,
    read_messages,
    read_nodes,
    read_rejects,
    read_sessions,
    write_messages,
)

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def start(s, n=0, t=0.0, q="q?"):
    return (s, n, at(t), "start", json.dumps({"question": q, "model": "alias"}))


def call(s, n, use, t=0.0, name="tool", thinking=None):
    blocks = [{"type": "thinking", "thinking": thinking}] if thinking else []
    blocks += [{"type": "text", "text": "dropped"}, {"type": "tool_use", "id": use, "name": name, "input": {"b": 1, "a": [1, 2]}}]
    return (s, n, at(t), "assistant", json.dumps({"content": blocks}))


def result(s, n, use, t=0.0, content="ok", error=None):
    block = {"type": "tool_result", "tool_use_id": use, "content": content, "is_error": error}
    return (s, n, at(t), "user", json.dumps({"content": [block]}))


def turn(s, n, t=0.0, **fields):
    return (s, n, at(t), "result", json.dumps(fields))


def custom(s, n, kind, content, meta=None, t=0.0):
    return (s, n, at(t), "custom", json.dumps({"nodes": [{"kind": kind, "content": content, "meta": meta or {}}]}))


def end(s, n, t=0.0, error=None):
    return (s, n, at(t), "end", json.dumps({"error": error}))


def messages(spark, *rows):
    return inline_rows(spark, MESSAGE_SCHEMA, list(rows)).repartition(3)


def nodes_of(spark, *rows):
    return build_nodes(messages(spark, *rows))


def listed(nodes):
    return [(r["seq"], r["kind"], r["parent_id"]) for r in nodes.orderBy("session_id", "seq").collect()]


def test_blocks_become_linked_nodes(spark):
    nodes = nodes_of(
        spark, start("s"), call("s", 1, "t1", thinking="hyp"), result("s", 2, "t1"), result("s", 3, "nope"),
        ("s", 4, at(0), "user", json.dumps({"content": "plain text"})),
        custom("s", 5, "observation", {"claim": "c"}, {"statut": "fait"}), turn("s", 6, model_usage={"b": 1, "a": 2}),
    )
    assert listed(nodes) == [
        (0, "session_root", None), (1, "thinking", "s#0"), (2, "tool_call", "s#0"), (3, "tool_result", "s#2"),
        (4, "tool_result", "s#0"), (5, "observation", "s#0"), (6, "turn_result", "s#0"),
    ]
    content = {r["kind"]: json.loads(r["content"]) for r in nodes.collect()}
    assert content["tool_call"] == {"name": "tool", "input": {"b": 1, "a": [1, 2]}}
    assert content["thinking"] == {"text": "hyp"} and content["session_root"] == {"question": "q?", "model": "alias"}
    assert content["turn_result"]["models"] == ["a", "b"] and content["turn_result"]["duration_ms"] is None


def test_result_takes_the_latest_earlier_call(spark):
    nodes = nodes_of(
        spark, start("s"), result("s", 1, "t"), call("s", 2, "t"), result("s", 3, "t"), call("s", 4, "t"), result("s", 5, "t"),
    )
    assert [p for _, k, p in listed(nodes) if k == "tool_result"] == ["s#0", "s#2", "s#4"]


def test_seal(spark):
    done = seal_sessions(
        messages(
            spark, start("open"), start("ok"), turn("ok", 1, num_turns=1, total_cost_usd=0.5),
            turn("ok", 2, num_turns=3, total_cost_usd=0.9, terminal_reason="done"), end("ok", 3, 9.0),
            start("bad"), end("bad", 1, 2.0, error="RuntimeError('boom')"),
        )
    )
    got = {r["session_id"]: r for r in done.collect()}
    assert (got["open"]["status"], got["open"]["ended_at"], got["open"]["meta"]) == ("open", None, "{}")
    assert got["ok"]["status"] == "closed" and got["ok"]["ended_at"] == at(9)
    assert json.loads(got["ok"]["meta"]) == {"num_turns": 3, "total_cost_usd": 0.9, "terminal_reason": "done"}
    assert got["bad"]["status"] == "aborted" and "boom" in json.loads(got["bad"]["meta"])["aborted_reason"]


def test_load(spark):
    rows = messages(spark, start("s"), call("s", 1, "t"), start("z"))
    sealed, nodes = seal_sessions(rows), build_nodes(rows)
    header, body = load_session(sealed, nodes, "s")
    assert header.first()["question"] == "q?" and [r["seq"] for r in body.collect()] == [0, 1]
    assert dict(body.dtypes)["ts"] == "timestamp"
    with pytest.raises(KeyError):
        load_session(sealed, nodes, "absent")
    with pytest.raises(ValueError, match="several"):
        single_session(sealed)
    with pytest.raises(ValueError, match="no session"):
        single_session(sealed.limit(0))
    assert single_session(sealed.filter("session_id = 's'")) == "s"


def test_overlapping_calls_count_once(spark):
    nodes = nodes_of(
        spark, start("s"), call("s", 1, "a", 0.0), call("s", 2, "b", 0.001), result("s", 3, "a", 2.0), result("s", 4, "b", 2.001),
        start("d"), call("d", 1, "a", 0.0), result("d", 2, "a", 1.0), call("d", 3, "b", 5.0), result("d", 4, "b", 8.0),
        start("n"), call("n", 1, "a"), start("t"), call("t", 1, "a", 0.0), result("t", 2, "a", 1.0), call("t", 3, "b", 1.0), result("t", 4, "b", 2.0),
    )
    calls = m.tool_calls(nodes)
    union = {r["session_id"]: r["union_ms"] for r in m.interval_union_ms(calls, ["session_id"], "started", "finished").collect()}
    assert union == {"s": 2001.0, "d": 4000.0, "t": 2000.0}
    unmatched = calls.filter("session_id = 'n'").first()
    assert unmatched["duration_ms"] is None and unmatched["is_error"] is None


def test_union_across_buckets(spark):
    hour = 3600.0
    spans = [(0, 3 * hour), (hour, 1.5 * hour), (2.9 * hour, 4 * hour), (9 * hour, 9 * hour + 1)]
    df = inline_rows(spark, "k int, a timestamp_ntz, b timestamp_ntz", [(1, at(a), at(b)) for a, b in spans] + [(1, at(0), None)])
    assert m.interval_union_ms(df, ["k"], "a", "b").first()["union_ms"] == (4 * hour + 1) * 1000


def test_later_result_replaces_earlier_one(spark):
    nodes = nodes_of(spark, start("s"), call("s", 1, "a"), result("s", 2, "a", 1.0, error=True), result("s", 3, "a", 3.0, error=False))
    r = m.tool_calls(nodes).first()
    assert (r["duration_ms"], r["is_error"]) == (3000.0, False)


def summary(spark, *rows):
    rows = messages(spark, *rows)
    return {r["session_id"]: r for r in m.session_summary(seal_sessions(rows), build_nodes(rows)).collect()}


def test_unknown_is_not_zero(spark):
    got = summary(
        spark, start("one"), start("two"), turn("two", 1, 2.0, duration_ms=100000, duration_api_ms=60000, total_cost_usd=0.02),
        turn("two", 2, 4.0, duration_ms=100000, duration_api_ms=60000, total_cost_usd=None),
    )
    one, two = got["one"], got["two"]
    assert one["wall_ms"] is None and one["total_cost_usd"] is None and one["total_api_ms"] is None
    assert one["total_tool_measured_ms"] is None and one["prose_chars"] is None and one["models"] == ""
    assert (two["wall_ms"], two["total_non_api_ms"], two["n_turns"]) == (4000.0, 80000, 2)
    assert (two["total_cost_usd"], two["n_unknown_cost"], two["cost_is_lower_bound"]) == (0.02, 1, True)


def test_texts_and_booleans_are_no_numbers(spark):
    nodes = nodes_of(spark, start("s"), turn("s", 1, duration_ms="12", duration_api_ms=True, usage={"input_tokens": 7.9, "output_tokens": "3"}))
    r = m.turn_metrics(nodes).first()
    assert (r["duration_ms"], r["duration_api_ms"], r["non_api_ms"]) == (None, None, None)
    assert (r["input_tokens"], r["output_tokens"]) == (7, None)


def test_degraded_cost_from_the_header(spark):
    rows = messages(spark, start("s"), turn("s", 1, total_cost_usd=0.42), end("s", 2))
    nodes = build_nodes(rows).filter("kind <> 'turn_result'")
    r = m.session_summary(seal_sessions(rows), nodes).first()
    assert (r["degraded"], r["n_turns"], r["total_cost_usd"], r["total_api_ms"]) == (True, 1, 0.42, None)


def test_outline_puts_results_under_their_call(spark):
    rows = messages(
        spark, start("s", q="why"), call("s", 1, "a", thinking="x" * 101), call("s", 2, "b", name="other"),
        result("s", 3, "a", content="first\n  result"), result("s", 4, "gone", content="lost"),
        custom("s", 5, "observation", {"claim": "c"}, {"statut": "refusé"}), end("s", 6),
    )
    lines = [r["line"] for r in m.session_outline(seal_sessions(rows), build_nodes(rows)).orderBy("line_no").collect()]
    assert lines == [
        "session s [closed] — 'why' (model=alias)", "  ├─ 💭 " + "x" * 99 + "…", '  ├─ 🔧 tool({"b": 1, "a": [1, 2]})',
        "  │    └─ → first result", '  ├─ 🔧 other({"b": 1, "a": [1, 2]})', "  ├─ [refusé] c",
    ]


def agent(spark, *texts):
    return nodes_of(spark, start("s"), *[custom("s", i + 1, "agent_turn", {"text": t}) for i, t in enumerate(texts)])


def with_payload(prose, **payload):
    return f"{prose}\n```json\n{json.dumps(payload)}\n```"


def test_attribution_adds_up(spark):
    """Prose, questions and the rest are measured apart, and together are the whole turn."""
    told = [("Three words here", {"delta": {"a": 1}}), ("More", {"questions": [{"n": 4, "constat": "why so"}]}), ("Only prose", None)]
    turns = [prose if payload is None else with_payload(prose, **payload) for prose, payload in told]
    rows = m.output_attribution(agent(spark, *turns)).orderBy("seq").collect()
    for (prose, payload), turn, r in zip(told, turns, rows):
        questions = len(json.dumps(payload["questions"])) if payload and "questions" in payload else 0
        assert (r["prose"], r["questions"]) == (len(prose), questions)
        assert r["delta"] == len(turn) - len(prose) - questions
    totals = m.attribution_totals(m.output_attribution(agent(spark, *turns))).first()
    assert (totals["prose"], totals["delta"]) == (sum(r["prose"] for r in rows), sum(r["delta"] for r in rows))


def test_median_of_question_lengths(spark):
    lengths = (3, 50, 7, 200)
    asked = [{"n": i, "constat": "k" * (n - 1), "enjeu": "v"} for i, n in enumerate(lengths)]
    asked += [17, {"n": 9, "constat": "ab", "options": {"first": "cdef", "second": "g"}}]
    nodes = agent(spark, with_payload("Asking", questions=asked))
    assert sorted(r["chars"] for r in m.question_lengths(nodes).collect()) == sorted([*lengths, 7])
    assert m.question_length_median(m.question_lengths(nodes)).first()["median_chars"] == 7


def test_header_quotes_the_question(spark):
    asked = {"s": "it's", "t": 'a "b" it\'s', "u": "two\nlines \\"}
    rows = messages(spark, *[start(k, q=q) for k, q in asked.items()])
    got = {r["session_id"]: r["line"] for r in m.session_outline(seal_sessions(rows), build_nodes(rows)).filter("line_no = 0").collect()}
    assert all(f"— {q!r} (model=" in got[k] for k, q in asked.items())


def test_proof_counts(spark):
    rows = messages(
        spark, start("s"), custom("s", 1, "human_turn", {"text": "r"}), custom("s", 2, "curation_validated", {"dataset": "x"}, {"hash": "abc"}),
        end("s", 3), start("z"),
    )
    got = {r["session_id"]: r for r in m.proof_counts(seal_sessions(rows), build_nodes(rows)).collect()}
    assert (got["s"]["human_turns"], got["s"]["validations"], got["s"]["dataset"], got["s"]["hash"]) == (1, 1, "x", "abc")
    assert (got["z"]["status"], got["z"]["human_turns"], got["z"]["validations"]) == ("open", 0, 0)


def run_stream(spark, folder, max_files=None):
    stream = ingest(read_messages(spark, f"{folder}/in", max_files), f"{folder}/store", f"{folder}/progress")
    stream.awaitTermination()
    return f"{folder}/store"


def deliver(spark, folder, *rows):
    frame = inline_rows(spark, MESSAGE_SCHEMA, list(rows)).coalesce(1)
    target = f"{folder}/in"
    frame.write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(target)


def test_stream_equals_batch_over_several_deliveries(spark, tmp_path):
    folder = str(tmp_path)
    log = [
        [start("s"), call("s", 1, "a", 0.25, thinking="t"), start("z", t=1.0)],
        [result("s", 2, "a", 1.5), call("s", 3, "b", 2.0), call("z", 1, "a", 2.0)],
        [result("s", 4, "b", 3.0), result("z", 2, "a", 3.0), turn("s", 5, 4.0, num_turns=1, total_cost_usd=0.1), end("s", 6, 5.0)],
    ]
    for part in log:  # one delivery, one run: the third run starts from the stored progress
        deliver(spark, folder, *part)
        store = run_stream(spark, folder)
    every = [row for part in log for row in part]
    batch = build_nodes(messages(spark, *every))
    columns = ["id", "session_id", "seq", "parent_id", "kind", "content", "meta", "ts"]
    assert sorted(map(str, read_nodes(spark, store).select(columns).collect())) == sorted(map(str, batch.select(columns).collect()))
    sealed = seal_sessions(messages(spark, *every))
    assert sorted(map(str, read_sessions(spark, store).collect())) == sorted(map(str, sealed.collect()))
    assert read_rejects(spark, store).count() == 0


def test_stream_drops_repeats_and_refuses_sealed_sessions(spark, tmp_path):
    folder = str(tmp_path)
    first = [start("s"), call("s", 1, "a"), end("s", 2), call("s", 9, "late"), start("o")]
    deliver(spark, folder, *first)
    run_stream(spark, folder)
    deliver(spark, folder, call("s", 1, "a"), call("s", 3, "b"), start("o", 5), call("o", 6, "x"), call("o", 6, "x"))
    store = run_stream(spark, folder)
    kinds = sorted((r["session_id"], r["seq"], r["kind"]) for r in read_nodes(spark, store).collect())
    assert kinds == [("o", 0, "session_root"), ("o", 1, "tool_call"), ("s", 0, "session_root"), ("s", 1, "tool_call")]
    reasons = sorted((r["session_id"], r["msg_no"], r["reason"]) for r in read_rejects(spark, store).collect())
    assert reasons == [("o", 5, "session is already stored"), ("s", 3, "session is sealed"), ("s", 9, "behind the end")]
    assert {r["session_id"]: r["status"] for r in read_sessions(spark, store).collect()} == {"s": "closed", "o": "open"}


def test_repeated_batch_replaces_its_own_output(spark, tmp_path):
    from plumbline.streaming.session_log import write_batch

    store = str(tmp_path)
    one = messages(spark, start("s"), call("s", 1, "a"))
    two = messages(spark, result("s", 2, "a"))
    write_batch(one, 0, store)
    write_batch(two, 1, store)
    once = sorted(map(str, read_nodes(spark, store).collect()))
    write_batch(two, 1, store)  # as after a failure between writing and committing
    assert sorted(map(str, read_nodes(spark, store).collect())) == once


def test_messages_keep_microseconds(spark, tmp_path):
    path = str(tmp_path / "m")
    write_messages(messages(spark, start("s", t=0.123456), start("z")), path)
    stream = ingest(read_messages(spark, path, 1), str(tmp_path / "store"), str(tmp_path / "progress"))
    stream.awaitTermination()
    stamps = read_nodes(spark, str(tmp_path / "store")).agg(F.max("ts")).first()[0]
    assert stamps == at(0.123456)


def test_events_are_parsed_by_all_cores(spark):
    """The events lie in one row group: without being dealt out, a task or two parse them all."""
    from plumbline.operators.sessions import flatten_messages
    from plumbline.plans.suite.sessions import event_messages

    flat = flatten_messages(event_messages(spark, "/root/testdata/sf0.01")).filter("kind = 'tool_call'")
    tasks = flat.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 3 * spark.sparkContext.defaultParallelism
    assert max(t["count"] for t in tasks) < 2 * sum(t["count"] for t in tasks) / len(tasks)
