"""Records out of free text: documents with observation arrays, conversations with payload blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import elements
from plumbline.operators import extraction as x
from plumbline.operators.sessions import flatten_messages, numbered, with_custom_nodes
from plumbline.plans.suite import query, table
from plumbline.plans.suite.sessions import _TURN_SQL, agent_texts

# Every document with a tail by doc_id % 5: a valid array, a status outside the vocabulary, none,
# a fenced array of two followed by another, an array that is no JSON.
_TEXT_SQL = """(SELECT doc_id, text || CASE doc_id % 5
  WHEN 0 THEN ' [ {"claim": "c' || doc_id || '", "statut": "fait", "note": "n"} ] ok'
  WHEN 1 THEN ' [{"claim": "c", "statut": "vrai"}]'
  WHEN 2 THEN ''
  WHEN 3 THEN chr(10) || '```json' || chr(10) || '[{"claim": "a", "statut": "hypothèse"},' || chr(10) || '{"claim": "b", "statut": "refusé", "nature": "x"}]' || chr(10) || '``` [{"claim": "z"}]'
  ELSE ' [{"claim": }]' END AS body FROM documents)"""
_FOUND = rf"(SELECT doc_id, body, regexp_extract(body, '(?s)\[\s*\{{.*?\}}\s*\]') AS found FROM {_TEXT_SQL})"


def observation_texts(spark, folder):
    case = F.col("doc_id") % 5
    ident = F.col("doc_id").cast("string")
    tail = (
        F.when(case == 0, F.concat(F.lit(' [ {"claim": "c'), ident, F.lit('", "statut": "fait", "note": "n"} ] ok')))
        .when(case == 1, F.lit(' [{"claim": "c", "statut": "vrai"}]'))
        .when(case == 2, F.lit(""))
        .when(
            case == 3,
            F.lit(
                '\n```json\n[{"claim": "a", "statut": "hypothèse"},\n'
                '{"claim": "b", "statut": "refusé", "nature": "x"}]\n``` [{"claim": "z"}]'
            ),
        )
        .otherwise(F.lit(' [{"claim": }]'))
    )
    return table(spark, folder, "documents").select("doc_id", F.concat("text", tail).alias("body"))


@query("txt_json_array", f"SELECT doc_id, CASE WHEN found <> '' THEN found END AS found FROM {_FOUND}")
def txt_json_array(spark, folder):
    return observation_texts(spark, folder).select("doc_id", x.json_array(F.col("body")).alias("found"))


@query(
    "txt_observations",
    """SELECT doc_id, 0 AS position, 'c' || doc_id AS claim, 'fait' AS statut, 'n' AS note, CAST(NULL AS VARCHAR) AS confiance, CAST(NULL AS VARCHAR) AS nature FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT doc_id, 0, 'a', 'hypothèse', NULL, NULL, NULL FROM documents WHERE doc_id % 5 = 3
    UNION ALL SELECT doc_id, 1, 'b', 'refusé', NULL, NULL, 'x' FROM documents WHERE doc_id % 5 = 3""",
)
def txt_observations(spark, folder):
    return x.observations(observation_texts(spark, folder), "body")


@query(
    "txt_rejected",
    """SELECT reason, count(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 1 THEN 'bad_observation' WHEN 2 THEN 'no_array' WHEN 4 THEN 'bad_json' END AS reason
    FROM documents) WHERE reason IS NOT NULL GROUP BY 1""",
)
def txt_rejected(spark, folder):
    bad = x.rejected_texts(observation_texts(spark, folder), "body")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "txt_observation_nodes",
    """SELECT 'd' || doc_id AS session_id, 'observation' AS kind, CAST(CASE doc_id % 5 WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS n, CAST(1 AS BIGINT) AS first_seq
    FROM documents WHERE doc_id % 5 IN (0, 3)""",
)
def txt_observation_nodes(spark, folder):
    """Observations join a session's nodes as children of its root."""
    texts = observation_texts(spark, folder)
    session = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    starts = texts.select(
        session.alias("session_id"), F.lit(-1).cast("bigint").alias("msg_no"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("start").alias("type"), F.lit("{}").alias("payload"),
    )
    obs = x.observations(texts, "body").withColumn("session", session)
    custom = x.observation_nodes(obs, "session", "doc_id")
    nodes = numbered(with_custom_nodes(flatten_messages(starts), custom))
    return nodes.filter(F.col("kind") == "observation").groupBy("session_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )


_BLOCK = r"(?s)```[A-Za-z]*[ \t\r]*\n(.*?)```"
_TURNS = f"""(SELECT session_id, turn, shape, s, body, regexp_extract_all(body, '{_BLOCK}', 1) AS blocks, string_split_regex(body, '{_BLOCK}') AS pieces FROM {_TURN_SQL})"""
_TRIM = "chr(10) || chr(9) || chr(13) || ' '"


@query("txt_blocks", f"SELECT session_id, turn, blocks[-1] AS block FROM {_TURNS}")
def txt_blocks(spark, folder):
    return agent_texts(spark, folder).select("session_id", "turn", x.last_block(F.col("body")).alias("block"))


@query(
    "txt_prose",
    f"""SELECT session_id, turn, trim(array_to_string(list_slice(pieces, 1, len(pieces) - 1), '') || chr(10) || pieces[-1], {_TRIM}) AS prose FROM {_TURNS}""",
)
def txt_prose(spark, folder):
    return agent_texts(spark, folder).select("session_id", "turn", x.prose(F.col("body")).alias("prose"))


@query(
    "txt_turns",
    f"""SELECT session_id, turn,
    CASE WHEN shape = 1 THEN trim(body, {_TRIM}) ELSE trim(array_to_string(list_slice(pieces, 1, len(pieces) - 1), '') || chr(10) || pieces[-1], {_TRIM}) END AS message,
    CASE shape WHEN 0 THEN '{{"columns":{{"c' || turn || '":{{"sens":"' || s || '"}}}}}}' END AS fiche_delta,
    CASE shape WHEN 0 THEN 1 WHEN 3 THEN 3 END AS n_questions, shape = 2 AS proposes_completion FROM {_TURNS}""",
)
def txt_turns(spark, folder):
    turns = x.parsed_turns(agent_texts(spark, folder), "body")
    asked = F.size(elements(F.try_parse_json("questions")))
    return turns.select(
        "session_id", "turn", "message", "fiche_delta",
        F.when(F.col("questions").isNotNull(), asked).alias("n_questions"), "proposes_completion",
    )
