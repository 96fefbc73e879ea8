"""Catalog curation: deltas from events, questions from conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import curation as c
from plumbline.operators.entry_tree import entry_tree, updated_tree
from plumbline.operators.extraction import parsed_turns
from plumbline.plans.suite import query, table
from plumbline.plans.suite.sessions import _TURN_SQL, agent_texts
from plumbline.session import shared_folder

# Per event one delta for the dataset of its user: the column named after its type, a title, and
# for errors a list under `columns`, which has to be ignored. Views write an empty delta.
_DELTA = """(SELECT 'd' || user_id AS dataset, event_id AS seq, event_type, CAST(round(value * 100) AS BIGINT) AS cents, event_id % 3 AS r FROM events)"""
_WRITES = f"""(SELECT dataset, seq, 'column' AS scope, event_type || '_' || r AS name, '{{"sens":"v' || cents || '","type":"numeric"}}' AS value FROM {_DELTA} WHERE event_type NOT IN ('view', 'error')
  UNION ALL SELECT dataset, seq, 'root', 'titre', '"t' || cents || '"' FROM {_DELTA} WHERE event_type <> 'view'
  UNION ALL SELECT dataset, seq, 'root', 'dataset', '"' || dataset || '"' FROM {_DELTA} WHERE event_type = 'signup'
  UNION ALL SELECT dataset, seq, 'column', 'odd', CAST(cents AS VARCHAR) FROM {_DELTA} WHERE event_type = 'purchase' AND seq % 7 = 0)"""
_MERGED = f"(SELECT dataset, scope, name, arg_max(value, seq) AS value FROM {_WRITES} GROUP BY 1, 2, 3)"
_NAMES = "(SELECT DISTINCT 'd' || user_id AS dataset, event_type || '_' || (event_id % 3) AS name FROM events UNION ALL SELECT DISTINCT 'd' || user_id, 'x-' || event_type FROM events)"


def deltas(spark, folder):
    ev = table(spark, folder, "events").select(
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("dataset"),
        F.col("event_id").alias("seq"), "event_type",
        F.round(F.col("value") * 100).cast("bigint").cast("string").alias("cents"),
        (F.col("event_id") % 3).cast("string").alias("r"),
    )
    kind = F.col("event_type")
    title = F.concat(F.lit('"titre":"t'), "cents", F.lit('"'))
    column = F.concat(F.lit('"'), kind, F.lit("_"), "r", F.lit('":{"sens":"v'), "cents", F.lit('","type":"numeric"}'))
    odd = F.when((kind == "purchase") & (F.col("seq") % 7 == 0), F.concat(F.lit(',"odd":'), "cents")).otherwise(F.lit(""))
    delta = (
        F.when(kind == "view", F.lit("{}"))
        .when(kind == "error", F.concat(F.lit("{"), title, F.lit(',"columns":["a","b"]}')))
        .otherwise(
            F.concat(
                F.lit("{"), title,
                F.when(kind == "signup", F.concat(F.lit(',"dataset":"'), "dataset", F.lit('"'))).otherwise(F.lit("")),
                F.lit(',"columns":{'), column, odd, F.lit("}}"),
            )
        )
    )
    return ev.select("dataset", "seq", delta.alias("delta"))


def names(spark, folder):
    ev = table(spark, folder, "events").select(
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("dataset"), "event_type", "event_id"
    )
    return ev.select(
        "dataset", F.concat("event_type", F.lit("_"), (F.col("event_id") % 3).cast("string")).alias("name")
    ).distinct().unionByName(
        ev.select("dataset", F.concat(F.lit("x-"), "event_type").alias("name")).distinct()
    )


@query("cur_writes", f"SELECT scope, name, count(*) AS n FROM {_WRITES} GROUP BY 1, 2")
def cur_writes(spark, folder):
    return c.delta_writes(deltas(spark, folder)).groupBy("scope", "name").agg(F.count(F.lit(1)).alias("n"))


@query("cur_merge", f"SELECT * FROM {_MERGED}")
def cur_merge(spark, folder):
    return c.merge_deltas(deltas(spark, folder))


@query(
    "cur_inventory",
    f"""SELECT dataset, count(*) FILTER (WHERE scope = 'column') AS n_columns,
    coalesce(string_agg(name, ', ' ORDER BY name) FILTER (WHERE scope = 'column'), '') AS columns FROM {_MERGED} GROUP BY 1""",
)
def cur_inventory(spark, folder):
    return c.inventory(c.merge_deltas(deltas(spark, folder)))


def _tree_sql(merged: str) -> str:
    """All nodes of the hash trees of (dataset, scope, name, value)."""
    above = "sha256(string_agg(node || digest, '' ORDER BY node)) AS digest, CAST(sum(n_chars) AS BIGINT) AS n_chars"
    return f"""(WITH l3 AS (SELECT dataset, sha256(scope || '/' || name) AS node, sha256(scope || '/' || name || '=' || value) AS digest,
        length(value) + length(name) AS n_chars FROM {merged}),
      l2 AS (SELECT dataset, left(node, 4) AS node, {above} FROM l3 GROUP BY dataset, left(node, 4)),
      l1 AS (SELECT dataset, left(node, 2) AS node, {above} FROM l2 GROUP BY dataset, left(node, 2)),
      l0 AS (SELECT dataset, '' AS node, {above} FROM l1 GROUP BY dataset)
      SELECT dataset, 0 AS level, node, digest, n_chars FROM l0 UNION ALL SELECT dataset, 1, node, digest, n_chars FROM l1
      UNION ALL SELECT dataset, 2, node, digest, n_chars FROM l2 UNION ALL SELECT dataset, 3, node, digest, n_chars FROM l3)"""


_HASHES = f"(SELECT dataset, digest AS hash, n_chars FROM {_tree_sql(_MERGED)} WHERE level = 0)"


@query("cur_hash", f"SELECT * FROM {_HASHES}")
def cur_hash(spark, folder):
    return c.entry_hash(c.merge_deltas(deltas(spark, folder)))


@query("cur_tree_update", f"SELECT * FROM {_tree_sql(_MERGED)}")
def cur_tree_update(spark, folder):
    """The tree of the first two thirds of all deltas, updated by the rest, is that of all deltas."""
    rows = deltas(spark, folder)
    late = F.col("seq") % 3 == 2
    last = c.delta_writes(rows).groupBy("dataset", "scope", "name").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return updated_tree(entry_tree(c.merge_deltas(rows.filter(~late))), last.filter(late).drop("seq"))


# Stored versions: even users have the same content twice over, user % 4 = 1 has other content,
# the rest is new.
_STORED = f"""(SELECT dataset, hash, 1 AS version FROM {_HASHES} WHERE CAST(substr(dataset, 2) AS INTEGER) % 2 = 0
  UNION ALL SELECT dataset, hash, 3 FROM {_HASHES} WHERE CAST(substr(dataset, 2) AS INTEGER) % 4 = 1
  UNION ALL SELECT dataset, 'other', 4 FROM {_HASHES} WHERE CAST(substr(dataset, 2) AS INTEGER) % 4 = 1)"""


@query(
    "cur_idempotent",
    f"""SELECT h.dataset, h.hash, CAST(coalesce(l.version, 0) + 1 AS BIGINT) AS version FROM {_HASHES} h
    LEFT JOIN (SELECT dataset, arg_max(hash, version) AS hash, max(version) AS version FROM {_STORED} GROUP BY 1) l USING (dataset)
    WHERE l.hash IS DISTINCT FROM h.hash""",
)
def cur_idempotent(spark, folder):
    hashes = c.entry_hash(c.merge_deltas(deltas(spark, folder)))
    user = F.substring("dataset", 2, 20).cast("bigint")
    stored = (
        hashes.filter(user % 2 == 0).select("dataset", "hash", F.lit(1).cast("bigint").alias("version"))
        .unionByName(hashes.filter(user % 4 == 1).select("dataset", "hash", F.lit(3).cast("bigint").alias("version")))
        .unionByName(hashes.filter(user % 4 == 1).select("dataset", F.lit("other").alias("hash"), F.lit(4).cast("bigint").alias("version")))
    )
    return c.changed_entries(hashes, stored)


@query(
    "cur_write_versions",
    f"SELECT 1 AS attempt, count(*) AS written FROM {_HASHES} UNION ALL SELECT 2, 0",
)
def cur_write_versions(spark, folder):
    """Write all entries twice: the second attempt finds nothing to do."""
    path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    merged = c.merge_deltas(deltas(spark, folder))
    first = c.write_versions(merged, path).select(F.lit(1).alias("attempt"))
    second = c.write_versions(merged, path).select(F.lit(2).alias("attempt"))
    rows = first.unionByName(second).groupBy("attempt").agg(F.count(F.lit(1)).alias("written"))
    both = spark.range(1, 3).select(F.col("id").cast("int").alias("attempt"))
    return both.join(rows, "attempt", "left").select("attempt", F.coalesce("written", F.lit(0)).alias("written"))


_WORDS = f"(SELECT DISTINCT dataset, unnest(regexp_extract_all(name || ' ' || value, '[0-9A-Za-z_]+')) AS word FROM {_MERGED})"
_UNCOVERED = f"""(SELECT n.dataset, n.name FROM {_NAMES} n WHERE n.name LIKE 'x-%'
  OR NOT EXISTS (SELECT 1 FROM {_WORDS} w WHERE w.dataset = n.dataset AND w.word = n.name))"""


@query("cur_uncovered", f"SELECT * FROM {_UNCOVERED}")
def cur_uncovered(spark, folder):
    return c.uncovered_names(c.merge_deltas(deltas(spark, folder)), names(spark, folder))


# Names with other characters than letters and digits: pieces of what an event wrote, some overwritten since.
_ODD = """(SELECT DISTINCT dataset, CASE seq % 8 WHEN 0 THEN '"v' || cents || '"' WHEN 1 THEN 'sens":"v' || cents || '","type' WHEN 2 THEN 'titre "t' || cents || '"'
    WHEN 3 THEN event_type || '_' || r || ' {"sens' WHEN 4 THEN ':"v' || cents WHEN 5 THEN '{' WHEN 6 THEN '":"' ELSE 'type":"numeric"}' END AS name FROM """ + _DELTA + ")"


@query(
    "cur_phrases",
    f"""SELECT n.dataset, n.name FROM {_ODD} n WHERE NOT EXISTS (SELECT 1 FROM {_MERGED} m WHERE m.dataset = n.dataset
      AND contains(m.name || ' ' || m.value, n.name)
      AND regexp_matches(m.name || ' ' || m.value, '(^|[^0-9A-Za-z_])' || regexp_escape(n.name) || '($|[^0-9A-Za-z_])'))""",
)
def cur_phrases(spark, folder):
    """Names of any characters, looked for in what the last writes left."""
    ev = table(spark, folder, "events")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    forms = [
        F.concat(F.lit('"v'), cents, F.lit('"')), F.concat(F.lit('sens":"v'), cents, F.lit('","type')), F.concat(F.lit('titre "t'), cents, F.lit('"')),
        F.concat("event_type", F.lit("_"), (F.col("event_id") % 3).cast("string"), F.lit(' {"sens')), F.concat(F.lit(':"v'), cents), F.lit("{"),
        F.lit('":"'), F.lit('type":"numeric"}'),
    ]
    name = F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int"))
    odd = ev.select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("dataset"), name.alias("name")).distinct()
    return c.uncovered_names(c.merge_deltas(deltas(spark, folder)), odd)


@query(
    "cur_coverage",
    f"""SELECT n.dataset, count(*) AS n_names, count(*) - count(u.name) AS n_covered FROM {_NAMES} n
    LEFT JOIN {_UNCOVERED} u USING (dataset, name) GROUP BY 1""",
)
def cur_coverage(spark, folder):
    return c.coverage(c.merge_deltas(deltas(spark, folder)), names(spark, folder))


@query(
    "cur_conformity",
    f"""WITH m AS {_MERGED}, k AS (SELECT DISTINCT dataset, CASE scope WHEN 'column' THEN 'columns' ELSE name END AS key FROM m),
    req(key) AS (VALUES ('dataset'), ('titre'), ('grain'), ('perimetre'), ('referentiels'), ('pieges_transversaux'), ('points_non_tranches'), ('columns')),
    ds AS (SELECT dataset, count(*) FILTER (WHERE scope = 'column') AS n_columns,
      count(*) FILTER (WHERE scope = 'column' AND value NOT LIKE '{{%') AS n_not_objects, CAST(sum(length(name) + length(value)) AS BIGINT) AS n_chars FROM m GROUP BY 1)
    SELECT dataset,
      coalesce((SELECT string_agg(key, ',' ORDER BY key) FROM req WHERE key NOT IN (SELECT key FROM k WHERE k.dataset = ds.dataset)), '') AS missing_keys,
      coalesce((SELECT string_agg(key, ',' ORDER BY key) FROM k WHERE k.dataset = ds.dataset AND key NOT IN (SELECT key FROM req)), '') AS extra_keys,
      coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM m WHERE m.dataset = ds.dataset AND scope = 'column'
        AND name NOT IN (SELECT n.name FROM {_NAMES} n WHERE n.dataset = ds.dataset)), '') AS ghost_columns,
      CASE WHEN n_columns > n_not_objects THEN 'sens,type' ELSE '' END AS fields, false AS fields_conform,
      n_columns, n_not_objects, n_chars, n_chars / (SELECT count(*) FROM {_NAMES} n WHERE n.dataset = ds.dataset) AS chars_per_column
    FROM ds""",
)
def cur_conformity(spark, folder):
    return c.conformity(c.merge_deltas(deltas(spark, folder)), names(spark, folder))


# --- questions -------------------------------------------------------------------------------------

_ASKED = f"""(SELECT session_id, turn AS seq, 0 AS pos, CAST(turn AS VARCHAR) AS n, true AS has_options, shape, s FROM {_TURN_SQL} WHERE shape = 0
  UNION ALL SELECT session_id, turn, 0, '1', true, shape, s FROM {_TURN_SQL} WHERE shape = 3
  UNION ALL SELECT session_id, turn, 1, NULL, false, 9, 'z' FROM {_TURN_SQL} WHERE shape = 3)"""
_MERGED_Q = f"""(SELECT session_id, n, shape, s, row_number() OVER (PARTITION BY session_id ORDER BY seq, pos) AS position FROM (
  SELECT session_id, n, arg_max(shape, seq * 10 + pos) AS shape, arg_max(s, seq * 10 + pos) AS s, min(seq * 10 + pos) // 10 AS seq, min(seq * 10 + pos) % 10 AS pos
  FROM {_ASKED} WHERE n IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT session_id, n, shape, s, seq, pos FROM {_ASKED} WHERE n IS NULL))"""


def questions(spark, folder):
    turns = parsed_turns(agent_texts(spark, folder), "body").withColumnRenamed("turn", "seq")
    asked = c.question_rows(turns)
    return c.merge_questions(asked)


@query("cur_questions", f"SELECT session_id, position, n, s AS constat FROM {_MERGED_Q}")
def cur_questions(spark, folder):
    return questions(spark, folder).select(
        "session_id", "position", "n", F.get_json_object("question", "$.constat").alias("constat")
    )


def _answered(spark, folder):
    """Every session answers 1, 2 and 4, asked or not."""
    sessions = table(spark, folder, "conversations").select("conv_id").distinct()
    answers = sessions.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"),
        F.explode(F.array(*map(F.lit, ("1", "2", "4")))).alias("n"),
    )
    return c.attach_answers(questions(spark, folder), answers.withColumn("reponse", F.concat(F.lit("r"), "n")))


@query(
    "cur_answers",
    f"SELECT session_id, position, n, CASE WHEN n IN ('1', '2', '4') THEN 'r' || n END AS reponse FROM {_MERGED_Q}",
)
def cur_answers(spark, folder):
    return _answered(spark, folder).select("session_id", "position", "n", "reponse")


@query(
    "cur_completeness",
    f"""SELECT session_id, position, n, CASE WHEN shape = 3 THEN CASE WHEN s = '' THEN 'constat' ELSE '' END
      ELSE CASE WHEN s = '' THEN 'constat,enjeu,options' ELSE 'enjeu,options' END END AS missing,
    shape = 3 AND s <> '' AS complete, n IS NOT NULL AND n IN ('1', '2', '4') AS answered FROM {_MERGED_Q}""",
)
def cur_completeness(spark, folder):
    return c.question_completeness(_answered(spark, folder))
