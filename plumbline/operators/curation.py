"""Catalog curation: last-write-wins merges, content hashes, versions and conformity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.local import inline_rows
from plumbline.functions.text import (
    as_text,
    entries,
    is_object,
    is_string,
    kind_of,
    member,
    number,
    truthy,
)
from plumbline.operators.entry_tree import roots
from plumbline.operators.ordered import running_number
from plumbline.operators.phrases import MERGED, found_names
from plumbline.session import settle
from plumbline.sources.tables import path_exists

# Root keys of a complete entry, fields of a column, fields of a complete question.
ROOT_KEYS = (
    "dataset", "titre", "grain", "perimetre", "referentiels", "pieges_transversaux",
    "points_non_tranches", "columns",
)
COLUMN_FIELDS = ("pieges", "sens", "type")
QUESTION_FIELDS = ("constat", "enjeu", "options")

_PLAIN_NAME = "^[0-9A-Za-z_]+$"


def delta_writes(deltas: DataFrame) -> DataFrame:
    """(dataset, seq, scope, name, value) from (dataset, seq, delta): one row per written key.

    `columns` is opened into its entries; deltas or `columns` that are no objects write nothing.
    """
    top = deltas.select(
        "dataset", "seq", F.explode(entries(F.try_parse_json("delta"))).alias("name", "_v")
    )
    root = top.filter(F.col("name") != "columns").select(
        "dataset", "seq", F.lit("root").alias("scope"), "name", F.to_json("_v").alias("value")
    )
    columns = top.filter(F.col("name") == "columns").select(
        "dataset", "seq", F.explode(entries(F.col("_v"))).alias("name", "_c")
    ).select("dataset", "seq", F.lit("column").alias("scope"), "name", F.to_json("_c").alias("value"))
    return root.unionByName(columns)


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """(dataset, scope, name, value): the last value written to every key.

    A maximum per key, so a dataset with many deltas is reduced before the shuffle.
    """
    return delta_writes(deltas).groupBy("dataset", "scope", "name").agg(
        F.max_by("value", "seq").alias("value")
    )


def inventory(merged: DataFrame) -> DataFrame:
    """(dataset, n_columns, columns): documented column names, sorted.

    Names are distinct after the merge: a list is as long as its table is wide.
    """
    return merged.groupBy("dataset").agg(
        F.count_if(F.col("scope") == "column").alias("n_columns"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("scope") == "column", F.col("name")))), ", "
        ).alias("columns"),
    )


def merge_questions(questions: DataFrame) -> DataFrame:
    """(session_id, position, n, n_kind, question) from (session_id, seq, pos, question).

    By number, the last wording wins at the place of the first. Questions without a number are kept
    each; entries that are no objects are dropped. `n` is the number as text, without fraction if it has none
    (1 and 1.0 are one), or a text itself; `n_kind` tells the number 2 from the text "2".
    """
    v = F.try_parse_json("question")
    given = member(F.col("_v"), "$.n")
    value = number(given)
    whole = F.when((value == F.floor(value)) & (F.abs(value) < 2.0**53), value.cast("bigint").cast("string"))
    text = F.when(is_string(given), as_text(given)).otherwise(F.to_json(given))
    named = F.coalesce(kind_of(given) != "VOID", F.lit(False))
    known = (
        questions.withColumn("_v", v)
        .filter(is_object(F.col("_v")))
        .withColumn("n", F.when(named, F.coalesce(whole, value.cast("string"), text)))
        .withColumn("n_kind", F.when(named, F.when(value.isNotNull(), "number").otherwise("text")))
    )
    at = F.struct("seq", "pos")
    merged = known.filter(F.col("n").isNotNull()).groupBy("session_id", "n", "n_kind").agg(
        F.max_by("question", at).alias("question"), F.min(at).alias("first")
    )
    single = known.filter(F.col("n").isNull()).select(
        "session_id", "n", "n_kind", "question", at.alias("first")
    )
    rows = merged.select("session_id", "n", "n_kind", "question", "first").unionByName(single).select(
        "session_id", "n", "n_kind", "question", F.col("first.seq").alias("_seq"), F.col("first.pos").alias("_pos")
    )
    return running_number(rows, ["session_id"], ["_seq", "_pos"], "position").select(
        "session_id", "position", "n", "n_kind", "question"
    )


def attach_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with `reponse` from (session_id, n, reponse); unanswered or unnumbered stay NULL.

    Answers that also have `n_kind` go to questions of that kind alone.
    """
    kind = ["n_kind"] if "n_kind" in answers.columns else []
    return questions.join(answers, ["session_id", "n", *kind], "left")


def entry_hash(merged: DataFrame) -> DataFrame:
    """(dataset, hash, n_chars): root of the entry's hash tree, see `entry_tree`."""
    return roots(merged).select("dataset", F.col("digest").alias("hash"), "n_chars")


def changed_entries(hashes: DataFrame, versions: DataFrame) -> DataFrame:
    """(dataset, hash, version): entries whose content differs from their latest stored version."""
    latest = versions.groupBy("dataset").agg(
        F.max_by("hash", "version").alias("_hash"), F.max("version").alias("_version")
    )
    return (
        hashes.select("dataset", "hash")
        .join(latest, "dataset", "left")
        .filter(~F.col("hash").eqNullSafe(F.col("_hash")))
        .select("dataset", "hash", (F.coalesce("_version", F.lit(0)) + 1).cast("bigint").alias("version"))
    )


def write_versions(merged: DataFrame, path: str) -> DataFrame:
    """Append changed entries as new versions below `path`; returns what was written.

    Writing the same content again appends nothing.
    """
    spark = merged.sparkSession
    hashes = entry_hash(merged)
    schema = "dataset string, hash string, version bigint"
    if path_exists(spark, f"{path}/versions"):
        versions = spark.read.schema(schema).parquet(f"{path}/versions")
    else:
        versions = inline_rows(spark, schema, [])
    changed = settle(changed_entries(hashes, versions))
    merged.join(changed.select("dataset", "version"), "dataset").write.mode("append").parquet(
        f"{path}/content"
    )
    changed.write.mode("append").parquet(f"{path}/versions")
    return changed


def uncovered_names(merged: DataFrame, names: DataFrame) -> DataFrame:
    """(dataset, name) of profiled columns that the entry names nowhere as a whole word or phrase.

    Plain names are matched with the entry's words by an anti join, all others through the phrase index. Empty
    names are covered nowhere, NULL names are left out.
    """
    text = F.concat_ws(" ", "name", "value")
    words = merged.select(
        "dataset", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9A-Za-z_]+"), F.lit(0)))).alias("name")
    )
    plain = names.filter(F.col("name").rlike(_PLAIN_NAME)).join(words.hint(MERGED), ["dataset", "name"], "left_anti")
    odd = names.filter(~F.col("name").rlike(_PLAIN_NAME))
    found = found_names(odd, merged.select("dataset", text.alias("text")))
    return plain.unionByName(odd.join(found.hint(MERGED), ["dataset", "name"], "left_anti"))


def coverage(merged: DataFrame, names: DataFrame) -> DataFrame:
    """(dataset, n_names, n_covered)."""
    missing = uncovered_names(merged, names).groupBy("dataset").agg(F.count(F.lit(1)).alias("_m"))
    return (
        names.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_names"))
        .join(missing.hint(MERGED), "dataset", "left")
        .select("dataset", "n_names", (F.col("n_names") - F.coalesce("_m", F.lit(0))).alias("n_covered"))
    )


def _names(values: Column) -> Column:
    return F.array_join(F.array_sort(F.coalesce(values, F.array().cast("array<string>"))), ",")


def conformity(merged: DataFrame, names: DataFrame) -> DataFrame:
    """Per dataset: missing and extra root keys, ghost columns, fields used, entries that are no
    objects, documented columns and characters per profiled column.

    All name lists are sorted texts; they are bounded by the width of an entry.
    """
    v = F.try_parse_json("value")
    column = F.col("scope") == "column"
    marked = merged.withColumn("_object", is_object(v))
    ghosts = (
        merged.filter(column).join(names.hint(MERGED), ["dataset", "name"], "left_anti")
        .groupBy("dataset").agg(F.collect_set("name").alias("ghosts"))
    )
    fields = (
        merged.filter(column)
        .select("dataset", F.explode(F.map_keys(entries(v))).alias("field"))
        .distinct().groupBy("dataset").agg(F.collect_list("field").alias("fields"))
    )
    widths = names.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_names"))
    required = F.array(*[F.lit(k) for k in ROOT_KEYS])
    root = F.collect_set(F.when(column, F.lit("columns")).otherwise(F.col("name")))
    per = marked.groupBy("dataset").agg(
        root.alias("_root"),
        F.count_if(column).alias("n_columns"),
        F.count_if(column & ~F.col("_object")).alias("n_not_objects"),
        F.sum(F.length("name") + F.length("value")).alias("n_chars"),
    )
    return (
        per.join(ghosts, "dataset", "left").join(fields, "dataset", "left").join(widths, "dataset", "left")
        .select(
            "dataset",
            _names(F.array_except(required, "_root")).alias("missing_keys"),
            _names(F.array_except("_root", required)).alias("extra_keys"),
            _names(F.col("ghosts")).alias("ghost_columns"),
            _names(F.col("fields")).alias("fields"),
            (_names(F.col("fields")) == ",".join(sorted(COLUMN_FIELDS))).alias("fields_conform"),
            "n_columns", "n_not_objects", "n_chars",
            (F.col("n_chars") / F.col("n_names")).alias("chars_per_column"),
        )
    )


def question_completeness(answered: DataFrame) -> DataFrame:
    """(session_id, position, n, missing, complete, answered) for questions with `reponse`."""
    v = F.try_parse_json("question")
    missing = F.filter(
        F.array(*[F.when(~truthy(member(v, f"$.{f}")), F.lit(f)) for f in QUESTION_FIELDS]),
        lambda f: f.isNotNull(),
    )
    return answered.select(
        "session_id", "position", "n",
        F.array_join(missing, ",").alias("missing"),
        (F.size(missing) == 0).alias("complete"),
        (F.coalesce(F.col("reponse"), F.lit("")) != "").alias("answered"),
    )


def question_rows(turns: DataFrame) -> DataFrame:
    """(session_id, seq, pos, question) from parsed turns with `questions` as JSON."""
    items = F.try_variant_get(F.try_parse_json("questions"), "$", "array<variant>")
    return turns.select("session_id", "seq", F.posexplode(items).alias("pos", "_q")).select(
        "session_id", "seq", "pos", F.to_json("_q").alias("question")
    )

