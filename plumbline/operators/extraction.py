"""Structured records out of free text: observation arrays and fenced turn payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import (
    FENCED_BLOCK,
    JSON_ARRAY,
    as_text,
    elements,
    is_array,
    is_null_or_string,
    is_object,
    is_string,
    member,
    parse_json,
    strip,
    truthy,
)

# The status vocabulary of an observation.
STATUSES = ("fait", "hypothèse", "refusé")
_OPTIONAL = ("note", "confiance", "nature")


def json_array(text: Column) -> Column:
    """First `[ {...} ]` of the text, NULL if there is none."""
    found = F.regexp_extract(text, JSON_ARRAY, 0)
    return F.when(found != "", found)


def _valid(item: Column) -> Column:
    checks = is_object(item) & is_string(member(item, "$.claim"))
    checks = checks & F.coalesce(
        is_string(member(item, "$.statut")) & as_text(member(item, "$.statut")).isin(*STATUSES),
        F.lit(False),
    )
    for field in _OPTIONAL:
        checks = checks & is_null_or_string(member(item, f"$.{field}"))
    return checks


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def parsed_observations(df: DataFrame, text: str) -> DataFrame:
    """Add `items` (the array's elements) and `reason` (why the text is rejected, NULL if it is not).

    One bad element rejects its whole text. The found array and its elements pass through one-row
    generators, so the search and the parse run once per text however often they are referred to.
    """
    found = _once(df, "_found", json_array(F.col(text)))
    parsed = _once(found, "items", elements(parse_json(F.col("_found"))))
    reason = (
        F.when(F.col("_found").isNull(), "no_array")
        .when(F.col("items").isNull(), "bad_json")
        .when(~F.forall("items", _valid), "bad_observation")
    )
    return parsed.withColumn("reason", reason).drop("_found")


def observations(df: DataFrame, text: str) -> DataFrame:
    """One row per observation of every accepted text, with its position."""
    keep = [c for c in df.columns if c != text]
    good = parsed_observations(df, text).filter(F.col("reason").isNull())
    return good.select(*keep, F.posexplode("items").alias("position", "_o")).select(
        *keep,
        "position",
        *[as_text(member(F.col("_o"), f"$.{f}")).alias(f) for f in ("claim", "statut", *_OPTIONAL)],
    )


def rejected_texts(df: DataFrame, text: str) -> DataFrame:
    """Texts without a valid observation array, with the reason."""
    return parsed_observations(df, text).filter(F.col("reason").isNotNull()).drop("items")


def observation_nodes(obs: DataFrame, session: str, order: str) -> DataFrame:
    """Observations as custom nodes: (session_id, msg_no, block_no, kind, content, meta)."""
    keep_null = {"ignoreNullFields": "false"}
    return obs.select(
        F.col(session).cast("string").alias("session_id"),
        F.col(order).cast("bigint").alias("msg_no"),
        F.col("position").cast("int").alias("block_no"),
        F.lit("observation").alias("kind"),
        F.to_json(F.struct("claim", "note"), keep_null).alias("content"),
        F.to_json(F.struct("statut", "confiance", "nature"), keep_null).alias("meta"),
    )


def last_block(text: Column) -> Column:
    """Content of the last fenced block, NULL without one."""
    blocks = F.regexp_extract_all(text, F.lit(FENCED_BLOCK), F.lit(1))
    return F.get(blocks, F.size(blocks) - 1)


def prose(text: Column) -> Column:
    """Text outside the fenced blocks: what precedes the last one, a line break, what follows it."""
    pieces = F.split(text, FENCED_BLOCK, -1)
    before = F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), "")
    return strip(F.concat(before, F.lit("\n"), F.element_at(pieces, -1)))


def parsed_turns(df: DataFrame, text: str) -> DataFrame:
    """Add message, fiche_delta and questions (JSON texts or NULL), proposes_completion.

    A text without a last block holding a JSON object is all message.
    """
    payload = F.col("_payload")
    outside = prose(F.col(text))
    legacy = F.coalesce(strip(as_text(member(payload, "$.message"))), F.lit(""))
    delta, asked = member(payload, "$.fiche_delta"), member(payload, "$.questions")
    usable = is_object(payload)
    return (
        df.withColumn("_payload", parse_json(last_block(F.col(text))))
        .withColumn(
            "message",
            F.when(~usable, strip(F.col(text)))
            .when(outside != "", outside)
            .otherwise(legacy),
        )
        .withColumn(
            "fiche_delta",
            F.when(usable & is_object(delta) & (F.to_json(delta) != "{}"), F.to_json(delta)),
        )
        .withColumn(
            "questions",
            F.when(usable & is_array(asked) & (F.to_json(asked) != "[]"), F.to_json(asked)),
        )
        .withColumn(
            "proposes_completion", usable & truthy(member(payload, "$.proposes_completion"))
        )
        .drop("_payload")
    )
