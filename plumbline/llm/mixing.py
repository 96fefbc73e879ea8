"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import settle_narrow

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK_WORDS = 8
SHARD_DOCS = 1024
MOST_COPIES = 3
STRETCH = 1 << 16


def word_count(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: Sequence[int], most_copies: int) -> DataFrame:
    """Adds `target` to (source, source_size): the words each source gives to a mix as large as all sizes.

    Sources take the weights in turn, in order of code points, null last. No target is above `most_copies`
    times its source's size; what is above goes to the others by weight. The sources that reach their bound
    are those with the smallest bound per weight, so running sums over that order settle it at once.
    """
    # One row per source in all these windows, whatever the number of documents.
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("nth", F.row_number().over(named) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(turn, (F.col("nth") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("bound", F.col("source_size") * F.lit(most_copies))
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranked.withColumn("level", F.col("bound") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everyone))
        .withColumn("all_weights", F.sum("weight").over(everyone))
        .withColumn("bounds", F.sum("bound").over(filling))
        .withColumn("weights", F.sum("weight").over(filling))
        .withColumn("full", F.col("bounds") + F.col("level") * (F.col("all_weights") - F.col("weights")) <= F.col("all_words"))
        .withColumn("spent", F.sum(F.when(F.col("full"), F.col("bound"))).over(everyone))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone))
        .withColumn("share", (F.col("all_words") - F.coalesce("spent", F.lit(0))) / F.col("open") * F.col("weight"))
        .withColumn("target", F.when(F.col("full"), F.col("bound").cast("double")).otherwise(F.col("share")))
        .select("source", "source_size", "nth", "target")
    )


def sainte_lague(votes: DataFrame, group: list[str], candidate: str, vote: str, seats: str, out: str) -> DataFrame:
    """Adds `out`: the seats each candidate of a group gets of the group's `seats`, by highest quotients.

    The quotients of a candidate are its votes by 1, 3, 5 and so on; equal ones go to the smaller
    `candidate`. Rounded shares are the apportionment of about as many seats, so only those missing or too
    many are settled by quotients: a few per candidate, however many seats there are. Candidates without
    votes get none.
    """
    within = Window.partitionBy(*group)
    shared = (
        votes.withColumn("_all", F.sum(vote).over(within))
        .withColumn("_share", F.when(F.col("_all") > 0, F.col(vote) / F.col("_all")).otherwise(0.0))
        .withColumn("_base", F.floor(F.col("_share") * F.col(seats) + 0.5))
        .withColumn("_more", F.col(seats) - F.sum("_base").over(within))
        .withColumn("_field", F.count(F.lit(1)).over(within))
    )
    # No candidate gains or loses more than its share of the difference and of one seat per candidate, and one.
    reach = F.ceil(F.col("_share") * (F.abs("_more") + F.col("_field"))) + 1
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(reach, F.abs("_more")) - 1)
    offers = (
        shared.where((F.col("_more") != 0) & (F.col("_share") > 0))
        .withColumn("_step", F.explode(steps))
        .withColumn("_seat", F.when(F.col("_more") > 0, F.col("_base") + F.col("_step")).otherwise(F.col("_base") - 1 - F.col("_step")))
        .where(F.col("_seat") >= 0)
        .withColumn("_quotient", F.col(vote) / (2 * F.col("_seat") + 1) * F.signum("_more"))
    )
    best = Window.partitionBy(*group).orderBy(F.desc("_quotient"), F.col(candidate) * F.signum("_more"))
    won = (
        offers.withColumn("_nth", F.row_number().over(best))
        .where(F.col("_nth") <= F.abs("_more"))
        .groupBy(*group, candidate)
        .agg(F.sum(F.signum("_more").cast("bigint")).alias("_won"))
    )
    kept = [*votes.columns, "_base"]
    return (
        shared.select(*kept)
        .join(won, [*group, candidate], "left")
        .withColumn(out, F.col("_base") + F.coalesce("_won", F.lit(0)))
        .select(*votes.columns, out)
    )


def numbered_copies(rows: DataFrame, times: Column, name: str, spread: list[str]) -> DataFrame:
    """Each row `times` times, numbered from 1 on as `name`.

    Numbers are made in stretches of STRETCH, so no row holds an array of all; the stretches of a row that stands very
    often are dealt out by `spread` and their place.
    """
    stretches = rows.withColumn("_times", times.cast("bigint")).where("_times > 0")
    stretches = stretches.withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_times") - 1) / STRETCH))))
    inner = F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(STRETCH).cast("bigint"), F.col("_times") - F.col("_stretch") * STRETCH))
    dealt = stretches.repartition(*spread, "_stretch").withColumn("_in", F.explode(inner))
    return dealt.withColumn(name, F.col("_stretch") * STRETCH + F.col("_in")).drop("_times", "_stretch", "_in")


def row_hash(*columns: str) -> Column:
    """96 bits that tell a row's values."""
    return F.struct(F.xxhash64(*columns).alias("long"), F.hash(*columns).alias("short"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    most_copies: int = MOST_COPIES,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    seed: int = 17,
) -> DataFrame:
    """How many words of each document a mix takes: (doc_id, size, source_size, target, taken).

    Documents are dealt to shards by a hash of id, source, text and a running number among equal rows. All blocks of the
    mix are apportioned to the sources by their targets, then each source's blocks to the shards by the words it has there: integer quotas per source
    and shard. Within both, documents stand in seeded order; a quota takes whole rounds of them, then the
    first blocks of that order. So only one document of a shard and source is cut, a source's words miss its target by
    about half a block, and none is taken more than `most_copies` times. Reruns agree.

    One row per row of `docs`. A null or empty text has size 0 and gives nothing; a null source is a source of
    its own, the last; null and repeated ids and repeated rows are dealt to shards like any others. Only `doc_id`, `text`
    and `source` are read. An empty table gives no row. All steps are DataFrame functions.
    """
    mixed = mix_rows(docs, row_hash("doc_id", "source", "text"), weights, most_copies, block_words, shard_docs, seed)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mix_rows(
    docs: DataFrame,
    key: Column,
    weights: Sequence[int] = (5, 2, 1),
    most_copies: int = MOST_COPIES,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    seed: int = 17,
) -> DataFrame:
    """`mix_sources` with what tells the rows: (key, nth, shard, doc_id, size, source_size, target, taken).

    Rows of equal `key` must be equal in `doc_id`, `text` and `source`; they count as rows 1, 2, 3 and so on, as `nth`.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    alike = sized.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("_rows"))
    sized = settle_narrow(numbered_copies(alike, F.col("_rows"), "nth", ["key"]).drop("_rows"))
    shards = max(1, -(-sized.count() // shard_docs))
    placed = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "key", "nth"), F.lit(shards)))
    supply = settle_narrow(placed.groupBy("source", "shard").agg(F.sum("size").alias("supply")))
    sources = source_targets(supply.groupBy("source").agg(F.sum("supply").alias("source_size")), weights, most_copies)
    sources = sources.withColumn("_one", F.lit(0)).withColumn(
        "blocks", F.round(F.sum("source_size").over(Window.partitionBy("_one")) / block_words).cast("bigint")
    )
    sources = sainte_lague(sources, ["_one"], "nth", "target", "blocks", "quota")
    sources = settle_narrow(sources.select("source", "source_size", "target", "nth", "quota"))

    same = supply["source"].eqNullSafe(sources["source"])
    votes = supply.join(sources, same).select(supply["source"], "shard", "supply", "source_size", "target", "nth", "quota")
    quotas = sainte_lague(votes, ["nth"], "shard", "supply", "quota", "seats").select(
        F.col("source").alias("_source"),
        F.col("shard").alias("_shard"),
        "source_size",
        "target",
        "supply",
        F.least(F.col("seats") * block_words, F.col("supply") * most_copies).alias("words"),
    )
    known = placed.join(quotas, placed["source"].eqNullSafe(quotas["_source"]) & (F.col("shard") == F.col("_shard")))
    seeded = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "key", "nth"), "doc_id", "size", "key", "nth")
    rounds = F.when(F.col("supply") > 0, F.floor(F.col("words") / F.col("supply"))).otherwise(0)
    end = F.sum("size").over(seeded.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        known.withColumn("_end", end)
        .withColumn("_rounds", rounds)
        .withColumn("_rest", F.col("words") - F.col("_rounds") * F.col("supply"))
        .withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - (F.col("_end") - F.col("size")))))
        .select("key", "nth", "shard", "doc_id", "size", "source_size", "target", (F.col("_rounds") * F.col("size") + F.col("_part")).cast("bigint").alias("taken"))
    )
