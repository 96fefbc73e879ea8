"""Names of any characters found as whole phrases in texts, through a positional index of words.

A text is words (runs of ASCII letters, digits and underscores) with gaps around them. Two words in a row with the gap
between them are one posting; a name of several words is found where all its postings stand at places that fit together.
A name without any word can only lie inside a gap. All matching is by equal keys: no pattern runs over pairs of
a name and a text.

Both sides of every join grow with the catalog, and texts and names are far wider than the files they come from, so
a size estimated from files would have them broadcast: `MERGED` keeps them shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = "[0-9A-Za-z_]+"
MERGED = "merge"


def _cut(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("_gaps", F.split(text, WORD, -1))


def _word_rows(cut: DataFrame, *keep: str) -> DataFrame:
    """A row per word: its number, the word before it with the gap before that one, and the gaps on both sides."""
    n = F.size("_words")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    return cut.select(*keep, "_words", "_gaps", n.alias("n_words"), F.explode(numbers).alias("at")).select(
        *keep,
        "n_words",
        "at",
        F.get("_words", F.col("at")).alias("word"),
        F.get("_words", F.col("at") - 1).alias("previous"),
        F.get("_gaps", F.col("at") - 1).alias("lead"),
        F.get("_gaps", F.col("at")).alias("between"),
        F.get("_gaps", F.col("at") + 1).alias("after"),
    )


def _fits_left(name_gap, gap, at_start):
    longer = F.length(gap) > F.length(name_gap)
    return (name_gap == "") | (F.endswith(gap, name_gap) & (longer | at_start))


def _fits_right(name_gap, gap, at_end):
    longer = F.length(gap) > F.length(name_gap)
    return (name_gap == "") | (F.startswith(gap, name_gap) & (longer | at_end))


def found_names(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (dataset, name) of names that stand in a text of their dataset with no word character on either side.

    names: (dataset, name); texts: (dataset, text). Empty and NULL names, NULL texts and NULL datasets are found
    nowhere. Upper and lower case differ.
    """
    names = _cut(names.select("dataset", "name").filter("name <> ''").distinct(), "name")
    texts = _cut(texts.select("dataset", "text").filter("text <> ''"), "text")

    wanted = _word_rows(names, "dataset", "name")
    one = wanted.filter("n_words = 1").select("dataset", "name", "word", F.col("between").alias("_l"), F.col("after").alias("_r"))
    standing = _word_rows(texts, "dataset").select(
        "dataset", "word", "between", "after", (F.col("at") == 0).alias("first"), (F.col("at") == F.col("n_words") - 1).alias("last")
    ).distinct()
    singles = (
        standing.join(one.hint(MERGED), ["dataset", "word"])
        .filter(_fits_left(F.col("_l"), F.col("between"), F.col("first")) & _fits_right(F.col("_r"), F.col("after"), F.col("last")))
        .select("dataset", "name")
    )

    pairs = wanted.filter("at > 0").select(
        "dataset", "name", "previous", "between", "word",
        F.col("at").alias("_at"), F.col("n_words").alias("_n"),
        F.when(F.col("at") == 1, F.col("lead")).otherwise("").alias("_l"),
        F.when(F.col("at") == F.col("n_words") - 1, F.col("after")).otherwise("").alias("_r"),
    )
    # A text is told by its digest: equal texts of a dataset hold the same names.
    postings = _word_rows(texts.withColumn("_text", F.sha2("text", 256)).dropDuplicates(["dataset", "_text"]), "dataset", "_text").filter("at > 0")
    several = (
        postings.join(pairs.hint(MERGED), ["dataset", "previous", "between", "word"])
        .filter(
            _fits_left(F.col("_l"), F.col("lead"), F.col("at") == 1)
            & _fits_right(F.col("_r"), F.col("after"), F.col("at") == F.col("n_words") - 1)
        )
        .groupBy("dataset", "name", "_text", (F.col("at") - F.col("_at")).alias("_from"), "_n")
        .agg(F.count(F.lit(1)).alias("_held"))
        .filter("_held = _n - 1")
        .select("dataset", "name")
    )

    bare = names.filter(F.size("_words") == 0).select("dataset", "name", F.length("name").alias("_length"))
    lengths = bare.select("dataset", "_length").distinct()
    gaps = texts.select("dataset", F.posexplode("_gaps").alias("_k", "_gap"), F.size("_words").alias("_n")).select(
        "dataset", "_gap", (F.col("_k") == 0).alias("first"), (F.col("_k") == F.col("_n")).alias("last")
    ).distinct()
    free = F.length("_gap") - F.col("_length")
    inside = (
        gaps.join(lengths.hint(MERGED), "dataset")
        .filter(free >= 0)
        .select("*", free.alias("_free"), F.explode(F.sequence(F.lit(0), free)).alias("_skip"))
        .filter(((F.col("_skip") > 0) | F.col("first")) & ((F.col("_skip") < F.col("_free")) | F.col("last")))
        .select("dataset", F.substring(F.col("_gap"), F.col("_skip") + 1, F.col("_length")).alias("name"))
        .distinct()
        .join(bare.select("dataset", "name").hint(MERGED), ["dataset", "name"])
    )
    return singles.unionByName(several).unionByName(inside).distinct()
