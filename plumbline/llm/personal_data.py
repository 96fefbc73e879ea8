"""Personal data: patterns of characters, and what stands in the contexts that these induce.

Addresses, numbers and cards that match by their characters are seeds. The words before them are lexical
patterns; strings that only look a little like an identifier are candidate instances. Patterns and instances form a
graph that is scored in rounds: a pattern is as good as the share of all its places in the corpus that hold
good instances, an instance as good as its patterns together. Candidates behind good patterns are found too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.shingles import PlainWords, mixed
from plumbline.session import settle

#: Fixed by the contract, in its order.
KINDS = ("email", "ip", "card", "phone")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: What a candidate may look like: written out or bracketed signs, and groups of digits or of hexadecimal digits.
_AT, _DOT = r"\x20?(?:@|[\[({]\x20?at\x20?[\])}])\x20?", r"\x20?(?:\.|[\[({]\x20?dot\x20?[\])}])\x20?"
LOOKS = (
    ("email", re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,64}}(?:{_DOT}[A-Za-z0-9-]{{1,64}})*", re.I)),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("ip", re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![\w.])", re.I)),
    ("digits", re.compile(r"(?<![\w+.-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![\w])")),
)
LEAST_SEEDS = 3
CONFIDENT = 0.5
ROUNDS = 3
BLOCK_PATTERNS = 1 << 20
_MENTION = "struct<start:bigint,nth:int,stop:bigint>"
_CANDIDATE = "struct<start:bigint,nth:int,stop:bigint,pattern:bigint,instance:bigint>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, stop) of all seeds, by start, then kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        match = DOMAIN.match(text, at)
        if match:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                last = match.end()
                found.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(int(part[-4:]) <= 255 and (len(part) <= 3 or not part[:-3].strip("0")) for part in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidate_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Strings that look like an identifier and touch no seed: (start, kind, stop); digits may be card or phone."""
    free = [(s, e) for s, _, e in taken]
    found = []

    def add(kind: int, m: re.Match) -> None:
        if all(m.end() <= s or m.start() >= e for s, e in free):
            found.append((m.start(), kind, m.end()))

    marks = "@" in text or re.search(r"[\[({]\x20?at", text, re.I)
    if marks:
        for m in LOOKS[0][1].finditer(text):
            add(0, m)
    if re.search("[0-9]", text):
        for _, look in LOOKS[1:3]:
            for m in look.finditer(text):
                add(1, m)
        for m in LOOKS[3][1].finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 13 <= n <= 19:
                add(2, m)
            if 7 <= n <= 15:
                add(3, m)
    return found


def contexts(text: str, start: int, words: PlainWords) -> list[int]:
    """Patterns before a place: its last word, and its last two words."""
    begin = max(0, start - 256)
    numbers = words.of(text[begin:start].encode())[-2:]
    out = [one_word(numbers[-1:])] if len(numbers) else []
    return [int(p[0]) for p in [*out, *([two_words(numbers)] if len(numbers) == 2 else [])]]


def one_word(numbers: np.ndarray) -> np.ndarray:
    return mixed(numbers ^ np.uint64(1)).view(np.int64)


def two_words(numbers: np.ndarray) -> np.ndarray:
    return mixed(mixed(numbers[:-1] ^ np.uint64(2)) + numbers[1:]).view(np.int64)


def normal(kind: int, text: str) -> int:
    """A number for an instance: digits alone for numbers, small letters for addresses."""
    plain = re.sub("[^0-9]", "", text) if kind >= 2 else text.lower()
    return int.from_bytes(hashlib.blake2b(f"{kind} {plain}".encode(), digest_size=8).digest(), "little", signed=True)


def find_mentions(docs: DataFrame) -> DataFrame:
    """One row per document, settled: (row, doc_id, base_sha256, base, seeds, candidates).

    `base` holds the spans of the seeds; `seeds` and `candidates` a row per pattern before a seed or candidate.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa

        words, attempt, n = PlainWords(), uuid.uuid4().hex, 0
        mention = pa.struct([("start", pa.int64()), ("nth", pa.int32()), ("stop", pa.int64())])
        candidate = pa.struct([*mention, ("pattern", pa.int64()), ("instance", pa.int64())])

        def told(text: str, spans: list) -> list[dict]:
            return [
                {"start": s, "nth": k, "stop": e, "pattern": p, "instance": normal(k, text[s:e])}
                for s, k, e in spans
                for p in contexts(text, s, words)
            ]

        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                spans = [{"start": s, "nth": k, "stop": e} for s, k, e in base]
                found = told(text, candidate_spans(text, base))
                rows.append((f"{attempt}-{n}", hashlib.sha256(joined.encode()).hexdigest(), spans, told(text, base), found))
                n += 1
            types = [pa.string(), pa.string(), pa.list_(mention), pa.list_(candidate), pa.list_(candidate)]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            names = ["row", "doc_id", "base_sha256", "base", "seeds", "candidates"]
            yield pa.RecordBatch.from_arrays([arrays[0], batch.column("doc_id"), *arrays[1:]], names)

    schema = f"row string, doc_id {kind}, base_sha256 string, base array<{_MENTION}>, seeds array<{_CANDIDATE}>, candidates array<{_CANDIDATE}>"
    return settle(docs.select("doc_id", "text").mapInArrow(find, schema))


def pattern_places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, places): how often the words of each pattern stand in all texts. Patterns go out in bounded blocks."""
    blocks = max(1, -(-patterns.count() // BLOCK_PATTERNS))
    counted = []
    for k in range(blocks):
        some = patterns.where(F.pmod("pattern", F.lit(blocks)) == k).toPandas()["pattern"].to_numpy(np.int64)
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(some))

        def count(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            words, wanted = PlainWords(), sent.value
            total = np.zeros(len(wanted), np.int64)
            for batch in batches:
                for text in batch.column("text"):
                    numbers = words.of(text.as_py() or b"")
                    for found in (one_word(numbers), two_words(numbers)):
                        at = np.minimum(np.searchsorted(wanted, found), max(len(wanted) - 1, 0))
                        if len(wanted):
                            total += np.bincount(at[wanted[at] == found], minlength=len(wanted))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(total[some])], ["pattern", "places"])

        counted.append(docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "pattern bigint, places bigint"))
    found = counted[0]
    for more in counted[1:]:
        found = found.unionByName(more)
    return settle(found.groupBy("pattern").agg(F.sum("places").alias("places")))


def confident_patterns(docs: DataFrame, mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(nth, pattern, confidence) of the patterns that tell an identifier of a kind, scored over the whole graph."""

    def edges(column: str, seed: bool) -> DataFrame:
        each = mentions.select(F.explode(column).alias("m")).select("m.nth", "m.pattern", "m.instance")
        return each.groupBy("nth", "pattern", "instance").agg(F.count(F.lit(1)).alias("mentions")).withColumn("seed", F.lit(seed))

    seeds = edges("seeds", True)
    enough = seeds.groupBy("nth", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SEEDS)
    enough = settle(enough.select("nth", "pattern"))
    places = pattern_places(docs, enough.select("pattern").distinct())
    graph = seeds.unionByName(edges("candidates", False)).join(enough, ["nth", "pattern"], "left_semi")
    graph = settle(graph.join(places, "pattern", "left"))
    scores = None
    for _ in range(rounds):
        scored = graph.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
        if scores is not None:
            scored = graph.join(scores, ["nth", "instance"], "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        good = F.sum(F.col("mentions") * F.col("score")) / (F.greatest(F.coalesce(F.max("places"), F.lit(0)), F.sum("mentions")) + 1)
        patterns = settle(scored.groupBy("nth", "pattern").agg(good.alias("confidence")))
        held = graph.where("NOT seed").join(patterns, ["nth", "pattern"])
        scores = settle(held.groupBy("nth", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")))
    return patterns


def find_personal_data(docs: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """Personal data of each whole text: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added).

    `spans` holds all spans as kind:start:stop in code points, stop exclusive, by start, then kind, joined by commas, and the
    counts are of all of them; `base_sha256` is over the spans that match by their characters. `n_added` counts
    those that their contexts tell: candidates behind a pattern of confidence `confident` or more, which touch no
    other span. A pattern needs three different seeds.

    One row per row of `docs`. A null text counts as empty and has no spans; ids may be null or repeat. Only
    `doc_id` and `text` are read. Texts are read twice and never shuffled; jobs run while this is called.
    """
    mentions = find_mentions(docs)
    patterns = confident_patterns(docs, mentions).where(F.col("confidence") >= confident)
    candidates = mentions.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("m")).select("row", "m.*")
    told = candidates.join(patterns, ["nth", "pattern"], "left_semi")
    span = F.struct("start", "nth", "stop")
    told = told.select("row", span.alias("span")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("found"))

    def free(kept: Column, x: Column) -> Column:
        """A span is added if it begins behind all those added before."""
        last = F.coalesce(F.element_at(kept, -1)["stop"], F.lit(0))
        return F.when((F.size(kept) == 0) | (x["start"] >= last), F.concat(kept, F.array(x))).otherwise(kept)

    none = F.array().cast(f"array<{_MENTION}>")
    out = mentions.select("row", "doc_id", "base_sha256", "base").join(told, "row", "left")
    out = out.withColumn("found", F.aggregate(F.coalesce("found", none), none, free))
    out = out.withColumn("all", F.sort_array(F.concat("base", "found")))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.transform("all", lambda x: F.concat_ws(":", F.element_at(kinds, x["nth"] + 1), x["start"].cast("string"), x["stop"].cast("string")))

    def count(kind: int) -> Column:
        return F.size(F.filter("all", lambda x: x["nth"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = map(count, range(len(KINDS)))
    return out.select("doc_id", *counts, "base_sha256", F.array_join(text, ",").alias("spans"), F.size("found").cast("bigint").alias("n_added"))
