"""N-gram Jaccard join by vertical partitioning.

A document is the set of its word shingles, as 64-bit numbers. Equal sets are one class, and only the class
with the smallest id goes on. The global order of shingles puts rare ones first:

1. the lower half of all numbers is counted over the whole corpus, cut into fragments by number, and the upper half over
   the documents that are still open then. Shingles of one document come first, then those of few, then
   those of many; within each, by number;
2. two sets of similarity 0.8 share a shingle among the first fifth of this order (prefix filter), at places
   that leave room for the overlap needed (positional filter). Shingles of one document fill most
   prefixes and match nothing;
3. pairs that share such a shingle are candidates. Their sets are cut into fragments of the global order, the
   overlap of each fragment is counted by itself, and the sum per pair decides.

A shingle of many prefixes would make all their pairs. There, documents are compared with a leader first,
a few rounds with other leaders each; then only pairs of different components are left, and all of those are compared.
So no link between components is lost, and no group is written out as its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.components import merge_components
from plumbline.llm.shingles import Words, mixed, shingles
from plumbline.session import in_fewer_tasks, remove_tables, settle, settle_narrow, settled_tables

SHINGLE_WORDS = 5
#: Similarity as a fraction: 100 * overlap >= 80 * union.
PER_CENT = 80
#: Documents of a counted shingle, and of a prefix shingle, above which it counts as common.
COMMON = 32
#: Shingles a task holds before it passes a block on, and shingles of a fragment.
BLOCK_SHINGLES = 1 << 19
FRAGMENT_SHINGLES = 1 << 20
#: Rows a task works on at once.
SLICE_ROWS = 256
SEGMENTS = 4
LEADER_ROUNDS = 3
_HALF = np.uint64(1 << 63)


def sliced(batches: Iterator) -> Iterator:
    """The batches in short slices, so that no more sets than that are held at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(k, SLICE_ROWS)


def set_of(text: bytes | None, words: Words, size: int) -> np.ndarray:
    return np.unique(shingles(words.of(text or b""), size))


def _fit(n: Column, more: int, per: int) -> Column:
    """ceil(n * more / per)."""
    return F.ceil(n * more / F.lit(per)).cast("bigint")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, low, digest): the size of each set, how many numbers are in the lower half, and a digest of the set."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        words = Words(1 << 18)
        for batch in sliced(batches):
            sets = [set_of(t.as_py(), words, size) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int((s < _HALF).sum()) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "low", "digest"],
            )

    return docs.mapInArrow(sign, "doc_id bigint, n bigint, low bigint, digest binary")


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes: planes of small or close numbers are all alike and compress away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values in a sorted array."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return first, np.diff(np.append(first, len(values)))


def shared_shingles(sets: DataFrame, fragments: int, read) -> DataFrame:
    """(doc_id, few, many): numbers of a document that others have too, by how many have them.

    `read` makes (id, digest, numbers below 2^63) of each row of a batch of `sets`. Tasks deal their numbers to
    fragments in blocks. Of equal digests in a block one is kept, that of the smallest id. A number that many
    documents of a block have is common everywhere: its documents are told at once, past the fragments (`fragment`
    below 0), and the fragment gets the number alone. So no block brings a fragment more than COMMON
    documents per number. What fragments find goes back to documents in as many parts as there are fragments.
    """
    width = -(-(1 << 63) // fragments)

    def part_of(owners: np.ndarray) -> np.ndarray:
        return (mixed(owners.view(np.uint64)) % np.uint64(fragments)).astype(np.int64)

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[bytes, tuple[int, np.ndarray]] = {}
        size = 0

        def block():
            ids = np.array([i for i, _ in held.values()], np.int64)
            numbers = np.concatenate([s for _, s in held.values()])
            owners = np.repeat(ids, [len(s) for _, s in held.values()])
            order = np.argsort(numbers, kind="stable")
            numbers, owners = numbers[order], owners[order]
            del order
            _, counts = _runs(numbers)
            common = np.repeat(counts > COMMON, counts)
            rows = []

            def add(fragment: int, n: np.ndarray, o: np.ndarray, told: np.ndarray) -> None:
                rows.append((fragment, packed(np.diff(n, prepend=np.uint64(0))), packed(o), packed(told)))

            cuts = np.searchsorted((numbers // np.uint64(width)).astype(np.int64), np.arange(fragments + 1))
            for k, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:])):
                if begin < end:
                    own, n = ~common[begin:end], numbers[begin:end]
                    add(k, n[own], owners[begin:end][own], np.unique(n[~own]))
            past = part_of(owners)
            for k in np.unique(past[common]).tolist():
                own = common & (past == k)
                add(-1 - k, numbers[own], owners[own], numbers[:0])
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            names = ["fragment", "numbers", "owners", "common"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in sliced(batches):
            for doc_id, digest, numbers in read(batch):
                if not len(numbers):
                    continue
                if digest in held:
                    held[digest] = min(held[digest][0], doc_id), numbers
                    continue
                held[digest] = doc_id, numbers
                size += len(numbers)
                if size >= BLOCK_SHINGLES:
                    yield block()
                    held, size = {}, 0
        if held:
            yield block()

    def count(table):
        import pyarrow as pa

        told_apart = table.column("fragment")[0].as_py() < 0
        blocks = list(zip(*(table.column(c).to_pylist() for c in ("numbers", "owners", "common"))))
        numbers = np.concatenate([np.cumsum(unpacked(b[0], np.uint64), dtype=np.uint64) for b in blocks])
        owners = np.concatenate([unpacked(b[1], np.int64) for b in blocks])
        told = np.unique(np.concatenate([unpacked(b[2], np.uint64) for b in blocks]))
        # Each of these arrays is as long as the fragment: they go as soon as they are used.
        del blocks
        order = np.argsort(numbers, kind="stable")
        numbers, owners = numbers[order], owners[order]
        del order
        first, counts = _runs(numbers)
        many = np.repeat((counts > COMMON) | np.isin(numbers[first], told), counts) | told_apart
        kept = np.repeat(counts > 1, counts) | many
        del first, counts
        numbers, owners, many = numbers[kept], owners[kept], many[kept]
        del kept
        parts = part_of(owners)
        rows = []
        for k in np.unique(parts).tolist():
            own = parts == k
            rows.append((k, packed(np.diff(numbers[own], prepend=np.uint64(0))), packed(owners[own]), np.packbits(many[own]).tobytes()))
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["part", "numbers", "owners", "many"])

    def gather(table):
        import pyarrow as pa

        numbers, owners, many = [], [], []
        for n, o, m in zip(*(table.column(c).to_pylist() for c in ("numbers", "owners", "many"))):
            numbers.append(np.cumsum(unpacked(n, np.uint64), dtype=np.uint64))
            owners.append(unpacked(o, np.int64))
            many.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(owners[-1])).astype(bool))
        numbers, owners, many = map(np.concatenate, (numbers, owners, many))
        by = np.argsort(owners, kind="stable")
        numbers, owners, many = numbers[by], owners[by], many[by]
        del by
        first, counts = _runs(owners)
        spans = list(zip(first.tolist(), (first + counts).tolist()))
        few = [numbers[a:b][~many[a:b]].tobytes() for a, b in spans]
        lots = [numbers[a:b][many[a:b]].tobytes() for a, b in spans]
        return pa.table([pa.array(owners[first], pa.int64()), pa.array(few, pa.binary()), pa.array(lots, pa.binary())], ["doc_id", "few", "many"])

    dealt = sets.mapInArrow(deal, "fragment bigint, numbers binary, owners binary, common binary")
    found = dealt.groupBy("fragment").applyInArrow(lambda table: count(table), "part bigint, numbers binary, owners binary, many binary")
    return found.groupBy("part").applyInArrow(lambda table: gather(table), "doc_id bigint, few binary, many binary")


def text_sets(size: int):
    """Reads (id, digest, lower half) from batches of (doc_id, text)."""
    words = Words(1 << 18)

    def read(batch) -> Iterator[tuple[int, bytes, np.ndarray]]:
        import xxhash

        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            found = set_of(text.as_py(), words, size)
            yield doc_id, xxhash.xxh128_digest(found.tobytes()), found[: np.searchsorted(found, _HALF)]

    return read


def upper_halves(batch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Reads (id, digest, upper half less 2^63) from batches of (doc_id, variant, numbers)."""
    for doc_id, variant, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "variant", "numbers"))):
        found = np.frombuffer(raw, np.uint64)
        yield doc_id, variant.to_bytes(8, "little", signed=True), found[np.searchsorted(found, _HALF) :] ^ _HALF


def packed_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, text) with texts compressed, for the way through a shuffle."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        tool = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in sliced(batches):
            told = pa.array([tool.compress(t.as_py()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), told], ["doc_id", "text"])

    return texts.mapInArrow(pack, "doc_id bigint, text binary")


def open_sets(open_docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, variant, n, numbers): sorted numbers of each set, from (doc_id, text, digest, variant) with packed texts.

    A text whose set has another digest is not the one meant.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        import zstandard

        words, tool = Words(1 << 18), zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            rows = []
            for doc_id, text, digest, variant in zip(*(batch.column(c) for c in ("doc_id", "text", "digest", "variant"))):
                found = set_of(tool.decompress(text.as_py()), words, size)
                if xxhash.xxh128_digest(found.tobytes()) == digest.as_py():
                    rows.append((doc_id.as_py(), variant.as_py(), len(found), found.tobytes()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "variant", "n", "numbers"])

    return open_docs.mapInArrow(cut, "doc_id bigint, variant bigint, n bigint, numbers binary")


def prefix_entries(sets: DataFrame) -> DataFrame:
    """(doc_id, variant, n, prefix, places): the shingles of each prefix that may match, in the global order.

    `sets` also has few, many of the lower and few_up, many_up of the upper half, and prefix_length.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "variant", "n", "numbers", "few", "many", "few_up", "many_up", "prefix_length"]
        for batch in sliced(batches):
            rows = []
            for doc_id, variant, n, raw, few, many, few_up, many_up, length in zip(*(batch.column(c).to_pylist() for c in names)):
                found = np.frombuffer(raw, np.uint64)
                several = np.concatenate([np.frombuffer(few or b"", np.uint64), np.frombuffer(few_up or b"", np.uint64) | _HALF])
                lots = np.concatenate([np.frombuffer(many or b"", np.uint64), np.frombuffer(many_up or b"", np.uint64) | _HALF])
                common = np.isin(found, lots)
                rare = np.isin(found, several) & ~common
                alone = int((~common & ~rare).sum())
                rest = np.concatenate([found[rare], found[common]])[: max(0, length - alone)]
                if len(rest):
                    rows.append((doc_id, variant, n, rest.view(np.int64).tolist(), list(range(alone, alone + len(rest)))))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                out = ["doc_id", "variant", "n", "prefix", "places"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], out)

    return sets.mapInArrow(cut, "doc_id bigint, variant bigint, n bigint, prefix array<bigint>, places array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate pairs (a, v_a, b, v_b), those that are similar enough, by overlaps counted fragment by fragment.

    Each set is cut into SEGMENTS fragments of the global order. A fragment's pairs meet their two segments, partial
    overlaps are counted there, and their sum per pair is compared with both sizes. A row that stands several
    times repeats all its segments alike, so the sum is taken by the number of rows.
    """
    quarter = (1 << 64) // SEGMENTS

    def segments(batches: Iterator) -> Iterator:
        import pyarrow as pa

        edges = np.array([k * quarter for k in range(1, SEGMENTS)], np.uint64)
        for batch in sliced(batches):
            rows = []
            for doc_id, variant, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "variant", "n", "numbers"))):
                found = np.frombuffer(raw, np.uint64)
                for k, part in enumerate(np.split(found, np.searchsorted(found, edges))):
                    rows.append((doc_id, variant, n, k, part.tobytes()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                names = ["doc_id", "variant", "n", "segment", "numbers"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def overlap(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["a", "v_a", "b", "v_b", "sizes"]
        for batch in sliced(batches):
            sides = zip(batch.column("left"), batch.column("right"))
            counts = [len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True)) for x, y in sides]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(counts, pa.int64())], [*names, "overlap"])

    ends = pairs.select(F.col("a").alias("doc_id"), F.col("v_a").alias("variant")).unionByName(pairs.select(F.col("b").alias("doc_id"), F.col("v_b").alias("variant")))
    met = sets.select("doc_id", "variant", "n", "numbers").join(ends.distinct(), ["doc_id", "variant"], "left_semi")
    cut = met.select("doc_id", "variant", "n", "numbers").mapInArrow(segments, "doc_id bigint, variant bigint, n bigint, segment int, numbers binary")
    left, right = (
        cut.select(F.col("doc_id").alias(x), F.col("variant").alias(f"v_{x}"), F.col("n").alias(f"n_{x}"), "segment", F.col("numbers").alias(name))
        for x, name in (("a", "left"), ("b", "right"))
    )
    spread = pairs.select("a", "v_a", "b", "v_b", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("segment"))
    met = spread.join(right, ["b", "v_b", "segment"]).join(left, ["a", "v_a", "segment"])
    met = met.select("a", "v_a", "b", "v_b", (F.col("n_a") + F.col("n_b")).alias("sizes"), "left", "right")
    counted = met.mapInArrow(overlap, "a bigint, v_a bigint, b bigint, v_b bigint, sizes bigint, overlap bigint")
    summed = counted.groupBy("a", "v_a", "b", "v_b", "sizes").agg((F.sum("overlap") * SEGMENTS / F.count(F.lit(1))).alias("overlap"))
    return summed.where(100 * F.col("overlap") >= PER_CENT * (F.col("sizes") - F.col("overlap"))).select("a", "b")


def _may_match(x: str, y: str) -> Column:
    """Sizes and places of a shared prefix shingle leave room for the overlap needed."""
    n_x, n_y, i, j = (F.col(c) for c in (f"n_{x}", f"n_{y}", f"place_{x}", f"place_{y}"))
    small, large = F.least(n_x, n_y), F.greatest(n_x, n_y)
    need = _fit(n_x + n_y, PER_CENT, 100 + PER_CENT)
    return (small * 100 >= large * PER_CENT) & (1 + F.least(n_x - i, n_y - j) - 1 >= need)


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of at least 0.8: (doc_id, n_shingles, component_id).

    One row per row of `docs`. `component_id` is the smallest id reachable by links, the document's own
    included. Null, empty and blank texts have no shingles and no links; a text of fewer words than a shingle is one
    shingle. Rows without id are linked with nothing and have no component; rows that share an id share its
    component, whatever their texts. Only `doc_id` and `text` are read. Jobs run while this is called; what
    they share is settled.
    """
    with settled_tables() as made:
        found = _near_duplicates(docs, size, lambda *read_by: remove_tables(docs.sparkSession, made, read_by))
    remove_tables(docs.sparkSession, made, [found])
    return found


def _near_duplicates(docs: DataFrame, size: int, tidy) -> DataFrame:
    """`tidy` takes what is still read of the tables settled so far; the others go."""
    told = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = settle(signatures(told, size))
    linkable = signed.where("n > 0 AND doc_id IS NOT NULL")
    # A digest is that of one set; the smallest id stands for its class.
    classes = settle_narrow(linkable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("low").alias("low")))
    total = classes.agg(F.sum("low")).first()[0] or 0
    fragments = max(1, math.ceil(total / FRAGMENT_SHINGLES))
    readable = told.where("doc_id IS NOT NULL AND text IS NOT NULL")

    shared = settle(in_fewer_tasks(shared_shingles(readable, fragments, text_sets(size))))
    counted = (F.octet_length("few") + F.octet_length("many")) / 8
    known = classes.join(shared, "doc_id", "left").withColumn("prefix_length", F.col("n") - _fit(F.col("n"), PER_CENT, 100) + 1)
    # Where shingles of this document alone fill the prefix, nothing can match.
    known = known.where(F.col("low") - F.coalesce(counted.cast("bigint"), F.lit(0)) < F.col("prefix_length"))
    known = settle(in_fewer_tasks(known.select("doc_id", "few", "many", "prefix_length", "digest", F.xxhash64("digest").alias("variant"))))
    sets = open_sets(packed_texts(readable).join(known.select("doc_id", "digest", "variant"), "doc_id"), size)
    if not linkable.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["doc_id", "variant"])
    sets = settle(in_fewer_tasks(sets))
    tidy(signed, classes, known, sets)
    # The upper half is counted over what is left: the others match nothing.
    rest = sets.agg(F.sum("n")).first()[0] or 0
    upper = shared_shingles(sets.select("doc_id", "variant", "numbers"), max(1, math.ceil(rest / 2 / FRAGMENT_SHINGLES)), upper_halves)
    upper = settle(in_fewer_tasks(upper.withColumnsRenamed({"few": "few_up", "many": "many_up"})))
    facts = known.drop("digest").join(upper, "doc_id", "left")

    index_length = F.col("n") - _fit(F.col("n"), 2 * PER_CENT, 100 + PER_CENT) + 1
    prefixes = prefix_entries(sets.join(facts, ["doc_id", "variant"]))
    entries = prefixes.select("doc_id", "variant", "n", index_length.alias("index_length"), F.explode(F.arrays_zip("prefix", "places")).alias("_e"))
    indexed = F.col("_e.places") < F.col("index_length")
    entries = settle_narrow(entries.select("doc_id", "variant", "n", F.col("_e.prefix").alias("shingle"), F.col("_e.places").alias("place"), indexed.alias("indexed")))
    sizes = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs"), F.count_if("indexed").alias("starts"))
    sizes = settle_narrow(sizes.where("docs > 1 AND starts > 0"))
    tidy(signed, classes, sets, entries, sizes)
    few = entries.join(sizes.where(F.col("docs") <= COMMON).select("shingle"), "shingle", "left_semi")
    many = entries.join(sizes.where(F.col("docs") > COMMON).select("shingle"), "shingle", "left_semi")

    def side(rows: DataFrame, name: str) -> DataFrame:
        renamed = {"doc_id": name, "variant": f"v_{name}", "n": f"n_{name}", "place": f"place_{name}", "indexed": f"indexed_{name}", "component": f"c_{name}"}
        return rows.withColumnsRenamed(renamed)

    def checked(pairs: DataFrame) -> DataFrame:
        return settle_narrow(similar(settle_narrow(pairs.select("a", "v_a", "b", "v_b").distinct()), sets))

    # The smaller set's shorter prefix meets the larger set's longer one.
    forward = F.struct("n_a", "a", "v_a") < F.struct("n_b", "b", "v_b")
    pairs = side(few, "a").where("indexed_a").join(side(few, "b"), "shingle").where(forward & _may_match("a", "b"))
    labels = docs.sparkSession.createDataFrame([], "node bigint, component bigint")
    # An id with several texts holds their classes together.
    several = linkable.groupBy("doc_id").agg(F.min("digest").alias("_lo"), F.max("digest").alias("_hi")).where("_lo <> _hi")
    own = linkable.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), "digest")
    own = own.join(classes.select("digest", F.col("doc_id").alias("b")), "digest").select("a", "b")
    labels = merge_components(labels, checked(pairs).unionByName(own))
    many = settle_narrow(many)
    tidy(signed, classes, sets, many, labels)

    def placed(rows: DataFrame) -> DataFrame:
        own = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("_c"))
        return rows.join(own, "doc_id", "left").withColumn("component", F.coalesce("_c", "doc_id")).drop("_c")

    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PER_CENT))
    for turn in range(LEADER_ROUNDS + 1):
        members = settle_narrow(placed(many))
        open_ = members.groupBy("shingle").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi")
        many = settle_narrow(members.join(open_.select("shingle"), "shingle", "left_semi"))
        if many.isEmpty():
            break
        members, many = many, many.drop("component")
        if turn < LEADER_ROUNDS:
            members = members.withColumn("band", band)
            # The fewer shingles of its own, the nearer a set is to all others of the group.
            drawn = F.min(F.struct("place" if turn == 0 else F.xxhash64("doc_id", F.lit(turn)), "doc_id", "variant", "component")).alias("_l")
            leaders = members.groupBy("shingle", "band").agg(drawn)
            leaders = leaders.select("shingle", "band", F.col("_l.doc_id").alias("a"), F.col("_l.variant").alias("v_a"), F.col("_l.component").alias("_c"))
            met = members.join(leaders, ["shingle", "band"]).where("component <> _c")
            pairs = met.select("a", "v_a", F.col("doc_id").alias("b"), F.col("variant").alias("v_b"))
        else:
            # Whatever is left between components is compared in full, but for pairs within the largest one.
            each = members.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("_n")).groupBy("shingle")
            largest = each.agg(F.max(F.struct("_n", "component")).alias("_m")).select("shingle", F.col("_m.component").alias("_main"))
            outside = members.join(largest, "shingle").where("component <> _main").drop("_main")
            met = side(outside, "a").join(side(members, "b"), "shingle")
            met = met.where((F.col("c_a") != F.col("c_b")) & _may_match("a", "b") & F.when(forward, F.col("indexed_a")).otherwise(F.col("indexed_b")))
            ends = [F.struct(F.col(x).alias("id"), F.col(f"v_{x}").alias("v")) for x in ("a", "b")]
            met = met.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"))
            pairs = met.select(F.col("x.id").alias("a"), F.col("x.v").alias("v_a"), F.col("y.id").alias("b"), F.col("y.v").alias("v_b"))
        labels = merge_components(labels, checked(pairs))
        tidy(signed, classes, sets, many, labels)

    found = classes.select("digest", "doc_id").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    found = found.select("digest", F.coalesce("component", "doc_id").alias("component"))
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = linkable.join(found, "digest").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return rest.unionByName(alone)
