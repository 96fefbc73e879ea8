"""A trie of conversation prefixes from double arrays, one per prefix shard.

A sequence of turns is a path of 16-byte digests. Equal sequences are one, with the number of its conversations.

1. Prefixes below which more turns stand than a shard may hold are hot; they are found level by level, and there are at
   most `total / limit` of them on a level, `limit` being at least the square root of all turns. A sequence's shard is
   named by its first prefix that is not hot, so all nodes from there on lie in one shard.
2. A shard numbers its turns densely, packs BASE and CHECK over these numbers (child of state s by turn c: state
   BASE[s] + c, if its CHECK is s), walks its sequences through them and sums from the leaves to the root along CHECK.
3. Hot prefixes and the root are shared by shards. What shards found below them is summed over all shards, and one more
   double array, over the hot prefixes alone, carries the sums to the root.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.mixing import word_count
from plumbline.session import settle

DIGEST = 16
#: Turns of a row of a path, and turns of a shard.
CHUNK_TURNS = 1 << 14
SHARD_TURNS = 1 << 15
IDS_BYTES = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_PATHS = "conv_id bigint, chunk int, path binary, words binary, length bigint, whole binary"
_NODES = "up binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


class DoubleArray:
    """BASE and CHECK of a trie of sorted, distinct sequences of numbers from 1 on; state 0 is the root.

    BASE may be negative: only BASE + number is ever looked up.
    """

    def __init__(self, sequences: list[np.ndarray]):
        parents, codes = self._nodes(sequences)
        slots = np.zeros(len(parents) + 1, np.int64)
        order = np.argsort(parents, kind="stable")
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(parents[order])) + 1]) if len(order) else np.empty(0, np.int64)
        counts = np.diff(np.append(firsts, len(order)))
        used = np.zeros(1024, bool)
        used[0] = True

        def room(places: int) -> None:
            """Makes `used` that long at least."""
            nonlocal used
            if len(used) < places:
                used = np.concatenate([used, np.zeros(places, bool)])

        bases = np.zeros(len(parents) + 1, np.int64)
        # Nodes with several children first: the first place where all of them are free.
        free, top = 1, 1
        for k in np.flatnonzero(counts > 1).tolist():
            children = order[firsts[k] : firsts[k] + counts[k]]
            steps = codes[children] - codes[children[0]]
            room(max(top, free) + int(steps[-1]) + 2)
            at = self._fit(used, free, top, steps)
            used[at + steps] = True
            top = max(top, at + int(steps[-1]) + 1)
            slots[children + 1] = at + steps
            bases[parents[children[0]]] = at - codes[children[0]]
            while used[free]:
                free += 1
                room(free + 1)
        # An only child fits anywhere: the free places in order.
        single = order[firsts[counts == 1]]
        room(int(used.sum()) + len(single))
        slots[single + 1] = np.flatnonzero(~used)[: len(single)]
        bases[parents[single]] = slots[single + 1] - codes[single]
        size = int(slots.max(initial=0)) + 1
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.base[slots] = bases
        self.check[slots[1:]] = slots[parents]

    @staticmethod
    def _nodes(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Parent (node 0: the root) and number of each node from 1 on, in the order of the sequences."""
        parents, codes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        before, path, n = np.empty(0, np.int64), np.zeros(1, np.int64), 1
        for numbers in sequences:
            shared = min(len(before), len(numbers))
            off = np.flatnonzero(before[:shared] != numbers[:shared])
            shared = int(off[0]) if len(off) else shared
            fresh = np.arange(n, n + len(numbers) - shared)
            path = np.concatenate([path[: shared + 1], fresh])
            parents.append(path[shared:-1])
            codes.append(numbers[shared:])
            before, n = numbers, n + len(fresh)
        return np.concatenate(parents), np.concatenate(codes)

    @staticmethod
    def _fit(used: np.ndarray, free: int, top: int, steps: np.ndarray, tries: int = 4, window: int = 64) -> int:
        """The first of the next free places from which all steps lead to free ones, or the place behind all used ones."""
        at = free
        for _ in range(tries):
            places = at + np.flatnonzero(~used[at : at + 4 * window])[:window]
            places = places[places < top]
            if not len(places):
                break
            good = ~used[places[:, None] + steps].any(1)
            if good.any():
                return int(places[good][0])
            at = int(places[-1]) + 1
        return max(top, free)

    def steps(self, sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Walks all sequences a turn at a time: (which sequences, their states, the turns that led there), from the root on."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        rows = np.argsort(-lengths, kind="stable")
        ordered = lengths[rows]
        starts = (np.cumsum(lengths) - lengths)[rows]
        numbers = np.concatenate([*sequences, np.empty(0, np.int64)])
        states = np.zeros(len(rows), np.int64)
        yield rows, states, np.zeros(len(rows), np.int64)
        for depth in range(int(lengths.max(initial=0))):
            open_ = int(np.searchsorted(-ordered, -depth, "left"))
            rows, ordered, starts, states = rows[:open_], ordered[:open_], starts[:open_], states[:open_]
            taken = numbers[starts + depth]
            after = self.base[states] + taken
            if (self.check[after] != states).any():
                raise ValueError("a sequence leaves the trie")
            states = after
            yield rows, states, taken


class Shard:
    """Aggregates of all nodes of one double array, by state."""

    def __init__(self, paths: list[bytes], words: list[bytes]):
        """`paths` are distinct and sorted; `words` holds the sizes (i4) of each path's turns."""
        # Numbers rise with the digests, so sorted paths are sorted sequences.
        distinct, dense = np.unique(np.frombuffer(b"".join(paths), f"S{DIGEST}"), return_inverse=True)
        ends = np.cumsum([len(p) // DIGEST for p in paths]).tolist()
        dense = dense.astype(np.int64) + 1
        self.sequences = [dense[a:b] for a, b in zip([0, *ends], ends)]
        self.trie = DoubleArray(self.sequences)
        sizes = np.zeros(len(distinct) + 1, np.int64)
        sizes[dense] = np.frombuffer(b"".join(words), "<i4")
        size = len(self.trie.check)
        self.depth = np.full(size, -1, np.int64)
        self.sizes = np.zeros(size, np.int64)
        self.ends = np.zeros(len(paths), np.int64)
        self.visits: list[tuple[np.ndarray, np.ndarray]] = []
        for depth, (rows, states, numbers) in enumerate(self.trie.steps(self.sequences)):
            self.visits.append((rows, states))
            self.depth[states] = depth
            self.ends[rows] = states
            self.sizes[states] = sizes[numbers]

    def through(self, values: list[int]) -> np.ndarray:
        """Sum of the values of all sequences through each state."""
        out, values = np.zeros(len(self.depth), np.int64), np.array(values, np.int64)
        for rows, states in self.visits:
            np.add.at(out, states, values[rows])
        return out

    def smallest(self, values: list[int]) -> np.ndarray:
        out, values = np.full(len(self.depth), np.iinfo(np.int64).max), np.array(values, np.int64)
        for rows, states in self.visits:
            np.minimum.at(out, states, values[rows])
        return out

    def at_ends(self, values: list, default) -> list:
        out = [default] * len(self.depth)
        for state, value in zip(self.ends.tolist(), values):
            out[state] = value
        return out

    def below(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees, tops included, carried along CHECK from the deepest states on."""
        out = own.copy()
        order = np.argsort(-self.depth, kind="stable")
        order = order[self.depth[order] > 0]
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        for level in np.split(order, cuts):
            np.add.at(out, self.trie.check[level], out[level])
        return out

    def children(self) -> np.ndarray:
        inner = self.trie.check[self.trie.check >= 0]
        return np.bincount(inner, minlength=len(self.depth))


def rebuilt_paths(conversations: DataFrame, stride: int = 20, most: int = 4) -> DataFrame:
    """Paths of conversations whose first turns are those of the first conversation of their run of `stride` ids.

    Conversation c takes the first h turns, h being crc32 of its decimal id modulo `most`, from conversation c - c % stride,
    and its own behind its first h. Returns (conv_id, chunk, path, words, length, whole): a path in rows of CHUNK_TURNS
    turns, the last of which has the number of all turns and the digest of the whole path.

    Turns go in order of `turn`, nulls first, equal ones by the digest of role and text. Rows without
    conv_id belong to no conversation. One shuffle of digests by run; a run streams through its task, whatever its size.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    conv = F.col("conv_id").cast("bigint")
    turns = conversations.where("conv_id IS NOT NULL").select(
        (conv - conv % stride).alias("head"), conv.alias("conv_id"), F.col("turn"), F.unhex(F.substring(told, 1, 2 * DIGEST)).alias("code"), word_count(text).alias("words")
    )
    order = ["head", F.col("conv_id") != F.col("head"), "conv_id", F.col("turn").asc_nulls_first(), "code"]

    def rebuild(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows: list[tuple] = []
        held: list[tuple[bytes, int]] = []
        head = conv_id = None
        first: list[tuple[bytes, int]] = []
        chunk = seen = drop = length = 0
        whole = hashlib.sha256()

        def emit(last: bool) -> None:
            nonlocal chunk, length
            path = b"".join(c for c, _ in held)
            whole.update(path)
            length += len(held)
            tail = (length, whole.digest()) if last else (None, None)
            rows.append((conv_id, chunk, path, np.array([w for _, w in held], "<i4").tobytes(), *tail))
            held.clear()
            chunk += 1

        def batch_of():
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            names = ["conv_id", "chunk", "path", "words", "length", "whole"]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], names)
            rows.clear()
            return out

        for batch in batches:
            for at, own, code, words in zip(*(batch.column(c).to_pylist() for c in ("head", "conv_id", "code", "words"))):
                if own != conv_id:
                    if conv_id is not None:
                        emit(True)
                    if at != head:
                        head, first = at, []
                    conv_id, chunk, seen, length, whole = own, 0, 0, 0, hashlib.sha256()
                    drop = 0 if own == head else zlib.crc32(str(own).encode()) % most
                    held.extend(first[:drop])
                seen += 1
                if own == head and seen < most:
                    first.append((code, words))
                if seen > drop:
                    held.append((code, words))
                    if len(held) >= CHUNK_TURNS:
                        emit(False)
            yield batch_of()
        if conv_id is not None:
            emit(True)
        yield batch_of()

    return turns.repartition("head").sortWithinPartitions(*order).select("head", "conv_id", "code", "words").mapInArrow(rebuild, _PATHS)


def _joined_ids(members: DataFrame) -> DataFrame:
    """(whole, ends): SHA-256 of the ascending, comma-joined ids of all members (conv_id, whole).

    Ids are dealt out by range, so a class of any size is joined in as many tasks; its pieces, one or some per
    range, then stream in order into one digest.
    """

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[bytes] = []
        key = first = None
        size = 0
        rows: list[tuple] = []
        for batch in batches:
            for whole, conv_id in zip(batch.column("whole").to_pylist(), batch.column("conv_id").to_pylist()):
                if whole != key or size >= IDS_BYTES:
                    if held:
                        rows.append((key, first, b",".join(held)))
                    held, key, first, size = [], whole, conv_id, 0
                held.append(str(conv_id).encode())
                size += len(held[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.binary(), pa.int64(), pa.binary()))], ["whole", "first", "ids"])
            rows = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([b",".join(held)], pa.binary())], ["whole", "first", "ids"])

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, told = None, hashlib.sha256()
        rows: list[tuple] = []
        for batch in batches:
            for whole, ids in zip(batch.column("whole").to_pylist(), batch.column("ids").to_pylist()):
                if whole != key:
                    if key is not None:
                        rows.append((key, told.hexdigest()))
                    key, told = whole, hashlib.sha256(ids)
                else:
                    told.update(b"," + ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 2, (pa.binary(), pa.string()))], ["whole", "ends"])
            rows = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([told.hexdigest()], pa.string())], ["whole", "ends"])

    ranged = members.select("whole", "conv_id").repartitionByRange("conv_id").sortWithinPartitions("whole", "conv_id")
    pieces = ranged.mapInArrow(join, "whole binary, first bigint, ids binary")
    return pieces.repartition("whole").sortWithinPartitions("whole", "first").select("whole", "ids").mapInArrow(digest, "whole binary, ends string")


def _prefix(turns: int):
    """The digest that names the prefix of a path's first `turns` turns."""
    return F.unhex(F.substring(F.sha2(F.substring("path", 1, DIGEST * turns), 256), 1, 2 * DIGEST))


def _table(columns, names: str):
    import pyarrow as pa

    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def shard_nodes(sequences: DataFrame) -> DataFrame:
    """Nodes of all shards, from rows (depth, bucket, up, parent, rep, chunk, path, words, n, ends).

    A shard holds the nodes from `depth` turns on. `up` stands at its nodes of just that depth and names the hot prefix above.
    """

    def nodes_of(held: list[dict]) -> list:
        for s in held:
            s["path"], s["words"] = b"".join(s["path"]), b"".join(s["words"])
        held.sort(key=lambda s: s["path"])
        shard = Shard([s["path"] for s in held], [s["words"] for s in held])
        n = shard.through([s["n"] for s in held])
        smallest = shard.smallest([s["rep"] for s in held])
        children = shard.children()
        leaves = shard.below((children == 0).astype(np.int64))
        saved = shard.below((n - 1) * shard.sizes)
        ends = shard.at_ends([s["ends"] for s in held], _EMPTY)
        top = held[0]["depth"]
        # States above belong to all shards.
        shown = np.flatnonzero(shard.depth >= top)
        parents = smallest[shard.trie.check]
        up: dict[int, bytes] = {}
        for r, s in zip(*(x.tolist() for x in shard.visits[top])):
            up[s] = held[r]["up"]
            parents[s] = held[r]["parent"]
        numbers = (shard.depth, smallest, parents, n, children, leaves, saved)
        return [[up.get(s) for s in shown.tolist()], *(x[shown] for x in numbers), [ends[s] for s in shown.tolist()]]

    def build(batches: Iterator) -> Iterator:
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["depth"], row["bucket"]) != key:
                    if held:
                        yield _table(nodes_of(held), _NODES)
                    key, held = (row["depth"], row["bucket"]), []
                if row["chunk"]:
                    held[-1]["path"].append(row["path"])
                    held[-1]["words"].append(row["words"])
                else:
                    held.append(row | {"path": [row["path"]], "words": [row["words"]]})
        if held:
            yield _table(nodes_of(held), _NODES)

    return sequences.repartition("depth", "bucket").sortWithinPartitions("depth", "bucket", "rep", "chunk").mapInArrow(build, _NODES)


def upper_nodes(hot: DataFrame) -> DataFrame:
    """Nodes of the hot prefixes, from one row each: (path, words, n, rep, ends, n_children, n_leaves, saved).

    The last three sum up what shards found right below. There are at most as many rows as the square root of
    all turns, times the levels on which prefixes are hot; one task walks them all.
    """

    def build(batches: Iterator) -> Iterator:
        held = [row for batch in batches for row in batch.to_pylist()]
        if not held:
            return
        held.sort(key=lambda s: s["path"])
        shard = Shard([s["path"] for s in held], [s["words"] for s in held])
        n, smallest, below, leaves, saved = (np.array(shard.at_ends([s[c] for s in held], 0), np.int64) for c in ("n", "rep", "n_children", "n_leaves", "saved"))
        children = shard.children() + below
        leaves = shard.below(leaves + (children == 0))
        saved = shard.below(saved + (n - 1) * shard.sizes)
        ends = shard.at_ends([s["ends"] for s in held], _EMPTY)
        at = shard.ends
        parents = [int(smallest[c]) if c >= 0 else None for c in shard.trie.check[at].tolist()]
        columns = [[None] * len(at), shard.depth[at], smallest[at], parents, n[at], children[at], leaves[at], saved[at], [ends[s] or _EMPTY for s in at.tolist()]]
        yield _table(columns, _NODES)

    return hot.select("path", "words", "n", "rep", "ends", "n_children", "n_leaves", "saved").coalesce(1).mapInArrow(build, _NODES)


def prefix_trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of all paths of `rebuilt_paths`.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest id
    below a node and below its parent, conversations and childless nodes below it, words that sharing its subtree's turns
    saves, and the digest of the ids that end at it. An empty table gives no row. Jobs run while this is called; what
    they share is settled. A shard holds about `shard_turns` turns in memory, or the square root of all, or one
    conversation that is longer, at 16 bytes and some numbers a turn.
    """
    paths = settle(paths)
    members = paths.where("whole IS NOT NULL")
    classes = members.groupBy("whole").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    classes = classes.join(_joined_ids(members), "whole").select(F.col("rep").alias("conv_id"), "n", F.col("length").alias("turns"), "ends")
    reps = settle(paths.join(classes, "conv_id").select(F.col("conv_id").alias("rep"), "chunk", "path", "words", "n", "turns", "ends"))
    first = reps.where("chunk = 0")
    everyone = first.agg(F.sum("turns"), F.sum("n"), F.min("rep"), F.max("turns")).first()
    if everyone[1] is None:
        return paths.sparkSession.createDataFrame([], _NODES).drop("up")
    limit = max(shard_turns, math.isqrt(everyone[0]) + 1)
    buckets = -(-everyone[0] // limit)

    above = _prefix(0)
    opened = first.withColumns({"up": above, "parent": F.lit(everyone[2])})
    empty = first.where("turns = 0").select("ends")
    root = first.limit(1).select(F.lit(0).alias("depth"), above.alias("up"), F.lit(b"").alias("path"), F.lit(b"").alias("words"), F.lit(everyone[1]).alias("n"), F.lit(everyone[2]).alias("rep"))
    hot = [root.join(empty, F.lit(True), "left")]
    dealt = []
    opened = opened.where("turns > 0")
    for depth in range(1, min(everyone[3], CHUNK_TURNS) + 1):
        named = opened.withColumn("prefix", _prefix(depth))
        here = F.col("turns") == depth
        groups = named.groupBy("prefix").agg(
            F.sum("turns").alias("_turns"), F.count(F.lit(1)).alias("_seqs"), F.sum("n").alias("n"), F.min("rep").alias("rep"),
            F.first(F.substring("path", 1, DIGEST * depth)).alias("path"), F.first(F.substring("words", 1, 4 * depth)).alias("words"), F.max(F.when(here, F.col("ends"))).alias("ends"),
        )
        found = settle(groups.where((F.col("_turns") > limit) & (F.col("_seqs") > 1)))
        deeper = not found.isEmpty()
        # At most total / limit rows, and so at most the square root of all turns.
        met = named.join(F.broadcast(found.select("prefix", F.col("rep").alias("_rep"))), "prefix", "left") if deeper else named.withColumn("_rep", F.lit(None).cast("bigint"))
        bucket = F.pmod(F.xxhash64("prefix"), F.lit(buckets))
        dealt.append(met.where("_rep IS NULL").select("rep", F.lit(depth).alias("depth"), bucket.alias("bucket"), "up", "parent"))
        if not deeper:
            break
        hot.append(found.select(F.lit(depth).alias("depth"), F.col("prefix").alias("up"), "path", "words", "n", "rep", "ends"))
        opened = met.where((F.col("_rep").isNotNull()) & ~here).select(*first.columns, F.col("prefix").alias("up"), F.col("_rep").alias("parent"))
    if not dealt:
        nodes = paths.sparkSession.createDataFrame([], _NODES)
    else:
        shards = dealt[0]
        for more in dealt[1:]:
            shards = shards.unionByName(more)
        nodes = settle(shard_nodes(reps.select("rep", "chunk", "path", "words", "n", "ends").join(shards, "rep")))
    sums = nodes.where("up IS NOT NULL").groupBy("up").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    shared = hot[0]
    for more in hot[1:]:
        shared = shared.unionByName(more)
    shared = shared.join(sums, "up", "left").fillna(0, ["n_children", "n_leaves", "saved"])
    return nodes.unionByName(upper_nodes(shared)).drop("up")


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of rebuilt conversations: `rebuilt_paths`, then `prefix_trie`."""
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return prefix_trie(rebuilt_paths(conversations), shard_turns).select(columns)
