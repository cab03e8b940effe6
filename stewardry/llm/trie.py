"""Prefix trie of conversations in flat arrays, addressed by minimal perfect hashes.

A prefix is the exclusive-or of the hashes of its turns, each salted with its place; a turn is known by 128 bits. Along a
conversation these are running values, kept over stretches of 4096 turns, so that one long conversation is many tasks'
work. Conversations that start alike lie next to each other, in shards of bounded size. A shard lists its distinct
prefixes, gives each a slot by a minimal perfect hash, whose slots are verified against the prefixes themselves, and
scatters its counts into arrays by slot. Only a shard's nodes are shuffled: a prefix that a third of all conversations
share is a row per shard. A digest whose parent, depth or size differ anywhere stops the job.

The smallest member of a node owns it. What a node adds to its ancestors is added in its owner's shard alone, from the
deepest slots up, along the array of parent slots; a node's sums over all shards are thus those of its whole subtree,
without a round per depth. A stretch adds what its owner's later stretches come to at its own last slot.

Rows without ``conv_id`` belong to no conversation and are left out. Null roles and texts are empty ones. Turns with the
same number follow each other by the hash of their content; repeated rows are turns of their own. An empty table has no
conversation, and so no root. Columns beyond ``conv_id``, ``turn``, ``role`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stewardry.llm.ordering import positions
from stewardry.scale import cut

STRETCH_BITS = 12  # a stretch of a conversation has 2**12 depths
SHARD_ROWS = 1 << 15  # a shard ends with the stretch that reaches so many
LISTED_BYTES = 1 << 16  # of conversation ids joined at once

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    z = values + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    z = (z ^ (z >> np.uint64(27))) * _MIX[1]
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 128-bit keys.

    Each level has a table of twice its keys in bits: a key alone on its place is settled, the others go on. A slot is
    the rank of its bit. ``verified`` keeps the keys by slot, and a lookup fails for any other key.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        rest, settled = np.arange(len(first)), 0
        while len(rest):
            if len(self.levels) == 100:
                raise ValueError("keys are not distinct")
            at = self._places(first[rest], second[rest], len(self.levels), 2 * len(rest) + 1)
            alone = np.bincount(at, minlength=2 * len(rest) + 1) == 1
            self.levels.append(alone)
            self.ranks.append(settled + np.cumsum(alone) - 1)
            settled += int(alone.sum())
            rest = rest[~alone[at]]
        self.verified = (np.zeros_like(first), np.zeros_like(second))
        slots = self._slots(first, second)
        if len(np.unique(slots)) != len(first):
            raise ValueError("two keys share a slot")
        self.verified[0][slots], self.verified[1][slots] = first, second

    @staticmethod
    def _places(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mixed(first ^ _mixed(second, 2 * level + 1), 2 * level + 2) % np.uint64(size)).astype(np.int64)

    def _slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        slots = np.full(len(first), -1, dtype=np.int64)
        rest = np.arange(len(first))
        for level, (alone, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._places(first[rest], second[rest], level, len(alone))
            here = alone[at]
            slots[rest[here]] = ranks[at[here]]
            rest = rest[~here]
        return slots

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that have none."""
        slots = self._slots(first, second)
        known = slots >= 0
        known[known] = (self.verified[0][slots[known]] == first[known]) & (self.verified[1][slots[known]] == second[known])
        return np.where(known, slots, -1)


def accumulate(values: np.ndarray, parents: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Sums over subtrees, by adding each depth's slots to their parents', from the deepest up. -1 is no parent."""
    out = values.copy()
    order = np.argsort(-depths, kind="stable")
    borders = np.flatnonzero(np.diff(depths[order])) + 1
    for slots in np.split(order, borders):
        inner = slots[parents[slots] >= 0]
        np.add.at(out, parents[inner], out[inner])
    return out


# Conversations ------------------------------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, ``position`` from 0, ``n`` turns in all, the turn's 128 bits ``t1``, ``t2``, ``bytes`` of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    return cut(positions(rows, "conv_id", ["turn", "t1", "t2"], "turns").drop("turn"), "placed-turns")


def grafted(turn_rows: DataFrame, base: Column, given: Column, most: int, stretch_bits: int = STRETCH_BITS) -> DataFrame:
    """Conversations rebuilt on another's start: conv_id, ``near``, ``depth``, ``t1``, ``t2``, ``bytes``.

    ``base`` and ``given`` are computed from conv_id: the first ``given`` turns of the base, all if it has fewer and
    none if it does not exist, replace as many of the conversation's own. ``most`` bounds ``given``. A row of depth 0
    stands for the conversation itself.
    """
    convs = turn_rows.where("position = 0").select("conv_id", "n", base.alias("near"), given.alias("given"))
    sizes = convs.select(F.col("conv_id").alias("near"), F.col("n").alias("n_base"))
    convs = convs.join(sizes, "near", "left").withColumn("taken", F.least("given", F.coalesce("n_base", F.lit(0))))
    head = (
        turn_rows.where(F.col("position") < most).drop("n").withColumnRenamed("conv_id", "near")
        .join(convs, "near").where(F.col("position") < F.col("taken"))
        .select("conv_id", "near", (F.col("position") + 1).alias("depth"), "t1", "t2", "bytes")
    )
    # a conversation's turns meet its row in stretches, so that a long one is no single key
    stretched = convs.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("n") - 1, stretch_bits))))
    tail = (
        turn_rows.drop("n").withColumn("stretch", F.shiftright("position", stretch_bits)).join(stretched, ["conv_id", "stretch"])
        .where(F.col("position") >= F.col("given"))
        .select("conv_id", "near", (F.col("position") - F.col("given") + F.col("taken") + 1).alias("depth"), "t1", "t2", "bytes")
    )
    zero = F.lit(0).cast("bigint")
    top = convs.select("conv_id", "near", zero.alias("depth"), zero.alias("t1"), zero.alias("t2"), zero.alias("bytes"))
    return head.unionByName(tail).unionByName(top)


# Trie ---------------------------------------------------------------------------------------------------------------


def _prefixes(members: DataFrame, stretch_bits: int) -> DataFrame:
    """Each row with its prefix ``p1``, ``p2``, its parent's ``q1``, ``q2``, its ``stretch`` and the conversation's ``length``."""
    salted = [F.when(F.col("depth") == 0, F.lit(0).cast("bigint")).otherwise(h) for h in (F.xxhash64("depth", "t1", "t2"), F.xxhash64("t2", "t1", "depth"))]
    rows = members.select(
        "conv_id", "near", "depth", "bytes", salted[0].alias("m1"), salted[1].alias("m2"), F.shiftright("depth", stretch_bits).alias("stretch")
    )
    rows = cut(rows, "members")
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    sums = rows.groupBy("conv_id", "stretch").agg(F.bit_xor("m1").alias("s1"), F.bit_xor("m2").alias("s2"), F.count("*").alias("n"))
    sums = sums.select(
        "conv_id", "stretch", (F.sum("n").over(whole) - 1).alias("length"),
        *[F.coalesce(F.bit_xor(s).over(before), zero).alias(s) for s in ("s1", "s2")],
    )
    here = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumns({"r1": F.bit_xor("m1").over(here), "r2": F.bit_xor("m2").over(here)})
    p1, p2 = (F.col(f"r{k}").bitwiseXOR(F.col(f"s{k}")) for k in (1, 2))
    return running.join(sums, ["conv_id", "stretch"]).select(
        "conv_id", "near", "stretch", "depth", "bytes", "length",
        p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("m1")).alias("q1"), p2.bitwiseXOR(F.col("m2")).alias("q2"),
    )


_NODES = (
    "shard long, stretch long, slot long, parent long, depth long, bytes long, p1 long, p2 long, q1 long, q2 long, "
    "n_convs long, n_ends long, least long, stub boolean, goes_on boolean"
)


def _shards(prefixes: DataFrame, stretch_bits: int, shard_rows: int) -> DataFrame:
    """The nodes of each shard by slot, and a row with ``goes_on`` for each conversation that has a next stretch."""
    more = ((F.col("depth") + 1) % (1 << stretch_bits) == 0) & (F.col("depth") < F.col("length"))
    # the last prefix of a stretch is also the stub that the next stretch hangs on
    rows = prefixes.withColumn("stretch", F.explode(F.when(more, F.array("stretch", F.col("stretch") + 1)).otherwise(F.array("stretch"))))
    by = ["stretch", "near", "conv_id"]
    names = ["conv_id", "stretch", "depth", "bytes", "length", "p1", "p2", "q1", "q2"]

    def table(at: dict[str, np.ndarray], shard: int) -> pa.RecordBatch:
        p1, p2 = at["p1"].view(np.uint64), at["p2"].view(np.uint64)
        order = np.lexsort((p2, p1))
        new = np.r_[True, (np.diff(p1[order]) != 0) | (np.diff(p2[order]) != 0)]
        firsts = order[new]
        phash = PerfectHash(p1[firsts], p2[firsts])
        slot, n = phash.slots(p1, p2), len(firsts)
        one = np.zeros(n, dtype=np.int64)
        one[phash.slots(p1[firsts], p2[firsts])] = firsts
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, slot, at["conv_id"])
        parent = phash.slots(at["q1"][one].view(np.uint64), at["q2"][one].view(np.uint64))
        depth, stretch = at["depth"][one], at["stretch"][one]
        parent[depth == 0] = -1
        stub = depth < stretch << stretch_bits
        for name in ("q1", "q2", "depth", "bytes"):
            if (at[name] != at[name][one][slot]).any():
                raise ValueError("two prefixes share a digest")
        last = ((at["depth"] + 1) % (1 << stretch_bits) == 0) & (at["depth"] >> stretch_bits == at["stretch"]) & (at["depth"] < at["length"])
        on = np.flatnonzero(last)
        pick = np.r_[one, on]
        columns = {
            "shard": np.full(n + len(on), shard), "stretch": at["stretch"][pick], "slot": np.r_[np.arange(n), slot[on]],
            "parent": np.r_[np.where(stub, -1, parent), np.full(len(on), -1)],
            **{name: at[name][pick] for name in ("depth", "bytes", "p1", "p2", "q1", "q2")},
            "n_convs": np.r_[np.bincount(slot, minlength=n), np.zeros(len(on), dtype=np.int64)],
            "n_ends": np.r_[np.bincount(slot[at["depth"] == at["length"]], minlength=n), np.zeros(len(on), dtype=np.int64)],
            "least": np.r_[least, at["conv_id"][on]], "stub": np.r_[stub, np.zeros(len(on), dtype=bool)],
            "goes_on": np.r_[np.zeros(n, dtype=bool), np.ones(len(on), dtype=bool)],
        }
        return pa.RecordBatch.from_pydict(columns)

    def enumerate_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        held: dict[str, np.ndarray] = {name: np.empty(0, dtype=np.int64) for name in names}
        for batch in batches:
            held = {name: np.r_[held[name], batch[name].to_numpy()] for name in names}
            while True:
                # whole stretches only, and of one number: up to the first border at or behind the wanted size
                borders = np.flatnonzero(np.diff(held["conv_id"]) | np.diff(held["stretch"])) + 1
                turned = np.flatnonzero(np.diff(held["stretch"])) + 1
                ends = np.r_[borders[borders >= shard_rows][:1], turned[:1]]
                if not len(ends):
                    break
                end = int(ends.min())
                yield table({name: held[name][:end] for name in names}, shard)
                held = {name: held[name][end:] for name in names}
                shard += 1
        if len(held["conv_id"]):
            yield table(held, shard)

    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by, "depth").select(*names)
    return cut(ordered.mapInArrow(enumerate_prefixes, _NODES), "shards")


def _owners(nodes: DataFrame) -> DataFrame:
    """One row per node: ``owner`` (its smallest member), ``n_convs``, ``n_ends``, depth and bytes."""
    whole = nodes.where("NOT goes_on AND NOT stub").groupBy("p1", "p2")
    checked = [F.min(c).alias(f"{c}_min") for c in ("q1", "q2", "depth", "bytes")] + [F.max(c).alias(f"{c}_max") for c in ("q1", "q2", "depth", "bytes")]
    found = whole.agg(F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends"), F.min("least").alias("owner"), *checked)
    same = F.lit(True)
    for c in ("q1", "q2", "depth", "bytes"):
        same = same & (F.col(f"{c}_min") == F.col(f"{c}_max"))
    n_convs = F.when(same, F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("bigint"))
    return found.select("p1", "p2", "owner", n_convs.alias("n_convs"), "n_ends", F.col("depth_min").alias("depth"), F.col("bytes_min").alias("bytes"))


def _sums(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """Per node: ``n_children``, ``n_leaves``, ``saved_tokens`` and ``parent_conv_id``, added up over shards."""
    known = nodes.where("NOT goes_on").join(owners.select("p1", "p2", "owner", F.col("n_convs").alias("all"), F.col("n_ends").alias("ends")), ["p1", "p2"])
    mine = (F.col("least") == F.col("owner")) & ~F.col("stub")
    known = known.select(
        "shard", "stretch", "slot", "parent", "depth", "p1", "p2", "owner", "stub", mine.alias("mine"),
        F.when(mine & (F.col("all") == F.col("ends")), 1).otherwise(0).cast("bigint").alias("leaf"),
        F.when(mine, (F.col("all") - 1) * F.col("bytes")).otherwise(F.lit(0)).cast("bigint").alias("saved"),
    )
    known = cut(known, "owned")
    # what the later stretches of a conversation come to, for the last slot of each stretch that goes on
    later = known.where("mine AND stretch > 0").groupBy(F.col("owner").alias("conv"), "stretch").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    none = F.lit(None).cast("bigint")
    ends = nodes.where("goes_on").select(F.col("least").alias("conv"), "stretch", "shard", "slot")
    both = later.select("conv", "stretch", "leaf", "saved", none.alias("shard"), none.alias("slot")).unionByName(
        ends.select("*", F.lit(0).cast("bigint").alias("leaf"), F.lit(0).cast("bigint").alias("saved"))
    )
    behind = Window.partitionBy("conv").orderBy(F.col("stretch").desc()).rangeBetween(Window.unboundedPreceding, -1)
    carried = both.select("shard", "slot", *[F.coalesce(F.sum(c).over(behind), F.lit(0)).alias(f"more_{c}") for c in ("leaf", "saved")]).where("shard IS NOT NULL")
    carried = carried.groupBy("shard", "slot").agg(F.sum("more_leaf").alias("more_leaf"), F.sum("more_saved").alias("more_saved"))
    rows = known.join(carried, ["shard", "slot"], "left").select(
        "shard", "slot", "parent", "depth", "p1", "p2", "owner", "stub", "mine",
        (F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).alias("leaf"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
    )
    names = rows.columns

    def table(at: dict[str, np.ndarray]) -> pa.RecordBatch:
        parent, depth, mine = at["parent"], at["depth"], at["mine"]
        up = np.flatnonzero(parent >= 0)
        children = np.zeros(len(parent), dtype=np.int64)
        np.add.at(children, parent[up], mine[up].astype(np.int64))
        # a stub's own stretch gets this shard's sums by way of ``carried``: only the children count there
        inner = np.where(at["stub"][parent], -1, parent)
        leaves, saved = (accumulate(at[c], np.where(parent >= 0, inner, -1), depth) for c in ("leaf", "saved"))
        above = np.where(parent >= 0, at["owner"][parent], 0)
        return pa.RecordBatch.from_pydict({
            "p1": at["p1"], "p2": at["p2"], "n_children": children, "n_leaves": np.where(at["stub"], 0, leaves),
            "saved_tokens": np.where(at["stub"], 0, saved), "parent_conv_id": pa.array(above, mask=~(mine & (parent >= 0))),
        })

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {name: batch[name].to_numpy(zero_copy_only=False) for name in names}
            held = new if held is None else {name: np.r_[held[name], new[name]] for name in names}
            borders = [0, *(np.flatnonzero(np.diff(held["shard"])) + 1).tolist()]
            for first, end in zip(borders, borders[1:], strict=False):
                yield table({name: held[name][first:end] for name in names})
            held = {name: held[name][borders[-1]:] for name in names}
        if held is not None and len(held["shard"]):
            yield table(held)

    schema = "p1 long, p2 long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"
    summed = rows.repartition("shard").sortWithinPartitions("shard", "slot").mapInArrow(add_up, schema)
    return summed.groupBy("p1", "p2").agg(
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.max("parent_conv_id").alias("parent_conv_id")
    )


def _ended(prefixes: DataFrame) -> DataFrame:
    """Per node where conversations end, the digest of their ids, ascending.

    The ids are sorted over all tasks and joined there; one task then reads a node's joined stretches in order.
    """
    by = ["p1", "p2", "conv_id"]
    ends = prefixes.where("depth = length").select(*by)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size = None, [], 0

        def flush():
            return pa.RecordBatch.from_pydict({
                "p1": pa.array([key[0]], pa.int64()), "p2": pa.array([key[1]], pa.int64()),
                "first": pa.array([ids[0]], pa.int64()), "listed": pa.array([",".join(map(str, ids))]),
            })

        for batch in batches:
            for p1, p2, conv in zip(*(batch[c].to_pylist() for c in by), strict=True):
                if ids and ((p1, p2) != key or size >= LISTED_BYTES):
                    yield flush()
                    ids, size = [], 0
                key = (p1, p2)
                ids.append(conv)
                size += 20
        if ids:
            yield flush()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def flush():
            return pa.RecordBatch.from_pydict({
                "p1": pa.array([key[0]], pa.int64()), "p2": pa.array([key[1]], pa.int64()), "ends_sha256": [state.hexdigest()],
            })

        for batch in batches:
            for p1, p2, part in zip(*(batch[c].to_pylist() for c in ("p1", "p2", "listed")), strict=True):
                if (p1, p2) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        yield flush()
                    key, state = (p1, p2), sha256()
                state.update(part.encode())
        if key is not None:
            yield flush()

    parts = ends.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(listed, "p1 long, p2 long, first long, listed string")
    return parts.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(hashed, "p1 long, p2 long, ends_sha256 string")


def trie(members: DataFrame, stretch_bits: int = STRETCH_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of ``members`` (as :func:`grafted` gives them).

    conv_id is the node's smallest member; ``saved_tokens`` adds up, over its subtree, the bytes that its members beyond
    the first need not store; ``ends_sha256`` is of the ids of the conversations that end there.
    """
    prefixes = cut(_prefixes(members, stretch_bits), "prefixes")
    nodes = _shards(prefixes, stretch_bits, shard_rows)
    owners = cut(_owners(nodes), "owners")
    empty = F.sha2(F.lit(""), 256)
    return owners.join(_sums(nodes, owners), ["p1", "p2"]).join(_ended(prefixes), ["p1", "p2"], "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
