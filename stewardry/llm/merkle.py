"""Merkle manifest of a dataset as a persistent tree: a changed leaf makes a version that shares all untouched nodes.

A leaf is the SHA-256 of a row's columns, each framed by its length. The leaves of a language ascend by ``doc_id``; two
neighbours make a node, level by level, a last single one too. The languages' roots, in order, make the root likewise.

Nodes lie in aligned blocks of 256, so that a block's levels need no other block. A task reduces a block to its root;
the roots of all blocks are the nodes of the next round, until a tree is one node. Back down, each block takes on the
siblings of its ancestors from the block above, one row per block, so that no task meets all leaves. A leaf's version
copies its ancestors only: those inside its block, then on along the siblings above; all else it shares.

Equal ``doc_id`` s, null ones first, ascend by their leaves; equal rows are leaves of their own. A null column is framed
as ``-``; an empty text is not null. An empty table has no leaves and no root. Columns beyond the five are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stewardry.llm.common import small_batches
from stewardry.llm.ordering import positions
from stewardry.scale import cut

LEVELS = 8  # of a block, which has 2**LEVELS nodes
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(*columns: Column) -> Column:
    """The digest of a row's columns, as lowercase hex."""
    texts = [c.cast("string") for c in columns]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*framed), 256)


def _digest(*parts: bytes) -> bytes:
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    return max(0, n - 1).bit_length()


def levels(digests: list[bytes], n_levels: int) -> list[list[bytes]]:
    """The digests and all levels above them."""
    out = [digests]
    for _ in range(n_levels):
        last = out[-1]
        out.append([_digest(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return out


def siblings(tree: list[list[bytes]], at: int) -> list[bytes]:
    """The siblings of a node and of its ancestors: ``L`` or ``R``, where it stands, and its digest; empty if none."""
    path = []
    for level in tree[:-1]:
        other = at ^ 1
        path.append((b"R" if at < other else b"L") + level[other] if other < len(level) else b"")
        at >>= 1
    return path


def ancestors(digest: bytes, path: list[bytes]) -> list[bytes]:
    """The nodes above a digest along its siblings, the root last."""
    out = []
    for entry in path:
        if not entry:
            digest = _digest(digest)
        elif entry[:1] == b"L":
            digest = _digest(entry[1:], digest)
        else:
            digest = _digest(digest, entry[1:])
        out.append(digest)
    return out


def _blocks(nodes: DataFrame, label: str) -> DataFrame:
    """Aligned blocks of ``nodes`` (tree, position, n, node): tree, block, n, ``members`` in order, ``top``."""
    blocks = nodes.groupBy("tree", F.shiftright("position", LEVELS).alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("position", "node"))).alias("members")
    )
    blocks = blocks.select("tree", "block", "n", F.col("members.node").alias("members"))
    kinds = T.StructType([*blocks.schema.fields, T.StructField("top", T.BinaryType())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for n, members in zip(batch["n"].to_pylist(), batch["members"].to_pylist(), strict=True):
                tops.append(levels([m["digest"] for m in members], min(LEVELS, height(n)))[-1][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.binary())], [*batch.schema.names, "top"])

    return cut(blocks.mapInArrow(reduce, kinds), label)


def _climb(nodes: DataFrame, most: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The block tables of all rounds, and each tree's root as ``tree``, ``top``."""
    rounds = [_blocks(nodes, f"{label}-0")]
    while most > 1 << LEVELS:
        most = -(-most >> LEVELS)
        below = rounds[-1].select(
            "tree", F.col("block").alias("position"), F.ceil(F.col("n") / (1 << LEVELS)).alias("n"), F.struct(F.col("top").alias("digest")).alias("node")
        )
        rounds.append(_blocks(below, f"{label}-{len(rounds)}"))
    return rounds, rounds[-1].select("tree", "top")


def _descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """tree, block, ``path`` from the top and ``subroot``, for the blocks whose tops are the members of ``blocks``.

    ``above`` has the same of each of ``blocks``; the result adds the siblings within it.
    """
    joined = blocks.join(above, ["tree", "block"]).select("tree", "block", "n", "members", "path", "subroot")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = levels([m["digest"] for m in row["members"]], min(LEVELS, height(row["n"])))
                first, count = row["block"] << LEVELS, len(row["members"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * count, pa.string()),
                        pa.array(range(first, first + count), pa.int64()),
                        pa.array([siblings(tree, i) + row["path"] for i in range(count)], pa.list_(pa.binary())),
                        pa.array([row["subroot"]] * count, pa.binary()),
                    ],
                    ["tree", "block", "path", "subroot"],
                )

    return joined.mapInArrow(walk, PATHS)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``tree`` (the language, so that null sorts first), ``doc_id``, ``leaf``, and where ``tampered``, ``changed``.

    Tampering adds 1 to ``n_chars``.
    """
    columns = [F.col(c) for c in COLUMNS]
    more = [F.col("n_chars").cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(leaf_of(*columns)).alias("leaf"),
        F.when(tampered, F.unhex(leaf_of(*more))).alias("changed"),
    )


PATHS = "tree string, block long, path array<binary>, subroot binary"
SCHEMA = "doc_id long, leaf binary, path array<binary>, subroot binary, root binary, version array<binary>, folded binary"


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """One row per document: its ``leaf``, ``path`` of siblings up to the ``root``, ``subroot`` of its language.

    ``version`` lists the nodes that a tampered leaf copies, the version's root last, and is null for other leaves.
    ``folded`` is the root that the tampered, else the original, leaf comes to along the original siblings.
    """
    spark = docs.sparkSession
    small_batches(spark)
    placed = positions(leaves(docs, tampered), "tree", ["doc_id", "leaf"], "leaves")
    nodes = placed.select("tree", "position", "n", F.struct(F.col("leaf").alias("digest"), "doc_id", "changed").alias("node"))
    # one more pass over small rows, for the number of rounds
    most = nodes.agg(F.max("n")).first()[0]
    if most is None:
        return spark.createDataFrame([], SCHEMA)
    rounds, subroots = _climb(nodes, most, "blocks")

    trunk = positions(subroots.select("tree", "top").withColumn("all", F.lit("")), "all", ["tree"], "subroots")
    named = cut(trunk, "trunk")
    upper = named.select(F.col("all").alias("tree"), "position", "n", F.struct(F.col("top").alias("digest")).alias("node"))
    above_rounds, root = _climb(upper, named.agg(F.max("n")).first()[0], "upper")
    root = bytes(root.first()["top"])

    paths = spark.createDataFrame([("", 0, [], None)], PATHS)
    for blocks in reversed(above_rounds):
        paths = _descend(blocks, paths)
    paths = named.join(paths.select(F.col("block").alias("position"), "path"), "position").select(
        "tree", F.lit(0).cast("bigint").alias("block"), "path", F.col("top").alias("subroot")
    )
    for blocks in reversed(rounds[1:]):
        paths = _descend(blocks, paths)
    joined = rounds[0].join(paths, ["tree", "block"]).select("n", "members", "path", "subroot")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = pa.list_(pa.binary())
        for batch in batches:
            for row in batch.to_pylist():
                members = row["members"]
                tree = levels([m["digest"] for m in members], min(LEVELS, height(row["n"])))
                proofs = [siblings(tree, i) + row["path"] for i in range(len(members))]
                starts = [m["changed"] or m["digest"] for m in members]
                copied = [ancestors(start, proof) for start, proof in zip(starts, proofs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([m["doc_id"] for m in members], pa.int64()),
                        pa.array([m["digest"] for m in members], pa.binary()),
                        pa.array(proofs, paths),
                        pa.array([row["subroot"]] * len(members), pa.binary()),
                        pa.array([root] * len(members), pa.binary()),
                        pa.array([c if m["changed"] else None for c, m in zip(copied, members, strict=True)], paths),
                        pa.array([c[-1] if c else start for c, start in zip(copied, starts, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "leaf", "path", "subroot", "root", "version", "folded"],
                )

    return joined.mapInArrow(prove, SCHEMA)


def hex_of(digest: str) -> Column:
    return F.lower(F.hex(digest))


def proof_digest(path: str = "path") -> Column:
    """The digest of a path's siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda e: F.lower(F.hex(F.substring(e, 2, 32)))), ""), 256)
