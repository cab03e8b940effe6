"""Hierarchies and dependency graphs of any depth, level by level.

Each level is one distributed join whose result is written to the shared folder, so lineage stays
flat and lost executors cost one level. The driver only asks whether a level is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stewardry.scale import cut, new_path


def _levels(spark, path: str, like: DataFrame) -> DataFrame:
    schema = T.StructType([*like.schema.fields, T.StructField("level", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def _contracted(links: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inner nodes of unbranched stretches, and the edges that are left when each stretch is one edge.

    Inner is a node with one link in and one out that is not ``fixed``. Inner nodes come with the ``head`` that their
    stretch begins behind and their distance ``far`` from it; edges have a weight ``w``, the links they stand for. Each
    round doubles how far a node looks back, so that a stretch of n nodes takes log2(n) joins. Rings of inner nodes hang
    on nothing and are left out of both.
    """
    outs = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_out"), F.min("dst").alias("next")).where("_out = 1")
    ins = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("_in"), F.min("src").alias("prev")).where("_in = 1")
    inner = cut(outs.join(ins, "node").join(fixed, "node", "left_anti").select("node", "prev", "next"), "inner")
    is_inner = inner.select(F.col("node").alias("prev"), F.lit(True).alias("_inner"))
    back = F.when(F.col("_inner"), F.col("prev"))
    walking = cut(
        inner.join(is_inner, "prev", "left").select(
            "node", back.alias("up"), F.when(F.col("_inner").isNull(), F.col("prev")).alias("head"), F.lit(1).cast("bigint").alias("far")
        ),
        "walking",
    )
    left = walking.where("up IS NOT NULL").count()
    while left:
        above = walking.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("head").alias("_head"), F.col("far").alias("_far"))
        walking = cut(
            walking.join(above, "up", "left").select(
                "node", F.col("_up").alias("up"), F.coalesce("head", "_head").alias("head"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far")
            ),
            "walking",
        )
        before, left = left, walking.where("up IS NOT NULL").count()
        if left == before:
            break
    placed = walking.where("up IS NULL").select("node", "head", "far")
    nodes = inner.select("node")
    ends = inner.join(nodes.withColumnRenamed("node", "next"), "next", "left_anti").select("node", "next")
    long = placed.join(ends, "node").select(F.col("head").alias("src"), F.col("next").alias("dst"), (F.col("far") + 1).alias("w"))
    short = (
        links.join(nodes.withColumnRenamed("node", "src"), "src", "left_anti").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_anti")
        .select("src", "dst", F.lit(1).cast("bigint").alias("w"))
    )
    return placed, cut(long.unionByName(short), "contracted")


def reachable(
    seeds: DataFrame, edges: DataFrame, *, node: str = "node", src: str = "src", dst: str = "dst",
    max_depth: int | None = None,
) -> DataFrame:
    """Nodes reachable from the seeds with the least level at which they are reached.

    Unbranched stretches are one weighted edge each (see :func:`_contracted`), so rounds go with the branchings on a
    path, not with its length. A round goes on from the nodes whose level it lowered; cycles lower none, so it ends.
    """
    spark = seeds.sparkSession
    path = new_path(spark, "reachable")
    links = cut(
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), "edges"
    )
    first = cut(seeds.select(F.col(node).alias("node")).where("node IS NOT NULL").distinct(), "seeds")
    inner, steps = _contracted(links, first)
    start = first.select("node", F.lit(0).cast("bigint").alias("level"))
    start.write.parquet(f"{path}/round=0")
    read = lambda folder: spark.read.schema(start.schema).parquet(folder).select("node", "level")
    rounds = 0
    while True:
        frontier = read(f"{path}/round={rounds}")
        seen = read(path).groupBy("node").agg(F.min("level").alias("_best"))
        found = steps.join(frontier, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("level") + F.col("w")).alias("level"))
        if max_depth is not None:
            found = found.where(F.col("level") <= max_depth)
        better = found.join(seen, "node", "left").where(F.col("_best").isNull() | (F.col("level") < F.col("_best")))
        rounds += 1
        better.select("node", "level").write.parquet(f"{path}/round={rounds}")
        if read(f"{path}/round={rounds}").isEmpty():
            break
    met = read(path).groupBy("node").agg(F.min("level").alias("level"))
    between = inner.join(met.select(F.col("node").alias("head"), F.col("level").alias("_at")), "head").select("node", (F.col("_at") + F.col("far")).alias("level"))
    whole = met.unionByName(between)
    if max_depth is not None:
        whole = whole.where(F.col("level") <= max_depth)
    return whole.select(F.col("node").alias(node), F.col("level").cast("int").alias("level"))


def blast_radius(
    seeds: DataFrame, edges: DataFrame, nodes: DataFrame, *, kind: str = "kind", max_depth: int | None = None
) -> DataFrame:
    """Number of distinct dependents of the seeds per level and kind."""
    hit = reachable(seeds, edges, max_depth=max_depth).where(F.col("level") > 0)
    return hit.join(nodes.select("node", kind), "node").groupBy("level", kind).agg(
        F.count("*").alias("n_nodes")
    )


def hierarchy_paths(
    edges: DataFrame, *, child: str = "child", parent: str = "parent", separator: str = "/"
) -> DataFrame:
    """Level, root-to-node path and ``status`` of every node; a root has a NULL parent.

    ``ok`` nodes hang under a root. ``orphan`` nodes hang under a node that is no child itself: the
    path starts below it, and the level counts from there. ``cycle`` nodes lie on or behind a cycle
    and have no path or level. A node with several parents keeps the least one; ``second_parent``
    tells so in place of ``ok``. Each round doubles the stretch a node has walked up, so that depth d
    takes log2(d) joins; when a round brings no node to its top, only cycles are left.
    """
    spark = edges.sparkSession
    path = new_path(spark, "paths")
    pairs = edges.select(F.col(child).alias("node"), F.col(parent).alias("up")).where(F.col("node").isNotNull())
    tree = cut(
        pairs.groupBy("node").agg(F.min("up").alias("up"), (F.count_distinct("up") > 1).alias("many")), "tree"
    )
    known = tree.select(F.col("node").alias("up"), F.lit(True).alias("_known"))
    walking = cut(
        tree.join(known, "up", "left").select(
            "node", "many", F.when(F.col("_known"), F.col("up")).alias("up"),
            F.col("node").cast("string").alias("path"), F.lit(0).cast("bigint").alias("level"),
            (F.col("up").isNotNull() & F.col("_known").isNull()).alias("orphan"),
        ),
        "walking",
    )
    done = ["node", "many", "path", "level", "orphan"]
    rounds = 0
    while True:
        walking.where(F.col("up").isNull()).select(*done).write.parquet(f"{path}/round={rounds}")
        finished = spark.read.parquet(f"{path}/round={rounds}")
        rest = walking.where(F.col("up").isNotNull())
        if finished.isEmpty():
            break
        above = walking.select(
            F.col("node").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"),
            F.col("level").alias("_level"), F.col("orphan").alias("_orphan"),
        )
        # what ended in an earlier round is looked up there
        ended = spark.read.schema(finished.schema).parquet(*[f"{path}/round={k}" for k in range(rounds)]) if rounds else None
        if ended is not None:
            above = above.unionByName(ended.select(
                F.col("node").alias("up"), F.lit(None).cast(dict(walking.dtypes)["up"]).alias("_up"),
                F.col("path").alias("_path"), F.col("level").alias("_level"), F.col("orphan").alias("_orphan"),
            ))
        walking = cut(
            rest.join(above, "up").select(
                "node", "many", F.col("_up").alias("up"), F.concat_ws(separator, "_path", "path").alias("path"),
                (F.col("level") + F.col("_level") + 1).alias("level"), (F.col("orphan") | F.col("_orphan")).alias("orphan"),
            ),
            "walking",
        )
        rounds += 1
    status = F.when(F.col("orphan"), "orphan").when(F.col("many"), "second_parent").otherwise("ok")
    placed = spark.read.schema(finished.schema).parquet(*[f"{path}/round={k}" for k in range(rounds + 1)])
    cyclic = rest.select(
        "node", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("level"), F.lit("cycle").alias("status")
    )
    return placed.select("node", F.col("path").cast("string"), "level", status.alias("status")).unionByName(cyclic)


def dependency_levels(nodes: DataFrame, refs: DataFrame, *, node: str = "node") -> DataFrame:
    """The load level of every node: a referent lies strictly below its referrers.

    ``refs`` has ``src`` (referrer) and ``dst`` (referent); references to unknown nodes do not
    count. Nodes on or behind a cycle get a NULL level; see :func:`dependency_cycles`. Unbranched stretches are one
    weighted edge each, so that rounds go with the branchings on the longest path.
    """
    spark = nodes.sparkSession
    path = new_path(spark, "dependency")
    known = cut(nodes.select(F.col(node).alias("node")).distinct(), "nodes")
    links = cut(
        refs.select("src", "dst").distinct().join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
        .join(known.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst")),
        "refs",
    )
    # from referents up: an inner node lies as far above its head as it is away
    inner, steps = _contracted(links, known.limit(0))
    unbranched = links.groupBy("dst").count().where("count = 1").join(links.groupBy("src").count().where("count = 1"), F.col("dst") == F.col("src"))
    placed = known.join(unbranched.select(F.col("dst").alias("node")), "node", "left_anti")
    waiting = cut(placed.select("node", F.lit(0).cast("bigint").alias("level")), "waiting")
    left = steps
    rounds = 0
    like = waiting
    while True:
        waiting.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").write.parquet(f"{path}/round={rounds}")
        ready = spark.read.schema(like.schema).parquet(f"{path}/round={rounds}")
        if ready.isEmpty():
            break
        raised = left.join(ready, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("level") + F.col("w")).alias("_to"))
        left = cut(left.join(ready.select(F.col("node").alias("src")), "src", "left_anti"), "left")
        waiting = cut(
            waiting.join(ready.select("node"), "node", "left_anti").join(raised, "node", "left")
            .select("node", F.greatest("level", F.coalesce("_to", F.lit(0))).alias("level")),
            "waiting",
        )
        rounds += 1
    done = spark.read.schema(like.schema).parquet(path).select("node", "level")
    between = inner.join(done.select(F.col("node").alias("head"), F.col("level").alias("_at")), "head").select("node", (F.col("_at") + F.col("far")).alias("level"))
    levels = done.unionByName(between)
    return known.join(levels, "node", "left").select(F.col("node").alias(node), F.col("level").cast("int").alias("level"))


def dependency_cycles(nodes: DataFrame, refs: DataFrame, *, node: str = "node") -> DataFrame:
    """Why nodes have no load level: ``node, status, cycle`` for those on a cycle and those that wait behind one.

    ``cycle`` names a strongly connected set by its least node; it is NULL for a node that is on none but refers, through
    others, to one. Nodes that can be loaded are left out. What has a level goes first, then what nothing left refers
    to; in the rest, each round marks every node with the least node that reaches it, and a set is what reaches its mark
    back among nodes of that mark. Rounds go with the length of the cycles, tables shrink with every set that is found.
    """
    spark = nodes.sparkSession
    path = new_path(spark, "cycles")
    stuck = cut(dependency_levels(nodes, refs, node=node).where("level IS NULL").select(F.col(node).alias("node")), "stuck")
    among = lambda links, kept: links.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(
        kept.withColumnRenamed("node", "dst"), "dst", "left_semi"
    ).select("src", "dst")
    links = cut(among(refs.select("src", "dst").distinct(), stuck), "stuck-refs")
    left = stuck
    rounds = 0
    like = stuck.select("node", F.col("node").alias("cycle"))
    while not left.isEmpty():
        # nodes that none of the rest refers to are on no cycle, and then those that only these referred to
        while True:
            held = cut(left.join(links.select(F.col("dst").alias("node")).distinct(), "node", "left_semi"), "held")
            if held.count() == left.count():
                break
            left, links = held, cut(among(links, held), "stuck-refs")
        if left.isEmpty():
            break
        marks = left.select("node", F.col("node").alias("mark"))
        while True:
            reached = links.join(marks, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "mark")
            new = cut(marks.unionByName(reached).groupBy("node").agg(F.min("mark").alias("mark")), "marks")
            changed = new.join(marks.withColumnRenamed("mark", "old"), "node").where("mark <> old").isEmpty()
            marks = new
            if changed:
                break
        of = lambda end: marks.select(F.col("node").alias(end), F.col("mark").alias(f"{end}_mark"))
        inside = cut(links.join(of("src"), "src").join(of("dst"), "dst").where("src_mark = dst_mark").select("src", "dst", F.col("src_mark").alias("mark")), "inside")
        back = marks.where("node = mark")
        while True:
            more = inside.join(back, (inside["dst"] == back["node"]) & (inside["mark"] == back["mark"])).select(inside["src"].alias("node"), inside["mark"])
            grown = cut(back.unionByName(more).distinct(), "back")
            done = grown.count() == back.count()
            back = grown
            if done:
                break
        # a single node is a cycle only if it refers to itself
        alone = back.groupBy("mark").agg(F.count("*").alias("n")).where("n = 1").select("mark")
        loops = inside.where("src = dst").select(F.col("src").alias("mark")).distinct()
        found = back.join(alone.join(loops, "mark", "left_anti"), "mark", "left_anti")
        found.select("node", F.col("mark").alias("cycle")).write.parquet(f"{path}/round={rounds}")
        rounds += 1
        left = cut(left.join(back.select("node"), "node", "left_anti"), "left")
        links = cut(among(links, left), "stuck-refs")
    sets = like.limit(0)
    if rounds:
        sets = spark.read.schema(like.schema).parquet(*[f"{path}/round={k}" for k in range(rounds)])
    status = F.when(F.col("cycle").isNull(), "behind").otherwise("cycle")
    return stuck.join(sets, "node", "left").select(F.col("node").alias(node), status.alias("status"), "cycle")


def cascade_delete(seeds: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleted nodes with their level, and the references to null.

    ``edges`` has ``src`` (owner), ``dst`` (peer) and ``on_delete``; only ``cascade`` edges delete
    the peer, any other value (no-action is the default) leaves it and nulls its reference.
    """
    cascade = F.coalesce(F.col("on_delete"), F.lit("no-action")) == "cascade"
    deleted = reachable(seeds, edges.where(cascade))
    gone = deleted.select(F.col("node").alias("src"))
    touched = edges.where(~cascade).join(gone, "src", "left_semi").select("src", "dst").distinct()
    nulled = touched.join(deleted.select(F.col("node").alias("dst")), "dst", "left_anti")
    return deleted, nulled


def unnest_children(
    documents: DataFrame, document: str, fields: Sequence[str], *, key: str, depth: int
) -> tuple[DataFrame, DataFrame]:
    """Rows of nested ``children: {kind, data[]}`` JSON with their parent, and the broken blocks.

    The depth is declared; each level is one explode. A ``children`` block without ``kind`` is an
    issue (``reason`` no_kind) and its rows are not emitted; so are the parents of rows below the
    declared depth (``too_deep``).
    """
    level = documents.select(
        F.try_parse_json(document).alias("_v"), F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("string").alias("kind"), F.lit(0).alias("level"),
    )
    rows, problems = None, None
    for _ in range(depth):
        named = level.withColumn("node", F.try_variant_get("_v", f"$.{key}", "string"))
        part = named.select(
            "node", "parent", "kind", "level",
            *[F.try_variant_get("_v", f"$.{f}", "string").alias(f) for f in fields],
        )
        rows = part if rows is None else rows.unionByName(part)
        kind = F.try_variant_get("_v", "$.children.kind", "string")
        data = F.try_variant_get("_v", "$.children.data", "array<variant>")
        block = F.try_variant_get("_v", "$.children", "variant")
        broken = named.where(block.isNotNull() & kind.isNull()).select("node", "level", F.lit("no_kind").alias("reason"))
        problems = broken if problems is None else problems.unionByName(broken)
        level = named.where(kind.isNotNull()).select(
            F.explode(data).alias("_v"), F.col("node").alias("parent"), kind.alias("kind"),
            (F.col("level") + 1).alias("level"),
        )
    below = level.select(F.col("parent").alias("node"), (F.col("level") - 1).alias("level"), F.lit("too_deep").alias("reason"))
    return rows, problems.unionByName(below.distinct())
