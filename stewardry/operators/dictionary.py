"""Audits of data-dictionary catalogues: many schema documents held in four tables.

``entities(doc, kind, name, is_generic, hierarchical, hfid, inherit_from, parent, children)``,
``attributes(doc, kind, name, attr_kind, n_choices, computed_kind, template, read_only, is_generic)``,
``relationships(doc, kind, name, peer, rel_kind, identifier, cardinality, optional, on_delete)``.
Verdicts are rows ``doc, rule, n_bad, passed``; a rule that needs a subject fails without one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.scale import cut, dealt, tasks_for


def _verdicts(per_doc: DataFrame, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Turn count columns into verdict rows: rule -> (bad-count column, subject-present test)."""
    rows = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.coalesce(F.col(bad), F.lit(0)).cast("bigint").alias("n_bad"),
                (F.coalesce(present, F.lit(False)) & (F.coalesce(F.col(bad), F.lit(0)) == 0)).alias("passed"),
            )
            for rule, (bad, present) in rules.items()
        ]
    )
    return per_doc.select("doc", F.explode(rows).alias("_v")).select("doc", "_v.*")


def attribute_rules(entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """Name length, deprecated kind, status as dropdown with choices, computed attributes.

    Status is looked for on nodes only. All rules are counted in one aggregate per document.
    """
    docs = entities.groupBy("doc").agg(F.count("*").alias("n_entities"))
    node = ~F.col("is_generic")
    computed = F.col("computed_kind").isNotNull()
    status = node & (F.col("name") == "status")
    counts = attributes.groupBy("doc").agg(
        F.count_if(F.length("name") < 3).alias("short"),
        F.count_if(F.col("attr_kind") == "String").alias("deprecated"),
        F.count_if(status).alias("n_status"),
        F.count_if(
            status & ((F.col("attr_kind") != "Dropdown") | (F.coalesce("n_choices", F.lit(0)) == 0))
        ).alias("bad_status"),
        F.count_if(computed).alias("n_computed"),
        F.count_if(computed & ~F.coalesce("read_only", F.lit(False))).alias("writable"),
        F.count_if(
            computed & ((F.col("computed_kind") != "Template") | (F.coalesce("template", F.lit("")) == ""))
        ).alias("bad_template"),
    )
    has = F.col("n_entities") > 0
    return _verdicts(
        docs.join(counts, "doc", "left"),
        {
            "attribute_name_length": ("short", has),
            "no_deprecated_kind": ("deprecated", has),
            "status_is_dropdown": ("bad_status", F.col("n_status") > 0),
            "computed_is_read_only": ("writable", F.col("n_computed") > 0),
            "computed_has_template": ("bad_template", F.col("n_computed") > 0),
        },
    )


# Peers of these prefixes are defined elsewhere.
EXTERNAL_PREFIXES = ("Builtin", "Infra")


def peer_kinds(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relations whose peer is a bare name instead of a full kind.

    Flagged only when the peer equals a name defined in the document and no kind defined there.
    """
    bare = relationships.where(F.coalesce("peer", F.lit("")) != "")
    for prefix in EXTERNAL_PREFIXES:
        bare = bare.where(~F.col("peer").startswith(prefix))
    names = entities.select("doc", F.col("name").alias("peer")).distinct()
    kinds = entities.select("doc", F.col("kind").alias("peer")).distinct()
    return bare.join(names, ["doc", "peer"], "left_semi").join(kinds, ["doc", "peer"], "left_anti")


def peer_kind_verdict(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Per document whether every peer uses a full kind; no relations at all fails."""
    docs = entities.select("doc").distinct()
    total = relationships.groupBy("doc").agg(F.count("*").alias("n_rels"))
    bad = peer_kinds(entities, relationships).groupBy("doc").agg(F.count("*").alias("bad"))
    joined = docs.join(total, "doc", "left").join(bad, "doc", "left")
    return _verdicts(joined, {"peer_uses_full_kind": ("bad", F.col("n_rels") > 0)})


def orphan_identifiers(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Identifiers used once whose peer is defined in the same document."""
    used = (
        relationships.where(F.coalesce("identifier", F.lit("")) != "")
        .groupBy("doc", "identifier")
        .agg(
            F.count("*").alias("n"), F.min("kind").alias("kind"), F.min("name").alias("name"),
            F.min("peer").alias("peer"),
        )
        .where(F.col("n") == 1)
    )
    kinds = entities.select("doc", F.col("kind").alias("peer")).distinct()
    return used.join(kinds, ["doc", "peer"], "left_semi").drop("n")


def renamed_identifiers(before: DataFrame, after: DataFrame) -> DataFrame:
    """Relations whose identifier was changed instead of reused (identifiers are immutable)."""
    old = before.where(F.col("identifier").isNotNull()).select(
        "doc", "kind", "name", F.col("identifier").alias("old_identifier")
    )
    new = after.select("doc", "kind", "name", F.col("identifier").alias("new_identifier"))
    joined = old.join(new, ["doc", "kind", "name"])
    return joined.where(~F.col("old_identifier").eqNullSafe(F.col("new_identifier")))


def without_hfid(entities: DataFrame) -> DataFrame:
    """Nodes with no human-friendly id of their own nor from a generic they list."""
    lacking = entities.where(~F.col("is_generic") & (F.coalesce("hfid", F.lit("")) == ""))
    generics = entities.where(F.col("is_generic") & (F.coalesce("hfid", F.lit("")) != "")).select(
        "doc", F.col("kind").alias("_generic")
    )
    rescued = (
        lacking.select("doc", "kind", F.explode("inherit_from").alias("_generic"))
        .join(generics, ["doc", "_generic"], "left_semi")
        .select("doc", "kind")
        .distinct()
    )
    return lacking.join(rescued, ["doc", "kind"], "left_anti")


def hierarchy_rules(entities: DataFrame) -> DataFrame:
    """A hierarchical generic exists, all nodes inherit it, and at least one node is a root.

    A document with several hierarchical generics is judged on the first by kind. The rows are counted first and dealt
    out by document to as many tasks as they are worth; both aggregates and the join then stay inside these.
    """
    node = ~F.col("is_generic")
    rows = dealt(
        entities.select(
            "doc", node.alias("_node"), F.coalesce("parent", F.lit("")).isin("", "null").alias("_root"), "inherit_from",
            F.when(F.col("is_generic") & F.coalesce("hierarchical", F.lit(False)), F.col("kind")).alias("_tops"),
        ),
        ["doc"], tasks_for(entities),
    )
    top = rows.where(F.col("_tops").isNotNull()).groupBy("doc").agg(F.min("_tops").alias("_top"))
    inherits = F.array_contains(F.coalesce("inherit_from", F.array().cast("array<string>")), F.col("_top"))
    per_doc = (
        rows.join(top, "doc", "left")
        .groupBy("doc")
        .agg(
            F.max(F.col("_top").isNotNull()).alias("has_top"),
            F.count_if(F.col("_node") & ~F.coalesce(inherits, F.lit(False))).alias("strays"),
            F.count_if(F.col("_node") & F.col("_root")).alias("n_roots"),
        )
        .withColumn("no_top", (~F.col("has_top")).cast("int"))
        .withColumn("no_root", (F.col("n_roots") == 0).cast("int"))
    )
    always = F.lit(True)
    return _verdicts(
        per_doc,
        {
            "hierarchical_generic": ("no_top", always),
            "nodes_inherit_it": ("strays", F.col("has_top")),
            "has_root": ("no_root", always),
        },
    )


def hierarchy_chain(entities: DataFrame, expected: Sequence[tuple[str, str]]) -> DataFrame:
    """Breaks of the expected chain of (parent name, child name), lower case, per document.

    A declared ``children`` or ``parent`` must name the other side; an empty one is not checked.
    """
    nodes = entities.where(~F.col("is_generic")).select(
        "doc", F.lower("name").alias("_n"), "kind", F.col("parent").alias("_p"), F.col("children").alias("_c")
    )
    steps = F.array(
        *[F.struct(F.lit(p).alias("parent_name"), F.lit(c).alias("child_name")) for p, c in expected]
    )
    pairs = entities.select("doc").distinct().select("doc", F.explode(steps).alias("_s")).select("doc", "_s.*")
    up = nodes.select("doc", F.col("_n").alias("parent_name"), F.col("kind").alias("pk"), F.col("_c").alias("pc"))
    down = nodes.select("doc", F.col("_n").alias("child_name"), F.col("kind").alias("ck"), F.col("_p").alias("cp"))
    joined = pairs.join(up, ["doc", "parent_name"], "left").join(down, ["doc", "child_name"], "left")
    problem = (
        F.when(F.col("pk").isNull(), "parent_missing")
        .when(F.col("ck").isNull(), "child_missing")
        .when((F.coalesce("pc", F.lit("")) != "") & (F.col("pc") != F.col("ck")), "children_differ")
        .when((F.coalesce("cp", F.lit("")) != "") & (F.col("cp") != F.col("pk")), "parent_differs")
    )
    return joined.select("doc", "parent_name", "child_name", problem.alias("problem")).where(
        F.col("problem").isNotNull()
    )


def parent_rules(relationships: DataFrame) -> DataFrame:
    """Broken Parent and Component relations, one row per relation and problem.

    Parent: mandatory, cardinality one, at most one per entity. Component: cardinality many.
    """
    parent, component = F.col("rel_kind") == "Parent", F.col("rel_kind") == "Component"
    tests = F.array_compact(
        F.array(
            F.when(parent & F.coalesce("optional", F.lit(True)), "parent_optional"),
            F.when(parent & ~F.col("cardinality").eqNullSafe("one"), "parent_not_one"),
            F.when(component & (F.coalesce("cardinality", F.lit("many")) != "many"), "component_not_many"),
        )
    )
    own = relationships.where(parent | component).select(
        "doc", "kind", "name", F.explode(tests).alias("problem")
    )
    several = (
        relationships.where(parent)
        .groupBy("doc", "kind")
        .agg(F.count("*").alias("n"), F.min("name").alias("name"))
        .where(F.col("n") > 1)
        .select("doc", "kind", "name", F.lit("several_parents").alias("problem"))
    )
    return own.unionByName(several)


def relation_presence(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Per document whether a Parent relation and a cascading delete exist where they are asked for."""
    docs = entities.select("doc").distinct()
    counts = relationships.groupBy("doc").agg(
        F.count_if(F.col("rel_kind") == "Parent").alias("n_parent"),
        F.count_if(F.col("on_delete") == "cascade").alias("n_cascade"),
    )
    rows = (
        docs.join(counts, "doc", "left")
        .withColumn("no_parent", (F.coalesce("n_parent", F.lit(0)) == 0).cast("int"))
        .withColumn("no_cascade", (F.coalesce("n_cascade", F.lit(0)) == 0).cast("int"))
    )
    always = F.lit(True)
    return _verdicts(rows, {"has_parent": ("no_parent", always), "has_cascade": ("no_cascade", always)})


def missing_inverses(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Forward one-cardinality Attribute relations without an inverse of the same identifier.

    The inverse may sit on the peer or on a generic the peer inherits, and may point to the source
    or to a generic the source inherits. Relations from extension blocks belong into
    ``relationships`` beforehand. Works across documents: kinds are global here.
    """
    forward = relationships.where(
        (F.col("rel_kind") == "Attribute")
        & (F.col("cardinality") == "one")
        & (F.col("kind") != F.col("peer"))
        & F.col("identifier").isNotNull()
    ).select("kind", "name", "identifier", "peer").distinct()
    bases = F.array_append(F.coalesce("inherit_from", F.array().cast("array<string>")), F.col("kind"))
    lineage = entities.select("kind", F.explode(bases).alias("base")).distinct()
    # the place of an inverse, by two hashes of all three; most stand right between the two kinds
    places = lambda on, to: [F.xxhash64("identifier", on, to).alias("_p1"), F.xxhash64(to, on, "identifier").alias("_p2")]
    declared = relationships.where(~F.col("rel_kind").isin("Parent", "Component")).select(
        "identifier", F.col("kind").alias("on_kind"), F.col("peer").alias("to_kind")
    )
    rest = cut(
        forward.select("*", *places("peer", "kind")).join(declared.select(*places("on_kind", "to_kind")), ["_p1", "_p2"], "left_anti").drop("_p1", "_p2"),
        "without-direct-inverse",
    )
    # the others list the few places with a generic on either side; only relations of generics can stand there
    source = lineage.select("kind", F.col("base").alias("to_kind"))
    holder = lineage.select(F.col("kind").alias("peer"), F.col("base").alias("on_kind"))
    generics = lineage.where(F.col("base") != F.col("kind")).select("base").distinct()
    one = F.lit(True)
    generic = cut(
        declared.join(generics.select(F.col("base").alias("on_kind"), one.alias("_on")), "on_kind", "left")
        .join(generics.select(F.col("base").alias("to_kind"), one.alias("_to")), "to_kind", "left")
        .where(F.col("_on").isNotNull() | F.col("_to").isNotNull())
        .select(*places("on_kind", "to_kind")).distinct(),
        "generic-places",
    )
    kept = ["kind", "name", "identifier", "peer"]
    found = (
        rest.join(source, "kind", "left").join(holder, "peer", "left")
        .withColumns({"to_kind": F.coalesce("to_kind", "kind"), "on_kind": F.coalesce("on_kind", "peer")})
        .where((F.col("to_kind") != F.col("kind")) | (F.col("on_kind") != F.col("peer")))
        .select(*kept, *places("on_kind", "to_kind"))
        .join(generic, ["_p1", "_p2"], "left_semi").select(*kept)
    )
    return rest.join(found, kept, "left_anti")


def unused_flags(flags: DataFrame, uses: DataFrame) -> DataFrame:
    """Flags ``(kind, flag)`` that are set while nothing uses them; each flag is judged on its own."""
    return flags.join(uses.select("kind", "flag").distinct(), ["kind", "flag"], "left_anti")


def unsafe_migrations(old: DataFrame, new: DataFrame, live_rows: DataFrame) -> DataFrame:
    """Attribute changes that break live data.

    ``old`` and ``new`` have ``kind, name`` and, in ``new``, ``optional``, ``has_default`` and
    ``state``; ``live_rows`` has ``kind, n_rows``. A new mandatory attribute without default needs
    an empty kind, and an attribute may only go by ``state: absent``.
    """
    a = old.select("kind", "name", F.lit(True).alias("_old"))
    b = new.select("kind", "name", "optional", "has_default", "state", F.lit(True).alias("_new"))
    joined = a.join(b, ["kind", "name"], "full_outer").join(live_rows, "kind", "left")
    live = F.coalesce("n_rows", F.lit(0)) > 0
    added = F.col("_old").isNull() & (F.coalesce("state", F.lit("present")) != "absent")
    problem = F.when(
        added & live & ~F.coalesce("optional", F.lit(False)) & ~F.coalesce("has_default", F.lit(False)),
        "mandatory_without_default",
    ).when(F.col("_new").isNull(), "vanished_without_state_absent")
    return joined.select("kind", "name", problem.alias("problem")).where(F.col("problem").isNotNull())
