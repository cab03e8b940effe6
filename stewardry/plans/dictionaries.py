"""Audits of a data-dictionary catalogue derived from orders and lines (family L).

Every order stands for one schema document and every line for an entity, an attribute and a
relation of it, so the catalogue grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stewardry.operators import dictionary as dic
from stewardry.registry import Tables, query

ENTITY = (
    "l_orderkey AS doc",
    "CASE WHEN l_linenumber = 7 THEN 'DcimTop' ELSE 'DcimPart' || l_partkey % 4 END AS kind",
    "CASE WHEN l_linenumber = 7 THEN 'Top' ELSE 'Part' || l_partkey % 4 END AS name",
    "l_linenumber = 7 AS is_generic",
    "l_linenumber = 7 AND l_returnflag <> 'R' AS hierarchical",
    "CASE WHEN l_returnflag = 'A' THEN NULL ELSE 'name__value' END AS hfid",
    "CASE WHEN l_linestatus = 'F' THEN 'DcimTop' ELSE 'DcimSide' END AS base",
    "CASE WHEN l_quantity < 10 THEN '' WHEN l_quantity < 20 THEN NULL ELSE 'DcimPart' || l_suppkey % 4 END AS parent",
    "CASE WHEN l_suppkey % 2 = 0 THEN 'DcimPart' || l_suppkey % 4 END AS children",
)
ATTRIBUTE = (
    "l_orderkey AS doc",
    "'DcimPart' || l_partkey % 4 AS kind",
    "CASE l_linenumber WHEN 1 THEN 'id' WHEN 2 THEN 'status' ELSE 'qty_' || l_linenumber END AS name",
    "CASE l_returnflag WHEN 'A' THEN 'Dropdown' WHEN 'N' THEN 'Text' ELSE 'String' END AS attr_kind",
    "l_suppkey % 3 AS n_choices",
    "CASE WHEN l_linenumber = 4 THEN CASE WHEN l_returnflag = 'R' THEN 'Script' ELSE 'Template' END END AS computed_kind",
    "CASE WHEN l_linenumber = 4 AND l_suppkey % 4 > 0 THEN 'x' END AS template",
    "l_linestatus = 'F' AS read_only",
    "l_linenumber = 7 AS is_generic",
)
RELATION = (
    "l_orderkey AS doc",
    "'DcimPart' || l_partkey % 4 AS kind",
    "'rel_' || l_linenumber AS name",
    "CASE l_suppkey % 3 WHEN 0 THEN 'DcimPart' || l_suppkey % 4 WHEN 1 THEN 'Part' || l_suppkey % 4 ELSE 'BuiltinTag' END AS peer",
    "CASE l_returnflag WHEN 'A' THEN 'Attribute' WHEN 'N' THEN 'Component' ELSE 'Parent' END AS rel_kind",
    "CASE WHEN l_linenumber <> 6 THEN 'id_' || l_suppkey % 3 END AS identifier",
    "CASE WHEN l_quantity > 25 THEN 'one' ELSE 'many' END AS cardinality",
    "l_suppkey % 2 = 0 AS optional",
    "CASE WHEN l_linestatus = 'O' THEN 'cascade' ELSE 'no-action' END AS on_delete",
)
CATALOGUE = f"""WITH e AS (SELECT {', '.join(ENTITY)} FROM lineitem), a AS (SELECT {', '.join(ATTRIBUTE)} FROM lineitem),
  r AS (SELECT {', '.join(RELATION)} FROM lineitem), d AS (SELECT DISTINCT doc FROM e)"""


def entities(t: Tables):
    return t.lineitem.selectExpr(*ENTITY).withColumn("inherit_from", F.array("base"))


def attributes(t: Tables):
    return t.lineitem.selectExpr(*ATTRIBUTE)


def relationships(t: Tables):
    return t.lineitem.selectExpr(*RELATION)


@query(
    "L1_attribute_rules",
    f"""{CATALOGUE}, c AS (SELECT doc, count(*) FILTER (length(name) < 3) AS b1, count(*) FILTER (attr_kind = 'String') AS b2,
          count(*) FILTER (NOT is_generic AND name = 'status') AS n3, count(*) FILTER (NOT is_generic AND name = 'status' AND (attr_kind <> 'Dropdown' OR n_choices = 0)) AS b3,
          count(computed_kind) AS n4, count(*) FILTER (computed_kind IS NOT NULL AND NOT read_only) AS b4,
          count(*) FILTER (computed_kind IS NOT NULL AND (computed_kind <> 'Template' OR template IS NULL)) AS b5 FROM a GROUP BY 1)
        SELECT doc, 'attribute_name_length' AS rule, b1 AS n_bad, b1 = 0 AS passed FROM c UNION ALL SELECT doc, 'no_deprecated_kind', b2, b2 = 0 FROM c
        UNION ALL SELECT doc, 'status_is_dropdown', b3, n3 > 0 AND b3 = 0 FROM c UNION ALL SELECT doc, 'computed_is_read_only', b4, n4 > 0 AND b4 = 0 FROM c
        UNION ALL SELECT doc, 'computed_has_template', b5, n4 > 0 AND b5 = 0 FROM c""",
    headline=True,
)
def attribute_rules(t: Tables):
    return dic.attribute_rules(entities(t), attributes(t))


@query(
    "L2_peer_kinds",
    f"""{CATALOGUE}, b AS (SELECT doc, count(*) AS n FROM r WHERE peer NOT LIKE 'Builtin%' AND peer NOT LIKE 'Infra%'
          AND (doc, peer) IN (SELECT (doc, name) FROM e) AND (doc, peer) NOT IN (SELECT (doc, kind) FROM e) GROUP BY 1)
        SELECT d.doc, 'peer_uses_full_kind' AS rule, coalesce(n, 0) AS n_bad, coalesce(n, 0) = 0 AS passed FROM d LEFT JOIN b ON d.doc = b.doc""",
)
def peer_kinds(t: Tables):
    return dic.peer_kind_verdict(entities(t), relationships(t))


@query(
    "L3_identifier_pairing",
    f"""{CATALOGUE}, u AS (SELECT doc, identifier, count(*) AS n, min(kind) AS kind, min(name) AS name, min(peer) AS peer FROM r WHERE identifier IS NOT NULL GROUP BY 1, 2)
        SELECT doc, identifier, kind, name, peer FROM u WHERE n = 1 AND (doc, peer) IN (SELECT (doc, kind) FROM e)""",
    headline=True,
)
def identifier_pairing(t: Tables):
    return dic.orphan_identifiers(entities(t), relationships(t))


@query(
    "L3_renamed_identifiers",
    """SELECT o_custkey AS doc, o_orderpriority AS kind, 'rel_' || o_orderkey AS name, 'id_' || o_orderkey AS old_identifier,
         CASE WHEN o_orderkey % 10 = 0 THEN 'fresh_' || o_orderkey END AS new_identifier FROM orders WHERE o_orderkey % 5 = 0""",
)
def renamed_identifiers(t: Tables):
    keys = ("o_custkey AS doc", "o_orderpriority AS kind", "'rel_' || o_orderkey AS name")
    before = t.orders.selectExpr(*keys, "'id_' || o_orderkey AS identifier")
    after = t.orders.selectExpr(
        *keys, "CASE WHEN o_orderkey % 10 = 0 THEN 'fresh_' || o_orderkey WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'id_' || o_orderkey END AS identifier"
    )
    return dic.renamed_identifiers(before, after)


@query(
    "L4_inherited_key",
    f"""{CATALOGUE}, g AS (SELECT doc, kind FROM e WHERE is_generic AND hfid IS NOT NULL)
        SELECT DISTINCT doc, kind FROM e x WHERE NOT is_generic AND hfid IS NULL AND NOT EXISTS (
          SELECT 1 FROM e y JOIN g ON g.doc = y.doc AND g.kind = y.base WHERE y.doc = x.doc AND y.kind = x.kind AND NOT y.is_generic AND y.hfid IS NULL)""",
)
def inherited_key(t: Tables):
    return dic.without_hfid(entities(t)).select("doc", "kind").distinct()


@query(
    "L5_hierarchy_rules",
    f"""{CATALOGUE}, t AS (SELECT doc, min(kind) AS top FROM e WHERE is_generic AND hierarchical GROUP BY 1),
        c AS (SELECT e.doc, max(top) IS NOT NULL AS has_top, count(*) FILTER (NOT is_generic AND NOT coalesce(base = top, false)) AS strays,
          count(*) FILTER (NOT is_generic AND coalesce(parent, '') IN ('', 'null')) AS roots FROM e LEFT JOIN t ON e.doc = t.doc GROUP BY 1)
        SELECT doc, 'hierarchical_generic' AS rule, CAST(NOT has_top AS BIGINT) AS n_bad, has_top AS passed FROM c
        UNION ALL SELECT doc, 'nodes_inherit_it', strays, has_top AND strays = 0 FROM c
        UNION ALL SELECT doc, 'has_root', CAST(roots = 0 AS BIGINT), roots > 0 FROM c""",
)
def hierarchy_rules(t: Tables):
    return dic.hierarchy_rules(entities(t))


@query(
    "L5_hierarchy_chain",
    f"""{CATALOGUE}, s AS (SELECT doc, p, c FROM d CROSS JOIN (VALUES ('part1', 'part2'), ('part2', 'part3')) v(p, c)),
        n AS (SELECT doc, lower(name) AS n, kind, parent, children FROM e WHERE NOT is_generic)
        SELECT doc, p AS parent_name, c AS child_name, problem FROM (SELECT s.doc, p, c, CASE WHEN u.kind IS NULL THEN 'parent_missing' WHEN w.kind IS NULL THEN 'child_missing'
          WHEN coalesce(u.children, '') <> '' AND u.children <> w.kind THEN 'children_differ' WHEN coalesce(w.parent, '') <> '' AND w.parent <> u.kind THEN 'parent_differs' END AS problem
          FROM s LEFT JOIN n u ON u.doc = s.doc AND u.n = p LEFT JOIN n w ON w.doc = s.doc AND w.n = c) WHERE problem IS NOT NULL""",
)
def hierarchy_chain(t: Tables):
    return dic.hierarchy_chain(entities(t), [("part1", "part2"), ("part2", "part3")])


@query(
    "L6_parent_rules",
    f"""{CATALOGUE} SELECT doc, kind, name, 'parent_optional' AS problem FROM r WHERE rel_kind = 'Parent' AND optional
        UNION ALL SELECT doc, kind, name, 'parent_not_one' FROM r WHERE rel_kind = 'Parent' AND cardinality <> 'one'
        UNION ALL SELECT doc, kind, name, 'component_not_many' FROM r WHERE rel_kind = 'Component' AND cardinality <> 'many'
        UNION ALL SELECT doc, kind, min(name), 'several_parents' FROM r WHERE rel_kind = 'Parent' GROUP BY doc, kind HAVING count(*) > 1""",
)
def parent_rules(t: Tables):
    return dic.parent_rules(relationships(t))


@query(
    "L6_relation_presence",
    f"""{CATALOGUE}, c AS (SELECT doc, bool_or(rel_kind = 'Parent') AS p, bool_or(on_delete = 'cascade') AS k FROM r GROUP BY 1)
        SELECT doc, 'has_parent' AS rule, CAST(NOT p AS BIGINT) AS n_bad, p AS passed FROM c UNION ALL SELECT doc, 'has_cascade', CAST(NOT k AS BIGINT), k FROM c""",
)
def relation_presence(t: Tables):
    return dic.relation_presence(entities(t), relationships(t))


#: Each line relates its part to its supplier; its quantity says what stands on the other side: the inverse, one
#: between generics, or a relation to something else.
INVERSES = """WITH e AS (SELECT 'P' || p_partkey AS kind, p_brand AS base FROM part UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
  l AS (SELECT *, CASE WHEN l_quantity < 20 THEN 'back' WHEN l_quantity = 50 THEN 'wide' ELSE 'other' END AS side FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
  r AS (SELECT 'P' || l_partkey AS kind, 'rel_' || l_linenumber AS name, 'S' || l_suppkey AS peer, 'ps_' || l_linenumber AS identifier, 'one' AS cardinality FROM l
    UNION ALL SELECT CASE side WHEN 'wide' THEN 'N' || s_nationkey ELSE 'S' || l_suppkey END, side || '_' || l_linenumber,
      CASE side WHEN 'back' THEN 'P' || l_partkey WHEN 'wide' THEN p_brand ELSE 'O' || l_orderkey END, 'ps_' || l_linenumber, 'many' FROM l)"""


@query(
    "L7_missing_inverse",
    f"""{INVERSES}, f AS (SELECT DISTINCT kind, name, identifier, peer FROM r WHERE cardinality = 'one')
        SELECT f.* FROM f JOIN e k ON k.kind = f.kind JOIN e p ON p.kind = f.peer WHERE NOT EXISTS (
          SELECT 1 FROM r WHERE r.identifier = f.identifier AND (r.kind = f.peer OR r.kind = p.base) AND (r.peer = f.kind OR r.peer = k.base))""",
    headline=True,
)
def missing_inverse(t: Tables):
    kinds = t.part.selectExpr("'P' || p_partkey AS kind", "array(p_brand) AS inherit_from").unionByName(
        t.supplier.selectExpr("'S' || s_suppkey AS kind", "array('N' || s_nationkey) AS inherit_from")
    )
    lines = (
        t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
        .join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("side", F.expr("CASE WHEN l_quantity < 20 THEN 'back' WHEN l_quantity = 50 THEN 'wide' ELSE 'other' END"))
    )
    both = lines.selectExpr(
        "inline(array(struct('P' || l_partkey AS kind, 'rel_' || l_linenumber AS name, 'S' || l_suppkey AS peer,"
        " 'ps_' || l_linenumber AS identifier, 'one' AS cardinality, 'Attribute' AS rel_kind),"
        " struct(CASE side WHEN 'wide' THEN 'N' || s_nationkey ELSE 'S' || l_suppkey END AS kind, side || '_' || l_linenumber AS name,"
        " CASE side WHEN 'back' THEN 'P' || l_partkey WHEN 'wide' THEN p_brand ELSE 'O' || l_orderkey END AS peer,"
        " 'ps_' || l_linenumber AS identifier, 'many' AS cardinality, 'Attribute' AS rel_kind)))"
    )
    return dic.missing_inverses(kinds, both)


@query(
    "L8_unused_flags",
    """SELECT p_partkey AS kind, 'generate_profile' AS flag FROM part WHERE p_size < 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
       UNION ALL SELECT p_partkey, 'generate_template' FROM part WHERE p_type = 'PROMO' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""",
)
def unused_flags(t: Tables):
    flags = t.part.where("p_size < 25").selectExpr("p_partkey AS kind", "'generate_profile' AS flag").unionByName(
        t.part.where("p_type = 'PROMO'").selectExpr("p_partkey AS kind", "'generate_template' AS flag")
    )
    uses = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").selectExpr(
        "l_partkey AS kind", "'generate_profile' AS flag"
    ).unionByName(t.lineitem.where("l_quantity = 50").selectExpr("l_partkey AS kind", "'generate_template' AS flag"))
    return dic.unused_flags(flags, uses)


@query(
    "L9_migration_safety",
    """WITH live AS (SELECT p_brand AS kind, count(*) AS n FROM part WHERE p_size > 47 GROUP BY 1)
       SELECT p_brand AS kind, 'a' || p_partkey AS name, CASE WHEN p_type = 'SMALL' THEN 'vanished_without_state_absent' ELSE 'mandatory_without_default' END AS problem
       FROM part LEFT JOIN live ON kind = p_brand WHERE p_type = 'SMALL' OR (p_type = 'PROMO' AND n > 0 AND p_size <= 25 AND p_partkey % 3 > 0)""",
)
def migration_safety(t: Tables):
    named = ("p_brand AS kind", "'a' || p_partkey AS name")
    old = t.part.where("p_type <> 'PROMO'").selectExpr(*named)
    new = t.part.where("p_type <> 'SMALL'").selectExpr(
        *named, "p_size > 25 AS optional", "p_partkey % 3 = 0 AS has_default", "'present' AS state"
    )
    live = t.part.where("p_size > 47").groupBy(F.col("p_brand").alias("kind")).agg(F.count("*").alias("n_rows"))
    return dic.unsafe_migrations(old, new, live)
