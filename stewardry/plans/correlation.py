"""Reference resolution, symmetry, overlap, containment, overlays and reconciliation (C, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stewardry.operators import aggregates as agg
from stewardry.operators import graph, joins
from stewardry.operators import reconcile as rec
from stewardry.operators.windows import first_wins
from stewardry.plans.policies import SHEET_SQL, SUPPLIER_INPUTS, customer_sheet, supplier_inputs
from stewardry.registry import Tables, query
from stewardry.scale import dealt, tasks_for


@query(
    "C3_resolve_reference",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' OR c_custkey % 7 = 0 THEN NULL ELSE CAST(n_nationkey AS BIGINT) END AS target_id,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN 'wrong_arity' WHEN c_custkey % 7 = 0 THEN 'unresolved' ELSE 'resolved' END AS status
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def resolve_reference(t: Tables):
    sheet = customer_sheet(t).selectExpr(
        "c_custkey",
        """CASE WHEN c_mktsegment = 'FURNITURE' THEN array(n_name)
             WHEN c_custkey % 7 = 0 THEN array(r_name, n_name) ELSE array(n_name, r_name) END AS ref""",
    )
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = joins.resolve_reference(sheet, "ref", nations, ["n_name", "r_name"], "n_nationkey")
    return out.select("c_custkey", F.col("target_id").cast("bigint").alias("target_id"), "status")


@query(
    "C4_closure",
    """SELECT 'part' AS kind, l_partkey AS "key", count(*) AS n_refs, 'emitted-and-live' AS scope FROM lineitem
       WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25 OR p_size >= 40) GROUP BY l_partkey""",
    headline=True,
)
def closure(t: Tables):
    keyed = lambda df, key: df.select(F.lit("part").alias("kind"), F.col(key).alias("key"))
    return joins.closure(
        keyed(t.lineitem, "l_partkey"),
        keyed(t.part.where("p_size < 25"), "p_partkey"),
        keyed(t.part.where("p_size >= 40"), "p_partkey"),
    )


EDGE_SQL = """SELECT o_custkey AS local, l_suppkey AS remote, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def trade_edges(t: Tables, lines):
    """One directed edge per line: customer nation to supplier nation."""
    # the line-order join is the only large one; nations come from two dimension joins
    sold = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        sold.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumnRenamed("c_nationkey", "local")
        .withColumnRenamed("s_nationkey", "remote")
    )


def party_edges(t: Tables):
    """One directed edge per line, from its customer's number to its supplier's, as if of one kind of party."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_shipdate")
    return lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("local"), F.col("l_suppkey").alias("remote"), "l_shipdate"
    )


@query(
    "C5_symmetric",
    f"""WITH e AS (SELECT DISTINCT local, remote FROM ({EDGE_SQL}))
        SELECT CAST(local AS BIGINT) AS local, CAST(remote AS BIGINT) AS remote FROM e a
        WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.local = a.remote AND b.remote = a.local)""",
    headline=True,
)
def symmetric(t: Tables):
    out = joins.missing_reverse(party_edges(t), "local", "remote")
    return out.select(F.col("local").cast("bigint").alias("local"), F.col("remote").cast("bigint").alias("remote"))


@query(
    "C6_symmetric_state",
    f"""WITH e AS (SELECT local, remote, bool_or(l_shipdate < TIMESTAMP '1999-01-01') AS active FROM ({EDGE_SQL}) GROUP BY 1, 2)
        SELECT CAST(a.local AS BIGINT) AS local, CAST(a.remote AS BIGINT) AS remote,
          CASE WHEN b.local IS NULL THEN 'missing' ELSE 'inactive' END AS state
        FROM e a LEFT JOIN e b ON b.local = a.remote AND b.remote = a.local
        WHERE a.active AND (b.local IS NULL OR NOT b.active)""",
)
def symmetric_state(t: Tables):
    active = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")
    out = joins.reverse_state(party_edges(t), "local", "remote", active)
    return out.select(
        F.col("local").cast("bigint").alias("local"), F.col("remote").cast("bigint").alias("remote"), "state"
    )


@query(
    "C7_interval_overlap",
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS bucket, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s,
         CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 30 END AS h, o_orderpriority <> '5-LOW' AS deep, o_orderstatus AS face FROM orders)
       SELECT a.bucket, a.id AS id_low, b.id AS id_high FROM o a JOIN o b ON a.bucket = b.bucket AND a.id < b.id
         AND a.s < b.s + b.h AND b.s < a.s + a.h AND (a.deep OR b.deep OR a.face = b.face)""",
    headline=True,
)
def interval_overlap(t: Tables):
    orders = t.orders.selectExpr(
        "o_orderkey",
        "o_custkey",
        "datediff(o_orderdate, DATE '1990-01-01') AS day",
        "CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 30 END AS span",
        "o_orderpriority <> '5-LOW' AS deep",
        "o_orderstatus AS face",
    )
    return joins.interval_overlap(
        orders,
        bucket="o_custkey",
        start="day",
        length="span",
        row_id="o_orderkey",
        bin_width=30,
        condition=F.col("deep_a") | F.col("deep_b") | (F.col("face_a") == F.col("face_b")),
        carry=["deep", "face"],
    )


# Every order gets an address below 10/8, every nation an approved prefix of its own length.
ADDRESS = """CASE WHEN o_custkey % 17 = 0 OR (o_orderstatus = 'P' AND o_custkey % 5 = 0) THEN NULL ELSE
  '10.' || c_nationkey || '.' || (o_orderkey % 256) || '.' || (o_custkey % 256) || '/32' END"""


def addresses(t: Tables):
    placed = t.spread("orders", "o_orderkey", "o_custkey", "o_orderstatus").join(
        t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    return placed.selectExpr("o_orderkey", "o_custkey", "c_nationkey AS site", f"{ADDRESS} AS address")


@query(
    "C8_cidr_containment",
    f"""SELECT o_orderkey, address FROM (SELECT o_orderkey, c_nationkey AS site, o_orderkey % 256 AS third, {ADDRESS} AS address
          FROM orders JOIN customer ON o_custkey = c_custkey)
        WHERE address IS NOT NULL AND third >= CAST(power(2, 8 - site % 5) AS BIGINT)""",
    headline=True,
)
def cidr_containment(t: Tables):
    prefixes = t.nation.selectExpr("n_nationkey AS site", "'10.' || n_nationkey || '.0.0/' || (16 + n_nationkey % 5) AS prefix")
    rogue = joins.cidr_containment(addresses(t), prefixes, address="address", scope="site")
    return rogue.select("o_orderkey", "address")


# Orders of even customers have an address of the other family; prefixes nest.
BOTH_FAMILIES = """CASE WHEN o_custkey % 2 = 0 THEN '2001:DB8:' || {hex_site} || ':' || {hex_third} || '::' || {hex_host}
  ELSE '10.' || c_nationkey || '.' || (o_orderkey % 256) || '.' || (o_custkey % 256) END"""


def mixed_addresses(t: Tables):
    made = BOTH_FAMILIES.format(hex_site="lower(hex(c_nationkey))", hex_third="hex(o_orderkey % 256)", hex_host="hex(o_custkey % 65536)")
    placed = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return placed.selectExpr("o_orderkey", "c_nationkey AS site", f"{made} AS address")


def mixed_prefixes(t: Tables):
    return t.nation.selectExpr(
        "n_nationkey AS site",
        "explode(array('10.' || n_nationkey || '.0.0/' || (16 + n_nationkey % 5), '10.' || n_nationkey || '.0.0/20',"
        " '2001:db8:' || hex(n_nationkey) || '::/' || (56 + n_nationkey % 5), '2001:0db8:' || hex(n_nationkey) || ':0:0:0:0.0.0.0/60')) AS prefix",
    )


MIXED = f"""SELECT o_orderkey, c_nationkey AS site, o_custkey % 2 AS family, o_orderkey % 256 AS third, c_nationkey % 5 AS wide,
    {BOTH_FAMILIES.format(hex_site="format('{:x}', c_nationkey)", hex_third="format('{:X}', o_orderkey % 256)", hex_host="format('{:X}', o_custkey % 65536)")} AS address
  FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(
    "C8_mixed_families",
    f"""SELECT o_orderkey, address FROM ({MIXED}) WHERE third >= CAST(power(2, 8 - wide) AS BIGINT) AND third >= 16""",
)
def mixed_containment(t: Tables):
    rogue = joins.cidr_containment(mixed_addresses(t), mixed_prefixes(t), address="address", scope="site")
    return rogue.select("o_orderkey", "address")


@query(
    "C8_longest_prefix",
    f"""SELECT o_orderkey, CASE WHEN third < 16 AND family = 0 THEN '2001:0db8:' || format('{{:X}}', site) || ':0:0:0:0.0.0.0/60'
          WHEN third < 16 THEN '10.' || site || '.0.0/20' WHEN third >= CAST(power(2, 8 - wide) AS BIGINT) THEN NULL
          WHEN family = 0 THEN '2001:db8:' || format('{{:X}}', site) || '::/' || (56 + wide) ELSE '10.' || site || '.0.0/' || (16 + wide) END AS best_prefix
        FROM ({MIXED})""",
)
def longest_prefix(t: Tables):
    return joins.longest_prefix(mixed_addresses(t), mixed_prefixes(t), address="address", scope="site").select("o_orderkey", "best_prefix")


@query(
    "C8_without_address",
    f"""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM
          (SELECT o_custkey, {ADDRESS} AS address FROM orders JOIN customer ON o_custkey = c_custkey) WHERE address IS NOT NULL)""",
)
def without_address(t: Tables):
    held = addresses(t).where("address IS NOT NULL").select(F.col("o_custkey").alias("c_custkey"))
    return joins.without_any(t.customer.select("c_custkey"), held, ["c_custkey"])


def impact_inputs(t: Tables) -> dict:
    windows = t.nation.selectExpr(
        "n_nationkey AS window_id",
        "add_months(DATE '1996-01-01', n_nationkey)::timestamp AS start",
        "add_months(DATE '1996-01-01', n_nationkey + 14)::timestamp AS end",
    )
    orders = t.orders.select("o_orderkey", "o_custkey")
    tasks = tasks_for(t.lineitem)
    riding = dealt(t.lineitem.select("l_suppkey", "l_orderkey"), ["l_orderkey"], tasks).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    return {
        "windows": windows,
        "scope": t.supplier.selectExpr("s_nationkey AS window_id", "s_suppkey"),
        "dependents": riding.selectExpr("l_suppkey AS s_suppkey", "l_orderkey", "o_custkey"),
        "window_id": "window_id",
        "asset": "s_suppkey",
        "dependent": "l_orderkey",
        "customer": "o_custkey",
        "at": F.lit("1997-06-15").cast("timestamp"),
        "tasks": tasks,
    }


@query(
    "C9_window_impact",
    """WITH w AS (SELECT n_nationkey AS window_id, TIMESTAMP '1996-01-01' + INTERVAL (n_nationkey) MONTH AS "start",
           TIMESTAMP '1996-01-01' + INTERVAL (n_nationkey + 14) MONTH AS "end" FROM nation)
       SELECT CAST(window_id AS BIGINT) AS window_id, count(DISTINCT s_suppkey) AS n_assets, count(DISTINCT l_orderkey) AS n_dependents,
         count(DISTINCT o_custkey) AS n_customers
       FROM w JOIN supplier ON s_nationkey = window_id LEFT JOIN (SELECT DISTINCT l_suppkey, l_orderkey, o_custkey FROM lineitem
         JOIN orders ON l_orderkey = o_orderkey) ON l_suppkey = s_suppkey
       WHERE "start" <= TIMESTAMP '1997-06-15' AND TIMESTAMP '1997-06-15' < "end" GROUP BY 1""",
)
def window_impact(t: Tables):
    return joins.window_impact(**impact_inputs(t)).withColumn("window_id", F.col("window_id").cast("bigint"))


@query(
    "C9_impact_rows",
    """SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS window_id, s_suppkey, l_orderkey, o_custkey
       FROM supplier LEFT JOIN (SELECT l_suppkey, l_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) ON l_suppkey = s_suppkey
       WHERE TIMESTAMP '1996-01-01' + INTERVAL (s_nationkey) MONTH <= TIMESTAMP '1997-06-15' AND TIMESTAMP '1997-06-15' < TIMESTAMP '1996-01-01' + INTERVAL (s_nationkey + 14) MONTH""",
)
def impact_rows(t: Tables):
    return joins.impact_rows(**impact_inputs(t)).withColumn("window_id", F.col("window_id").cast("bigint"))


# Choices come from the data: names are the bare words, labels their upper-case spelling.
CHOICES = """SELECT DISTINCT lower(substr(o_orderpriority, 3)) AS name, CASE WHEN o_orderpriority = '5-LOW' THEN 'high' ELSE substr(o_orderpriority, 3) END AS label
  FROM orders WHERE o_orderpriority <> '1-URGENT'"""
LABELS = """CASE WHEN o_orderstatus = 'F' THEN substr(o_orderpriority, 3) WHEN o_orderstatus = 'P' THEN lower(substr(o_orderpriority, 3))
  ELSE upper(substr(o_orderpriority, 3, 1)) || lower(substr(o_orderpriority, 4)) END"""


@query(
    "C10_dropdown_lookup",
    f"""WITH c AS ({CHOICES}), v AS (SELECT {LABELS} AS value, count(*) AS n_rows FROM orders GROUP BY 1),
        s AS (SELECT name, 1 AS step, name AS text FROM c UNION ALL SELECT name, 2, label FROM c
              UNION ALL SELECT name, 3, lower(name) FROM c UNION ALL SELECT name, 3, lower(label) FROM c),
        m AS (SELECT value, step, min(name) AS low, max(name) AS high FROM v JOIN s ON text = CASE WHEN step = 3 THEN lower(value) ELSE value END GROUP BY 1, 2),
        b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY value ORDER BY step) = 1)
        SELECT v.value, n_rows, CASE WHEN low = high THEN low END AS name,
          CASE WHEN low IS NULL THEN 'unmatched' WHEN low <> high THEN 'ambiguous' ELSE 'matched' END AS status
        FROM v LEFT JOIN b ON v.value = b.value""",
)
def dropdown_lookup(t: Tables):
    choices = t.orders.where("o_orderpriority <> '1-URGENT'").selectExpr(
        "lower(substr(o_orderpriority, 3)) AS name",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'high' ELSE substr(o_orderpriority, 3) END AS label",
    ).distinct()
    return joins.dropdown_lookup(t.orders.selectExpr(f"{LABELS} AS value"), "value", choices)


def tree_edges(t: Tables):
    """The foreign keys of four tables as one edge list ``kind, child, parent``."""
    label = lambda kind, key: f"'{kind}:' || {key}"
    return (
        t.region.selectExpr("'region' AS kind", f"{label('region', 'r_regionkey')} AS child", "CAST(NULL AS STRING) AS parent")
        .unionByName(t.nation.selectExpr("'nation' AS kind", f"{label('nation', 'n_nationkey')} AS child", f"{label('region', 'n_regionkey')} AS parent"))
        .unionByName(t.customer.selectExpr("'customer' AS kind", f"{label('customer', 'c_custkey')} AS child", f"{label('nation', 'c_nationkey')} AS parent"))
        .unionByName(t.orders.selectExpr("'orders' AS kind", f"{label('orders', 'o_orderkey')} AS child", f"{label('customer', 'o_custkey')} AS parent"))
    )


TREE_SQL = """SELECT 'region' AS kind, 'region:' || r_regionkey AS child, NULL AS parent FROM region
  UNION ALL SELECT 'nation', 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'customer', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'orders', 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders"""


@query(
    "C11_blast_radius",
    f"""WITH RECURSIVE e AS ({TREE_SQL}), r AS (SELECT 'region:1' AS node, 0 AS level
          UNION ALL SELECT e.child, level + 1 FROM r JOIN e ON e.parent = r.node)
        SELECT CAST(level AS BIGINT) AS level, kind, count(DISTINCT node) AS n_nodes FROM r JOIN e ON e.child = r.node WHERE level > 0 GROUP BY ALL""",
)
def blast_radius(t: Tables):
    tree = tree_edges(t)
    seeds = tree.where("child = 'region:1'").selectExpr("child AS node")
    edges = tree.selectExpr("parent AS src", "child AS dst")
    out = graph.blast_radius(seeds, edges, tree.selectExpr("child AS node", "kind"))
    return out.withColumn("level", F.col("level").cast("bigint"))


@query(
    "C12_peer_attribute_match",
    """SELECT l_orderkey, l_linenumber, l_suppkey, c_nationkey AS claimed, s_nationkey AS actual FROM lineitem
       JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
       WHERE c_nationkey IS DISTINCT FROM s_nationkey""",
    headline=True,
)
def peer_attribute_match(t: Tables):
    sold = (
        t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
        .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "c_nationkey AS claimed")
    )
    return joins.peer_mismatch(
        sold, t.supplier, peer="l_suppkey", claimed="claimed", node_id="s_suppkey", actual="s_nationkey"
    )


@query(
    "C13_dedupe_undirected",
    f"""WITH e AS (SELECT c_nationkey AS a, s_nationkey AS b, l_orderkey, l_linenumber, l_partkey FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey)
        SELECT CAST(least(a, b) AS BIGINT) AS end_low, CAST(greatest(a, b) AS BIGINT) AS end_high, count(*) AS n_links, min(l_orderkey) AS first_order
        FROM e GROUP BY 1, 2""",
    headline=True,
)
def dedupe_undirected(t: Tables):
    links = trade_edges(t, t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    out = joins.undirected(links, "local", "remote", ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.select(
        F.col("end_low").cast("bigint").alias("end_low"),
        F.col("end_high").cast("bigint").alias("end_high"),
        "n_links",
        F.col("l_orderkey").alias("first_order"),
    )


# Profiles by segment (priority by name length) and by nation; some attributes stay unset.
PROFILES = """SELECT DISTINCT 'seg-' || c_mktsegment AS profile_id, CAST(length(c_mktsegment) AS BIGINT) AS priority,
    CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'tier-' || c_mktsegment END AS tier, 'owner-' || c_mktsegment AS owner FROM customer
  UNION ALL SELECT 'nat-' || n_nationkey, CAST(8 + n_nationkey % 3 AS BIGINT), 'tier-' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'owner-' || n_name END FROM nation"""
ASSIGNED = """SELECT c_custkey, 'seg-' || c_mktsegment AS profile_id FROM customer
  UNION ALL SELECT c_custkey, 'nat-' || c_nationkey FROM customer WHERE c_custkey % 3 > 0"""


@query(
    "C14_profile_peers",
    """WITH p AS (SELECT DISTINCT 'seg-' || c_mktsegment AS profile_id, length(c_mktsegment) AS priority FROM customer
             UNION ALL SELECT 'nat-' || n_nationkey, 8 + n_nationkey % 3 FROM nation),
         q AS (SELECT DISTINCT 'seg-' || c_mktsegment AS profile_id, 'site' AS relation, 'S' || unnest(range(0, length(c_mktsegment) % 3 + 1)) AS peer FROM customer
             UNION ALL SELECT 'nat-' || n_nationkey, 'site', 'N' || n_regionkey FROM nation WHERE n_nationkey % 2 = 0
             UNION ALL SELECT 'nat-' || n_nationkey, 'vlan', n_name FROM nation),
         a AS (SELECT c_custkey, 'seg-' || c_mktsegment AS profile_id FROM customer UNION ALL SELECT c_custkey, 'nat-' || c_nationkey FROM customer),
         o AS (SELECT DISTINCT o_custkey AS c_custkey, 'site' AS relation, 'own-' || o_orderpriority AS peer FROM orders WHERE o_orderkey % 5 = 0),
         w AS (SELECT c_custkey, relation, profile_id FROM a JOIN (SELECT DISTINCT profile_id, relation FROM q) USING (profile_id) JOIN p USING (profile_id)
             QUALIFY row_number() OVER (PARTITION BY c_custkey, relation ORDER BY priority, profile_id) = 1)
       SELECT c_custkey, relation, peer, false AS from_profile, NULL AS source FROM o
       UNION ALL SELECT DISTINCT w.c_custkey, w.relation, q.peer, true, w.profile_id FROM w JOIN q ON q.profile_id = w.profile_id AND q.relation = w.relation
       WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.c_custkey = w.c_custkey AND o.relation = w.relation)""",
)
def profile_peers(t: Tables):
    segments = t.customer.select("c_mktsegment").distinct()
    profiles = segments.selectExpr("'seg-' || c_mktsegment AS profile_id", "length(c_mktsegment) AS priority").unionByName(
        t.nation.selectExpr("'nat-' || n_nationkey AS profile_id", "int(8 + n_nationkey % 3) AS priority")
    )
    peers = (
        segments.selectExpr("'seg-' || c_mktsegment AS profile_id", "'site' AS relation", "explode(transform(sequence(0, length(c_mktsegment) % 3), k -> 'S' || k)) AS peer")
        .unionByName(t.nation.where("n_nationkey % 2 = 0").selectExpr("'nat-' || n_nationkey AS profile_id", "'site' AS relation", "'N' || n_regionkey AS peer"))
        .unionByName(t.nation.selectExpr("'nat-' || n_nationkey AS profile_id", "'vlan' AS relation", "n_name AS peer"))
    )
    assigned = t.customer.selectExpr("c_custkey", "explode(array('seg-' || c_mktsegment, 'nat-' || c_nationkey)) AS profile_id")
    own = t.orders.where("o_orderkey % 5 = 0").selectExpr("o_custkey AS c_custkey", "'site' AS relation", "'own-' || o_orderpriority AS peer")
    return joins.resolve_profile_peers(own, assigned, profiles, peers, object_id="c_custkey")


@query(
    "C14_resolve_profiles",
    f"""WITH p AS ({PROFILES}), a AS ({ASSIGNED}),
        o AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'own' END AS tier, CASE WHEN c_acctbal < 0 THEN 'credit' END AS owner FROM customer),
        t AS (SELECT c_custkey, p.tier AS w, profile_id AS s FROM a JOIN p USING (profile_id) WHERE p.tier IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY priority, profile_id) = 1),
        n AS (SELECT c_custkey, p.owner AS w, profile_id AS s FROM a JOIN p USING (profile_id) WHERE p.owner IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY priority, profile_id) = 1)
        SELECT o.c_custkey, coalesce(tier, t.w) AS tier, tier IS NULL AND t.w IS NOT NULL AS tier_from_profile,
          CASE WHEN tier IS NULL THEN t.s END AS tier_source, coalesce(owner, n.w) AS owner,
          owner IS NULL AND n.w IS NOT NULL AS owner_from_profile, CASE WHEN owner IS NULL THEN n.s END AS owner_source
        FROM o LEFT JOIN t ON o.c_custkey = t.c_custkey LEFT JOIN n ON o.c_custkey = n.c_custkey""",
)
def resolve_profiles(t: Tables):
    segments = t.customer.selectExpr(
        "'seg-' || c_mktsegment AS profile_id",
        "CAST(length(c_mktsegment) AS BIGINT) AS priority",
        "CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'tier-' || c_mktsegment END AS tier",
        "'owner-' || c_mktsegment AS owner",
    ).distinct()
    nations = t.nation.selectExpr(
        "'nat-' || n_nationkey AS profile_id",
        "CAST(8 + n_nationkey % 3 AS BIGINT) AS priority",
        "'tier-' || n_name AS tier",
        "CASE WHEN n_nationkey % 2 = 0 THEN 'owner-' || n_name END AS owner",
    )
    assigned = t.customer.selectExpr("c_custkey", "'seg-' || c_mktsegment AS profile_id").unionByName(
        t.customer.where("c_custkey % 3 > 0").selectExpr("c_custkey", "'nat-' || c_nationkey AS profile_id")
    )
    objects = t.customer.selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 5 = 0 THEN 'own' END AS tier",
        "CASE WHEN c_acctbal < 0 THEN 'credit' END AS owner",
    )
    return joins.resolve_profiles(
        objects, assigned, segments.unionByName(nations), ["tier", "owner"], object_id="c_custkey", identity=["c_custkey"]
    )


@query(
    "C15_instantiate_template",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'manual' END, 'std-' || p_type) AS mode, p_name AS child, count(*) AS n
       FROM orders JOIN part ON p_type = CASE WHEN o_orderpriority < '3' THEN 'PROMO' ELSE 'ECONOMY' END AND p_size = 1 + o_custkey % 50
       GROUP BY ALL""",
)
def instantiate_template(t: Tables):
    objects = t.orders.selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderstatus = 'F' THEN 'manual' END AS mode",
        "CASE WHEN o_orderpriority < '3' THEN 'PROMO' ELSE 'ECONOMY' END || '-' || (1 + o_custkey % 50) AS template",
    )
    kinds = t.part.selectExpr("p_type || '-' || p_size AS template", "p_name AS child", "'std-' || p_type AS mode")
    filled, children = joins.instantiate_template(
        objects,
        kinds.select("template", "mode").distinct(),
        kinds.groupBy("template", "child").agg(F.count("*").alias("n")),
        ["mode"],
        object_id="o_orderkey",
        template_id="template",
    )
    return filled.join(children.drop("template"), "o_orderkey").select("o_orderkey", "mode", "child", "n")


OVERLAY = """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'RENAMED' END AS c_mktsegment,
  CASE WHEN c_custkey % 6 = 0 THEN CAST(c_nationkey + 1 AS INT) END AS c_nationkey, c_custkey % 10 = 0 AS _deleted
  FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey + 1000000000, 'NEW', CAST(1 AS INT), false FROM customer WHERE c_custkey % 50 = 1"""


def customer_overlay(t: Tables):
    edits = t.customer.where("c_custkey % 2 = 0").selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 4 = 0 THEN 'RENAMED' END AS c_mktsegment",
        "CASE WHEN c_custkey % 6 = 0 THEN CAST(c_nationkey + 1 AS INT) END AS c_nationkey",
        "c_custkey % 10 = 0 AS _deleted",
    )
    fresh = t.customer.where("c_custkey % 50 = 1").selectExpr(
        "c_custkey + 1000000000 AS c_custkey", "'NEW' AS c_mktsegment", "CAST(1 AS INT) AS c_nationkey", "false AS _deleted"
    )
    return edits.unionByName(fresh)


VIEW_SQL = f"""SELECT coalesce(b.c_custkey, o.c_custkey) AS c_custkey, coalesce(o.c_mktsegment, b.c_mktsegment) AS c_mktsegment,
    coalesce(o.c_nationkey, b.c_nationkey) AS c_nationkey, b.c_name
  FROM customer b FULL JOIN ({OVERLAY}) o ON b.c_custkey = o.c_custkey WHERE NOT coalesce(_deleted, false)"""


def customer_view(t: Tables):
    return joins.branch_view(
        t.customer, customer_overlay(t), "c_custkey", aware=["c_mktsegment", "c_nationkey"], agnostic=["c_name"]
    )


@query("C16_branch_view", VIEW_SQL)
def branch_view(t: Tables):
    return customer_view(t)


@query(
    "C16_branch_diff",
    f"""WITH v AS ({VIEW_SQL}) SELECT coalesce(v.c_custkey, b.c_custkey) AS c_custkey,
          CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN v.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
          CASE WHEN b.c_custkey IS NOT NULL AND v.c_custkey IS NOT NULL THEN concat_ws(',',
            CASE WHEN b.c_mktsegment IS DISTINCT FROM v.c_mktsegment THEN 'c_mktsegment' END,
            CASE WHEN b.c_nationkey IS DISTINCT FROM v.c_nationkey THEN 'c_nationkey' END) END AS changed_columns
        FROM v FULL JOIN customer b ON b.c_custkey = v.c_custkey
        WHERE b.c_custkey IS NULL OR v.c_custkey IS NULL OR b.c_mktsegment IS DISTINCT FROM v.c_mktsegment OR b.c_nationkey IS DISTINCT FROM v.c_nationkey""",
)
def branch_diff(t: Tables):
    return joins.branch_diff(t.customer, customer_view(t), "c_custkey", ["c_mktsegment", "c_nationkey"])


@query(
    "C17_xref",
    """SELECT doc_id, 'unused' AS direction FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT doc_id, 'undefined' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def xref(t: Tables):
    return joins.xref(t.labels, t.documents, "doc_id")


@query(
    "C18_resolve_generic",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 'customer' ELSE 'supplier' END AS kind,
         CASE WHEN o_orderstatus = 'F' THEN c_custkey WHEN o_orderstatus = 'O' THEN s_suppkey END AS target_id,
         CASE WHEN o_orderstatus = 'P' THEN 'kind_missing' WHEN (o_orderstatus = 'F' AND c_custkey IS NULL) OR (o_orderstatus = 'O' AND s_suppkey IS NULL)
           THEN 'unresolved' ELSE 'resolved' END AS status
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey""",
)
def resolve_generic(t: Tables):
    refs = t.orders.selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderstatus = 'F' THEN 'customer' WHEN o_orderstatus = 'O' THEN 'supplier' END AS kind",
        "o_custkey AS key",
    )
    party = t.customer.selectExpr("'customer' AS kind", "c_custkey AS key", "c_custkey AS target_id").unionByName(
        t.supplier.selectExpr("'supplier' AS kind", "s_suppkey AS key", "s_suppkey AS target_id")
    )
    return joins.resolve_generic(refs, party).drop("key")


@query(
    "C19_common_parent",
    """SELECT count(*) AS n_links, left_parent, right_parent FROM (SELECT c_nationkey AS left_parent, s_nationkey AS right_parent
         FROM (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
         JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) WHERE left_parent <> right_parent GROUP BY ALL""",
)
def common_parent(t: Tables):
    final = t.orders.select("o_orderkey", "o_custkey")
    links = (
        t.lineitem.select("l_orderkey", "l_suppkey")
        .join(final, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s_suppkey"))
        .distinct()
    )
    apart = joins.common_parent(
        links,
        t.customer.withColumnRenamed("c_nationkey", "parent"),
        t.supplier.withColumnRenamed("s_nationkey", "parent"),
        left_key="c_custkey",
        right_key="s_suppkey",
        parent="parent",
    )
    return apart.groupBy("left_parent", "right_parent").agg(F.count("*").alias("n_links"))


@query(
    "C20_error_to_source",
    """SELECT 'orders.json' AS file, l_orderkey * 10 + l_linenumber AS row, CASE WHEN l_tax > CAST(0.05 AS DOUBLE) THEN 'tax' ELSE 'colour' END AS attr,
         'orders.csv' AS src_file, CASE WHEN l_linenumber < 5 THEN l_orderkey * 10 + l_linenumber ELSE l_orderkey END AS line_from,
         CASE WHEN l_linenumber < 5 THEN l_orderkey * 10 + l_linenumber + 3 ELSE l_orderkey + 1 END AS line_to,
         CASE WHEN l_tax > CAST(0.05 AS DOUBLE) THEN 'Tax (%)' END AS src_column
       FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_tax FROM lineitem)""",
)
def error_to_source(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_tax").distinct()
    errors = lines.selectExpr(
        "'orders.json' AS file", "l_orderkey * 10 + l_linenumber AS row", "CASE WHEN l_tax > 0.05D THEN 'tax' ELSE 'colour' END AS attr"
    )
    children = lines.select("l_orderkey", "l_linenumber").distinct().selectExpr(
        "'orders.json' AS file",
        "l_orderkey * 10 + l_linenumber AS row",
        "CASE WHEN l_linenumber < 5 THEN 'orders.csv' END AS src_file",
        "CASE WHEN l_linenumber < 5 THEN l_orderkey * 10 + l_linenumber END AS line_from",
        "CASE WHEN l_linenumber < 5 THEN l_orderkey * 10 + l_linenumber + 3 END AS line_to",
        "l_orderkey * 10 AS parent_row",
        "map('tax', 'Tax (%)') AS columns",
    )
    parents = t.orders.selectExpr(
        "'orders.json' AS file", "o_orderkey * 10 AS row", "'orders.csv' AS src_file", "o_orderkey AS line_from",
        "o_orderkey + 1 AS line_to", "CAST(NULL AS BIGINT) AS parent_row", "map('tax', 'Tax (%)') AS columns",
    )
    return joins.error_to_source(errors, children.unionByName(parents))


# --- merge, reconcile, decompose -----------------------------------------------------------------


@query(
    "E1_first_wins",
    f"""SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, file, n_seen FROM (
          SELECT *, count(*) OVER (PARTITION BY s_suppkey) AS n_seen FROM ({SUPPLIER_INPUTS}))
        QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY file) = 1""",
)
def first_wins_merge(t: Tables):
    merged = rec.merge_inputs(list(supplier_inputs(t))).withColumn("line", F.col("s_suppkey"))
    survivors, _ = first_wins(merged, ["s_suppkey"])
    return survivors.select(
        "s_suppkey", "s_name", F.col("s_nationkey").cast("bigint").alias("s_nationkey"), "file", "n_seen"
    )


@query(
    "E1_first_wins_events",
    """SELECT user_id, event_type, event_id, n_seen FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n_seen FROM events)
       QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
    headline=True,
)
def first_wins_events(t: Tables):
    survivors, _ = first_wins(
        t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id"
    )
    return survivors.select("user_id", "event_type", "event_id", "n_seen")


@query(
    "E1_duplicates",
    f"""WITH i AS ({SUPPLIER_INPUTS}) SELECT s_suppkey, file, min(file) OVER (PARTITION BY s_suppkey) AS kept
        FROM i QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY file) > 1""",
)
def duplicates_reported(t: Tables):
    merged = rec.merge_inputs(list(supplier_inputs(t))).withColumn("line", F.col("s_suppkey"))
    _, losers = first_wins(merged, ["s_suppkey"])
    return losers.select(
        "s_suppkey", "file", F.when(F.col("kept_input") == 0, "a.csv").otherwise("b.csv").alias("kept")
    )


@query(
    "G2_merge_inputs",
    """SELECT c_custkey, c_name, c_mktsegment, NULL AS c_acctbal, 0 AS input_rank FROM customer WHERE c_nationkey < 12
       UNION ALL SELECT c_custkey, c_name, NULL, c_acctbal, 1 FROM customer WHERE c_nationkey >= 10""",
)
def merge_inputs(t: Tables):
    first = t.customer.where("c_nationkey < 12").select("c_custkey", "c_name", "c_mktsegment")
    second = t.customer.where("c_nationkey >= 10").select("c_custkey", "c_name", "c_acctbal")
    return rec.merge_inputs([first, second])


DESIRED = "SELECT c_custkey + CASE WHEN c_custkey % 9 = 0 THEN 1000000000 ELSE 0 END AS c_custkey, c_name, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer"


def desired_customers(t: Tables):
    return t.customer.selectExpr(
        "c_custkey + CASE WHEN c_custkey % 9 = 0 THEN 1000000000 ELSE 0 END AS c_custkey",
        "c_name",
        "CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment",
    )


@query(
    "G3_reconcile",
    f"""SELECT coalesce(d.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'create' WHEN d.c_custkey IS NULL THEN 'delete'
          WHEN d.c_name IS NOT DISTINCT FROM a.c_name AND d.c_mktsegment IS NOT DISTINCT FROM a.c_mktsegment THEN 'keep' ELSE 'update' END AS action,
          CASE WHEN d.c_custkey IS NULL THEN a.c_name ELSE d.c_name END AS c_name,
          CASE WHEN d.c_custkey IS NULL THEN a.c_mktsegment ELSE d.c_mktsegment END AS c_mktsegment
        FROM ({DESIRED}) d FULL JOIN customer a ON d.c_custkey = a.c_custkey""",
    headline=True,
)
def reconcile(t: Tables):
    return rec.reconcile(desired_customers(t), t.customer, "c_custkey", ["c_name", "c_mktsegment"])


@query(
    "G4_insert_only",
    f"""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer) THEN 'customer with c_custkey ' || c_custkey || ' already exists' END AS reason
        FROM ({DESIRED})""",
)
def insert_only(t: Tables):
    fresh, rejected = rec.insert_only(desired_customers(t), t.customer, "c_custkey", kind="customer")
    return fresh.select("c_custkey", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("c_custkey", "reason")
    )


@query(
    "G5_decompose",
    f"""SELECT 'region' AS kind, r_name AS name, NULL AS parent FROM region WHERE r_name IN (SELECT r_name FROM ({SHEET_SQL}))
        UNION ALL SELECT 'nation', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name IN (SELECT n_name FROM ({SHEET_SQL}))
        UNION ALL SELECT 'customer', c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    headline=True,
)
def decompose(t: Tables):
    parts = rec.decompose(
        customer_sheet(t),
        [
            rec.Part("region", ["r_name"], {"r_name": "name"}),
            rec.Part("nation", ["n_name"], {"n_name": "name", "r_name": "parent"}),
            rec.Part("customer", ["c_name"], {"c_name": "name", "n_name": "parent"}),
        ],
        order=["c_custkey"],
    )
    out = None
    for kind, rows in parts.items():
        if "parent" not in rows.columns:
            rows = rows.withColumn("parent", F.lit(None).cast("string"))
        rows = rows.select(F.lit(kind).alias("kind"), "name", "parent")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "G6_nest_components",
    """SELECT l_orderkey, CAST(0 AS BIGINT) AS block, 'OrderLine' AS kind, count(*) AS n_children, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1""",
    headline=True,
)
def nest_components(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    nested = rec.nest_components(
        lines,
        "l_orderkey",
        kind="OrderLine",
        columns=["l_linenumber", "l_partkey", "l_quantity"],
        order=["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"],
        chunk=F.col("l_linenumber"),
    )
    data = F.col("children.data")
    return nested.select(
        "l_orderkey",
        "block",
        "children.kind",
        F.size(data).cast("bigint").alias("n_children"),
        F.get(data, F.lit(0))["l_linenumber"].alias("first_line"),
    )


@query(
    "G7_cascade_delete",
    """WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)),
         o AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (FROM c))
       SELECT 'deleted' AS outcome, 'region:1' AS node UNION ALL SELECT 'deleted', 'nation:' || n_nationkey FROM n
       UNION ALL SELECT 'deleted', 'customer:' || c_custkey FROM c
       UNION ALL SELECT 'deleted', 'orders:' || o_orderkey FROM o WHERE o_orderstatus = 'F'
       UNION ALL SELECT 'nulled', 'orders:' || o_orderkey FROM o WHERE o_orderstatus <> 'F'""",
)
def cascade_delete(t: Tables):
    held = tree_edges(t).where("kind <> 'orders'").selectExpr("parent AS src", "child AS dst", "'cascade' AS on_delete")
    placed = t.orders.selectExpr(
        "'customer:' || o_custkey AS src",
        "'orders:' || o_orderkey AS dst",
        "CASE WHEN o_orderstatus = 'F' THEN 'cascade' WHEN o_orderstatus = 'O' THEN 'no-action' END AS on_delete",
    )
    seeds = t.region.where("r_regionkey = 1").selectExpr("'region:' || r_regionkey AS node")
    deleted, nulled = graph.cascade_delete(seeds, held.unionByName(placed))
    return deleted.select(F.lit("deleted").alias("outcome"), "node").unionByName(
        nulled.select(F.lit("nulled").alias("outcome"), F.col("dst").alias("node"))
    )


@query(
    "G8_missing_outputs",
    """SELECT u.user_id, t.event_type, count(e.event_id) > 0 AS produced, count(e.event_id) AS score
       FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'refund']) AS event_type) t
       LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY ALL""",
)
def missing_outputs(t: Tables):
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view", "refund")])
    expected = t.events.select("user_id").distinct().select("user_id", F.explode(kinds).alias("event_type"))
    produced = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("score"))
    return rec.missing_outputs(expected, produced, ["user_id", "event_type"], "score")


@query(
    "I1_hierarchy_paths",
    f"""WITH RECURSIVE e AS ({TREE_SQL}), r AS (SELECT child AS node, child AS path, 0 AS level FROM e WHERE parent IS NULL
          UNION ALL SELECT e.child, r.path || '/' || e.child, level + 1 FROM r JOIN e ON e.parent = r.node)
        SELECT node, path, CAST(level AS BIGINT) AS level FROM r""",
    headline=True,
)
def hierarchy_paths(t: Tables):
    return graph.hierarchy_paths(tree_edges(t)).select("node", "path", "level")


@query(
    "I1_hierarchy_status",
    """SELECT k AS node, CASE k % 4 WHEN 1 THEN (k - 1) || '/' || k WHEN 3 THEN NULL ELSE CAST(k AS VARCHAR) END AS path,
         CAST(CASE k % 4 WHEN 1 THEN 1 WHEN 3 THEN NULL ELSE 0 END AS BIGINT) AS level,
         CASE k % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'second_parent' WHEN 2 THEN 'orphan' ELSE 'cycle' END AS status
       FROM (SELECT o_orderkey AS k FROM orders UNION SELECT o_orderkey - 1 FROM orders WHERE o_orderkey % 4 = 1)""",
)
def hierarchy_status(t: Tables):
    """Roots, children with two parents, children of nobody, and cycles, from all order keys."""
    edges = t.orders.selectExpr(
        """inline(CASE o_orderkey % 4 WHEN 0 THEN array(struct(o_orderkey AS child, CAST(NULL AS BIGINT) AS parent))
           WHEN 1 THEN array(struct(o_orderkey - 1 AS child, CAST(NULL AS BIGINT) AS parent), struct(o_orderkey AS child, o_orderkey - 1 AS parent),
                             struct(o_orderkey AS child, o_orderkey + 1000000000 AS parent))
           WHEN 2 THEN array(struct(o_orderkey AS child, -o_orderkey AS parent))
           ELSE array(struct(o_orderkey AS child, o_orderkey AS parent)) END)"""
    )
    return graph.hierarchy_paths(edges)


@query(
    "I2_unnest_children",
    """SELECT 'nation:' || n_nationkey AS node, 'region:' || n_regionkey AS parent, 'nation' AS kind, CAST(1 AS BIGINT) AS level FROM nation
       UNION ALL SELECT 'region:' || r_regionkey, NULL, NULL, 0 FROM region
       UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'customer', 2 FROM customer WHERE c_nationkey <> 7""",
)
def unnest_children(t: Tables):
    # one document per region, nation and customer path: the nesting is derived row by row
    sheet = customer_sheet(t).selectExpr(
        """'{"id":"region:' || r_regionkey || '","children":{"kind":"nation","data":[{"id":"nation:' || n_nationkey ||
           '","children":{' || CASE WHEN n_nationkey = 7 THEN '' ELSE '"kind":"customer",' END ||
           '"data":[{"id":"customer:' || c_custkey || '"}]}}]}}' AS doc"""
    )
    rows, _ = graph.unnest_children(sheet, "doc", [], key="id", depth=3)
    return rows.distinct().withColumn("level", F.col("level").cast("bigint"))


@query(
    "I3_dependency_levels",
    f"""SELECT 'region:' || r_regionkey AS node, CAST(0 AS BIGINT) AS level FROM region
        UNION ALL SELECT 'nation:' || n_nationkey, CASE WHEN n_regionkey = 4 THEN 0 ELSE 1 END FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, CASE WHEN c_nationkey = 7 THEN NULL WHEN n_regionkey = 4 THEN 1 ELSE 2 END FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def dependency_levels(t: Tables):
    tree = tree_edges(t).where("kind <> 'orders'")
    refs = tree.where("parent IS NOT NULL AND parent <> 'region:4'").selectExpr("child AS src", "parent AS dst")
    # customers of nation 7 refer to themselves: a cycle, which can never be loaded
    looped = t.customer.where("c_nationkey = 7").selectExpr("'customer:' || c_custkey AS src", "'customer:' || c_custkey AS dst")
    out = graph.dependency_levels(tree.selectExpr("child AS node"), refs.unionByName(looped))
    return out.withColumn("level", F.col("level").cast("bigint"))


# Twelve nations refer to each other in rings of three, the customers of the first ring stand behind it.
@query(
    "I3_dependency_cycles",
    """SELECT 'nation:' || n_nationkey AS node, 'cycle' AS status, 'nation:' || (n_nationkey // 3 * 3) AS cycle FROM nation WHERE n_nationkey < 9
       UNION ALL SELECT 'region:' || r_regionkey, 'cycle', 'region:' || r_regionkey FROM region WHERE r_regionkey = 4
       UNION ALL SELECT 'customer:' || c_custkey, 'behind', NULL FROM customer WHERE c_nationkey < 9""",
)
def dependency_cycles(t: Tables):
    nodes = (
        t.nation.selectExpr("'nation:' || n_nationkey AS node").unionByName(t.region.selectExpr("'region:' || r_regionkey AS node"))
        .unionByName(t.customer.selectExpr("'customer:' || c_custkey AS node"))
    )
    refs = (
        t.nation.where("n_nationkey < 9").selectExpr(
            "'nation:' || n_nationkey AS src", "'nation:' || (n_nationkey div 3 * 3 + (n_nationkey + 1) % 3) AS dst"
        )
        .unionByName(t.customer.selectExpr("'customer:' || c_custkey AS src", "'nation:' || c_nationkey AS dst"))
        .unionByName(t.region.where("r_regionkey = 4").selectExpr("'region:4' AS src", "'region:4' AS dst"))
    )
    return graph.dependency_cycles(nodes, refs)


@query(
    "D17_kind_coverage",
    """WITH f AS (SELECT source AS kind, lang AS file FROM documents WHERE lang IN ('en', 'fr')),
         e AS (SELECT DISTINCT source AS kind FROM documents UNION SELECT DISTINCT 'missing-' || lang FROM documents)
       SELECT kind, 'missing' AS problem FROM e WHERE kind NOT IN (SELECT kind FROM f)
       UNION ALL SELECT kind, 'several_outputs' FROM f GROUP BY kind HAVING count(DISTINCT file) > 1""",
)
def kind_coverage(t: Tables):
    found = t.documents.where("lang IN ('en', 'fr')").selectExpr("source AS kind", "lang AS file")
    expected = t.documents.selectExpr("source AS kind").unionByName(t.documents.selectExpr("'missing-' || lang AS kind"))
    return agg.kind_coverage(expected, found, kind="kind", file="file")
