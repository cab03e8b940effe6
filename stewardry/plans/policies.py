"""Policy checks, correlation joins and their reports (families B, C and D over plain tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stewardry.functions.network import strip_prefix
from stewardry.operators import aggregates as agg
from stewardry.operators import checks, joins
from stewardry.operators.windows import truncate_report
from stewardry.registry import Tables, query


def violation_sql(policy, kind, object_id, reason, source, *, name=None, group="NULL", severity="ERROR", fix="NULL"):
    name = name or object_id
    return f"""
    SELECT '{policy}' AS policy, '{kind}' AS kind, CAST({object_id} AS VARCHAR) AS object_id,
           CAST({name} AS VARCHAR) AS object_name, CAST({group} AS VARCHAR) AS group_key,
           '{severity}' AS severity, {reason} AS reason, CAST({fix} AS VARCHAR) AS suggested_fix
    FROM {source}"""


@query(
    "B1_get_nodes",
    """SELECT c_custkey, c_name AS display_label FROM customer
       WHERE contains(c_mktsegment, 'MACH') AND c_nationkey IN (
         SELECT n_nationkey FROM nation WHERE n_regionkey IN (
           SELECT r_regionkey FROM region WHERE contains(r_name, 'AMERICA')))""",
)
def get_nodes(t: Tables):
    region = checks.Relation(t.region, "n_regionkey", "r_regionkey")
    nation = checks.Relation(t.nation, "c_nationkey", "n_nationkey", {"region": region})
    return checks.get_nodes(
        t.customer,
        {"nation__region__r_name__value": "AMERICA", "c_mktsegment__value": "MACH"},
        relations={"nation": nation},
        id_column="c_custkey",
        label=F.col("c_name"),
        partial_match=True,
    )


@query(
    "B1_get_nodes_exact",
    """SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey IN (
         SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA')""",
)
def get_nodes_exact(t: Tables):
    region = checks.Relation(t.region, "n_regionkey", "r_regionkey")
    nation = checks.Relation(t.nation, "c_nationkey", "n_nationkey", {"region": region})
    return checks.get_nodes(
        t.customer,
        {"nation__region__r_name__value": "AMERICA", "c_mktsegment__value": "MACHINERY"},
        relations={"nation": nation},
        id_column="c_custkey",
        include_attributes=True,
    )


@query(
    "B2_search_nodes",
    """SELECT p_partkey, p_name, p_brand FROM part
       WHERE contains(CAST(p_partkey AS VARCHAR), 'ring') OR contains(p_name, 'ring') OR contains(p_brand, 'ring')
       ORDER BY p_partkey LIMIT 50""",
)
def search_nodes(t: Tables):
    return checks.search_nodes(
        t.part.select("p_partkey", "p_name", "p_brand"), "ring", order=["p_partkey"], limit=50
    )


@query(
    "B3_page_after",
    """WITH o AS (SELECT o_orderkey, o_custkey FROM orders), k AS (SELECT max(o_orderkey) // 2 AS mid FROM o)
       SELECT o_orderkey, o_custkey, (SELECT count(*) FROM o) AS total_count, (SELECT count(*) FROM o, k WHERE o_orderkey > mid) > 50 AS has_more
       FROM o WHERE o_orderkey > (SELECT mid FROM k) ORDER BY o_orderkey LIMIT 50""",
)
def page_after(t: Tables):
    orders = t.orders.select("o_orderkey", "o_custkey")
    half = orders.agg((F.max("o_orderkey") / 2).cast("bigint")).first()[0]
    return checks.page(orders, order=["o_orderkey"], limit=50, after=[half])


@query(
    "B3_page",
    """SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total_count,
         (SELECT count(*) FROM orders) > 150 AS has_more
       FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100""",
)
def page_by_offset(t: Tables):
    orders = t.orders.select("o_orderkey", "o_custkey")
    return checks.page(orders, order=["o_orderkey"], limit=50, offset=100)


NAMES = "SELECT p_partkey, nullif(p_name, 'hot gear') AS p_name, p_brand FROM part"


def part_name_violations(t: Tables):
    parts = t.part.selectExpr("p_partkey", "nullif(p_name, 'hot gear') AS p_name", "p_brand")
    return checks.regex_conformance(
        parts,
        "p_name",
        "^(red|small) ",
        policy="part_name_pattern",
        kind="part",
        object_id="p_partkey",
        object_name="p_name",
        group_key="p_brand",
    )


PART_NAME_SQL = violation_sql(
    "part_name_pattern",
    "part",
    "p_partkey",
    "'does not match pattern ^(red|small) '",
    f"({NAMES}) WHERE NOT coalesce(regexp_matches(p_name, '^(red|small) '), false)",
    name="p_name",
    group="p_brand",
)


@query("B4_regex_conformance", PART_NAME_SQL)
def regex_conformance(t: Tables):
    return part_name_violations(t)


def line_part_violations(t: Tables):
    lines = t.lineitem.select(
        "l_partkey", "l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id")
    )
    return checks.membership(
        lines,
        "l_partkey",
        t.part.where("p_size < 25").select("p_partkey"),
        policy="approved_parts",
        kind="lineitem",
        object_id="line_id",
        group_key="l_suppkey",
        allowed_column="p_partkey",
    )


@query(
    "B5_membership",
    violation_sql(
        "approved_parts",
        "lineitem",
        "l_orderkey || '-' || l_linenumber",
        "l_partkey || ' is not in the approved set'",
        "lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)",
        group="l_suppkey",
    ),
    headline=True,
)
def membership(t: Tables):
    return line_part_violations(t)


@query(
    "B5_membership_scoped",
    violation_sql(
        "sizes_per_supplier",
        "lineitem",
        "l_orderkey || '-' || l_linenumber",
        "p_size || ' is not in the approved set'",
        """(SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A') x
           WHERE NOT EXISTS (SELECT 1 FROM lineitem y JOIN part q ON y.l_partkey = q.p_partkey
             WHERE y.l_returnflag = 'R' AND y.l_suppkey = x.l_suppkey AND q.p_size = x.p_size)""",
        group="l_suppkey",
        severity="WARN",
    ),
)
def membership_scoped(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    sized = lines.join(t.part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    seen = sized.withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return checks.membership(
        seen.where("l_returnflag = 'A'"),
        "p_size",
        sized.where("l_returnflag = 'R'").select("l_suppkey", "p_size"),
        policy="sizes_per_supplier",
        kind="lineitem",
        object_id="line_id",
        group_key="l_suppkey",
        allowed_column="p_size",
        scope="l_suppkey",
        severity="WARN",
    )


def unlabelled_documents(t: Tables):
    labelled = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return checks.presence(
        labelled,
        "quality",
        policy="document_labelled",
        kind="document",
        object_id="doc_id",
        group_key="source",
        severity="WARN",
        suggested_fix="label the document",
    )


@query(
    "B6_presence",
    violation_sql(
        "document_labelled",
        "document",
        "d.doc_id",
        "'no quality assigned'",
        "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL",
        group="source",
        severity="WARN",
        fix="'label the document'",
    ),
)
def presence(t: Tables):
    return unlabelled_documents(t)


# A JSON document per event whose attributes are right or wrong depending on the event type.
EVENT_DOC = """
  concat('{"count": ', get_json_object(props, '$.k'),
    ', "managed": ', CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN '"yes"' ELSE 'false' END,
    ', "at": ', CASE event_type WHEN 'error' THEN '"01/02/2024"' ELSE '"2024-01-15T00:00:00Z"' END,
    ', "meta": ', CASE event_type WHEN 'signup' THEN '"{}"' ELSE props END, '}')"""


@query(
    "B7_type_conformance",
    violation_sql(
        "typed_attributes",
        "event",
        "event_id",
        "reason",
        """(SELECT event_id, event_type, 'managed is not a Boolean' AS reason FROM events WHERE event_type = 'view'
            UNION ALL SELECT event_id, event_type, 'at is not a DateTime' FROM events WHERE event_type = 'error'
            UNION ALL SELECT event_id, event_type, 'meta is not a JSON' FROM events WHERE event_type = 'signup'
            UNION ALL SELECT event_id, event_type, 'count is not a Number' FROM events
              WHERE json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))""",
        group="event_type",
    ),
)
def type_conformance(t: Tables):
    events = t.events.selectExpr("event_id", "event_type", f"{EVENT_DOC} AS doc")
    return checks.type_conformance(
        events,
        "doc",
        {"count": "Number", "managed": "Boolean", "at": "DateTime", "meta": "JSON"},
        policy="typed_attributes",
        kind="event",
        object_id="event_id",
        group_key="event_type",
    )


LINE_BOUNDS = (
    checks.Constraint("l_quantity", min_value=3, max_value=48, excluded_values="7,10-12"),
    checks.Constraint("l_discount", max_value=0.09),
    checks.Constraint("l_tax", max_value=0.07),
    checks.Constraint("l_returnflag", regex="^[AN]", enum=("A", "N")),
)


@query(
    "B8_param_constraints",
    violation_sql(
        "line_bounds",
        "lineitem",
        "l_orderkey || '-' || l_linenumber",
        "reason",
        """(SELECT *, unnest(list_filter([
              CASE WHEN l_quantity < 3 THEN 'l_quantity: min_value' END,
              CASE WHEN l_quantity > 48 THEN 'l_quantity: max_value' END,
              CASE WHEN l_quantity = 7 OR l_quantity BETWEEN 10 AND 12 THEN 'l_quantity: excluded_values' END,
              CASE WHEN l_discount > CAST(0.09 AS DOUBLE) THEN 'l_discount: max_value' END,
              CASE WHEN l_tax > CAST(0.07 AS DOUBLE) THEN 'l_tax: max_value' END,
              CASE WHEN NOT regexp_matches(l_returnflag, '^[AN]') THEN 'l_returnflag: regex' END,
              CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'l_returnflag: enum' END],
              lambda x: x IS NOT NULL)) AS reason FROM lineitem)""",
        group="l_suppkey",
    ),
    headline=True,
)
def param_constraints(t: Tables):
    lines = t.lineitem.select(
        "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"),
    )
    return checks.param_constraints(
        lines, LINE_BOUNDS, policy="line_bounds", kind="lineitem", object_id="line_id", group_key="l_suppkey"
    )


@query(
    "B9_fail_closed_gate",
    """WITH h AS (SELECT DISTINCT p_brand AS file,
                 replace(lower(p_name), ' ', '_') || '_' || p_size AS "column" FROM part),
            m AS (SELECT DISTINCT replace(lower(p_name), ' ', '_') || '_' || p_size AS "column" FROM part
                  WHERE p_type <> 'PROMO')
       SELECT file, "column" FROM h WHERE "column" NOT IN (SELECT "column" FROM m)""",
)
def fail_closed_gate(t: Tables):
    named = t.part.selectExpr(
        "p_brand AS file", "replace(lower(p_name), ' ', '_') || '_' || p_size AS column", "p_type"
    )
    return checks.unmapped_columns(named.select("file", "column").distinct(), named.where("p_type <> 'PROMO'"))


@query(
    "B10_as_subtype",
    """SELECT 'customer' AS kind, c_custkey AS party_id, c_name AS name, c_mktsegment AS segment FROM customer
       WHERE nullif(c_mktsegment, 'FURNITURE') IS NOT NULL""",
)
def as_subtype(t: Tables):
    customers = t.customer.selectExpr(
        "'customer' AS kind", "c_custkey AS party_id", "c_name AS name",
        "nullif(c_mktsegment, 'FURNITURE') AS segment",
    )
    suppliers = t.supplier.selectExpr("'supplier' AS kind", "s_suppkey AS party_id", "s_name AS name")
    return checks.as_subtype(customers.unionByName(suppliers, allowMissingColumns=True), ["segment"])


@query(
    "B11_omit_nulls",
    """SELECT c_custkey, '{"name":"' || c_name || '"' ||
         coalesce(',"segment":"' || nullif(c_mktsegment, 'BUILDING') || '"', '') || ',"nation":' || c_nationkey || '}' AS doc
       FROM customer""",
)
def omit_nulls(t: Tables):
    rows = t.customer.selectExpr(
        "c_custkey", "c_name AS name", "nullif(c_mktsegment, 'BUILDING') AS segment", "c_nationkey AS nation"
    )
    return rows.select("c_custkey", checks.omit_nulls(["name", "segment", "nation"]).alias("doc"))


@query(
    "C1_cross_key",
    violation_sql(
        "order_has_customer",
        "orders",
        "o_orderkey",
        "'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' has no counterpart'",
        """orders WHERE o_orderstatus <> 'P' AND 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
             NOT IN (SELECT c_name FROM customer WHERE c_acctbal > 0)""",
        group="o_orderstatus",
    ),
)
def cross_key(t: Tables):
    orders = t.orders.select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", "")
        .otherwise(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("/32")))
        .alias("ref"),
    )
    return joins.cross_key(
        orders,
        strip_prefix(F.col("ref")),
        t.customer.where("c_acctbal > 0"),
        strip_prefix(F.col("c_name")),
        policy="order_has_customer",
        kind="orders",
        object_id="o_orderkey",
        group_key="o_orderstatus",
    )


@query(
    "C2_traverse",
    """SELECT r_name, n_name, count(DISTINCT c_custkey) AS n_customers, count(o_orderkey) AS n_orders
       FROM region LEFT JOIN nation ON r_regionkey = n_regionkey
       LEFT JOIN customer ON n_nationkey = c_nationkey
       LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""",
    headline=True,
)
def traverse(t: Tables):
    # orders are counted per customer first: the fan-out never travels
    placed = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    reached = joins.traverse(
        t.region.select("r_regionkey", "r_name"),
        [
            joins.Hop(t.nation, "r_regionkey", "n_regionkey"),
            joins.Hop(t.customer.select("c_custkey", "c_nationkey"), "n_nationkey", "c_nationkey"),
            joins.Hop(placed, "c_custkey", "o_custkey"),
        ],
    )
    return reached.groupBy("r_name", "n_name").agg(
        F.count("c_custkey").alias("n_customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders")
    )


# --- counts, groups and scorecards -------------------------------------------------------------


@query(
    "D1_related_count",
    """SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'F') AS n_related
       FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
       HAVING count(o_orderkey) FILTER (o_orderstatus = 'F') < 2 OR count(o_orderkey) FILTER (o_orderstatus = 'F') > 6""",
)
def related_count(t: Tables):
    return agg.related_count(
        t.customer.select("c_custkey"),
        t.orders.select("o_custkey", "o_orderstatus"),
        "c_custkey",
        "o_custkey",
        condition=F.col("o_orderstatus") == "F",
        minimum=2,
        maximum=6,
    )


@query(
    "D2_required_directions",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN coalesce(a, 0) = 0 THEN 'A' END, CASE WHEN coalesce(r, 0) = 0 THEN 'R' END) AS missing
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a,
         count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
       WHERE o_orderstatus = 'O' AND (coalesce(a, 0) = 0 OR coalesce(r, 0) = 0)""",
    headline=True,
)
def required_directions(t: Tables):
    return agg.required_categories(
        t.orders.where("o_orderstatus = 'O'").select("o_orderkey"),
        t.lineitem.select("l_orderkey", "l_returnflag"),
        "o_orderkey",
        "l_orderkey",
        "l_returnflag",
        ["A", "R"],
    )


@query(
    "D3_group_violations",
    f"""WITH v AS (SELECT object_id, coalesce(nullif(group_key, 'Brand#7'), 'unknown') AS "group" FROM ({PART_NAME_SQL}))
        SELECT v."group", v.object_id, n AS n_in_group FROM v
        JOIN (SELECT "group", count(*) AS n FROM v GROUP BY 1) s ON v."group" = s."group" """,
)
def group_violations(t: Tables):
    found = part_name_violations(t).withColumn("group_key", F.expr("nullif(group_key, 'Brand#7')"))
    return agg.group_violations(found, "group_key").select("group", "object_id", "n_in_group")


SCORECARD_SQL = """
WITH p AS (
  SELECT 'part_name_pattern' AS policy, (SELECT count(*) FROM part) AS checked,
    (SELECT count(*) FROM part WHERE NOT coalesce(regexp_matches(nullif(p_name, 'hot gear'), '^(red|small) '), false)) AS failed
  UNION ALL SELECT 'approved_parts', (SELECT count(*) FROM lineitem),
    (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25))
  UNION ALL SELECT 'document_labelled', (SELECT count(*) FROM documents),
    (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))),
s AS (SELECT * FROM p UNION ALL SELECT 'OVERALL', CAST(sum(checked) AS BIGINT), CAST(sum(failed) AS BIGINT) FROM p)
SELECT policy, checked, checked - failed AS passed, failed,
  round_even((checked - failed) * 100.0::DOUBLE / checked, 1) AS pct,
  CASE WHEN failed = 0 THEN 'PASS' ELSE 'WARN' END AS status FROM s"""


@query("D4_scorecard", SCORECARD_SQL, headline=True)
def scorecard(t: Tables):
    counted = [
        agg.policy_counts("part_name_pattern", t.part, part_name_violations(t)),
        agg.policy_counts("approved_parts", t.lineitem, line_part_violations(t)),
        agg.policy_counts("document_labelled", t.documents, unlabelled_documents(t)),
    ]
    checked, failed = counted[0]
    for more_checked, more_failed in counted[1:]:
        checked, failed = checked.unionByName(more_checked), failed.unionByName(more_failed)
    return agg.scorecard(checked, failed)


@query(
    "D5_profile_columns",
    """WITH c AS (SELECT 'c_name' AS "column", c_name AS value FROM customer
         UNION ALL SELECT 'c_mktsegment', nullif(c_mktsegment, 'BUILDING') FROM customer
         UNION ALL SELECT 'opened', CASE WHEN c_custkey % 4 = 0 THEN 'N/A' ELSE '2024-01-0' || (c_custkey % 9 + 1) END FROM customer
         UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer),
       k AS (SELECT "column", value, value IS NULL OR upper(trim(value)) IN ('', 'NULL', 'N/A', '#N/A', '-', '<BLANK>') AS blank FROM c),
       r AS (SELECT * FROM k WHERE NOT blank),
       f AS (SELECT "column", string_agg(value, '|' ORDER BY value) AS first_values FROM
         (SELECT DISTINCT "column", value, dense_rank() OVER (PARTITION BY "column" ORDER BY value) AS d FROM r) WHERE d <= 5 GROUP BY 1),
       s AS (SELECT "column", count(DISTINCT value) AS n_distinct, min(length(value)) AS min_length, max(length(value)) AS max_length,
         round_even(avg(CAST(regexp_full_match(trim(value), '[+-]?\\d+(\\.\\d+)?') AS INT)), 4) AS numeric_share,
         round_even(avg(CAST(regexp_full_match(trim(value), '(\\d{4}-\\d{2}-\\d{2}([T ].*)?|\\d{1,2}/\\d{1,2}/\\d{4})') AS INT)), 4) AS date_share,
         round_even(avg(CAST(regexp_full_match(trim(value), '.*\\D\\d+') AS INT)), 4) AS sequence_share FROM r GROUP BY 1),
       b AS (SELECT "column", count(*) AS n_rows, round_even(avg(CAST(blank AS INT)), 4) AS blank_share FROM k GROUP BY 1)
       SELECT b."column", n_rows, n_distinct, min_length, max_length, numeric_share, date_share, sequence_share, blank_share,
         first_values, n_distinct <= 10 AS choice_hint FROM b JOIN s ON b."column" = s."column" JOIN f ON b."column" = f."column" """,
)
def profile_columns(t: Tables):
    cells = t.customer.selectExpr(
        "c_name",
        "nullif(c_mktsegment, 'BUILDING') AS c_mktsegment",
        "CASE WHEN c_custkey % 4 = 0 THEN 'N/A' ELSE '2024-01-0' || (c_custkey % 9 + 1) END AS opened",
        "CAST(c_nationkey AS STRING) AS c_nationkey",
    )
    return agg.profile_columns(cells, cells.columns)


SHEET_SQL = """SELECT c_custkey, c_name, n_name, n_nationkey, r_regionkey, r_name, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def customer_sheet(t: Tables):
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "n_name", "n_nationkey", "r_regionkey", "r_name", "c_mktsegment"
    )


@query(
    "D6_group_constancy",
    f"""WITH g AS (SELECT n_name, count(DISTINCT r_name) AS a, count(DISTINCT n_nationkey) AS b, count(DISTINCT c_mktsegment) AS c
          FROM ({SHEET_SQL}) GROUP BY 1),
        v AS (SELECT count(*) AS n_keys, max(a) = 1 AS a, max(b) = 1 AS b, max(c) = 1 AS c FROM g)
        SELECT n_keys, x.k AS "column", x.v AS constant, x.v AND n_keys >= 3 AS is_parent_column FROM (
          SELECT n_keys, unnest([{{'k': 'r_name', 'v': a}}, {{'k': 'n_nationkey', 'v': b}}, {{'k': 'c_mktsegment', 'v': c}}]) AS x FROM v)""",
)
def group_constancy(t: Tables):
    return agg.group_constancy(customer_sheet(t), "n_name", ["r_name", "n_nationkey", "c_mktsegment"])


@query(
    "D7_uniqueness",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    headline=True,
)
def uniqueness(t: Tables):
    return agg.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


SUPPLIER_INPUTS = """
  SELECT 'a.csv' AS file, s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal < 6000
  UNION ALL SELECT 'b.csv', s_suppkey, s_name, CASE WHEN s_acctbal > 4500 THEN s_nationkey + 1 ELSE s_nationkey END
  FROM supplier WHERE s_acctbal > 3000"""


def supplier_inputs(t: Tables):
    first = t.supplier.where("s_acctbal < 6000").selectExpr(
        "'a.csv' AS file", "s_suppkey", "s_name", "s_nationkey"
    )
    second = t.supplier.where("s_acctbal > 3000").selectExpr(
        "'b.csv' AS file", "s_suppkey", "s_name",
        "CASE WHEN s_acctbal > 4500 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey",
    )
    return first, second


@query(
    "D8_merge_conflicts",
    f"""WITH i AS ({SUPPLIER_INPUTS}) SELECT file, s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM i
        WHERE s_suppkey IN (SELECT s_suppkey FROM i GROUP BY 1 HAVING count(DISTINCT (s_name, s_nationkey)) > 1)""",
)
def merge_conflicts(t: Tables):
    first, second = supplier_inputs(t)
    found = agg.merge_conflicts(first.unionByName(second), ["s_suppkey"], ["s_name", "s_nationkey"])
    return found.withColumn("s_nationkey", F.col("s_nationkey").cast("bigint"))


@query(
    "D9_capacity",
    """SELECT n_nationkey, size, count(*) AS used, round_even(count(*) / size, 4) AS usage
       FROM (SELECT n_nationkey, CAST(20 + n_nationkey * 40 AS BIGINT) AS size FROM nation)
       JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
       GROUP BY 1, 2 HAVING count(*) > size * 0.8""",
)
def capacity(t: Tables):
    placed = t.orders.select("o_custkey").join(
        t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    return agg.capacity(
        t.nation.selectExpr("n_nationkey", "CAST(20 + n_nationkey * 40 AS BIGINT) AS size"),
        placed,
        key="n_nationkey",
        member_key="c_nationkey",
        size="size",
    )


CHECK_ROWS = """
  SELECT c_nationkey AS subject, 1 AS check_order, 'positive_balance' AS "check", c_acctbal > 0 AS passed FROM customer
  UNION ALL SELECT c_nationkey, 2, 'known_segment', c_mktsegment <> 'FURNITURE' FROM customer
  UNION ALL SELECT c_nationkey, 3, 'named', nullif(c_name, 'Customer#000000007') IS NOT NULL FROM customer"""


def check_rows(t: Tables):
    out = None
    for order, name, test in (
        (1, "positive_balance", "c_acctbal > 0"),
        (2, "known_segment", "c_mktsegment <> 'FURNITURE'"),
        (3, "named", "nullif(c_name, 'Customer#000000007') IS NOT NULL"),
    ):
        rows = t.customer.selectExpr(
            "c_nationkey AS subject", f"{order} AS check_order", f"'{name}' AS check", f"{test} AS passed"
        )
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("subject", "check_order", "check").agg(F.bool_and("passed").alias("passed"))


@query(
    "D10_score",
    f"""WITH r AS (SELECT subject, check_order, "check", bool_and(passed) AS passed FROM ({CHECK_ROWS}) GROUP BY ALL)
        SELECT subject, total, n_passed, coalesce(failed, '') AS failed_checks, score,
          CASE WHEN score >= 1 THEN 'ok' WHEN score >= 0.5 THEN 'warn' ELSE 'fail' END AS band FROM (
          SELECT subject, count(*) AS total, count(*) FILTER (passed) AS n_passed,
            string_agg("check", ',' ORDER BY check_order) FILTER (NOT passed) AS failed,
            round_even(count(*) FILTER (passed) / count(*), 4) AS score FROM r GROUP BY subject)""",
)
def score(t: Tables):
    return agg.score(check_rows(t), "subject")


@query(
    "F2_truncate_report",
    f"""WITH v AS (SELECT group_key, object_id, object_name FROM ({PART_NAME_SQL}))
        SELECT group_key, object_id, object_name, shown, total, greatest(total - 10, 0) AS more FROM (
          SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY object_id) AS shown,
            count(*) OVER (PARTITION BY group_key) AS total FROM v) WHERE shown <= 10""",
)
def report(t: Tables):
    found = part_name_violations(t).select("group_key", "object_id", "object_name")
    out = truncate_report(found, "group_key", ["object_id"])
    return out.withColumn("shown", F.col("shown").cast("bigint"))


@query(
    "G1_design_diff",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'mismatch' END AS status,
         CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN concat_ws(',', CASE WHEN d.quality IS DISTINCT FROM l.quality THEN 'quality' END,
           CASE WHEN d.toxic IS DISTINCT FROM l.toxic THEN 'toxic' END) END AS attributes
       FROM (SELECT doc_id, CAST(n_chars > 500 AS INT) AS quality, 0 AS toxic FROM documents WHERE lang <> 'de') d
       FULL JOIN labels l ON d.doc_id = l.doc_id
       WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR d.quality IS DISTINCT FROM l.quality OR d.toxic IS DISTINCT FROM l.toxic""",
)
def design_diff(t: Tables):
    from stewardry.operators.reconcile import design_diff as diff

    design = t.documents.where("lang <> 'de'").selectExpr(
        "doc_id", "CAST(n_chars > 500 AS INT) AS quality", "0 AS toxic"
    )
    return diff(design, t.labels, "doc_id", ["quality", "toxic"])


def flagship(t: Tables):
    """Which line items use parts outside the approved list, per nation, and what share complies."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    approved = t.part.where("p_size < 25").select(F.col("p_partkey").alias("_part")).distinct()
    judged = lines.join(approved, F.col("l_partkey") == F.col("_part"), "left").groupBy("l_suppkey").agg(
        F.count("*").alias("checked"), F.count("_part").alias("passed")
    )
    placed = judged.join(
        t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")
    ).join(t.nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return placed.groupBy("n_name").agg(
        F.sum("checked").alias("checked"),
        F.sum("passed").alias("passed"),
        (F.sum("checked") - F.sum("passed")).alias("failed"),
        F.bround(F.sum("passed") * 100.0 / F.sum("checked"), 1).alias("pct"),
    )


query(
    "flagship_compliance_by_nation",
    """SELECT n_name, count(*) AS checked, count(*) FILTER (p_size < 25) AS passed, count(*) FILTER (NOT p_size < 25) AS failed,
         round_even(count(*) FILTER (p_size < 25) * 100.0::DOUBLE / count(*), 1) AS pct
       FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    headline=True,
)(flagship)
