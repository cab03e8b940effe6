"""Sources and sinks round trips (family A), user extensions (K) and streams (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stewardry.contracts import violations
from stewardry.extensions import Extensions
from stewardry.operators import aggregates as agg
from stewardry.operators.checks import GateClosed
from stewardry.plans.triage import MESSAGE
from stewardry.registry import Tables, query
from stewardry.scale import new_path
from stewardry.sources import delimited, documents, importing, sinks
from stewardry.streaming import changes


def written_csv(t: Tables) -> tuple[str, str]:
    """Customers as comma files, suppliers as semicolon files in another encoding."""
    commas, semicolons = new_path(t.spark, "customers"), new_path(t.spark, "suppliers")
    t.customer.select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(commas)
    t.supplier.selectExpr("s_suppkey", "'Zoë ' || s_name AS s_name", "s_suppkey || ',5' AS rate").write.options(
        header=True, sep=";", encoding="ISO-8859-1"
    ).csv(semicolons)
    return commas, semicolons


@query(
    "A1_read_delimited",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, NULL AS s_suppkey, NULL AS s_name, NULL AS rate, true AS placed FROM customer
       UNION ALL SELECT NULL, NULL, NULL, CAST(s_suppkey AS VARCHAR), 'Zoë ' || s_name, s_suppkey || ',5', true FROM supplier""",
)
def read_delimited(t: Tables):
    rows = delimited.read_delimited(t.spark, written_csv(t))
    placed = (F.col("_line") >= 2) & F.col("_file").endswith(".csv") & F.col("_input_rank").isNotNull()
    return rows.select("c_custkey", "c_name", "c_mktsegment", "s_suppkey", "s_name", "rate", placed.alias("placed"))


@query(
    "A1_multiline_records",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text, true AS placed FROM documents""",
)
def multiline_records(t: Tables):
    """Whole texts as quoted cells, with their line breaks and quotes."""
    path = new_path(t.spark, "texts")
    t.documents.select("doc_id", "lang", "text").write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    rows = delimited.read_delimited(t.spark, [path])
    # lines are physical ones: a record begins behind all line breaks of the records before it
    return rows.select("doc_id", "lang", "text", (F.col("_line") >= 2).alias("placed"))


@query(
    "A2_sniff_dialect",
    """SELECT 'c_custkey,c_name,c_mktsegment' AS header, 'utf-8' AS encoding, ',' AS delimiter, '"' AS quote, 'lf' AS eol, '.' AS "decimal", count(*) > 0 AS found FROM customer
       UNION ALL SELECT 's_suppkey;s_name;rate', 'windows-1252', ';', '"', 'lf', ',', count(*) > 0 FROM supplier""",
)
def sniff_dialect(t: Tables):
    found = delimited.sniff_dialect(t.spark, written_csv(t)).where("header <> ''")
    return found.groupBy("header", "encoding", "delimiter", "quote", "eol", "decimal").agg(
        (F.count("*") > 0).alias("found")
    )


@query(
    "A3_dialect_clean",
    """SELECT page_id AS id, 'html' AS "column", 'semicolons' AS problem FROM pages WHERE length(html) - length(replace(html, ';', '')) >= 2 AND NOT contains(html, chr(65279))
       UNION ALL SELECT page_id, 'html', 'byte_order_mark' FROM pages WHERE contains(html, chr(65279))
       UNION ALL SELECT doc_id, 'text', 'semicolons' FROM documents WHERE length(text) - length(replace(text, ';', '')) >= 2""",
)
def dialect_clean(t: Tables):
    pages = delimited.dialect_leftovers(t.pages.selectExpr("page_id AS id", "html"), ["html"], ["id"])
    texts = delimited.dialect_leftovers(t.documents.selectExpr("doc_id AS id", "text"), ["text"], ["id"])
    return pages.unionByName(texts)


@query(
    "A4_write_load_set",
    """SELECT '01' AS load_order, 'region' AS kind, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_problems FROM region
       UNION ALL SELECT '02', 'nation', count(*), 0 FROM nation UNION ALL SELECT '03a', 'customer', count(*), 0 FROM customer
       UNION ALL SELECT '03b', 'supplier', count(*), 0 FROM supplier""",
)
def write_load_set(t: Tables):
    path = new_path(t.spark, "load-set")
    frames = {"region": t.region, "nation": t.nation, "customer": t.customer, "supplier": t.supplier}
    sinks.write_load_set(frames, [("nation", "region"), ("customer", "nation"), ("supplier", "nation")], path)
    back = t.spark.read.schema("value string, load_order string, kind string").text(path)
    problems = sinks.envelope_problems(back, "value", ["load_order", "kind"]).groupBy("load_order", "kind").agg(
        F.count("*").alias("p")
    )
    counts = back.groupBy("load_order", "kind").agg(F.count("*").alias("n_rows"))
    return counts.join(problems, ["load_order", "kind"], "left").select(
        "load_order", "kind", "n_rows", F.coalesce("p", F.lit(0)).alias("n_problems")
    )


KINDS = [
    importing.Kind("nation", "n_nationkey", (
        importing.Attribute("n_nationkey", "Key", "Integer"), importing.Attribute("n_name", "Nation Name", optional=False),
    )),
    importing.Kind("customer", "c_custkey", (
        importing.Attribute("c_custkey", "Customer", "Integer"), importing.Attribute("c_name", "Full  Name", optional=False),
        importing.Attribute("c_acctbal", "Balance", "Number"), importing.Attribute("c_active", "", "Boolean"),
        importing.Attribute("c_nationkey", "Nation", "Integer", refers="nation"),
    )),
    importing.Kind("supplier", "s_suppkey", (
        importing.Attribute("s_suppkey", "Supplier", "Integer"), importing.Attribute("s_name", "Name", optional=False),
        importing.Attribute("s_acctbal", "Balance", "Number"), importing.Attribute("s_nationkey", "Nation", "Integer", refers="nation"),
    )),
]


def nation_files(t: Tables) -> str:
    path = new_path(t.spark, "nations")
    t.nation.selectExpr("n_nationkey AS Key", "n_name AS `Nation Name`").write.options(header=True, sep="\t").csv(path)
    return path


def object_rows(t: Tables, path: str, *fields: str):
    """Kind, load order and some fields of all rows of a load set."""
    back = t.spark.read.schema("value string, load_order string, kind string").text(path)
    return back.select("kind", "load_order", *[F.get_json_object("value", f"$.spec.data[0].{f}").alias(f) for f in fields])


@query(
    "A4_import_files",
    """SELECT 'nation' AS kind, '01' AS load_order, CAST(n_nationkey AS VARCHAR) AS nation, n_name AS name, NULL AS customer, NULL AS active, NULL AS balance FROM nation
       UNION ALL SELECT 'customer', '02', CAST(c_nationkey AS VARCHAR), c_name || chr(10) || '"' || c_mktsegment || '"', CAST(c_custkey AS VARCHAR),
         CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END, CAST(c_acctbal AS DOUBLE) FROM customer""",
)
def import_files(t: Tables):
    # two files of another dialect each: cells over several lines, a decimal comma, words for booleans
    path = new_path(t.spark, "customers")
    t.customer.selectExpr(
        "c_custkey AS Customer", "c_name || chr(10) || '\"' || c_mktsegment || '\"' AS `full name`", "replace(string(c_acctbal), '.', ',') AS `Balance (USD)`",
        "if(c_custkey % 2 = 0, 'Yes', 'no') AS c_active", "c_nationkey AS `Nation`",
    ).write.options(header=True, sep=";", escape='"').csv(path)
    ready = importing.draft(t.spark, {"nation": [nation_files(t)], "customer": [path]}, KINDS)
    emitted = new_path(t.spark, "import")
    importing.emit(ready, emitted)
    rows = object_rows(t, emitted, "n_nationkey", "c_nationkey", "n_name", "c_name", "c_custkey", "c_active", "c_acctbal")
    return rows.select(
        "kind", "load_order", F.coalesce("n_nationkey", "c_nationkey").alias("nation"), F.coalesce("n_name", "c_name").alias("name"),
        F.col("c_custkey").alias("customer"), F.col("c_active").alias("active"), F.col("c_acctbal").cast("double").alias("balance"),
    )


@query(
    "B9_import_issues",
    """SELECT 'supplier' AS kind, 'Gpu Count' AS "column", 'unmapped' AS code, NULL AS cell, CAST(1 AS BIGINT) AS n, false AS written
       UNION ALL SELECT 'supplier', 's_name', 'required_blank', NULL, count(*), false FROM supplier WHERE s_suppkey % 7 = 0 HAVING count(*) > 0
       UNION ALL SELECT 'supplier', 's_acctbal', 'not_a_number', 'many ' || s_nationkey, count(*), false FROM supplier WHERE s_suppkey % 5 = 0 GROUP BY ALL
       UNION ALL SELECT DISTINCT 'supplier', 's_nationkey', 'orphan', CAST(s_nationkey + 100 AS VARCHAR), CAST(1 AS BIGINT), false FROM supplier WHERE s_suppkey % 11 = 0
       UNION ALL SELECT 'supplier', 's_suppkey', 'conflict', CAST(s_suppkey AS VARCHAR), CAST(1 AS BIGINT), false FROM supplier WHERE s_suppkey % 13 = 0""",
)
def import_issues(t: Tables):
    path = new_path(t.spark, "suppliers")
    rows = t.supplier.selectExpr(
        "s_suppkey AS Supplier", "if(s_suppkey % 7 = 0, ' - ', s_name) AS name", "if(s_suppkey % 5 = 0, 'many ' || s_nationkey, string(s_acctbal)) AS `Balance (USD)`",
        "s_nationkey + if(s_suppkey % 11 = 0, 100, 0) AS Nation", "1 AS `Gpu Count`",
    )
    # some suppliers come again, most of them the same, others under another name
    again = rows.where("Supplier % 6 = 0 AND name <> ' - ' AND `Balance (USD)` NOT LIKE 'many%'")
    other = t.supplier.where("s_suppkey % 13 = 0").selectExpr("s_suppkey", "s_name || ' again'", "'1.5'", "s_nationkey", "1")
    rows.unionByName(again).union(other).write.options(header=True).csv(path)
    ready = importing.draft(t.spark, {"nation": [nation_files(t)], "supplier": [path]}, KINDS)
    emitted = new_path(t.spark, "import")
    try:
        importing.emit(ready, emitted)
        written = True
    except GateClosed:  # the findings are rows beside the load set that was not written
        written = False
    found = t.spark.read.schema(importing.ISSUES).json(f"{emitted}-issues")
    return found.groupBy("kind", "column", "code", "cell").agg(F.count("*").alias("n")).withColumn("written", F.lit(written))


@query(
    "A5_provenance",
    " UNION ALL ".join(
        f"SELECT '{n}.parquet' AS file, count(*) AS rows, true AS hashed FROM {n}" for n in ("customer", "events", "orders", "lineitem")
    ),
)
def provenance(t: Tables):
    names = ("customer", "events", "orders", "lineitem")
    found = sinks.provenance(t.spark, [t.path(n) for n in names], format="parquet")
    return found.select("file", "rows", ((F.length("sha256") == 64) & (F.col("bytes") > 0)).alias("hashed"))


OBJECT_DOC = """CASE WHEN event_type = 'error' THEN 'not json' WHEN event_type = 'signup' THEN '{"spec": {"kind": "Signup", "data": "none"}}'
  ELSE '{"apiVersion": "v1", "kind": "Object", "spec": {"kind": "' || event_type || '", "data": [' || props || ', 3, {"k": ' || user_id || '}]}}' END"""


@query(
    "A6_explode_documents",
    """SELECT event_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type NOT IN ('error', 'signup')
       UNION ALL SELECT event_id, event_type, user_id FROM events WHERE event_type NOT IN ('error', 'signup')""",
)
def explode_documents(t: Tables):
    docs = t.events.selectExpr("event_id", f"{OBJECT_DOC} AS doc")
    rows = documents.explode_documents(docs, "doc", ["event_id"])
    return rows.select("event_id", "kind", F.try_variant_get("row", "$.k", "bigint").alias("k"))


@query(
    "A7_flatten_response",
    """SELECT o_orderkey, o_orderstatus AS status, c_name AS customer, CAST(l_partkey IS NOT NULL AS BIGINT) AS n_lines, l_partkey AS part, CASE WHEN l_partkey IS NOT NULL THEN 'L' END AS typename
       FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
    headline=True,
)
def flatten_response(t: Tables):
    # one response per line (an order without lines has no edges), so nothing is grouped
    line = F.struct(
        F.struct(F.struct(F.col("l_partkey").alias("value")).alias("part"), F.lit("L").alias("__typename")).alias("node")
    )
    nested = (
        t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
        .join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            F.struct(F.col("o_orderstatus").alias("value")).alias("status"),
            F.struct(F.struct(F.struct(F.col("c_name").alias("value")).alias("name")).alias("node")).alias("customer"),
            F.struct(F.when(F.col("l_partkey").isNotNull(), F.array(line)).alias("edges")).alias("lines"),
        )
    )
    flat = documents.flatten_response(nested)
    first = F.get("lines", F.lit(0))
    return flat.select(
        "o_orderkey",
        "status",
        F.col("customer.name").alias("customer"),
        F.size("lines").cast("bigint").alias("n_lines"),
        first["part"].alias("part"),
        first["typename"].alias("typename"),
    )


@query(
    "A8_read_log_bundle",
    f"""SELECT event_type AS service, user_id % 2 = 1 AS is_previous, 'r' || user_id % 3 AS replica, row_number() OVER (PARTITION BY event_type, user_id % 3, user_id % 2 ORDER BY event_id) AS line_no,
          date_trunc('second', ts) AS ts, CASE WHEN value > 20 THEN 'WARN' ELSE 'INFO' END AS level, {MESSAGE} AS msg FROM events""",
)
def read_log_bundle(t: Tables):
    path = new_path(t.spark, "logs")
    lines = t.events.selectExpr(
        "event_type AS service",
        "'r' || user_id % 3 AS replica",
        "CASE WHEN user_id % 2 = 1 THEN 'previous' ELSE 'current' END AS log",
        "event_id",
        f"date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z ' || CASE WHEN value > 20 THEN 'WARN' ELSE 'INFO' END || ' ' || {MESSAGE} AS value",
    )
    parts = ["service", "replica", "log"]
    lines.repartition(*parts).sortWithinPartitions(*parts, "event_id").drop("event_id").write.partitionBy(*parts).text(path)
    layout = r"service=([^/]+)/replica=([^/]+)/log=(?:(previous)|current)/"
    back = documents.read_log_lines(t.spark, f"{path}/*/*/*/*.txt", layout)
    return back.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "A9_read_manifest",
    """SELECT o_orderkey, '1' || substr(o_orderpriority, 1, 1) AS collected_at, 'collector-' || o_orderstatus AS collector, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS status,
         CASE WHEN o_orderstatus = 'F' THEN 'timeout' END AS error, o_orderstatus = 'F' AS is_finding FROM orders
       UNION ALL SELECT o_orderkey, '1' || substr(o_orderpriority, 1, 1), 'metrics', NULL, NULL, true FROM orders""",
)
def read_manifest(t: Tables):
    docs = t.orders.selectExpr(
        "o_orderkey",
        """'{"collected_at":"1' || substr(o_orderpriority, 1, 1) || '","collectors":[{"name":"collector-' || o_orderstatus || '","status":"' ||
           CASE WHEN o_orderstatus = 'F' THEN 'failed","error":"timeout' ELSE 'ok' END || '"},{"name":"metrics"}]}' AS doc""",
    )
    return documents.read_manifest(docs, "doc", ["o_orderkey"])


@query(
    "A10_write_artifacts",
    """SELECT n_name AS target, count(*) AS n_lines, min('{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}') AS first_line
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def write_artifacts(t: Tables):
    path = new_path(t.spark, "artifacts")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("target"), "c_name", "c_mktsegment"
    )
    content = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    sinks.write_artifacts(rows, "target", content, "application/json", path)
    back = t.spark.read.schema("value string, target string").text(path)
    return back.groupBy("target").agg(F.count("*").alias("n_lines"), F.min("value").alias("first_line"))


@query(
    "A10_artifact_forms",
    """SELECT n_name AS target, 'text/csv' AS content_type, c_name || ', "' || c_mktsegment || '"' AS name, CAST(c_custkey AS VARCHAR) AS "key" FROM customer JOIN nation ON c_nationkey = n_nationkey
       UNION ALL SELECT n_name, 'application/xml', c_name || ', "' || c_mktsegment || '"', CAST(c_custkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def artifact_forms(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "n_name AS target", "named_struct('name', c_name || ', \"' || c_mktsegment || '\"', 'key', c_custkey) AS content"
    )
    csv, xml = new_path(t.spark, "csv"), new_path(t.spark, "xml")
    sinks.write_artifacts(rows, "target", F.col("content"), "text/csv", csv)
    sinks.write_artifacts(rows, "target", F.col("content"), "application/xml", xml)
    lines = t.spark.read.schema("name string, key string, target string").options(header=True, escape='"').csv(csv)
    elements = t.spark.read.schema("value string, target string").text(xml).select(
        "target", F.from_xml("value", "name string, key string").alias("c")
    ).select("target", "c.*")
    return lines.withColumn("content_type", F.lit("text/csv")).unionByName(elements.withColumn("content_type", F.lit("application/xml"))).select(
        "target", "content_type", "name", "key"
    )


# --- user extensions ---------------------------------------------------------------------------------

EXTENSIONS = Extensions()


@EXTENSIONS.check("no_negative_balance")
def no_negative_balance(frames):
    return violations(
        frames["customer"].where("c_acctbal < 0"),
        policy="no_negative_balance",
        kind="customer",
        object_id="c_custkey",
        reason="balance below zero",
    )


@EXTENSIONS.check("segment_notice")
def segment_notice(frames):
    return violations(
        frames["customer"].where("c_mktsegment = 'FURNITURE'"),
        policy="segment_notice",
        kind="customer",
        object_id="c_custkey",
        reason="segment is being phased out",
        severity="INFO",
    )


@EXTENSIONS.generator("contacts")
def contacts(frames):
    return {"contact": frames["customer"].selectExpr("c_custkey AS contact_id", "lower(c_name) AS label")}


@EXTENSIONS.transform("card", "application/json")
def card(rows):
    return rows.select(F.col("c_name").alias("target"), F.struct(F.col("c_custkey").alias("id")).alias("content"))


@query(
    "K1_user_checks",
    """SELECT 'no_negative_balance' AS "check", count(*) AS n_errors, 0 AS n_infos, count(*) = 0 AS passed FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT 'segment_notice', 0, count(*), true FROM customer WHERE c_mktsegment = 'FURNITURE'""",
)
def user_checks(t: Tables):
    return EXTENSIONS.verdicts({"customer": t.customer})


@query(
    "K2_user_generators",
    """SELECT c_custkey AS contact_id, CASE WHEN c_nationkey = 1 THEN 'create' WHEN c_nationkey = 2 THEN 'update' ELSE 'keep' END AS action, lower(c_name) AS label FROM customer""",
)
def user_generators(t: Tables):
    tracked = t.customer.where("c_nationkey <> 1").selectExpr(
        "c_custkey AS contact_id", "CASE WHEN c_nationkey = 2 THEN c_name ELSE lower(c_name) END AS label"
    )
    return EXTENSIONS.generate("contacts", {"customer": t.customer}, {"contact": tracked}, {"contact": "contact_id"})["contact"]


@query(
    "K3_user_transforms",
    """SELECT c_name AS target, 'application/json' AS content_type, '{"id":' || c_custkey || '}' AS content FROM customer""",
)
def user_transforms(t: Tables):
    return EXTENSIONS.render("card", t.customer)


# --- streams -----------------------------------------------------------------------------------------


def event_feed(t: Tables):
    return changes.change_feed(t.spark, t.folder, t.events.schema, "events.parquet")


@query(
    "J1_targeted_checks",
    """SELECT CAST(c_custkey AS VARCHAR) AS object_id, c_nationkey AS group_key FROM customer
       WHERE c_acctbal < 3000 AND c_mktsegment = 'MACHINERY' AND c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')""",
)
def targeted_checks(t: Tables):
    out, state = new_path(t.spark, "targeted"), new_path(t.spark, "targeted-state")

    def low_balance(customers):
        return violations(
            customers.where("c_acctbal < 3000"),
            policy="low_balance",
            kind="customer",
            object_id="c_custkey",
            group_key="c_nationkey",
            reason="balance below the floor",
        )

    changes.targeted_checks(
        event_feed(t).where("event_type = 'purchase'"),
        t.customer,
        t.customer.where("c_mktsegment = 'MACHINERY'"),
        low_balance,
        change_key="user_id",
        key="c_custkey",
        out=out,
        state=state,
    )
    found = t.spark.read.parquet(out).dropDuplicates(["policy", "object_id"])
    return found.select("object_id", F.col("group_key").cast("int").alias("group_key"))


@query(
    "J1_global_checks",
    "SELECT CAST(c_custkey AS VARCHAR) AS object_id FROM customer WHERE c_acctbal < 3000",
)
def global_checks(t: Tables):
    out, state = new_path(t.spark, "global"), new_path(t.spark, "global-state")

    def low_balance(customers):
        return violations(
            customers.where("c_acctbal < 3000"),
            policy="low_balance",
            kind="customer",
            object_id="c_custkey",
            reason="balance below the floor",
        )

    changes.targeted_checks(
        event_feed(t), t.customer, t.customer, low_balance, change_key="user_id", key="c_custkey",
        out=out, state=state, on_all=True,
    )
    return t.spark.read.parquet(out).select("object_id").distinct()


#: Every tenth event comes in a second delivery, when the first has moved the watermark on.
DELIVERED = "event_id % 10 = 3"
MARKS = f"""m AS (SELECT max(ts) FILTER (NOT ({DELIVERED})) - INTERVAL 1 HOUR AS first_mark, max(ts) - INTERVAL 1 HOUR AS last_mark FROM events)"""
SIGNALS = f"""l AS (SELECT event_id, event_type AS service, ts, time_bucket(INTERVAL 1 DAY, ts) AS w, {MESSAGE} AS msg, {DELIVERED} AS again FROM events),
     j AS (SELECT l.*, again AND w + INTERVAL 1 DAY <= first_mark AS late, w + INTERVAL 1 DAY <= last_mark AS is_final FROM l, m)"""


def in_two_deliveries(t: Tables, run):
    """A stream that is run over a first delivery, and goes on from its checkpoint when a second has come."""
    folder, root = new_path(t.spark, "deliveries"), new_path(t.spark, "stream")
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = None
    for part in (f"NOT ({DELIVERED})", DELIVERED):
        rows.where(part).write.mode("append").parquet(folder)
        out = run(changes.change_feed(t.spark, folder, rows.schema), root)
    return out


def signal_outcome(t: Tables):
    tests = {k: F.col("msg").rlike(agg.SIGNAL_CLASSES[k]) for k in ("severity", "connection")}

    def run(feed, root):
        lines = feed.selectExpr("event_id", "ts", "event_type AS service", f"{MESSAGE} AS msg")
        return changes.stream_signals(lines, "ts", "service", tests, width="1 day", delay="1 hour", root=root)

    return in_two_deliveries(t, run)


def incident_outcome(t: Tables):
    def run(feed, root):
        errors = feed.where("event_type = 'error'").select("ts", "user_id", "event_id")
        return changes.stream_incidents(errors, ["user_id"], "ts", gap_seconds=6 * 3600, delay="1 hour", root=root)

    return in_two_deliveries(t, run)


@query(
    "J2_stream_signals",
    f"""WITH {MARKS}, {SIGNALS}
        SELECT CAST(w AS TIMESTAMP) AS window_start, service, count(*) FILTER (regexp_matches(msg, '(?i)\\b(error|critical|fatal|panic)\\b')) AS severity,
          count(*) FILTER (regexp_matches(msg, '(?i)connection (refused|reset|closed)|timed? ?out|retry')) AS connection, is_final
        FROM j WHERE NOT late GROUP BY ALL""",
)
def stream_signals(t: Tables):
    out = signal_outcome(t)
    rows = out.final.withColumn("is_final", F.lit(True)).unionByName(out.held.withColumn("is_final", F.lit(False)))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "service", "severity", "connection", "is_final")


@query(
    "J2_late_rows",
    f"""WITH {MARKS}, {SIGNALS}
        SELECT event_id, service FROM j WHERE late""",
)
def late_rows(t: Tables):
    return signal_outcome(t).late.select("event_id", "service")


ERRORS = f"""m AS (SELECT max(ts) FILTER (NOT ({DELIVERED})) - INTERVAL 1 HOUR AS first_mark, max(ts) - INTERVAL 1 HOUR AS last_mark FROM events WHERE event_type = 'error'),
     x AS (SELECT user_id, ts, event_id, {DELIVERED} AND ts + INTERVAL 6 HOUR <= first_mark AS late FROM events, m WHERE event_type = 'error')"""


@query(
    "J3_stream_incidents",
    f"""WITH {ERRORS}, a AS (SELECT *, {DELIVERED} AS again FROM x WHERE NOT late),
         -- what the first delivery closed stays closed; all else is clustered together
         f AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL
           OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS o FROM a WHERE NOT again WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))),
         c AS (SELECT user_id, i, count(*) AS n_signals, min(ts) AS first_seen, max(ts) AS last_seen FROM f GROUP BY ALL),
         closed AS (SELECT c.* FROM c, m WHERE last_seen + INTERVAL 6 HOUR <= first_mark),
         r AS (SELECT user_id, ts, event_id FROM a WHERE again UNION ALL SELECT f.user_id, ts, event_id FROM f WHERE NOT EXISTS (SELECT 1 FROM closed k WHERE k.user_id = f.user_id AND k.i = f.i)),
         g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL
           OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS o FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))),
         d AS (SELECT user_id, i, count(*) AS n_signals, min(ts) AS first_seen, max(ts) AS last_seen FROM g GROUP BY ALL)
       SELECT user_id, n_signals, first_seen, last_seen, true AS is_final FROM closed
       UNION ALL SELECT user_id, n_signals, first_seen, last_seen, last_seen + INTERVAL 6 HOUR <= last_mark FROM d, m""",
)
def stream_incidents(t: Tables):
    out = incident_outcome(t)
    rows = out.final.withColumn("is_final", F.lit(True)).unionByName(out.held.withColumn("is_final", F.lit(False)))
    return rows.select(
        "user_id", "n_signals", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
        F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "is_final",
    )


@query("J3_late_signals", f"WITH {ERRORS} SELECT event_id, user_id FROM x WHERE late")
def late_signals(t: Tables):
    return incident_outcome(t).late.select("event_id", "user_id")


@query(
    "J4_stream_dedupe",
    "SELECT DISTINCT user_id, event_type FROM events",
)
def stream_dedupe(t: Tables):
    feed = event_feed(t).selectExpr("CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "event_id")
    out = changes.run_to_end(
        changes.stream_dedupe(feed, ["user_id", "event_type"], "ts", delay="60 days"), "dedupe"
    )
    return out.select("user_id", "event_type")
