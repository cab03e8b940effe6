"""Runs, logs, incidents, ranges, allocation and reports (families D, E, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stewardry.functions.text import error_template, expand_range
from stewardry.operators import aggregates as agg
from stewardry.operators import corpus, windows
from stewardry.registry import Tables, query


@query(
    "D11_run_stats",
    """SELECT event_type, count(*) AS n, round_even(avg(value), 3) AS mean, coalesce(round_even(stddev_samp(value), 3), 0) AS stddev
       FROM events GROUP BY 1 UNION ALL SELECT 'single-' || event_id, count(*), round_even(avg(value), 3), 0.0 FROM events WHERE event_id < 3 GROUP BY 1""",
)
def run_stats(t: Tables):
    rows = t.events.select("event_type", "value").unionByName(
        t.events.where("event_id < 3").selectExpr("'single-' || event_id AS event_type", "value")
    )
    return agg.run_stats(rows, ["event_type"], "value")


RUNS = """SELECT user_id % 20 AS suite, user_id, CAST(count(*) FILTER (event_type <> 'error') AS DOUBLE) / count(*) AS rate
  FROM events GROUP BY 1, 2"""


def user_rates(t: Tables):
    return t.events.groupBy((F.col("user_id") % 20).alias("suite"), "user_id").agg(
        (F.count_if(F.col("event_type") != "error") / F.count("*")).alias("rate")
    )


@query(
    "D12_gate",
    f"""SELECT suite, count(*) AS n_runs, bool_or(rate < 0.65) AS any_run_failed, round_even(avg(rate), 3) AS mean_rate,
          NOT bool_or(rate < 0.65) AND round_even(avg(rate), 3) >= 0.79 AS passed FROM ({RUNS}) GROUP BY 1""",
)
def gate(t: Tables):
    return agg.gate(user_rates(t), ["suite"], "rate", run_floor=0.65, suite_floor=0.79)


@query(
    "D13_with_vs_baseline",
    """SELECT s.source, round_even(coalesce(a, 0), 3) AS with_rate, round_even(coalesce(b, 0), 3) AS without_rate,
         round_even(round_even(coalesce(a, 0), 3) - round_even(coalesce(b, 0), 3), 3) AS delta
       FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, avg(quality) FILTER (n_chars > 800) AS a,
         avg(quality) FILTER (n_chars <= 800) AS b FROM documents JOIN labels USING (doc_id) GROUP BY 1) r ON s.source = r.source""",
)
def with_vs_baseline(t: Tables):
    documents = t.documents.select("doc_id", "source", "n_chars")
    runs = documents.join(t.labels.select("doc_id", "quality"), "doc_id").withColumn(
        "variant", F.when(F.col("n_chars") > 800, "with").otherwise("without")
    )
    return agg.with_vs_baseline(documents, runs, ["source"], variant="variant", rate="quality")


# Log lines derived from events: the type is the service, the value decides what the line says.
MESSAGE = """CASE WHEN event_type = 'error' AND value > 12 THEN 'FATAL java heap OutOfMemoryError at node-' || user_id
  WHEN event_type = 'error' THEN 'ERROR connection refused by 10.0.' || user_id || '.1'
  WHEN value > 25 THEN 'query find_' || user_id || ' took ' || CAST(round(value * 100) AS INT) || ' ms'
  WHEN event_type = 'purchase' AND value > 20 THEN 'Traceback (most recent call last)'
  WHEN event_type = 'view' AND value < 2 THEN 'request timed out, retry ' || event_id
  ELSE 'ok ' || event_id END"""


def log_lines(t: Tables):
    events = t.spread("events", "event_id", "ts", "user_id", "event_type", "value")
    return events.selectExpr("event_id", "ts", "user_id", "event_type AS service", f"{MESSAGE} AS msg", "value")


@query(
    "D14_signal_sweep",
    f"""WITH l AS (SELECT event_type AS service, {MESSAGE} AS msg, value FROM events),
        s AS (SELECT DISTINCT service FROM l UNION SELECT DISTINCT service || '-standby' FROM l),
        c AS (SELECT service, x.k AS class, x.v AS hits FROM (SELECT service, unnest([
          {{'k': 'traceback', 'v': count(*) FILTER (contains(msg, 'Traceback (most recent call last)'))}},
          {{'k': 'severity', 'v': count(*) FILTER (regexp_matches(msg, '(?i)\\b(error|critical|fatal|panic)\\b'))}},
          {{'k': 'resource_kill', 'v': count(*) FILTER (regexp_matches(msg, '(?i)outofmemory|oomkilled|out of memory|killed'))}},
          {{'k': 'connection', 'v': count(*) FILTER (regexp_matches(msg, '(?i)connection (refused|reset|closed)|timed? ?out|retry'))}},
          {{'k': 'restart', 'v': count(*) FILTER (value > 40)}}]) AS x FROM l GROUP BY service))
        SELECT service, class, hits FROM c UNION ALL SELECT s.service, k.class, 0 FROM s
          CROSS JOIN (SELECT DISTINCT class FROM c) k WHERE s.service NOT IN (SELECT service FROM c)""",
    headline=True,
)
def signal_sweep(t: Tables):
    lines = log_lines(t)
    services = lines.select("service").unionByName(lines.selectExpr("service || '-standby' AS service"))
    return agg.signal_sweep(lines, services, service="service", message="msg", restarted=F.col("value") > 40)


@query(
    "D15_collapse_repeats",
    f"""SELECT service, regexp_replace(regexp_replace(regexp_replace(msg, '\\b(?:(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){{3}}(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\b', '<ip>', 'g'),
            '\\d+', '<n>', 'g'), '\\s+', ' ', 'g') AS template, count(*) AS n_lines, min(ts) AS first_seen, max(ts) AS last_seen
        FROM (SELECT event_type AS service, ts, {MESSAGE} AS msg FROM events) GROUP BY 1, 2""",
    headline=True,
)
def collapse_repeats(t: Tables):
    lines = log_lines(t).withColumn("template", error_template(F.col("msg")))
    return agg.collapse_repeats(lines, ["service", "template"], "ts")


@query(
    "D15_repeated_lines",
    """SELECT line, count(*) AS n_lines, min(doc_id) AS first_seen, max(doc_id) AS last_seen
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1 HAVING count(*) > 1""",
    headline=True,
)
def repeated_lines(t: Tables):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return agg.collapse_repeats(lines, ["line"], "doc_id").where("n_lines > 1")


ATTRIBUTE = "p_type || '-' || CAST(p_size AS STRING)"


@query(
    "D16_shape_duplicates",
    f"""WITH m AS (SELECT DISTINCT l_orderkey AS node, {ATTRIBUTE} AS a FROM lineitem JOIN part ON l_partkey = p_partkey),
        s AS (SELECT node, count(*) AS n, string_agg(a, '|' ORDER BY a) AS sig FROM m GROUP BY 1),
        u AS (SELECT sig, n, min(node) AS shape, count(*) AS n_nodes FROM s GROUP BY ALL),
        h AS (SELECT u.shape, u.n, m.a FROM u JOIN m ON m.node = u.shape),
        p AS (SELECT x.shape, y.shape AS other FROM h x JOIN h y ON x.a = y.a AND x.shape <> y.shape
              GROUP BY x.shape, y.shape, x.n, y.n HAVING count(*) * 100 > (x.n + y.n - count(*)) * 70),
        q AS (SELECT p.shape, CAST(sum(n_nodes) AS BIGINT) AS m FROM p JOIN u ON u.shape = p.other GROUP BY 1)
        SELECT u.shape, u.n AS n_attributes, n_nodes, n_nodes + coalesce(m, 0) AS n_alike FROM u LEFT JOIN q ON q.shape = u.shape
        WHERE n_nodes + coalesce(m, 0) >= 3""",
    headline=True,
)
def shape_duplicates(t: Tables):
    sold = t.lineitem.select("l_orderkey", "l_partkey").join(
        t.part.selectExpr("p_partkey", f"{ATTRIBUTE} AS attribute"), F.col("l_partkey") == F.col("p_partkey")
    )
    return corpus.shape_duplicates(sold, "l_orderkey", "attribute")


@query(
    "D18_slow_queries",
    f"""SELECT query, count(*) AS n, count(*) FILTER (ms > 3000) AS n_slow, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS max_ms, quantile_disc(ms, 0.95) AS p95_ms FROM (
          SELECT regexp_extract(msg, 'query (\\S+) took (\\d+) ms', 1) AS query, CAST(regexp_extract(msg, 'query (\\S+) took (\\d+) ms', 2) AS BIGINT) AS ms
          FROM (SELECT {MESSAGE} AS msg FROM events) WHERE regexp_matches(msg, 'query (\\S+) took (\\d+) ms')) GROUP BY 1""",
)
def slow_queries(t: Tables):
    return agg.slow_queries(log_lines(t), "msg", limit_ms=3000)


@query(
    "D19_session_counters",
    """WITH e AS (SELECT *, json_extract_string(props, '$.k') AS target FROM events),
         f AS (SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS first_edit, min(ts) FILTER (event_type = 'view') AS first_read FROM e GROUP BY 1),
         n AS (SELECT user_id, event_type, target, count(*) AS n FROM e GROUP BY ALL),
         m AS (SELECT user_id, max(n) FILTER (event_type = 'error') AS repeated_errors, max(n) FILTER (event_type = 'purchase') AS edits_of_one,
           sum(n - 1) FILTER (event_type = 'click') AS restated FROM n GROUP BY 1),
         c AS (SELECT e.user_id, count(*) FILTER (event_type = 'signup' AND ts > first_read) AS fetches_after_read,
           count(*) FILTER (event_type = 'view' AND (first_edit IS NULL OR ts < first_edit)) AS reads_before_edit FROM e JOIN f ON e.user_id = f.user_id GROUP BY 1),
         r AS (SELECT c.user_id, CAST(coalesce(repeated_errors, 0) AS BIGINT) AS repeated_errors, CAST(coalesce(edits_of_one, 0) AS BIGINT) AS edits_of_one,
           CAST(coalesce(restated, 0) AS BIGINT) AS restated, fetches_after_read, reads_before_edit FROM c JOIN m ON m.user_id = c.user_id)
       SELECT *, concat_ws(',', CASE WHEN repeated_errors >= 2 THEN 'repeated_errors' END, CASE WHEN edits_of_one >= 3 THEN 'edits_of_one' END,
         CASE WHEN restated >= 1 THEN 'restated' END, CASE WHEN fetches_after_read >= 1 THEN 'fetches_after_read' END,
         CASE WHEN reads_before_edit >= 4 THEN 'reads_before_edit' END) AS hints FROM r""",
)
def session_counters(t: Tables):
    kind = F.col("event_type")
    events = t.events.select("user_id", "event_type", "ts", F.get_json_object("props", "$.k").alias("target"))
    found = agg.session_counters(
        events, ["user_id"], ts="ts", error=kind == "error", edit=kind == "purchase", read=kind == "view", ask=kind == "click",
        fetch=kind == "signup", tool="event_type", target="target", request="target",
    )
    return found.withColumn("hints", F.array_join("hints", ","))


@query(
    "D20_fixed_profile",
    """SELECT c_nationkey AS kind, 'segment' AS attribute, min(profile) AS profile, min(value) AS value FROM (
         SELECT c_nationkey, 'p' || CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE c_custkey % 3 END AS profile,
           CASE WHEN c_custkey % 50 < 3 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'BUILDING' ELSE c_mktsegment END END AS value FROM customer)
       GROUP BY 1 HAVING count(DISTINCT profile) = 1 AND count(DISTINCT value) = 1""",
)
def fixed_profile(t: Tables):
    profiles = t.customer.selectExpr(
        "c_nationkey AS kind", "'segment' AS attribute",
        "'p' || CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE c_custkey % 3 END AS profile",
        "CASE WHEN c_custkey % 50 < 3 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'BUILDING' ELSE c_mktsegment END END AS value",
    )
    return agg.fixed_profile(profiles, "kind", "attribute", "value", "profile")


PORTS = """SELECT l_orderkey AS parent, 'Ethernet' || (l_suppkey % 2) || '/' || CASE WHEN l_returnflag = 'N' THEN '0' || l_linenumber ELSE CAST(l_linenumber AS STRING) END AS name,
  CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'N' THEN NULL ELSE l_returnflag END AS role FROM lineitem"""


def ports(t: Tables):
    lines = t.spread("lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return lines.selectExpr(
        "l_orderkey AS parent",
        "'Ethernet' || (l_suppkey % 2) || '/' || CASE WHEN l_returnflag = 'N' THEN '0' || l_linenumber ELSE CAST(l_linenumber AS STRING) END AS name",
        "CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'N' THEN NULL ELSE l_returnflag END AS role",
    )


@query(
    "E2_collapse_ranges",
    f"""WITH d AS (SELECT DISTINCT parent, role, regexp_extract(name, '^(.*?)(\\d+)$', 1) AS prefix, regexp_extract(name, '^(.*?)(\\d+)$', 2) AS digits FROM ({PORTS})),
        n AS (SELECT *, CAST(digits AS BIGINT) AS num, CASE WHEN digits LIKE '0_%' THEN length(digits) ELSE 0 END AS width FROM d),
        i AS (SELECT *, num - row_number() OVER (PARTITION BY parent, role, prefix, width ORDER BY num) AS isl FROM n),
        r AS (SELECT *, count(*) OVER (PARTITION BY parent, role, prefix, width, isl) AS n FROM i)
        SELECT parent, prefix || '[' || arg_min(digits, num) || '-' || arg_max(digits, num) || ']' AS name, role, count(*) AS n_rows, true AS expand_range
        FROM r WHERE n >= 4 GROUP BY parent, role, prefix, width, isl
        UNION ALL SELECT parent, prefix || digits, role, 1, false FROM r WHERE n < 4""",
    headline=True,
)
def collapse_ranges(t: Tables):
    return windows.collapse_ranges(ports(t), "parent", "name", ["role"])


@query("E2_duplicate_names", f"SELECT parent, name, count(*) AS n FROM ({PORTS}) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_names(t: Tables):
    return windows.duplicate_names(ports(t), "parent", "name")


@query("H11_expand_range", f"SELECT DISTINCT parent, name, role FROM ({PORTS})")
def expand_ranges(t: Tables):
    return expand_range(windows.collapse_ranges(ports(t), "parent", "name", ["role"]), "name").select(
        "parent", "name", "role"
    )


INCIDENTS = """SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS incident FROM (
  SELECT event_id, user_id, ts, event_type, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def clustered(t: Tables):
    signals = t.events.select("event_id", "user_id", "ts", "event_type")
    return windows.incidents(signals, ["user_id"], "ts", 21600, tie=["event_id"])


@query(
    "E3_incidents",
    f"SELECT event_id, user_id, CAST(incident AS BIGINT) AS incident FROM ({INCIDENTS})",
    headline=True,
)
def incidents(t: Tables):
    return clustered(t).select("event_id", "user_id", "incident")


@query(
    "E4_root_candidate",
    f"""SELECT user_id, CAST(incident AS BIGINT) AS incident, event_id, event_type, n_signals, n_signals - 1 AS n_cascade FROM (
          SELECT *, count(*) OVER (PARTITION BY user_id, incident) AS n_signals FROM ({INCIDENTS}))
        QUALIFY row_number() OVER (PARTITION BY user_id, incident ORDER BY
          CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, ts, event_id) = 1""",
    headline=True,
)
def root_candidate(t: Tables):
    out = windows.root_candidate(
        clustered(t), ["user_id", "incident"], "event_type", ["ts", "event_id"], {"purchase": 0, "error": 1}
    )
    return out.select("user_id", "incident", "event_id", "event_type", "n_signals", "n_cascade")


@query(
    "E5_red_to_green",
    """SELECT user_id, event_id, ts, red_ts FROM (SELECT *, lag(event_type) OVER w AS before, lag(ts) OVER w AS red_ts FROM events
         WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'purchase' AND before = 'error'""",
)
def red_to_green(t: Tables):
    kind = F.col("event_type")
    out = windows.red_to_green(
        t.events.select("user_id", "event_id", "ts", "event_type"),
        ["user_id"],
        "ts",
        "event_id",
        failed=kind == "error",
        passed=kind == "purchase",
    )
    return out.select("user_id", "event_id", "ts", "red_ts")


@query(
    "E5_ever_red_to_green",
    """SELECT user_id, min(ts) FILTER (event_type = 'error') AS first_red, max(ts) FILTER (event_type = 'purchase') AS last_green
       FROM events GROUP BY 1 HAVING min(ts) FILTER (event_type = 'error') < max(ts) FILTER (event_type = 'purchase')""",
)
def ever_red_to_green(t: Tables):
    kind = F.col("event_type")
    return windows.ever_red_to_green(
        t.events, ["user_id"], "ts", failed=kind == "error", passed=kind == "purchase"
    )


@query(
    "E6_allocate_next",
    """WITH pools AS (SELECT n_nationkey AS pool, n_nationkey * 1000 + 5000 AS low, n_nationkey * 1000 + 5000 + 30 + n_nationkey AS high FROM nation),
         used AS (SELECT c_nationkey AS pool, c_nationkey * 1000 + 5000 + c_custkey % 37 AS number, CASE WHEN c_acctbal < 0 THEN c_custkey END AS c_custkey
                  FROM customer WHERE c_mktsegment = 'BUILDING'),
         req AS (SELECT c_nationkey AS pool, c_custkey FROM customer WHERE c_custkey % 3 < 2),
         held AS (SELECT pool, c_custkey, min(number) AS number FROM used WHERE c_custkey IS NOT NULL GROUP BY ALL),
         free AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY number) AS r FROM (
           SELECT pool, unnest(range(low, high + 1)) AS number FROM pools) f WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.pool = f.pool AND u.number = f.number)),
         wait AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY c_custkey) AS r FROM req q
           WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.pool = q.pool AND h.c_custkey = q.c_custkey))
       SELECT CAST(q.pool AS BIGINT) AS pool, q.c_custkey, CAST(h.number AS BIGINT) AS number, 'kept' AS status FROM req q JOIN held h ON h.pool = q.pool AND h.c_custkey = q.c_custkey
       UNION ALL SELECT CAST(w.pool AS BIGINT), c_custkey, number, CASE WHEN number IS NULL THEN 'exhausted' ELSE 'allocated' END FROM wait w LEFT JOIN free f ON f.pool = w.pool AND f.r = w.r""",
    headline=True,
)
def allocate_next(t: Tables):
    pools = t.nation.selectExpr(
        "n_nationkey AS pool", "CAST(n_nationkey * 1000 + 5000 AS BIGINT) AS low",
        "CAST(n_nationkey * 1000 + 5030 + n_nationkey AS BIGINT) AS high",
    )
    used = t.customer.where("c_mktsegment = 'BUILDING'").selectExpr(
        "c_nationkey AS pool", "c_nationkey * 1000 + 5000 + c_custkey % 37 AS number",
        "CASE WHEN c_acctbal < 0 THEN c_custkey END AS c_custkey",
    )
    requests = t.customer.where("c_custkey % 3 < 2").selectExpr("c_nationkey AS pool", "c_custkey")
    out = windows.allocate_next(requests, pools, used, requester="c_custkey")
    return out.withColumn("pool", F.col("pool").cast("bigint"))


@query(
    "E7_log_tail",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS from_end FROM events QUALIFY from_end <= 3""",
    headline=True,
)
def log_tail(t: Tables):
    out = windows.log_tail(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 3)
    return out.select("user_id", "event_id", F.col("from_end").cast("bigint").alias("from_end"))


# Tracebacks inside the event log: five lines per failing event, one per other event.
TRACE = """CASE WHEN event_type = 'error' THEN concat('Traceback (most recent call last):', chr(10), '  File "/app/own/job.py", line ', user_id, ', in run', chr(10),
    '  File "/lib/site-packages/driver.py", line 9, in call', chr(10), '    raise', chr(10), 'own.errors.JobError: job ', event_id, ' failed') ELSE concat('ok ', event_id) END"""


def trace_lines(t: Tables):
    blocks = t.spread("events", "user_id", "event_id", "event_type").selectExpr("user_id", "event_id", f"{TRACE} AS block")
    return blocks.select(
        F.concat(F.lit("user-"), "user_id").alias("file"),
        F.posexplode(F.split("block", "\n")).alias("i", "text"),
        "event_id",
    ).select("file", (F.col("event_id") * 10 + F.col("i")).alias("line_no"), "text")


@query(
    "E8_stitch_tracebacks",
    """SELECT 'user-' || user_id AS file, event_id * 10 AS line_no, 'own.errors.JobError' AS exception_class, 'job ' || event_id || ' failed' AS message,
         'File "/app/own/job.py", line ' || user_id || ', in run' AS innermost_frame FROM events WHERE event_type = 'error'""",
    headline=True,
)
def stitch_tracebacks(t: Tables):
    return windows.stitch_tracebacks(trace_lines(t), own_code="/own/")


@query(
    "H25_exception_parts",
    """SELECT event_id, 'own.errors.JobError' AS exception_class, 'job ' || event_id || ' failed' AS message,
         'File "/app/own/job.py", line ' || user_id || ', in run' AS frame FROM events WHERE event_type = 'error'""",
)
def exception_parts(t: Tables):
    from stewardry.functions.text import exception_parts as parts

    blocks = t.events.where("event_type = 'error'").selectExpr("event_id", "user_id", "event_type", f"{TRACE} AS block")
    name, message, frame = parts(F.col("block"), "/own/")
    return blocks.select(
        "event_id", name.alias("exception_class"), message.alias("message"), frame.alias("frame")
    )


@query(
    "E9_context",
    """SELECT h.conv_id, h.turn AS hit, c.turn, c.role, md5(c.text) AS text_md5 FROM conversations h JOIN conversations c
         ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 2 AND h.turn + 6 WHERE h.role = 'system'""",
)
def context(t: Tables):
    turns = t.conversations
    hits = turns.where("role = 'system'").select("conv_id", "turn")
    out = windows.context(turns, hits, ["conv_id"], "turn")
    return out.select("conv_id", "hit", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


FINDINGS = """SELECT o_orderkey AS position, 'report-' || (o_custkey % 40) AS report, CASE WHEN o_orderstatus = 'F' THEN 'ladder' ELSE 'schema' END AS phase,
  CAST(1 + o_custkey % 7 AS BIGINT) AS ladder_step, 'file-' || (o_orderkey % 11) AS file, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_custkey % 7 < 3 THEN 'MEDIUM' WHEN o_orderkey % 17 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM orders"""


def findings(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey AS position",
        "'report-' || (o_custkey % 40) AS report",
        "CASE WHEN o_orderstatus = 'F' THEN 'ladder' ELSE 'schema' END AS phase",
        "CAST(1 + o_custkey % 7 AS BIGINT) AS ladder_step",
        "'file-' || (o_orderkey % 11) AS file",
        """CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_custkey % 7 < 3 THEN 'MEDIUM'
             WHEN o_orderkey % 17 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity""",
    )


@query(
    "E10_is_sorted",
    f"""SELECT report, position FROM (SELECT *, lag(ladder_step) OVER w AS s, lag(file) OVER w AS f FROM ({FINDINGS}) WHERE phase = 'ladder'
          WINDOW w AS (PARTITION BY report ORDER BY position)) WHERE s > ladder_step OR (s = ladder_step AND f > file)""",
)
def is_sorted(t: Tables):
    rows = findings(t).where("phase = 'ladder'")
    return windows.sort_breaks(rows, ["report"], "position", ["ladder_step", "file"]).select("report", "position")


@query(
    "F1_order_findings",
    f"""SELECT position, phase, row_number() OVER (PARTITION BY phase ORDER BY CASE WHEN phase = 'ladder' THEN ladder_step END,
          CASE WHEN phase = 'ladder' THEN file END, position) AS report_position FROM ({FINDINGS})""",
)
def order_findings(t: Tables):
    out = windows.order_findings(findings(t), phase="phase", sorted_phase="ladder")
    return out.select("position", "phase", "report_position")


@query(
    "H26_severity_rank",
    f"""SELECT position, severity, CASE WHEN ladder_step <= 3 THEN 'MEDIUM' ELSE 'LOW' END AS expected,
          CASE WHEN severity IS NULL THEN 'missing' WHEN severity = 'HIGH' THEN 'above_cap' WHEN severity <> CASE WHEN ladder_step <= 3 THEN 'MEDIUM' ELSE 'LOW' END THEN 'differs' ELSE 'ok' END AS verdict
        FROM ({FINDINGS}) WHERE phase = 'ladder'""",
)
def severity_rank(t: Tables):
    from stewardry.functions.text import severity_of_step, severity_rank as rank

    expected = severity_of_step(F.col("ladder_step"))
    verdict = (
        F.when(F.col("severity").isNull(), "missing")
        .when(rank(F.col("severity")) > 2, "above_cap")
        .when(F.col("severity") != expected, "differs")
        .otherwise("ok")
    )
    rows = findings(t).where("phase = 'ladder'")
    return rows.select("position", "severity", expected.alias("expected"), verdict.alias("verdict"))


@query(
    "E11_load_order",
    f"""WITH k AS (SELECT DISTINCT p_type || '/' || p_size AS kind, CAST(CASE WHEN p_size > 40 THEN 0 WHEN p_size > 20 THEN 1 ELSE 2 END AS BIGINT) AS level FROM part)
        SELECT kind, level, lpad(CAST(level + 1 AS VARCHAR), 2, '0') || CASE WHEN i >= 26 THEN chr(CAST(96 + i // 26 AS INT)) ELSE '' END || chr(CAST(97 + i % 26 AS INT)) AS prefix
        FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY kind) - 1 AS i FROM k)""",
)
def load_order(t: Tables):
    kinds = t.part.selectExpr(
        "p_type || '/' || p_size AS kind",
        "CAST(CASE WHEN p_size > 40 THEN 0 WHEN p_size > 20 THEN 1 ELSE 2 END AS BIGINT) AS level",
    ).distinct()
    return windows.load_order(kinds)


TOKENS = """SELECT DISTINCT {key} AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM {table}"""
SCORES = f"""WITH d AS (SELECT * FROM ({TOKENS.format(key='doc_id', table='documents')}) WHERE token <> ''), i AS (SELECT * FROM ({TOKENS.format(key='item_id', table='benchmark')}) WHERE token <> ''),
  w AS (SELECT token, greatest(1, 1000000000 // count(*)) AS weight FROM i GROUP BY 1)
  SELECT i.id AS item_id, d.id AS doc_id, count(*) AS n_shared, CAST(sum(weight) AS BIGINT) AS score FROM d JOIN i ON d.token = i.token JOIN w ON w.token = i.token GROUP BY ALL"""


def best_items(t: Tables, k: int, min_score: int = 1):
    return corpus.top_known_issues(
        t.spread("documents", "doc_id", "text"), t.benchmark.select("item_id", "text"), k,
        subject="doc_id", subject_text="text", issue="item_id", issue_text="text", min_score=min_score,
    )


@query(
    "M8_known_issue_match",
    f"""SELECT doc_id, item_id, n_shared, score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM ({SCORES})) WHERE rank <= 10""",
    headline=True,
)
def known_issue_match(t: Tables):
    return best_items(t, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "F3_top_matches",
    f"""WITH s AS (SELECT * FROM ({SCORES}) WHERE score >= 3000000000), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM s)
        SELECT d.doc_id, item_id, score, coalesce(rank, 0) AS rank FROM documents d LEFT JOIN (SELECT * FROM r WHERE rank <= 3) r ON d.doc_id = r.doc_id""",
)
def top_matches(t: Tables):
    strong = best_items(t, 3, min_score=3_000_000_000).drop("rank", "n_shared")
    return windows.top_matches(t.documents, strong, "doc_id", "item_id", "score", 3)
