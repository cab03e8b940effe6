"""Cell coercion, names, redaction, leaks and text rules (families H and M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stewardry.contracts import issues
from stewardry.functions import coerce, network, text
from stewardry.operators import corpus
from stewardry.registry import Tables, query


@query(
    "H1_snake_case",
    """SELECT p_partkey, trim(regexp_replace(lower('/' || p_name || ' #' || p_brand || ' (' || p_size || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part""",
)
def snake_case(t: Tables):
    return t.part.select(
        "p_partkey",
        text.snake_case(F.expr("'/' || p_name || ' #' || p_brand || ' (' || p_size || ')'")).alias("name"),
    )


@query(
    "H2_unit_strip",
    """SELECT p_partkey, p_name AS header, lower(p_type) AS unit, p_size % 3 = 0 AS cell_has_unit FROM part""",
)
def unit_strip(t: Tables):
    parts = t.part.selectExpr(
        "p_partkey", "p_name || '  (' || p_type || ') ' AS h",
        "CASE WHEN p_size % 3 = 0 THEN p_size || ' GB' ELSE CAST(p_size AS STRING) END AS cell",
    )
    return parts.select(
        "p_partkey",
        text.unit_strip(F.col("h")).alias("header"),
        text.unit_of(F.col("h")).alias("unit"),
        text.has_unit(F.col("cell")).alias("cell_has_unit"),
    )


HEADER = """CASE p_size % 6 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN upper(p_name) WHEN 2 THEN 'LABEL  of ' || p_name
  WHEN 3 THEN p_name || ' (GB)' WHEN 4 THEN p_name || ' (TB)' ELSE 'other ' || p_name END"""
ATTR_NAME = "replace(p_name, ' ', '_') || CASE WHEN p_type = 'PROMO' THEN '_gb' ELSE '' END"
ATTR_LABEL = "CASE WHEN p_size > 45 THEN 'Label of red bolt' ELSE 'Label of ' || p_name END"


@query(
    "H3_map_columns",
    f"""WITH h AS (SELECT DISTINCT p_brand, {HEADER} AS header FROM part),
        a AS (SELECT DISTINCT p_brand, {ATTR_NAME} AS name, lower({ATTR_LABEL}) AS label FROM part WHERE p_size > 10),
        b AS (SELECT *, trim(regexp_replace(header, '\\([^)]*\\)', '')) AS bare FROM h),
        x AS (SELECT p_brand, header, 0 AS o, header AS u FROM b UNION ALL SELECT p_brand, header, 3, bare FROM b WHERE bare <> header),
        s AS (SELECT x.p_brand, header, o + 1 AS step, name FROM x JOIN a ON a.p_brand = x.p_brand AND a.name = u
          UNION ALL SELECT x.p_brand, header, o + 2, name FROM x JOIN a ON a.p_brand = x.p_brand AND a.name = trim(regexp_replace(lower(u), '[^a-z0-9]+', '_', 'g'), '_')
          UNION ALL SELECT x.p_brand, header, o + 3, name FROM x JOIN a ON a.p_brand = x.p_brand AND a.label = lower(regexp_replace(u, '\\s+', ' ', 'g'))),
        m AS (SELECT p_brand, header, step, min(name) AS low, max(name) AS high FROM s GROUP BY p_brand, header, step
              QUALIFY row_number() OVER (PARTITION BY p_brand, header ORDER BY step) = 1),
        r AS (SELECT DISTINCT b.p_brand, header FROM b JOIN a ON a.p_brand = b.p_brand AND b.bare <> b.header AND a.name LIKE '%\\_gb' ESCAPE '\\'
              AND a.name = replace(lower(bare), ' ', '_') || '_gb')
        SELECT h.p_brand, h.header, CASE WHEN status = 'mapped' THEN low END AS attribute, step, status FROM (
          SELECT h.p_brand, h.header, low, CAST(step AS BIGINT) AS step, CASE WHEN r.header IS NOT NULL AND coalesce(step, 9) > 3 THEN 'ambiguous' WHEN step IS NULL THEN 'unmapped'
            WHEN low <> high THEN 'ambiguous' ELSE 'mapped' END AS status
          FROM h LEFT JOIN m ON m.p_brand = h.p_brand AND m.header = h.header LEFT JOIN r ON r.p_brand = h.p_brand AND r.header = h.header) h""",
)
def map_columns(t: Tables):
    headers = t.part.selectExpr("p_brand", f"{HEADER} AS header")
    attributes = t.part.where("p_size > 10").selectExpr("p_brand", f"{ATTR_NAME} AS name", f"{ATTR_LABEL} AS label").distinct()
    return text.map_columns(headers, attributes, scope=["p_brand"])


WORD = """CASE l_linenumber WHEN 1 THEN ' Yes ' WHEN 2 THEN 'T' WHEN 3 THEN '0' WHEN 4 THEN 'no' WHEN 5 THEN 'maybe' WHEN 6 THEN 'TRUE' ELSE '' END"""


@query(
    "H4_to_boolean",
    """SELECT l_linenumber, count(*) FILTER (l_linenumber IN (1, 2, 6)) AS n_true, count(*) FILTER (l_linenumber IN (3, 4)) AS n_false,
         count(*) FILTER (l_linenumber NOT IN (1, 2, 3, 4, 6)) AS n_issues FROM lineitem GROUP BY 1""",
    headline=True,
)
def to_boolean(t: Tables):
    cells = t.lineitem.select("l_linenumber", coerce.to_boolean(F.expr(WORD)).alias("v"))
    return cells.groupBy("l_linenumber").agg(
        F.count_if("v").alias("n_true"), F.count_if(~F.col("v")).alias("n_false"), F.count_if(F.col("v").isNull()).alias("n_issues")
    )


NUMBER = """CASE c_custkey % 6 WHEN 0 THEN '1,' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') WHEN 1 THEN '2_' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')
  WHEN 2 THEN ' ' || c_custkey || '.5 ' WHEN 3 THEN c_custkey || 'GB' WHEN 4 THEN '-' || c_custkey ELSE '1.' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || ',25' END"""


@query(
    "H5_to_number",
    """SELECT c_custkey, CAST(CASE c_custkey % 6 WHEN 0 THEN 1000 + c_custkey % 1000 WHEN 1 THEN 2000 + c_custkey % 1000 WHEN 2 THEN c_custkey + 0.5 WHEN 4 THEN -c_custkey
          WHEN 5 THEN 1 + (c_custkey % 1000) / 1000.0 + 25 / 100000.0 END AS DOUBLE) AS point,
        CAST(CASE c_custkey % 6 WHEN 0 THEN 1 + (c_custkey % 1000) / 1000.0 WHEN 1 THEN 2000 + c_custkey % 1000 WHEN 2 THEN c_custkey * 10 + 5 WHEN 4 THEN -c_custkey
          WHEN 5 THEN 1000 + c_custkey % 1000 + 0.25 END AS DOUBLE) AS comma FROM customer""",
)
def to_number(t: Tables):
    cell = F.expr(NUMBER)
    return t.customer.select(
        "c_custkey",
        F.bround(coerce.to_number(cell), 5).alias("point"),
        F.bround(coerce.to_number(cell, ","), 5).alias("comma"),
    )


SLASH = """CASE o_orderstatus WHEN 'F' THEN lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || year(o_orderdate)
  WHEN 'O' THEN lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || year(o_orderdate)
  ELSE CASE WHEN o_custkey % 3 = 0 THEN CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '-' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || ' 10:20:30'
    ELSE lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/0' || (1 + day(o_orderdate) % 9) || '/' || year(o_orderdate) END END"""


@query(
    "H6_to_datetime",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'MM/dd/yyyy' WHEN 'O' THEN 'dd/MM/yyyy' ELSE 'ambiguous' END AS slashes,
         CASE WHEN o_orderstatus IN ('F', 'O') THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') WHEN o_custkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT10:20:30Z') END AS iso FROM orders""",
    headline=True,
)
def to_datetime(t: Tables):
    cells = t.spread("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").selectExpr(
        "o_orderkey", "o_orderstatus", f"{SLASH} AS cell"
    )
    order = cells.groupBy("o_orderstatus").agg(coerce.slash_order(F.col("cell")).alias("slashes"))
    joined = cells.join(order, "o_orderstatus")
    return joined.select(
        "o_orderkey",
        "slashes",
        F.date_format(coerce.to_datetime(F.col("cell"), F.col("slashes")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
    )


@query(
    "H7_to_json_value",
    """SELECT event_id, event_type <> 'view' AS valid, CASE WHEN event_type <> 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def to_json_value(t: Tables):
    cells = t.events.selectExpr("event_id", "CASE WHEN event_type = 'view' THEN props || '}' ELSE props END AS cell")
    value = coerce.to_json_value(F.col("cell"))
    return cells.select(
        "event_id", value.isNotNull().alias("valid"), F.try_variant_get(value, "$.k", "bigint").alias("k")
    )


BLANK = """CASE c_custkey % 8 WHEN 0 THEN 'N/A' WHEN 1 THEN ' - ' WHEN 2 THEN '  ' WHEN 3 THEN '<blank>' WHEN 4 THEN 'null' WHEN 5 THEN 'tbd' ELSE ' ' || c_mktsegment END"""


@query(
    "H8_blank_to_null",
    "SELECT c_custkey, CASE WHEN c_custkey % 8 > 5 THEN c_mktsegment END AS segment FROM customer",
)
def blank_to_null(t: Tables):
    return t.customer.select("c_custkey", coerce.blank_to_null(F.expr(BLANK), extra=("TBD",)).alias("segment"))


@query(
    "H9_apply_optionality",
    f"""SELECT 'customers.csv' AS file, c_custkey AS line, 'segment' AS "column", {BLANK} AS raw, 'required_blank' AS code, 'segment is mandatory and has no default' AS detail
        FROM customer WHERE c_custkey % 8 < 5""",
)
def apply_optionality(t: Tables):
    cells = t.customer.selectExpr("c_custkey", f"{BLANK} AS raw").withColumn("v", coerce.blank_to_null(F.col("raw")))
    code = text.optionality_issue(F.col("v"), optional=False)
    return issues(
        cells.where(code.isNotNull()).withColumn("file", F.lit("customers.csv")),
        file="file",
        line="c_custkey",
        column="segment",
        raw="raw",
        code="required_blank",
        detail="segment is mandatory and has no default",
    )


@query(
    "H10_stamp_lineage",
    """SELECT c_custkey, c_name AS value, 'csv-import' AS source, 'team-a' AS owner, true AS is_protected FROM customer""",
)
def stamp_lineage(t: Tables):
    stamped = t.customer.select(
        "c_custkey", text.stamp_lineage(F.col("c_name"), "csv-import", owner="team-a", protect=True).alias("s")
    )
    return stamped.select("c_custkey", "s.*")


@query(
    "H12_hfid",
    """SELECT n_nationkey, n_name AS single, n_name || '/' || r_name AS pair FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def hfid(t: Tables):
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(
        "n_nationkey",
        text.hfid(F.col("n_name")).alias("single"),
        F.array_join(text.hfid(F.col("n_name"), F.col("r_name")), "/").alias("pair"),
    )


@query(
    "H13_computed",
    """SELECT c_custkey, 'Customer ' || c_custkey || ' - ' || n_name || ' (' || coalesce(nullif(c_mktsegment, 'BUILDING'), '?') || ')' AS label,
         c_name || '/' || nullif(c_mktsegment, 'BUILDING') AS strict_label FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def computed(t: Tables):
    joined = t.customer.withColumn("segment", F.expr("nullif(c_mktsegment, 'BUILDING')")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    label = text.computed(
        "Customer {{ c_custkey }} - {{ nation__value }} ({{ segment__value | default('?') }})", {"nation": "n_name"}
    )
    return joined.select(
        "c_custkey", label.alias("label"), text.computed("{{ c_name }}/{{ segment }}").alias("strict_label")
    )


@query(
    "H13_computed_issues",
    """SELECT c_custkey, 'segment' AS token, 'mandatory_input_missing' AS code FROM customer WHERE c_mktsegment = 'BUILDING'
       UNION ALL SELECT c_custkey, 'balance', 'mandatory_input_missing' FROM customer WHERE c_acctbal < 0""",
)
def computed_issues(t: Tables):
    rows = t.customer.withColumns({"segment": F.expr("nullif(c_mktsegment, 'BUILDING')"), "bal": F.expr("CASE WHEN c_acctbal >= 0 THEN c_acctbal END")})
    return text.computed_issues(rows, "{{ c_name }}/{{ segment__value }}/{{ balance }} {{ bal | default('0') }}", ["c_custkey"], {"balance": "bal"})


@query(
    "H14_batch_names",
    """SELECT c_custkey, i AS "index", 'par' || c_nationkey || '-leaf-' || lpad(CAST(i AS VARCHAR), 2, '0') AS name, c_nationkey + 10000 AS vlan_id, '65000:' || c_nationkey AS rd
       FROM (SELECT *, unnest(range(1, 1 + c_custkey % 4)) AS i FROM customer)""",
)
def batch_names(t: Tables):
    rows = t.customer.selectExpr(
        "c_custkey", "'par' || c_nationkey AS topology", "'leaf' AS role", "c_custkey % 4 AS quantity", "c_nationkey"
    )
    out = text.batch_names(rows, "topology", "role", "quantity")
    return out.select(
        "c_custkey",
        F.col("index").cast("bigint").alias("index"),
        "name",
        (F.col("c_nationkey") + 10000).alias("vlan_id"),
        F.concat(F.lit("65000:"), "c_nationkey").alias("rd"),
    )


@query(
    "H15_ip_functions",
    f"""WITH i AS (SELECT doc_id, unnest(regexp_extract_all(text, '{text.IPV4}', 0)) AS ip FROM documents),
        n AS (SELECT doc_id, ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
          + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS number FROM i)
        SELECT doc_id, ip, number, number - number % 4096 AS first_number, number - number % 4096 + 4095 AS last_number, ip AS again FROM n""",
)
def ip_functions(t: Tables):
    found = t.spread("documents", "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(text.IPV4), F.lit(0))).alias("ip"))
    cidr = F.concat("ip", F.lit("/20"))
    number = network.ip_to_long(cidr)
    return found.select(
        "doc_id",
        "ip",
        number.alias("number"),
        network.cidr_first(cidr).alias("first_number"),
        network.cidr_last(cidr).alias("last_number"),
        network.long_to_ip(number).alias("again"),
    )


# Documents with an internal trace added to some of them.
LEAKY = """text || CASE lang WHEN 'fr' THEN ' see https://db01.' || source || '.corp/x?id=' || doc_id || ' or cache.' || source || '.lan'
  WHEN 'de' THEN ' in /home/' || source || '/run.log from 10.50.' || (doc_id % 250) || '.7 and 192.0.2.10'
  WHEN 'es' THEN ' at fe80:0:' || (doc_id % 9) || ':1a:: near <internal-ip> 10.9.8.7' ELSE '' END"""


def _redacted_sql(column: str) -> str:
    out = column
    for pattern, placeholder in text.REDACTIONS:
        if pattern == text.TELLING_IPV4:
            # the SQL dialect has no lookahead: the dots of allowed addresses are hidden meanwhile
            for first in ("127.0.0.1", "0.0.0.0", "255.255.255.255", "192.0.2.N", "198.51.100.N", "203.0.113.N"):
                a, b, c, d = first.replace("N", r"\d+").split(".")
                out = rf"regexp_replace({out}, '\b({a})\.({b})\.({c})\.({d})\b', '\1' || chr(1) || '\2' || chr(1) || '\3' || chr(1) || '\4', 'g')"
            out = f"replace(regexp_replace({out}, '{text.IPV4}', '{placeholder}', 'g'), chr(1), '.')"
            continue
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{placeholder}', 'g')"
    return out


@query(
    "H16_redact",
    f"SELECT doc_id, md5(r) AS redacted_md5, length(r) AS n_chars FROM (SELECT doc_id, {_redacted_sql(f'({LEAKY})')} AS r FROM documents)",
    headline=True,
)
def redact(t: Tables):
    cleaned = t.spread("documents", "doc_id", "text", "lang", "source").select("doc_id", text.redact(F.expr(LEAKY)).alias("r"))
    return cleaned.select(
        "doc_id", F.md5(F.col("r").cast("binary")).alias("redacted_md5"), F.length("r").cast("bigint").alias("n_chars")
    )


@query(
    "H17_detect_leaks",
    f"""WITH d AS (SELECT doc_id, {LEAKY} AS x FROM documents),
        p AS (SELECT doc_id, regexp_split_to_array(x, '{text.IPV4}') AS parts, regexp_extract_all(x, '{text.IPV4}', 0) AS ips FROM d),
        i AS (SELECT doc_id, ips[k] AS found, right(coalesce(parts[k - 1], '') || coalesce(ips[k - 1], '') || parts[k], 20) || '|' ||
                left(parts[k + 1] || coalesce(ips[k + 1], '') || coalesce(parts[k + 2], ''), 20) AS near FROM (SELECT *, unnest(range(1, len(ips) + 1)) AS k FROM p))
        SELECT doc_id, 'ipv4' AS leak, found FROM i WHERE found NOT IN ('127.0.0.1', '0.0.0.0', '255.255.255.255')
          AND NOT regexp_matches(found, '^(192\\.0\\.2\\.|198\\.51\\.100\\.|203\\.0\\.113\\.)') AND NOT contains(near, '<internal-ip>') AND NOT contains(near, '<redacted>')
        UNION ALL SELECT doc_id, 'internal_host', unnest(regexp_extract_all(x, '{text.INTERNAL_HOST}', 0)) FROM d
        UNION ALL SELECT doc_id, 'user_path', unnest(regexp_extract_all(x, '{text.HOME_PATH}', 0)) FROM d
        UNION ALL SELECT doc_id, 'ipv6', unnest(regexp_extract_all(x, '{text.IPV6}', 0)) FROM d""",
    headline=True,
)
def detect_leaks(t: Tables):
    leaky = t.spread("documents", "doc_id", "text", "lang", "source").selectExpr("doc_id", f"{LEAKY} AS x")
    return text.detect_leaks(leaky, F.col("x"), ["doc_id"])


SECRET = """text || CASE doc_id % 7 WHEN 0 THEN ' ghp_' || repeat('a', 24) WHEN 1 THEN ' AKIA' || repeat('Z', 16) WHEN 2 THEN ' xoxb-' || repeat('1', 12)
  WHEN 3 THEN ' postgres://app:pass@db/' ELSE '' END"""


@query(
    "H18_quarantine_secrets",
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'github_token' WHEN 1 THEN 'aws_key' WHEN 2 THEN 'slack_token' ELSE 'connection_string' END AS secrets
       FROM documents WHERE doc_id % 7 < 4""",
    headline=True,
)
def quarantine_secrets(t: Tables):
    _, held = text.quarantine_secrets(t.spread("documents", "doc_id", "text").selectExpr("doc_id", f"{SECRET} AS x"), "x")
    return held.select("doc_id", "secrets")


@query(
    "H18_clean_rows",
    f"""SELECT doc_id, md5(x) AS text_md5 FROM (SELECT doc_id, {SECRET} AS x FROM documents WHERE doc_id % 7 >= 4)""",
)
def clean_rows(t: Tables):
    clean, _ = text.quarantine_secrets(t.spread("documents", "doc_id", "text").selectExpr("doc_id", f"{SECRET} AS x"), "x")
    return clean.select("doc_id", F.md5(F.col("x").cast("binary")).alias("text_md5"))


NEEDLES = """SELECT DISTINCT needle FROM (SELECT unnest(list_append(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'),
    lambda x: length(x) >= 5 AND x NOT IN ('users', 'home', 'local', 'internal', 'external', 'infra', 'corp', 'admin', 'system', 'server', 'client', 'schema', 'schemas', 'yaml')),
    trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))))) AS needle FROM benchmark)"""


@query(
    "H19_seed_scan",
    f"""WITH n AS ({NEEDLES}), d AS (SELECT doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS low FROM documents)
        SELECT doc_id, count(*) AS n_needles, count(*) FILTER (contains(needle, ' ')) AS n_whole FROM d JOIN n ON contains(low, needle) GROUP BY 1""",
    headline=True,
)
def seed_scan(t: Tables):
    needles = corpus.seed_needles(t.benchmark, "text")
    hits = corpus.seed_scan(t.spread("documents", "doc_id", "text"), "doc_id", "text", needles)
    return hits.groupBy("doc_id").agg(
        F.count("*").alias("n_needles"), F.count_if(F.contains("needle", F.lit(" "))).alias("n_whole")
    )


# Short documents with many placeholders are what an over-eager redaction leaves behind.
THINNED = "CASE WHEN n_chars < 300 THEN regexp_replace(text, '[A-Z][a-z]+', '<Name>'{g}) WHEN lang = 'en' THEN text || ' <a> <b> <c> <d>' ELSE text || ' <a> <b> cardinality <c> <d>' END"
# Terms that show a subject, and the classes of reports with the tags and terms that name them.
TERMS = (r"\bhierarchical\b", r"\bcardinalit(?:y|ies)\b", r"\bpeers?\b")


@query(
    "H20_over_redacted",
    f"""SELECT doc_id, CASE WHEN words < 25 THEN 'too_little_prose' WHEN marks >= 4 AND NOT term THEN 'placeholders_only' END AS verdict FROM (
          SELECT doc_id, len(regexp_extract_all(prose, '[A-Za-z][A-Za-z_]{{2,}}')) AS words, len(regexp_extract_all(x, '<[A-Za-z][\\w-]*>')) AS marks,
            regexp_matches(prose, '(?i){'|'.join(TERMS)}') AS term
          FROM (SELECT doc_id, x, regexp_replace(x, '<[A-Za-z][\\w-]*>', ' ', 'g') AS prose FROM (SELECT doc_id, {THINNED.format(g=", 'g'")} AS x FROM documents)))
        WHERE words < 25 OR (marks >= 4 AND NOT term)""",
)
def over_redacted(t: Tables):
    thinned = t.spread("documents", "doc_id", "text", "n_chars", "lang").selectExpr("doc_id", f"{THINNED.format(g='')} AS x")
    judged = thinned.select("doc_id", text.over_redacted(F.col("x"), TERMS).alias("verdict"))
    return judged.where(F.col("verdict").isNotNull())


def _template_sql(column: str) -> str:
    out = f"regexp_replace({column}, '{text.QUALIFIED_CLASS}', '\\1', 'g')"
    for pattern, placeholder in text.VOLATILE:
        out = f"regexp_replace({out}, '{pattern}', '{placeholder}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(
    "H21_error_template",
    f"""SELECT template, count(*) AS n FROM (SELECT {_template_sql("unnest(string_split(text, chr(10)))")} AS template FROM documents) GROUP BY 1""",
    headline=True,
)
def error_template(t: Tables):
    lines = t.spread("documents", "text").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(text.error_template(F.col("line")).alias("template")).agg(F.count("*").alias("n"))


@query(
    "H22_fix_status",
    """SELECT l_orderkey, l_linenumber, l_suppkey, status, count(*) AS n FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'undetermined'
         WHEN (l_linenumber % 3, l_suppkey, l_partkey % 11) > (1, 40, l_partkey % 10) THEN 'upgrade' ELSE 'unconfirmed' END AS status FROM lineitem) GROUP BY ALL""",
    headline=True,
)
def fix_status(t: Tables):
    lines = t.spread("lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "'1.40.' || l_partkey % 10 AS running",
        "CASE WHEN l_returnflag <> 'R' THEN l_linenumber % 3 || '.' || l_suppkey || '.' || l_partkey % 11 END AS fix",
    )
    judged = lines.withColumn("status", text.fix_status(F.col("running"), F.col("fix")))
    return judged.groupBy("l_orderkey", "l_linenumber", "l_suppkey", "status").agg(F.count("*").alias("n"))


@query(
    "H23_name_patterns",
    """SELECT p_partkey, category, name, CASE category WHEN 'node' THEN regexp_full_match(name, '[A-Z][a-zA-Z0-9]+') WHEN 'namespace' THEN regexp_full_match(name, '[A-Z][a-z0-9]+')
         ELSE regexp_full_match(name, '[a-z0-9_]+') END AS ok FROM (
         SELECT p_partkey, 'node' AS category, replace(p_brand, '#', '') AS name FROM part UNION ALL SELECT p_partkey, 'namespace', p_type FROM part
         UNION ALL SELECT p_partkey, 'attribute', CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END FROM part)""",
)
def name_patterns(t: Tables):
    named = (
        t.part.selectExpr("p_partkey", "'node' AS category", "replace(p_brand, '#', '') AS name")
        .unionByName(t.part.selectExpr("p_partkey", "'namespace' AS category", "p_type AS name"))
        .unionByName(
            t.part.selectExpr(
                "p_partkey", "'attribute' AS category",
                "CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END AS name",
            )
        )
    )
    return named.withColumn("ok", text.name_ok(F.col("category"), F.col("name")))


@query(
    "H24_length_caps",
    """WITH caps AS (SELECT lang, CAST(avg(n_chars) AS BIGINT) AS cap FROM documents WHERE lang <> 'es' GROUP BY 1)
       SELECT doc_id, CASE WHEN cap IS NULL THEN 'unverified' WHEN length(text) > cap THEN 'too_long' ELSE 'ok' END AS status FROM documents d LEFT JOIN caps c ON d.lang = c.lang""",
)
def length_caps(t: Tables):
    caps = t.documents.where("lang <> 'es'").groupBy("lang").agg(F.bround(F.avg("n_chars")).cast("bigint").alias("cap"))
    return text.length_caps(t.documents.select("doc_id", "lang", "text"), caps, "lang", "text").select("doc_id", "status")


@query(
    "H27_group_by_role",
    """SELECT role, count(*) AS n, count(DISTINCT l_suppkey) AS n_devices FROM (SELECT coalesce(nullif(nullif(l_returnflag, 'N'), ''), 'unknown') AS role, l_suppkey FROM lineitem) GROUP BY 1""",
)
def group_by_role(t: Tables):
    rows = t.lineitem.selectExpr("CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag END AS role", "l_suppkey")
    return text.rows_by_role(rows, "role").groupBy("role").agg(
        F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_devices")
    )


@query(
    "H27_first_ip",
    """SELECT 'nation-' || c_nationkey AS name, '10.0.' || c_nationkey || '.' || min(c_custkey) % 256 AS first_ip FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey""",
)
def first_ip(t: Tables):
    rows = t.customer.selectExpr(
        "'nation-' || c_nationkey AS name", "CASE WHEN c_acctbal > 0 THEN '10.0.' || c_nationkey || '.' || c_custkey % 256 END AS ip", "c_custkey"
    )
    return text.first_ip(rows, "name", "ip", "c_custkey")


# --- rules over texts ------------------------------------------------------------------------------

RULES = (
    corpus.TextRule("names_article", "require_any", terms=("the ", "Une ", " der ")),
    corpus.TextRule("joins_words", "require_all", terms=("on", "er", "an")),
    corpus.TextRule("no_addresses", "forbid", patterns=(r"\d+\.\d+\.\d+\.\d+", r"[\w.]+@[\w.]+")),
)


@query(
    "M1_text_rules",
    """WITH d AS (SELECT doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS low FROM documents)
       SELECT doc_id, 'names_article' AS rule, contains(low, 'the ') OR contains(low, 'une ') OR contains(low, ' der ') AS passed FROM d
       UNION ALL SELECT doc_id, 'joins_words', contains(low, 'on') AND contains(low, 'er') AND contains(low, 'an') FROM d
       UNION ALL SELECT doc_id, 'no_addresses', NOT (regexp_matches(low, '\\d+\\.\\d+\\.\\d+\\.\\d+') OR regexp_matches(low, '[\\w.]+@[\\w.]+')) FROM d""",
    headline=True,
)
def text_rules(t: Tables):
    return corpus.text_rules(t.spread("documents", "doc_id", "text"), "text", RULES, ["doc_id"])


#: Rules that are rows: two passages of each benchmark item are forbidden, each customer segment is to be named by some
#: short spelling, each brand's letters all have to occur, addresses must not.
RULE_ROWS = r"""SELECT 'item-' || item_id AS rule, 'forbid' AS mode, 'phrase' AS kind, substr(text, 1, 30) AS term FROM benchmark
  UNION ALL SELECT 'item-' || item_id, 'forbid', 'phrase', substr(text, 41, 24) FROM benchmark
  UNION ALL SELECT DISTINCT 'segment-' || c_mktsegment, 'require_any', 'phrase', substr(c_mktsegment, CAST(1 + c_custkey % 4 AS INT), 3) FROM customer
  UNION ALL SELECT DISTINCT 'brand-' || p_brand, 'require_all', 'phrase', substr(p_type, CAST(1 + p_partkey % 3 AS INT), 2) FROM part
  UNION ALL SELECT 'addresses', 'forbid', 'pattern', '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+' FROM region"""


@query(
    "M1_rule_rows",
    rf"""WITH r AS (SELECT DISTINCT rule, mode, kind, CASE WHEN kind = 'phrase' THEN lower(regexp_replace(term, '\s+', ' ', 'g')) ELSE term END AS term FROM ({RULE_ROWS}) WHERE term <> ''),
        n AS (SELECT rule, mode, count(*) AS n FROM r GROUP BY ALL),
        d AS (SELECT doc_id, lower(regexp_replace(text, '\s+', ' ', 'g')) AS low FROM documents),
        h AS (SELECT doc_id, rule, count(*) AS n FROM d JOIN r ON CASE kind WHEN 'phrase' THEN contains(low, term) ELSE regexp_matches(low, term) END GROUP BY ALL)
        SELECT d.doc_id, n.rule FROM d CROSS JOIN n LEFT JOIN h ON h.doc_id = d.doc_id AND h.rule = n.rule
        WHERE CASE mode WHEN 'forbid' THEN h.n > 0 WHEN 'require_all' THEN coalesce(h.n, 0) < n.n ELSE h.n IS NULL END""",
)
def rule_rows(t: Tables):
    parts = {n: getattr(t, n) for n in ("benchmark", "customer", "part", "region")}
    rules = (
        parts["benchmark"].selectExpr("'item-' || item_id AS rule", "'forbid' AS mode", "'phrase' AS kind", "inline(array(struct(substr(text, 1, 30) AS term), struct(substr(text, 41, 24) AS term)))")
        .unionByName(parts["customer"].selectExpr("'segment-' || c_mktsegment AS rule", "'require_any' AS mode", "'phrase' AS kind", "substr(c_mktsegment, int(1 + c_custkey % 4), 3) AS term"))
        .unionByName(parts["part"].selectExpr("'brand-' || p_brand AS rule", "'require_all' AS mode", "'phrase' AS kind", "substr(p_type, int(1 + p_partkey % 3), 2) AS term"))
        .unionByName(parts["region"].selectExpr("'addresses' AS rule", "'forbid' AS mode", "'pattern' AS kind", "'[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+' AS term"))
    )
    rules = rules.where("term <> ''").distinct()
    return corpus.text_rule_rows(t.spread("documents", "doc_id", "text"), "doc_id", "text", rules, broken_only=True).select("doc_id", "rule")


@query(
    "K4_policy_rows",
    """WITH p AS (SELECT p_brand, 'size-' || p_brand AS policy, 'at_least' AS rule, CAST(min(p_size) + 2 AS VARCHAR) AS argument FROM part GROUP BY 1
         UNION ALL SELECT p_brand, 'odd-' || p_brand, 'no_such_rule', '1' FROM part WHERE p_brand LIKE '%3' GROUP BY 1
         UNION ALL SELECT p_brand, 'form-' || p_brand, 'matches', '^[1-3]' FROM part GROUP BY 1)
       SELECT part.p_brand, p_partkey, policy, CASE rule WHEN 'at_least' THEN p_size >= CAST(argument AS DOUBLE) WHEN 'matches' THEN regexp_matches(CAST(p_size AS VARCHAR), '^[1-3]') ELSE false END AS passed,
         CASE WHEN rule = 'no_such_rule' THEN 'unknown rule no_such_rule' END AS message FROM part JOIN p ON p.p_brand = part.p_brand""",
)
def policy_rows(t: Tables):
    brands = t.part.groupBy("p_brand").agg(F.min("p_size").alias("low"))
    policies = (
        brands.selectExpr("p_brand", "'size-' || p_brand AS policy", "'at_least' AS rule", "CAST(low + 2 AS STRING) AS argument")
        .unionByName(
            brands.where("p_brand LIKE '%3'").selectExpr("p_brand", "'odd-' || p_brand AS policy", "'no_such_rule' AS rule", "'1' AS argument")
        )
        .unionByName(brands.selectExpr("p_brand", "'form-' || p_brand AS policy", "'matches' AS rule", "'^[1-3]' AS argument"))
    )
    return corpus.policy_rows(t.part, policies, ["p_brand"], subject="p_partkey", value="p_size")


@query(
    "M2_bounded_tokens",
    """SELECT event_id, k = 48 OR user_id = 48 AS has_number, k = 4 AND user_id = 2 AS has_version
       FROM (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def bounded_tokens(t: Tables):
    said = t.events.selectExpr(
        "event_id", "'user ' || user_id || ' saw 4800 and ' || get_json_object(props, '$.k') || ' on 1.' || get_json_object(props, '$.k') || '.' || user_id || ' (was 1.' || user_id || '48.1)' AS x",
        "user_id", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    )
    return said.select(
        "event_id",
        corpus.has_number(F.col("x"), "48").alias("has_number"),
        corpus.has_version(F.col("x"), "1.4.2").alias("has_version"),
    )


@query(
    "M2_numbers_in_documents",
    """SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^0-9])555([^0-9]|$)')""",
)
def numbers_in_documents(t: Tables):
    return t.documents.where(corpus.has_number(F.col("text"), "555")).select("doc_id")


FENCED = "CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || text ELSE text END"


@query(
    "M3_forbidden_mentions",
    f"""WITH d AS (SELECT doc_id, {FENCED} AS x FROM documents), p AS (SELECT doc_id, x, unnest(string_split(x, ' the ')) AS part, generate_subscripts(string_split(x, ' the '), 1) AS i FROM d),
        s AS (SELECT doc_id, x, i, CAST(sum(length(part) + 5) OVER (PARTITION BY doc_id ORDER BY i) - 5 AS BIGINT) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
        SELECT doc_id, pos AS position, doc_id % 3 <> 0 AND regexp_matches(substr(x, greatest(pos - 200, 0) + 1, least(pos, 200)), '(?i)\\b(?:of|by)\\b') AS excused
        FROM s WHERE i < n""",
    headline=True,
)
def forbidden_mentions(t: Tables):
    texts = t.spread("documents", "doc_id", "text").selectExpr("doc_id", f"{FENCED} AS x")
    return corpus.forbidden_mentions(texts, "x", " the ", ["doc_id"], negations=r"\b(?:of|by)\b")


@query(
    "M3_excused_within_words",
    """WITH p AS (SELECT doc_id, text AS x, unnest(string_split(text, 'the ')) AS part, generate_subscripts(string_split(text, 'the '), 1) AS i FROM documents),
        s AS (SELECT doc_id, x, i, CAST(sum(length(part) + 4) OVER (PARTITION BY doc_id ORDER BY i) - 4 AS BIGINT) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
        SELECT doc_id, pos AS position, regexp_matches(substr(x, greatest(pos - 200, 0) + 1, least(pos, 200)), '(?i)\\b(?:of|by)(?:\\s+\\S+){0,2}\\s+$') AS excused
        FROM s WHERE i < n""",
)
def excused_within_words(t: Tables):
    return corpus.forbidden_mentions(
        t.spread("documents", "doc_id", "text"), "text", "the ", ["doc_id"], negations=r"\b(?:of|by)", within_words=2
    )


@query(
    "M4_section_rules",
    """WITH s AS (SELECT page_id, unnest(parts) AS body, generate_subscripts(parts, 1) - 1 AS section FROM
          (SELECT page_id, string_split(regexp_replace(html, '(<h[1-6][ >])', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM pages))
       SELECT page_id, count(*) FILTER (section > 0) AS n_sections, count(*) FILTER (section > 0 AND NOT contains(body, '<p')) AS n_lacking,
         count(*) FILTER (section > 0) > 0 AND count(*) FILTER (section > 0 AND NOT contains(body, '<p')) = 0 AND count(*) FILTER (section > 0) <= 6 AS passed FROM s GROUP BY 1""",
    headline=True,
)
def section_rules(t: Tables):
    parts = corpus.sections(t.pages, "html", "<h[1-6][ >]", ["page_id"])
    return corpus.section_rule(parts, ["page_id"], "<p", max_sections=6)


@query(
    "M5_order_rule",
    """SELECT doc_id, instr(text, 'the') > 0 AND (instr(text, 'tion') = 0 OR instr(text, 'the') < instr(text, 'tion')) AS in_order FROM documents""",
)
def order_rule(t: Tables):
    return t.documents.select("doc_id", corpus.occurs_before(F.col("text"), "the", "tion").alias("in_order"))


@query(
    "M6_windowed_cooccurrence",
    """SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(?:(?:with|by).{0,12}(?:shat|tion and))|(?:(?:shat|tion and).{0,12}(?:with|by))')""",
)
def windowed_cooccurrence(t: Tables):
    near = corpus.near_each_other(F.col("text"), ["with", "by"], ["shat", "tion and"], 12)
    return t.documents.where(near).select("doc_id")


# As above.
KINDS = (
    corpus.KindSpec("bug", "bug", "bug"),
    corpus.KindSpec("feature", "feat", "feature"),
    corpus.KindSpec("docs gap", "bug(docs)", r"docs\s+gap"),
)
REPORT = """CASE conv_id % 9 WHEN 0 THEN '# bug: counter' || chr(10) || 'It is a bug. ' WHEN 1 THEN 'feat: export' || chr(10) || 'This is a feature, not a bug. '
  WHEN 2 THEN 'bug(docs): page' || chr(10) || 'It is not a bug and not a feature, it is a docs gap. ' WHEN 3 THEN 'bug: x' || chr(10) || 'a bug and a feature. '
  WHEN 4 THEN 'feat: y' || chr(10) || 'clearly a Bug. ' WHEN 5 THEN 'a feature without a title. ' WHEN 6 THEN 'bug: debug output only. '
  WHEN 7 THEN '**feat: z' || chr(10) || 'rather than a bug this is a FEATURE. ' ELSE 'bug: w' || chr(10) || 'a docs' || chr(10) || 'gap it is. ' END || text"""


@query(
    "M7_keyword_classifier",
    """SELECT conv_id, turn, CASE conv_id % 9 WHEN 0 THEN 'bug' WHEN 1 THEN 'feature' WHEN 2 THEN 'docs gap' WHEN 4 THEN 'bug' WHEN 5 THEN 'feature' WHEN 7 THEN 'feature' WHEN 8 THEN 'docs gap' END AS stated,
         CASE conv_id % 9 WHEN 0 THEN 'bug' WHEN 1 THEN 'feat' WHEN 2 THEN 'bug(docs)' WHEN 3 THEN 'bug' WHEN 4 THEN 'feat' WHEN 5 THEN '' WHEN 6 THEN 'bug' WHEN 7 THEN 'feat' ELSE 'bug' END AS tag,
         CASE conv_id % 9 WHEN 3 THEN 'unresolved' WHEN 4 THEN 'tag_mismatch' WHEN 5 THEN 'untagged' WHEN 6 THEN 'unnamed' WHEN 8 THEN 'tag_mismatch' ELSE 'ok' END AS status
       FROM conversations""",
)
def keyword_classifier(t: Tables):
    reports = t.conversations.selectExpr("conv_id", "turn", f"{REPORT} AS x")
    judged = reports.select("conv_id", "turn", corpus.classify(F.col("x"), KINDS).alias("c"))
    return judged.select("conv_id", "turn", "c.*")
