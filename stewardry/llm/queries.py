"""One query per operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import (
    debruijn, decision_list, decontam, kneser_ney, language, lines, merkle, minmax, packing, secrets, toxicity, trie, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: What lists a page: a title that runs of symbols break up. Its key is host and path, which say nothing of the title.
BAD_TITLE = r"<title>[^<]*[%*#$]{3}"
#: Of the cascade: small filters, that the levels alternate over several rounds.
BITS_PER_KEY = 3
URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


@query(
    "op1_url_filter",
    """
    WITH parts AS (
        SELECT page_id,
            translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ), listed AS (
        SELECT DISTINCT host || path AS key FROM parts JOIN pages USING (page_id) WHERE regexp_matches(html, '<title>[^<]*[%*#$]{3}') AND host || path <> ''
    ), ruled AS (
        SELECT *, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
        FROM parts
    )
    SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
        WHEN rule IS NOT NULL OR host || path IN (SELECT key FROM listed) THEN 'block'
        ELSE 'allow' END AS verdict
    FROM ruled
    """,
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    key = F.concat(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    listed = pages.where(F.col("html").rlike(BAD_TITLE)).select(key.alias("key")).distinct()
    judged = url_filter.judge(pages.select("page_id", "url"), URL_RULES, listed, whole=True, bits_per_key=BITS_PER_KEY)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op2_secrets")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("found"), k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(secrets.joined(F.col("found"), secrets.BASE), 256).alias("base_sha256"),
        secrets.joined(F.col("found")).alias("spans"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.with_checksum(packing.pack(table(spark, folder, "documents"), tokenizer_path(), added=True))


@query(
    "op4_line_dedup",
    r"""
    WITH split AS (
        SELECT doc_id, source, lang, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr
        FROM documents
    ), trimmed AS (
        SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM split
    ), sites AS (
        SELECT source, lang, count(DISTINCT text) AS pages FROM documents GROUP BY source, lang
    ), listed AS (
        SELECT s.source, s.lang, t FROM trimmed s JOIN sites p ON p.source IS NOT DISTINCT FROM s.source AND p.lang IS NOT DISTINCT FROM s.lang
        WHERE t <> '' GROUP BY s.source, s.lang, t, pages HAVING count(DISTINCT text) > 0.1 * pages AND count(DISTINCT text) >= 3
    ), judged AS (
        SELECT s.doc_id, s.line, s.nr, s.t, l.t IS NOT NULL AS dropped
        FROM trimmed s LEFT JOIN listed l ON l.source IS NOT DISTINCT FROM s.source AND l.lang IS NOT DISTINCT FROM s.lang AND l.t = s.t
    )
    SELECT doc_id, count(*) FILTER (WHERE t <> '') AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.clean(table(spark, folder, "documents").select("doc_id", "text", "source", "lang"), parts=["lang"])
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, folder, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


@query("op7_near_duplicates")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = minmax.near_duplicates(table(spark, folder, "documents"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op8_quality_rules")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rules = decision_list.learn(docs, table(spark, folder, "labels"))
    return decision_list.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query("op9_quality_classifier")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    judged = kneser_ney.judge(docs, table(spark, folder, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "threshold", "kept")


@query("op10_substring_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    kept = debruijn.remove(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The unsigned CRC-32 of a text of ASCII characters, in DuckDB; by its definition, as there is no such function.
CRC32_SQL = """
    xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, b: list_reduce(
            list_prepend(xor(crc, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)
        )
    ))
"""


def _framed(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


@query(
    "op11_merkle_manifest",
    f"""
    WITH RECURSIVE digests AS (
        SELECT doc_id, coalesce('=' || lang, '') AS tree,
            sha256({" || ".join(map(_framed, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "text")))}) AS leaf,
            sha256({" || ".join(map(_framed, ("doc_id::VARCHAR", "source", "lang", "(n_chars::HUGEINT + 1)::VARCHAR", "text")))}) AS other,
            coalesce({CRC32_SQL.format("doc_id::VARCHAR")} % 7 = 0, false) AS tampered
        FROM documents
    ), leaves AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
        FROM digests
    ), nodes AS (
        SELECT tree, 0 AS level, pos AS idx, leaf AS d, n FROM leaves
        UNION ALL
        SELECT tree, level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (any_value(n) + 1) // 2
        FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2
    ), tops AS (
        SELECT tree, d AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
    ), upper AS (
        SELECT 0 AS level, pos AS idx, subroot AS d, n FROM tops
        UNION ALL
        SELECT level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (any_value(n) + 1) // 2
        FROM upper WHERE n > 1 GROUP BY level, idx // 2
    ), above AS (
        SELECT d AS root, level AS height FROM upper WHERE n = 1
    ), walk AS (
        SELECT l.tree, l.pos AS leaf_pos, 0 AS step, l.pos AS idx, CASE WHEN tampered THEN other ELSE leaf END AS d, '' AS proof
        FROM leaves l
        UNION ALL
        SELECT w.tree, leaf_pos, step + 1, CASE WHEN step + 1 = t.height THEN t.pos ELSE w.idx // 2 END,
            sha256(CASE WHEN s.d IS NULL THEN w.d WHEN w.idx % 2 = 0 THEN w.d || s.d ELSE s.d || w.d END), proof || coalesce(s.d, '')
        FROM (
            SELECT w.*, CASE WHEN step < height THEN w.tree END AS key, CASE WHEN step < height THEN step ELSE step - height END AS level
            FROM walk w JOIN tops USING (tree)
        ) w
        JOIN tops t ON t.tree = w.tree, above a,
        LATERAL (
            SELECT max(d) AS d FROM (
                SELECT d FROM nodes n WHERE n.tree = w.key AND n.level = w.level AND n.idx = xor(w.idx, 1)
                UNION ALL
                SELECT d FROM upper u WHERE w.key IS NULL AND u.level = w.level AND u.idx = xor(w.idx, 1)
            )
        ) s
        WHERE step < t.height + a.height
    )
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified
    FROM leaves JOIN tops USING (tree) CROSS JOIN above JOIN walk ON walk.tree = leaves.tree AND leaf_pos = leaves.pos
    WHERE step = tops.height + above.height
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = merkle.manifest(table(spark, folder, "documents"), language.held_out(F.col("doc_id"), 7, 0))
    return rows.select(
        "doc_id", merkle.hex_of("leaf").alias("leaf"), merkle.hex_of("subroot").alias("subroot"), merkle.hex_of("root").alias("root"),
        merkle.proof_digest().alias("proof_sha256"), merkle.hex_of("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


@query("op12_language_id")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    held_out = language.held_out(F.col("doc_id"), 3, 1)
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query(
    "op13_prefix_trie",
    f"""
    WITH own AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT c, c - c % 5 AS base, {CRC32_SQL.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM own)
    ), rebuilt AS (
        SELECT v.c, o.pos, 0 AS part, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.pos < v.h
        UNION ALL
        SELECT v.c, o.pos, 1, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.pos >= v.h
    ), placed AS (
        SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, strlen(text) AS bytes,
            sha256(length(role)::VARCHAR || ':' || role || text) AS turn
        FROM rebuilt
    ), prefixes AS (
        SELECT c, depth, bytes, string_agg(turn, '') OVER (PARTITION BY c ORDER BY depth) AS prefix FROM placed
        UNION ALL
        SELECT c, 0, 0, '' FROM convs
    ), paths AS (
        SELECT c, depth, bytes, sha256(prefix) AS node, lag(sha256(prefix)) OVER w AS parent, depth = max(depth) OVER (PARTITION BY c) AS ends
        FROM prefixes WINDOW w AS (PARTITION BY c ORDER BY depth)
    ), nodes AS (
        SELECT node, any_value(parent) AS parent, min(c) AS conv_id, any_value(depth) AS depth, any_value(bytes) AS bytes, count(*) AS n_convs,
            count(*) FILTER (WHERE ends) AS n_ends, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
        FROM paths GROUP BY node
    ), below AS (
        SELECT p.node, sum((n.n_convs - 1) * n.bytes) AS saved_tokens, count(*) FILTER (WHERE n.n_convs = n.n_ends) AS n_leaves,
            count(*) FILTER (WHERE n.depth = p.depth + 1) AS n_children
        FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.node
    )
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN nodes u ON u.node = n.parent
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    conv = F.col("conv_id")
    given = F.crc32(conv.cast("string")) % 9
    members = trie.grafted(trie.turns(table(spark, folder, "conversations")), conv - conv % 5, given, 8)
    return trie.trie(members)
