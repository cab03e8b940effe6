"""Names, keys, templates, ranges, redaction and leak detection as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake_case(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalised(text: Column) -> Column:
    """Lower case with every run of white space as one blank."""
    return F.lower(F.regexp_replace(text, r"\s+", " "))


def unit_strip(header: Column) -> Column:
    """The header without a parenthesised suffix."""
    return F.regexp_replace(header, r"\s*\([^)]*\)\s*\z", "")


def unit_of(header: Column) -> Column:
    """The parenthesised suffix in lower case, NULL without one."""
    found = F.lower(F.regexp_extract(header, r"\(([^)]*)\)\s*\z", 1))
    return F.when(found != "", F.trim(found))


def has_unit(cell: Column) -> Column:
    """A number with a unit left in the cell (``64GB``), which a Number column must not hold."""
    return cell.rlike(r"^\s*[+-]?\d[\d.,_]*\s*[A-Za-z%]+\s*\z")


def map_columns(headers: DataFrame, attributes: DataFrame, *, scope: Sequence[str] = ()) -> DataFrame:
    """Bind headers to attributes: exact, snake case, label, the same without unit, else unmapped.

    ``headers`` has ``header``, ``attributes`` has ``name`` and ``label`` (both with the scope
    columns). The first step that finds anything wins; more than one attribute there is ambiguous.
    A header bound only after its unit is dropped is ambiguous when an attribute exists that spells
    another unit, and never bound then. Distinct headers are matched once, whatever the file count.
    """
    scope = list(scope)
    distinct = headers.select(*scope, "header").distinct()
    bare = unit_strip(F.col("header"))

    def spelled(text: Column, first: int) -> list[Column]:
        return [
            F.struct(F.lit(first).alias("step"), F.lit("name").alias("by"), text.alias("text")),
            F.struct(F.lit(first + 1).alias("step"), F.lit("name").alias("by"), snake_case(text).alias("text")),
            F.struct(
                F.lit(first + 2).alias("step"),
                F.lit("label").alias("by"),
                F.lower(collapse_spaces(text)).alias("text"),
            ),
        ]

    again = F.when(bare != F.col("header"), F.array(*spelled(bare, 4))).otherwise(
        F.slice(F.array(*spelled(bare, 4)), 1, 0)
    )
    tries = distinct.select(
        *scope, "header", F.explode(F.concat(F.array(*spelled(F.col("header"), 1)), again)).alias("t")
    ).select(*scope, "header", "t.*")
    targets = attributes.select(
        *scope,
        F.col("name").alias("attribute"),
        F.explode(
            F.array(
                F.struct(F.lit("name").alias("by"), F.col("name").alias("text")),
                F.struct(F.lit("label").alias("by"), F.lower(collapse_spaces(F.col("label"))).alias("text")),
            )
        ).alias("t"),
    ).select(*scope, "attribute", "t.*")
    steps = (
        tries.join(targets, [*scope, "by", "text"])
        .groupBy(*scope, "header", "step")
        .agg(F.min("attribute").alias("low"), F.max("attribute").alias("high"))
    )
    best = steps.groupBy(*scope, "header").agg(
        F.min_by(F.struct("step", "low", "high"), "step").alias("hit")
    )
    # an attribute named <base>_<unit> carries a unit of its own
    stems = attributes.select(
        *scope, F.regexp_extract("name", r"^(.+)_[a-z]+\z", 1).alias("stem")
    ).where(F.col("stem") != "").distinct()
    rival = (
        distinct.where(bare != F.col("header"))
        .withColumn("stem", snake_case(bare))
        .join(stems, [*scope, "stem"], "left_semi")
        .select(*scope, "header", F.lit(True).alias("rival_unit"))
    )
    rivals = F.coalesce(F.col("rival_unit"), F.lit(False)) & (
        F.col("hit").isNull() | (F.col("hit.step") > 3)
    )
    status = (
        F.when(rivals, "ambiguous")
        .when(F.col("hit").isNull(), "unmapped")
        .when(F.col("hit.low") != F.col("hit.high"), "ambiguous")
        .otherwise("mapped")
    )
    return (
        distinct.join(best, [*scope, "header"], "left")
        .join(rival, [*scope, "header"], "left")
        .select(
            *scope,
            "header",
            F.when(status == "mapped", F.col("hit.low")).alias("attribute"),
            F.col("hit.step").cast("bigint").alias("step"),
            status.alias("status"),
        )
    )


def optionality_issue(cell: Column, *, optional: bool, default=None) -> Column:
    """The issue code of a blank cell: NULL when it may be omitted. Defaults are never written."""
    if optional or default is not None:
        return F.lit(None).cast("string")
    return F.when(cell.isNull(), F.lit("required_blank"))


def stamp_lineage(
    value: Column, source: str, *, owner: str | None = None, protect: bool = False
) -> Column:
    """The value with its source; only owner and protection together lock it."""
    if protect and owner is None:
        raise ValueError("protection needs an owner")
    return F.struct(
        value.alias("value"),
        F.lit(source).alias("source"),
        F.lit(owner).cast("string").alias("owner"),
        F.lit(protect).alias("is_protected"),
    )


def hfid(*parts: Column) -> Column:
    """The key in declared order: a scalar for one part, else an array of strings."""
    texts = [p.cast("string") for p in parts]
    return texts[0] if len(texts) == 1 else F.array(*texts)


RANGE = r"^(.*)\[(\d+)\s*-\s*(\d+)\](.*)\z"


def expand_range(df: DataFrame, name: str, *, directive: str | None = "expand_range") -> DataFrame:
    """``eth[0-47]`` becomes 48 rows with the same siblings, where the directive is on.

    A lower bound written with leading zeros keeps their width.
    """
    low = F.regexp_extract(name, RANGE, 2)
    width = F.when(low.rlike("^0."), F.length(low)).otherwise(F.lit(0))
    allowed = F.lit(True) if directive is None else F.coalesce(F.col(directive), F.lit(False))
    ranged = F.col(name).rlike(RANGE) & allowed
    numbers = F.when(
        ranged, F.sequence(low.try_cast("bigint"), F.regexp_extract(name, RANGE, 3).try_cast("bigint"))
    ).otherwise(F.array(F.lit(None).cast("bigint")))
    number = F.col("_n").cast("string")
    shown = F.when(F.col("_w") > 0, F.lpad(number, F.greatest("_w", F.length(number)), F.lit("0"))).otherwise(number)
    full = F.concat(F.regexp_extract(name, RANGE, 1), shown, F.regexp_extract(name, RANGE, 4))
    rows = df.select("*", width.alias("_w"), F.explode(numbers).alias("_n"))
    return rows.withColumn(name, F.when(F.col("_n").isNotNull(), full).otherwise(F.col(name))).drop("_n", "_w")


_TOKEN = re.compile(r"\{\{\s*(\w+?)(?:__value)?\s*(?:\|\s*default\('([^']*)'\)\s*)?\}\}")


def computed(template: str, columns: Mapping[str, str] | None = None) -> Column:
    """A name from ``{{ attr__value }}`` tokens; NULL when a token without default is NULL.

    ``columns`` maps token names to column names where they differ (a joined peer's attribute).
    """
    parts: list[Column] = []
    at = 0
    for match in _TOKEN.finditer(template):
        if match.start() > at:
            parts.append(F.lit(template[at : match.start()]))
        name = (columns or {}).get(match.group(1), match.group(1))
        value = F.col(name).cast("string")
        parts.append(value if match.group(2) is None else F.coalesce(value, F.lit(match.group(2))))
        at = match.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def computed_issues(df: DataFrame, template: str, keep: Sequence[str], columns: Mapping[str, str] | None = None) -> DataFrame:
    """A row ``keep.., token, code`` for each token without default that is NULL, for which :func:`computed` gives no name."""
    names = {m.group(1): (columns or {}).get(m.group(1), m.group(1)) for m in _TOKEN.finditer(template) if m.group(2) is None}
    lacking = [F.when(F.col(column).isNull(), F.lit(token)) for token, column in names.items()]
    tokens = F.array_compact(F.array(*lacking)) if lacking else F.array().cast("array<string>")
    return df.select(*keep, F.explode(tokens).alias("token")).withColumn("code", F.lit("mandatory_input_missing"))


def batch_names(df: DataFrame, prefix: str, role: str, quantity: str, *, out: str = "name") -> DataFrame:
    """``quantity`` rows per input row, named ``{prefix}-{role}-{i:02d}`` from 1."""
    rows = df.where(F.col(quantity) > 0).withColumn("index", F.explode(F.sequence(F.lit(1), F.col(quantity).cast("int"))))
    return rows.withColumn(out, F.format_string("%s-%s-%02d", prefix, role, "index"))


# What must not leave the house, and the placeholder that replaces it. Order counts:
# a URL holds a host, a host may hold an address.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
IPV6 = r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{0,4}\b"
INTERNAL_TLDS = ("local", "internal", "corp", "lan", "intranet", "home", "private")
_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]{0,62}"
INTERNAL_HOST = rf"(?i)\b{_LABEL}(?:\.{_LABEL})+\.(?:{'|'.join(INTERNAL_TLDS)})\b"
INTERNAL_URL = rf"(?i)\bhttps?://(?:[^\s/@]*@)?{_LABEL}(?:\.{_LABEL})*\.(?:{'|'.join(INTERNAL_TLDS)})\b[^\s]*"
USER_PATH = r"(?:/Users/|/home/|C:\\Users\\)[A-Za-z][\w.-]+"
HOME_PATH = r"(?i)(?:/users/|/home/|~[\\/]|[a-z]:\\users\\)\S*"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ALLOWED_IPS = ("127.0.0.1", "0.0.0.0", "255.255.255.255")
DOCUMENTATION_PREFIXES = ("192.0.2.", "198.51.100.", "203.0.113.")
PLACEHOLDERS = ("<internal-ip>", "<redacted>")
SECRETS = {
    "github_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "secret_key": r"sk-[A-Za-z0-9]{20,}",
    "slack_token": r"xox[bpoa]-[A-Za-z0-9-]{10,}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "jwt": r"eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}",
    "connection_string": r"\b[a-z][a-z0-9+]*://[^\s:/@]+:[^\s:/@]+@",
}

_ALLOWED = "|".join([*map(re.escape, ALLOWED_IPS), *(re.escape(p) + r"\d+" for p in DOCUMENTATION_PREFIXES)])
#: An address that a redacted text must not show: loopback, wildcard and documentation addresses stay.
TELLING_IPV4 = rf"\b(?!(?:{_ALLOWED})\b)(?:{_OCTET}\.){{3}}{_OCTET}\b"

REDACTIONS: tuple[tuple[str, str], ...] = (
    (INTERNAL_URL, "<internal-url>"),
    (EMAIL, "<email>"),
    (INTERNAL_HOST, "<internal-host>"),
    (USER_PATH + r"\S*", "<path>"),
    (TELLING_IPV4, "<internal-ip>"),
    (IPV6, "<internal-ipv6>"),
)


def redact(text: Column, rules: Sequence[tuple[str, str]] = REDACTIONS) -> Column:
    """The text with every rule applied in the given order."""
    for pattern, placeholder in rules:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def container_rule(names: Sequence[str]) -> tuple[str, str]:
    """A redaction rule for the container names of an environment, longest first."""
    listed = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return (rf"\b(?:{listed})\b", "<container>")


def allowed_ip(ip: Column) -> Column:
    ok = ip.isin(list(ALLOWED_IPS))
    for prefix in DOCUMENTATION_PREFIXES:
        ok = ok | ip.startswith(prefix)
    return ok


def detect_leaks(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Rows ``(keep.., leak, found)``: one per address, host, user path or IPv6 literal in a text.

    An address is excused when it is on the allow-list or a placeholder stands within 20 characters.
    All patterns run in one pass; only hits are exploded.
    """
    pieces = F.split(text, IPV4)
    ips = F.regexp_extract_all(text, F.lit(IPV4), F.lit(0))
    some = lambda parts, i: F.coalesce(F.get(parts, i), F.lit(""))
    # 20 characters reach over one neighbouring address, never over two and a placeholder
    before = lambda i: F.concat(some(pieces, i - 1), some(ips, i - 1), F.get(pieces, i))
    after = lambda i: F.concat(F.get(pieces, i + 1), some(ips, i + 1), some(pieces, i + 2))
    around = F.transform(
        F.sequence(F.lit(0), F.size(ips) - 1),
        lambda i: F.struct(
            F.get(ips, i).alias("found"),
            F.concat(
                F.right(before(i), F.lit(20)), F.lit("\n"), F.left(after(i), F.lit(20))
            ).alias("near"),
        ),
    )
    excused = lambda x: allowed_ip(x["found"]) | x["near"].contains(PLACEHOLDERS[0]) | x["near"].contains(PLACEHOLDERS[1])
    leaking = F.when(
        F.size(ips) > 0, F.transform(F.filter(around, lambda x: ~excused(x)), lambda x: x["found"])
    ).otherwise(F.array().cast("array<string>"))

    def tagged(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("leak"), x.alias("found")))

    hits = F.concat(
        tagged("ipv4", leaking),
        tagged("internal_host", F.regexp_extract_all(text, F.lit(INTERNAL_HOST), F.lit(0))),
        tagged("user_path", F.regexp_extract_all(text, F.lit(HOME_PATH), F.lit(0))),
        tagged("ipv6", F.regexp_extract_all(text, F.lit(IPV6), F.lit(0))),
    )
    return df.select(*keep, F.explode(hits).alias("_h")).select(*keep, "_h.leak", "_h.found")


def secret_kinds(text: Column) -> Column:
    """The kinds of secret a text holds."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SECRETS.items()]))


def quarantine_secrets(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and whole rows with a secret; a secret is never partly redacted."""
    marked = df.withColumn("secrets", F.array_join(secret_kinds(F.col(text)), ","))
    clean = marked.where(F.coalesce(F.col("secrets"), F.lit("")) == "").drop("secrets")
    return clean, marked.where(F.col("secrets") != "")


PLACEHOLDER = r"<[A-Za-z][\w-]*>"


# From how few words a redacted text is too thin, and from how many placeholders on it needs a term.
MIN_WORDS, MAX_PLACEHOLDERS = 25, 4


def over_redacted(
    text: Column, domain_terms: Sequence[str], *, min_words: int = MIN_WORDS, max_placeholders: int = MAX_PLACEHOLDERS
) -> Column:
    """``too_little_prose``, ``placeholders_only`` or NULL for a redacted text still worth reading."""
    prose = F.regexp_replace(text, PLACEHOLDER, " ")
    words = F.regexp_count(prose, F.lit(r"[A-Za-z][A-Za-z_]{2,}"))
    marks = F.regexp_count(text, F.lit(PLACEHOLDER))
    terms = "(?i)" + "|".join(domain_terms)
    return F.when(words < min_words, "too_little_prose").when(
        (marks >= max_placeholders) & ~prose.rlike(terms), "placeholders_only"
    )


# Volatile parts of an error message, in the order they are replaced.
VOLATILE: tuple[tuple[str, str], ...] = (
    (r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", "<uuid>"),
    (r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?", "<time>"),
    (r"https?://\S+", "<url>"),
    (IPV4, "<ip>"),
    (r"(?:/[\w.-]+){2,}", "<path>"),
    (r"\b[a-z0-9]+(?:-[a-z0-9]+)*-[0-9a-f]{8}\b", "<branch>"),
    # a dotted name is a host where a port follows or its last label says so; modules and files stay
    (r"\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:\d+\b", "<host>:<n>"),
    (r"\b(?:[A-Za-z0-9-]+\.)+(?:com|net|org|edu|gov|io|dev|cloud|local|internal|intra|lan|corp|home|example|test|localdomain)\b", "<host>"),
    (r"\d+", "<n>"),
)


#: An exception class behind its modules; the class stays, or different errors would become one host.
QUALIFIED_CLASS = r"\b(?:[A-Za-z_][A-Za-z0-9_]*\.)+([A-Z][A-Za-z0-9_]*(?:Error|Exception|Warning|Timeout|Failure))\b"


def error_template(message: Column) -> Column:
    """The message without ids, times, hosts, addresses and paths: its class and constant words."""
    return collapse_spaces(redact(F.regexp_replace(message, QUALIFIED_CLASS, "$1"), VOLATILE))


def exception_parts(block: Column, own_code: str) -> tuple[Column, Column, Column]:
    """Class and message from the last line of a traceback block, and the innermost own frame."""
    last = F.element_at(F.split(F.rtrim(block), "\n"), -1)
    frames = F.filter(F.split(block, "\n"), lambda x: x.rlike(r'^\s+File "') & x.contains(own_code))
    return (
        F.regexp_extract(last, r"^([\w.]+)", 1),
        F.regexp_extract(last, r"^[\w.]+:\s*(.*)", 1),
        F.trim(F.try_element_at(frames, F.lit(-1))),
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once per row, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def version_key(version: Column) -> Column:
    """A struct that sorts like the version: all its numbers, a release above its pre-releases, then the suffix number.

    NULL for a text that does not start with a number (``v`` may stand before it). Patterns of suffixes are tried on
    versions that have one only.
    """
    leading = F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1)
    suffix = lambda x: F.when(x["version"] == x["numbers"], "").otherwise(
        F.lower(F.regexp_extract(x["version"], r"^v?\d+(?:\.\d+)*(.*)$", 1))
    )
    short = lambda x: F.when(x.endswith("0"), F.regexp_replace(x, r"(\.0+)+$", "")).otherwise(x)

    def key(x: Column) -> Column:
        numbers, rest = x["numbers"], x["rest"]
        parts = F.transform(F.split(numbers, r"\."), lambda n: n.try_cast("decimal(38,0)"))
        later = (rest == "") | rest.rlike(r"^[.+-]?post|^\+")
        made = F.struct(
            parts.alias("numbers"), later.cast("int").alias("released"), ((rest != "") & rest.rlike(r"post")).cast("int").alias("post"),
            F.when(rest == "", "").otherwise(F.regexp_extract(rest, r"^[^0-9]*", 0)).alias("stage"),
            F.when(rest != "", F.regexp_extract(rest, r"(\d+)", 1).try_cast("bigint")).alias("number"),
        )
        return F.when(numbers != "", made)

    read = F.struct(version.alias("version"), leading.alias("numbers"))
    return _once(read, lambda x: _once(F.struct(short(x["numbers"]).alias("numbers"), suffix(x).alias("rest")), key))


def fix_status(running: Column, fix: Column) -> Column:
    """``upgrade``, ``unconfirmed`` or ``undetermined``; an unreadable version is undetermined."""
    keys = F.struct(version_key(running).alias("have"), version_key(fix).alias("want"))
    return _once(
        keys,
        lambda x: F.when(x["have"].isNull() | x["want"].isNull(), "undetermined")
        .when(x["want"] > x["have"], "upgrade").otherwise("unconfirmed"),
    )


# Naming rules per category.
NAME_PATTERNS = {
    "node": r"^[A-Z][a-zA-Z0-9]+\z",
    "namespace": r"^[A-Z][a-z0-9]+\z",
    "attribute": r"^[a-z0-9\_]+\z",
    "relationship": r"^[a-z0-9\_]+\z",
    "identifier": r"^[a-z0-9\_]+\z",
}


def name_ok(category: Column, name: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for kind, pattern in NAME_PATTERNS.items():
        out = F.when(category == kind, name.rlike(pattern)).otherwise(out)
    return out


def severity_of_step(step: Column) -> Column:
    """Severity by ladder step: 1-3 MEDIUM, 4-7 LOW, others none."""
    return F.when(step.between(1, 3), "MEDIUM").when(step.between(4, 7), "LOW")


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, name in enumerate(("LOW", "MEDIUM", "HIGH", "CRITICAL"), start=1):
        out = F.when(F.upper(severity) == name, F.lit(rank)).otherwise(out)
    return out


def length_caps(values: DataFrame, caps: DataFrame | None, key: str, value: str) -> DataFrame:
    """Values longer than their cap; without a cap (or a cap table) the result is ``unverified``."""
    if caps is None:
        return values.withColumn("status", F.lit("unverified"))
    # measured before the join, so that a caller that does not keep the values sends lengths instead of texts
    joined = values.withColumn("_length", F.length(value)).join(caps.select(key, "cap"), key, "left")
    status = (
        F.when(F.col("cap").isNull(), "unverified")
        .when(F.col("_length") > F.col("cap"), "too_long")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).drop("_length")


def rows_by_role(df: DataFrame, role: str) -> DataFrame:
    """Rows with their role, ``unknown`` when blank."""
    text = F.trim(F.col(role))
    return df.withColumn(role, F.when(text.isNull() | (text == ""), "unknown").otherwise(text))


def first_ip(df: DataFrame, name: str, address: str, order: str) -> DataFrame:
    """The first address per name."""
    return df.where(F.col(address).isNotNull()).groupBy(name).agg(F.min_by(address, order).alias("first_ip"))
