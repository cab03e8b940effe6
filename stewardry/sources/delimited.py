"""Delimited files: listing, dialect per file, typed-by-nobody rows with file and line."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stewardry.functions.text import snake_case
from stewardry.operators.checks import GateClosed
from stewardry.scale import cut

# Accepted extensions, and delimiters in order of preference.
EXTENSIONS = ("csv", "tsv")
DELIMITERS = (",", ";", "\t")
BOM = "﻿"
# Windows-1252 characters at bytes 0x80-0x9F, where ISO-8859-1 has control codes.
CP1252_FROM = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"

SHOWN = 20  # problems that a refusal lists


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def list_inputs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The files to import as ``path, file, length, input_rank`` (``file``: as row metadata name it).

    Files and folders may be mixed. Folders give their ``*.csv`` and ``*.tsv`` files in alphabetical
    order, below the place the user gave them; a file named twice counts once, at its first place.
    Any other explicit file rejects the whole import before anything is read.
    """
    found = None
    for place, path in enumerate(paths):
        listed = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(path)
            .select("path", "length", F.col("_metadata.file_path").alias("file"), F.lit(place).alias("_place"))
        )
        last = path.rstrip("/").rsplit("/", 1)[-1]
        if "." in last and last.rsplit(".", 1)[-1].lower() not in EXTENSIONS:
            explicit = listed.where(F.col("path").endswith(f"/{last}")).limit(1).count()
            if explicit:
                raise GateClosed(f"cannot import {last}: only {', '.join(EXTENSIONS)} are supported")
        found = listed if found is None else found.unionByName(listed)
    if found is None:
        raise GateClosed("no inputs given")
    return (
        found.where(_extension(F.col("path")).isin(list(EXTENSIONS)))
        .groupBy("path", "file")
        .agg(F.max("length").alias("length"), F.min("_place").alias("_place"))
        .select("path", "file", "length", F.format_string("%06d:%s", "_place", "path").alias("input_rank"))
    )


def sniff_dialect(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per file: encoding, delimiter, quote, line ending, decimal sign, header, what was seen, and ``problem``.

    Decided once per file by one aggregate over its raw lines, so a file of any size is looked at in
    splits. Bytes are UTF-8, else windows-1252, else (where that leaves a byte undefined) ISO-8859-1.
    Delimiters are counted in the header, outside quotes; a tie goes to the extension, else
    ``delimiter`` is NULL. ``bom`` and ``candidates`` (delimiters with their counts) are for the report.
    ``problem`` says why the reader refuses a file: an ambiguous delimiter, a header that goes on in the
    next line, or NUL bytes, which UTF-16 has.
    """
    value = F.col("value")
    files = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .text(list(paths))
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
        .withColumn("_id", F.monotonically_increasing_id())
    )
    extension = _extension(F.col("file"))
    facts = files.where(extension.isin(list(EXTENSIONS))).groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(value)).alias("utf8"),
        F.bool_or(F.contains(value, F.lit('"'))).alias("double_quotes"),
        F.bool_or(F.contains(value, F.lit("'"))).alias("single_quotes"),
        F.bool_or(F.endswith(value, F.lit("\r"))).alias("crlf"),
        ((F.count("*") == 1) & F.bool_or(F.contains(value, F.lit("\r")))).alias("cr"),
        F.bool_or(F.make_valid_utf8(value).rlike(r"(^|[;\"'])\d+,\d+")).alias("comma_numbers"),
        F.bool_or(F.contains(value, F.lit("\0"))).alias("nul"),
        F.bool_or(F.decode(value.cast("binary"), "ISO-8859-1").rlike(r"[\x81\x8D\x8F\x90\x9D]")).alias("undefined"),
        F.min_by(value.cast("binary"), F.struct("_start", "_id")).alias("first"),
    )
    first = F.when(F.col("utf8"), F.col("first").cast("string")).otherwise(F.decode("first", "ISO-8859-1"))
    header = F.regexp_replace(F.split_part(first, F.lit("\r"), F.lit(1)), f"^{BOM}", "")

    def times(mark: str) -> Column:
        bare = F.regexp_replace("header", r'"[^"]*"', "")
        return F.length(bare) - F.length(F.replace(bare, F.lit(mark), F.lit("")))

    counts = [times(d) for d in DELIMITERS]
    most = F.greatest(*counts)
    leaders = F.array_compact(
        F.array(*[F.when(n == most, F.lit(d)) for n, d in zip(counts, DELIMITERS, strict=True)])
    )
    hint = F.when(extension == "tsv", F.lit("\t")).otherwise(F.lit(","))
    delimiter = F.when(F.size(leaders) == 1, F.get(leaders, F.lit(0))).when(F.array_contains(leaders, hint), hint)
    quote = F.when(~F.col("double_quotes") & F.col("single_quotes"), "'").otherwise('"')
    goes_on = F.regexp_count("header", F.col("quote")) % 2 == 1
    return (
        facts.withColumn("header", header)
        .withColumn("delimiter", delimiter)
        .withColumn("quote", quote)
        .select(
            "file",
            F.when(F.col("utf8"), "utf-8").when(F.col("undefined"), "iso-8859-1").otherwise("windows-1252").alias("encoding"),
            "delimiter",
            "quote",
            F.when(F.col("crlf"), "crlf").when(F.col("cr"), "cr").otherwise("lf").alias("eol"),
            F.when((F.col("delimiter") == ";") & F.col("comma_numbers"), ",").otherwise(".").alias("decimal"),
            "header",
            F.startswith(F.col("first").cast("string"), F.lit(BOM)).alias("bom"),
            F.format_string(", %d | ; %d | tab %d", *counts).alias("candidates"),
            F.when(F.col("nul"), "NUL bytes")
            .when(F.col("delimiter").isNull(), "no clear delimiter")
            .when(goes_on, "a header that goes on in the next line")
            .alias("problem"),
        )
    )


def decoded(value: Column, encoding: str) -> Column:
    """Text of a line read as raw bytes."""
    if encoding == "utf-8":
        return value
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return latin if encoding == "iso-8859-1" else F.translate(latin, CP1252_FROM, CP1252_TO)


def numbered_lines(spark: SparkSession, paths: Sequence[str], eol: str = "lf") -> DataFrame:
    """Raw lines as ``_path``, ``_line`` (1-based), ``value``, read by splits.

    The files are read once, so that all that follows sees the same splits and bytes. A line's number is its place in
    its split, known from the running id of the scan, behind the lines of all earlier splits; a row per split is all
    that is added up.
    """
    raw = spark.read.option("lineSep", "\r" if eol == "cr" else "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value"),
    )
    raw = cut(raw, "lines")
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = cut(raw.groupBy("_path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")), "splits").select(
        "_path", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    return raw.join(splits, ["_path", "_start"]).select(
        "_path", "_start", (F.col("_id") - F.col("_first") + F.col("_base") + 1).alias("_line"), "value"
    )


def _ends_inside(value: Column, delimiter: str, quote: str, inside: bool) -> Column:
    """Whether a line ends inside quotes, given whether it begins inside.

    Doubled quotes are characters and taken out. Outside, a quote opens a cell only at the cell's start; inside, the
    next one closes it. No expression of the line's length is matched, so that a cell may be megabytes long.
    """
    parts = F.split(F.replace(value, F.lit(quote * 2), F.lit("")), quote)
    opens = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda part, k: F.endswith(part, F.lit(delimiter)) | ((k == 0) & (part == "")),
    )
    ends = F.aggregate(opens, F.lit(inside), lambda state, opening: ~state & opening)
    return F.when(F.contains(value, F.lit(quote)), ends).otherwise(F.lit(inside))


def open_spans(lines: DataFrame, delimiter: str, quote: str) -> DataFrame:
    """Runs of lines that are one record: ``_path``, ``_from``, ``_to``; ``_to`` is NULL where the quotes never close.

    A line maps the state it begins in to the one it ends in; such maps are joined along a file. All but the
    identity are events; a run of flips since the last constant gives an event's own state. That is done inside
    each split, and over one row per split for the states that splits begin in.
    """
    ends = [_ends_inside(F.col("value"), delimiter, quote, inside) for inside in (False, True)]
    events = lines.select("_path", "_start", "_line", ends[0].alias("_o"), ends[1].alias("_i")).where("_o OR NOT _i")
    events = cut(events, "quotes")
    flip = (F.col("_o") & ~F.col("_i")).cast("int")
    constant = F.col("_o") == F.col("_i")

    def after(last: Column, flips: Column, begin: Column) -> Column:
        """The state behind a last constant (its value, the flips up to it) and ``flips`` in all."""
        since = F.when(last.isNull(), flips).otherwise(flips - last["n"])
        base = F.when(last.isNull(), begin).otherwise(last["v"])
        return base != (since % 2 == 1)

    here = Window.partitionBy("_path", "_start").orderBy("_line")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mapped = events.withColumn("_flips", F.sum(flip).over(upto)).withColumn(
        "_last", F.last(F.when(constant, F.struct(F.col("_o").alias("v"), F.col("_flips").alias("n"))), ignorenulls=True).over(upto)
    )
    splits = mapped.groupBy("_path", "_start").agg(F.max_by(F.struct("_last", "_flips"), "_line").alias("s")).select(
        "_path", "_start", F.col("s._flips").alias("_n"),
        F.when(F.col("s._last").isNotNull(), after(F.col("s._last"), F.col("s._flips"), F.lit(False))).alias("_v"),
    )
    files = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("_path").orderBy("_start")
    total = splits.withColumn("_all", F.sum("_n").over(files)).withColumn(
        "_const", F.last(F.when(F.col("_v").isNotNull(), F.struct(F.col("_v").alias("v"), F.col("_all").alias("n"))), ignorenulls=True).over(files)
    )
    begins = total.withColumn("_end", after(F.col("_const"), F.col("_all"), F.lit(False))).select(
        "_path", "_start", F.coalesce(F.lag("_end").over(earlier), F.lit(False)).alias("_begin")
    )
    states = mapped.join(begins, ["_path", "_start"]).select(
        "_path", "_start", "_line", "_begin", after(F.col("_last"), F.col("_flips"), F.col("_begin")).alias("_state")
    )
    # a span begins where the state turns to inside, and ends where it turns back
    turns = states.withColumn("_was", F.coalesce(F.lag("_state").over(here), "_begin")).where("_was <> _state")
    following = Window.partitionBy("_path").orderBy("_line")
    return turns.withColumn("_to", F.lead("_line").over(following)).where("_state").select("_path", F.col("_line").alias("_from"), "_to")


def records(lines: DataFrame, spans: DataFrame, eol: str = "lf") -> DataFrame:
    """Whole records as ``_path``, ``_line`` (where they begin), ``value``; lines inside a span are joined.

    Spans are met by blocks of 1024 lines. Lines outside of spans are not gathered.
    """
    block = F.shiftright("_line", 10)
    by_block = spans.withColumn("_block", F.explode(F.sequence(F.shiftright("_from", 10), F.shiftright("_to", 10))))
    blocks = by_block.groupBy("_path", "_block").agg(F.array_sort(F.collect_list(F.struct("_from", "_to"))).alias("_spans"))
    placed = lines.withColumn("_block", block).join(blocks, ["_path", "_block"], "left").withColumn(
        "_from", F.expr("get(filter(_spans, s -> s._from <= _line AND _line <= s._to), 0)._from")
    )
    return_mark = "\r" if eol == "cr" else "\n"
    alone = placed.where("_from IS NULL").select("_path", "_line", "value")
    joined = placed.where("_from IS NOT NULL").groupBy("_path", F.col("_from").alias("_line")).agg(
        F.array_sort(F.collect_list(F.struct("_line", "value"))).alias("_lines")
    )
    whole = joined.select("_path", "_line", F.array_join(F.col("_lines.value"), return_mark).alias("value"))
    return alone.unionByName(whole)


def _refuse(problems: list[str], n: int) -> None:
    if problems:
        more = f"; and {n - len(problems)} more" if n > len(problems) else ""
        raise GateClosed("; ".join(problems) + more)


def _check_spans(lines: DataFrame, spans: DataFrame, most_lines: int, eol: str) -> None:
    """Refuses files with quotes that never close or records of too many lines, with line and byte offset."""
    bad = spans.where(F.col("_to").isNull() | (F.col("_to") - F.col("_from") >= most_lines))
    found = bad.orderBy("_path", "_from").limit(SHOWN).collect()
    if not found:
        return
    firsts = lines.sparkSession.createDataFrame([(r["_path"], r["_from"]) for r in found], "_path string, _from long")
    sizes = lines.join(F.broadcast(firsts), "_path").where(F.col("_line") < F.col("_from"))
    offsets = {(r["_path"], r["_from"]): r["n"] for r in sizes.groupBy("_path", "_from").agg(F.sum(F.octet_length("value") + 1).alias("n")).collect()}
    _refuse(
        [
            f"{'quotes that never close' if r['_to'] is None else f'a record of more than {most_lines} lines'} "
            f"in {r['_path']}, line {r['_from']}, byte {offsets.get((r['_path'], r['_from']), 0)}"
            for r in found
        ],
        bad.count(),
    )


def read_delimited(
    spark: SparkSession, paths: Sequence[str], *, most_lines: int = 100_000, with_decimal: bool = False
) -> DataFrame:
    """All rows as text columns named by their header, with ``_file``, ``_line`` and ``_input_rank``.

    ``with_decimal`` adds the decimal sign of the row's file as ``_decimal``. A quoted cell may run over lines, up to
    ``most_lines`` of them; ``_line`` is the physical line a record begins in. An empty cell is NULL, quoted or not.
    Files that share a dialect and header are read together; the driver sees the list of files, as Spark's file index
    does, never their rows. Files with a problem stop the import before a row is read, as they would break it.
    """
    inputs = list_inputs(spark, paths)
    plans = (
        sniff_dialect(spark, paths)
        .join(inputs, "file")
        .select("path", "input_rank", "encoding", "delimiter", "quote", "eol", "decimal", "header", "candidates", "problem")
        .collect()
    )
    refused = sorted(f"{p.problem} in {p.path} ({p.encoding}, header has {p.candidates})" for p in plans if p.problem is not None)
    _refuse(refused[:SHOWN], len(refused))
    groups: dict[tuple, list] = {}
    for p in plans:
        groups.setdefault((p.encoding, p.delimiter, p.quote, p.eol, p.decimal, p.header), []).append(p)
    out = None
    for (encoding, delimiter, quote, eol, decimal, header), files in sorted(groups.items()):
        cells = [c.strip() for c in next(csv.reader([header], delimiter=delimiter, quotechar=quote, skipinitialspace=True))]
        ddl = ", ".join(f"`{c}` string" for c in cells)
        lines = numbered_lines(spark, [f.path for f in files], eol)
        spans = cut(open_spans(lines, delimiter, quote), "spans")
        _check_spans(lines, spans, most_lines, eol)
        whole = records(lines, spans, eol).withColumn("value", decoded(F.col("value"), encoding))
        if eol == "crlf":
            whole = whole.withColumn("value", F.expr(r"if(endswith(value, '\r'), left(value, length(value) - 1), value)"))
        rows = whole.where((F.col("_line") > 1) & (F.trim("value") != ""))
        parsed = rows.select(
            F.col("_path").alias("_file"),
            "_line",
            # multiLine: line breaks inside quotes stay as they are
            F.from_csv("value", ddl, {"sep": delimiter, "quote": quote, "escape": quote, "multiLine": "true"}).alias("_row"),
        ).select("_row.*", "_file", F.col("_line").cast("bigint").alias("_line"))
        if with_decimal:
            parsed = parsed.withColumn("_decimal", F.lit(decimal))
        out = parsed if out is None else out.unionByName(parsed, allowMissingColumns=True)
    if out is None:
        raise GateClosed("no readable csv or tsv file found")
    ranks = inputs.select(F.col("file").alias("_file"), F.col("input_rank").alias("_input_rank"))
    return out.join(ranks, "_file", "left")


def dialect_leftovers(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Text values that show a wrongly read dialect: a byte-order mark or several semicolons."""
    cells = df.unpivot(list(keep), list(columns), "column", "value")
    problem = F.when(F.col("value").contains(BOM), "byte_order_mark").when(
        F.regexp_count("value", F.lit(";")) >= 2, "semicolons"
    )
    return cells.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("value")


def header_cells(dialects: DataFrame) -> DataFrame:
    """Rows ``file, position, header`` of all files for the column mapping."""
    cells = F.split(F.col("header"), F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")))
    rows = dialects.select("file", F.posexplode(cells).alias("position", "header"))
    return rows.withColumn("header", F.trim("header")).withColumn("snake", snake_case(F.col("header")))
