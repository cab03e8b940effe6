"""Load sets, provenance manifests and per-target artifacts."""

from __future__ import annotations

import _hashlib
import ctypes
from collections.abc import Iterator, Mapping, Sequence
from ctypes.util import find_library
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.operators.checks import GateClosed, fail_closed
from stewardry.operators.graph import dependency_levels
from stewardry.operators.windows import load_order
from stewardry.scale import cut, dealt, new_path, scratch

# The envelope of an object document and the allowed artifact types.
ENVELOPE = ("apiVersion", "kind", "spec.kind", "spec.data")
CONTENT_TYPES = (
    "application/json",
    "application/yaml",
    "application/xml",
    "application/hcl",
    "text/plain",
    "text/markdown",
    "text/csv",
    "image/svg+xml",
)


def envelope(rows: DataFrame, kind: str, *, api_version: str = "v1") -> DataFrame:
    """One JSON document per row: ``apiVersion, kind: Object, spec: {kind, data: [row]}``.

    Blank values are left out. One row per document keeps the writer free of any grouping.
    """
    document = F.to_json(
        F.struct(
            F.lit(api_version).alias("apiVersion"),
            F.lit("Object").alias("kind"),
            F.struct(F.lit(kind).alias("kind"), F.array(F.struct(*rows.columns)).alias("data")).alias("spec"),
        ),
        {"ignoreNullFields": "true"},
    )
    return rows.select(document.alias("value"))


def load_prefixes(spark: SparkSession, kinds: Sequence[str], references: Sequence[tuple[str, str]]) -> dict[str, str]:
    """``NN`` by dependency level for each kind, with a letter where a level has several; a cycle is refused.

    ``references`` pairs a kind with one it refers to. A schema has few kinds, so the driver holds them.
    """
    nodes = spark.createDataFrame([(k,) for k in sorted(set(kinds))], "node string")
    refs = spark.createDataFrame([(a, b) for a, b in references if a != b], "src string, dst string")
    levels = dependency_levels(nodes, refs).withColumnRenamed("node", "kind")
    fail_closed(levels.where("level IS NULL").select("kind"), "kinds that refer to each other")
    rows = load_order(levels).collect()
    alone = {r["level"] for r in rows if sum(x["level"] == r["level"] for x in rows) == 1}
    return {r["kind"]: r["prefix"].rstrip("abcdefghijklmnopqrstuvwxyz") if r["level"] in alone else r["prefix"] for r in rows}


def write_load_set(
    frames: Mapping[str, DataFrame], references: Sequence[tuple[str, str]], path: str, *, issues: DataFrame | None = None
) -> dict[str, str]:
    """Write the kinds below ``path/load_order=NN/kind=K``, referents first; gives each kind its prefix.

    Any row of ``issues`` closes the gate before the first file. All kinds go out in one partitioned write;
    rebalancing gives each kind files of even size and splits a kind that holds most rows.
    """
    if not frames:
        raise GateClosed("no kind to load")
    if issues is not None:
        fail_closed(issues, "open issues")
    prefixes = load_prefixes(next(iter(frames.values())).sparkSession, list(frames), references)
    out = None
    for kind, rows in frames.items():
        part = envelope(rows, kind).select(
            "value", F.lit(prefixes[kind]).alias("load_order"), F.lit(kind).alias("kind")
        )
        out = part if out is None else out.unionByName(part)
    out.hint("rebalance", "load_order", "kind").write.partitionBy("load_order", "kind").text(path)
    return prefixes


def envelope_problems(documents: DataFrame, document: str, keep: Sequence[str]) -> DataFrame:
    """Documents that lack one of the four envelope fields or have the wrong kind."""
    parsed = F.try_parse_json(document)
    lacking = [
        F.when(F.try_variant_get(parsed, f"$.{field}", "variant").isNull(), F.lit(f"{field} missing"))
        for field in ENVELOPE
    ]
    wrong = F.when(F.try_variant_get(parsed, "$.kind", "string") != "Object", F.lit("kind is not Object"))
    return documents.select(*keep, F.explode(F.array_compact(F.array(*lacking, wrong))).alias("problem"))


#: A task takes those splits of a file that begin within so many bytes; the hash goes on in the next round's task.
BYTES_A_TASK = 64 << 20
#: Files with these ends Spark's text reader unpacks, so that their own bytes come from the binary reader.
PACKED = ("bz2", "deflate", "gz", "lz4", "snappy", "zst")
PIECE = 8 << 10
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
STATES = "_path string, _size long, _bytes long, value binary, sha256 string"


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``_path``, ``sha256`` and ``bytes`` of files of any size.

    Splits of a file are read by many tasks, as lines, and written as pieces of bytes. A SHA-256 must take them in order,
    so it goes on in rounds: in each, one task takes about ``BYTES_A_TASK`` of a file, beginning with the state that the
    round before has left. The pieces are removed at the end. A line is read by one task. The reader drops a byte order
    mark, which the lengths tell, and it is put back. Packed files are read whole, which Spark refuses above 2 GB. Spark's
    readers pass over empty files, and those of a byte order mark alone, which have no row.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            path, size, start, value = batch.columns
            new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1]))
            for a, b in pairwise(sorted({0, *(k + 1 for k in pc.indices_nonzero(new).to_pylist()), batch.num_rows})):
                data = pa.py_buffer(b"\n".join([*value[a:b].to_pylist(), b""]))
                ends = pa.array([*range(0, data.size, PIECE), data.size], pa.int32())
                cuts = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, ends.buffers()[1], data])
                place = {"_path": path[a].as_py(), "_size": size[a].as_py(), "_start": start[a].as_py()}
                own = {"_n": range(n, n + len(cuts)), "_bytes": pc.cast(pc.binary_length(cuts), pa.int64()), "value": cuts}
                made = pa.RecordBatch.from_pydict({k: [v] * len(cuts) for k, v in place.items()} | own)
                yield from (made.slice(k, 1000) for k in range(0, len(cuts), 1000))
                n += len(cuts)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the OpenSSL that hashlib uses; hashlib's own objects do not hand out their state, an SHA256_CTX of 112 bytes
        openssl = ctypes.CDLL(getattr(_hashlib, "__file__", None) or find_library("crypto"))
        path, size, seen, state = None, 0, 0, None

        def row() -> pa.RecordBatch:
            kept, result = state.raw, ctypes.create_string_buffer(32)
            openssl.SHA256_Final(result, state)
            found = pa.array([result.raw.hex() if seen == size else None], pa.string())
            return pa.RecordBatch.from_pydict({"_path": [path], "_size": [size], "_bytes": [seen], "value": [kept], "sha256": found})

        for batch in batches:
            for name, length, start, _, taken, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != path:
                    if path is not None:
                        yield row()
                    path, size, seen, state = name, length, 0, ctypes.create_string_buffer(112)
                    openssl.SHA256_Init(state)
                if start < 0:
                    seen, state = taken, ctypes.create_string_buffer(value, 112)
                else:
                    value = value[: size - seen]  # the last line may have had no line feed
                    openssl.SHA256_Update(state, value, ctypes.c_size_t(len(value)))
                    seen += len(value)
        if path is not None:
            yield row()

    states = new_path(spark, "sha256-states")
    packed = rf"(?i)\.({'|'.join(PACKED)})$"
    lines = (
        spark.read.option("lineSep", "\n").text(list(paths))
        .select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"),
                F.col("_metadata.file_block_start").alias("_start"), F.col("value").cast("binary").alias("value"))
        .where(~F.col("_path").rlike(packed))
    )
    with scratch(spark):
        kinds = "_path string, _size long, _start long, _n long, _bytes long, value binary"
        pieces = cut(lines.mapInArrow(split, kinds), "pieces")
        totals = pieces.groupBy("_path").agg(F.max("_size").alias("_size"), (F.max("_size") - F.sum("_bytes")).alias("_gap"))
        fail_closed(totals.where(~F.col("_gap").isin(-1, 0, 2, 3)).select("_path"), "files whose lines do not add up to their size")
        marks = totals.where("_gap >= 2").select(
            "_path", "_size", F.lit(0).alias("_start"), F.lit(-1).alias("_n"), F.lit(3).alias("_bytes"), F.lit(BYTE_ORDER_MARK).alias("value")
        )
        part = F.floor(F.col("_start") / BYTES_A_TASK)
        parts = sorted(pieces.groupBy(part.alias("_part")).agg(F.sum("_bytes").alias("_bytes")).collect()) or [(0, 0)]
        for k, (number, size) in enumerate(parts):
            first = number * BYTES_A_TASK
            rows = pieces.where(F.col("_start").between(first, first + BYTES_A_TASK - 1))
            if k == 0:
                rows = rows.unionByName(marks)
            else:
                left = spark.read.schema(STATES).parquet(f"{states}/round={k - 1}").where("sha256 IS NULL")
                rows = rows.unionByName(left.drop("sha256").withColumns({"_start": F.lit(-1), "_n": F.lit(-1)}))
            taken = dealt(rows, ["_path"], -(-size // BYTES_A_TASK)).sortWithinPartitions("_path", "_start", "_n")
            taken.mapInArrow(digest, STATES).write.parquet(f"{states}/round={k}")
    done = spark.read.schema(STATES).parquet(states).where("sha256 IS NOT NULL")
    ends = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in end) for end in PACKED]
    whole = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(ends)}}}").load(list(paths))
    return done.select("_path", "sha256", F.col("_size").alias("bytes")).unionByName(
        whole.where("length > 0").select(
            F.col("_metadata.file_path").alias("_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")
        )
    )


def provenance(spark: SparkSession, paths: Sequence[str], *, format: str = "csv", header: bool = True) -> DataFrame:
    """Per source file its full SHA-256, size and row count; see :func:`file_digests`. Rows are counted by splits."""
    reader = spark.read.option("header", header) if format == "csv" else spark.read
    counts = (
        reader.format(format)
        .load(list(paths))
        .groupBy(F.col("_metadata.file_path").alias("_path"))
        .agg(F.count("*").alias("rows"))
    )
    clean = lambda df: df.withColumn("_path", F.regexp_replace("_path", "^file:/+", "/"))
    return (
        clean(file_digests(spark, paths))
        .join(clean(counts), "_path", "left")
        .select(
            F.regexp_extract("_path", r"([^/]+)\z", 1).alias("file"),
            "sha256",
            "bytes",
            F.coalesce("rows", F.lit(0)).alias("rows"),
        )
    )


def write_manifest(manifest: DataFrame, path: str, *, branch: str) -> None:
    """The provenance of an emission with its branch and UTC time."""
    stamped = manifest.withColumn("branch", F.lit(branch)).withColumn(
        "emitted", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    stamped.write.json(path)


def artifact_text(df: DataFrame, content: Column, content_type: str) -> Column:
    """The content as text of its type: a struct as JSON (which YAML contains), a CSV line or an XML element.

    A string is taken as it is, and the other types, which structs have no one form of, take nothing else.
    """
    if content_type not in CONTENT_TYPES:
        raise ValueError(f"content type {content_type!r} is not one of {CONTENT_TYPES}")
    kind = df.select(content.alias("c")).schema["c"].dataType.typeName()
    if kind == "string":
        return content
    if content_type in ("application/json", "application/yaml"):
        return F.to_json(content)
    if kind == "struct" and content_type == "text/csv":
        # quoted where a cell holds a comma, a quote or a line break; those two are doubled and kept
        return F.to_csv(content, {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    if kind == "struct" and content_type == "application/xml":
        return F.regexp_replace(F.to_xml(content, {"rowTag": "item"}), r"\s*\n\s*", "")
    raise ValueError(f"{content_type} needs text, not a {kind}")


def write_artifacts(df: DataFrame, target: str, content: Column, content_type: str, path: str) -> None:
    """One artifact folder per target, in the form of its content type; see :func:`artifact_text`.

    Rows are rebalanced by target, so a target is a few even files instead of one per task. A CSV file begins
    with the names of the struct's fields.
    """
    rows = df.select(artifact_text(df, content, content_type).alias("value"), F.col(target)).hint("rebalance", target)
    kind = df.select(content.alias("c")).schema["c"].dataType
    if content_type == "text/csv" and kind.typeName() == "struct":
        parsed = df.select(F.col(target), content.alias("c")).select(target, "c.*").hint("rebalance", target)
        parsed.write.partitionBy(target).options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
        return
    rows.write.partitionBy(target).text(path)
