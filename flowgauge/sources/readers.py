"""CSV and Parquet scans with one missing-value convention."""

from __future__ import annotations

import csv
import logging
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgauge.functions.scalars import MISSING_TOKENS, quote
from flowgauge.operators.clean import feature_mapping, trim_names, union_tables
from flowgauge.operators.flows import assemble_flows
from flowgauge.operators.labeling import TimeWindow, label_from_column, label_static, label_time_windows
from flowgauge.operators.small import SMALL_BYTES, attach

log = logging.getLogger(__name__)

SUFFIXES = {".csv": "csv", ".parquet": "parquet"}


class NoDataLoaded(Exception):
    """No configured input gave a table."""


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _fs(spark, path)
    return bool(fs.exists(target))


def list_formats(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files below a path by format; files with another ending are skipped with a warning."""
    target, fs = _fs(spark, path)
    found: dict[str, list[str]] = {}
    if fs.getFileStatus(target).isFile():
        names = [path]
    else:
        names, it = [], fs.listFiles(target, True)
        while it.hasNext():
            names.append(it.next().getPath().toString())
    for name in sorted(names):
        leaf = name.rsplit("/", 1)[-1]
        if leaf.startswith(("_", ".")):
            continue
        suffix = "." + leaf.rsplit(".", 1)[-1].lower() if "." in leaf else ""
        if suffix not in SUFFIXES:
            log.warning("unsupported file %s skipped", name)
            continue
        found.setdefault(SUFFIXES[suffix], []).append(name)
    return found


def _options(reader):
    reader = reader.option("header", True).option("ignoreLeadingWhiteSpace", True)
    return reader.option("ignoreTrailingWhiteSpace", True).option("nanValue", "NaN")


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; blanks around names and cells are cut, missing tokens become NULL.

    Without a schema the cells of all rows are read twice: once as text to tell the
    narrowest type that holds every cell of a column, and by the scan itself. Names
    come from the heads of the files, which must have one header.
    """
    if schema is not None:
        return fold_tokens(trim_names(_options(spark.read).schema(schema).csv(path)))
    files = sorted(unquote(f) for f in spark.read.text(path).inputFiles())
    # files are looked at until one has a line
    head = next((h for f in files for h in heads(spark, [f]).values()), None)
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    names = _unique([c.strip() for c in next(csv.reader([head], escapechar="\\", skipinitialspace=True))])
    plain = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = fold_tokens(trim_names(_options(spark.read).schema(plain).csv(path)))
    kinds = infer_types(raw)
    return fold_missing_nan(raw.select(*[_typed(c, kinds[c]).alias(c) for c in raw.columns]))


def _unique(cells: list[str]) -> list[str]:
    """Names as the scan itself would give them: blank ones by number, repeated ones with their number."""
    named = [c if c else f"_c{i}" for i, c in enumerate(cells)]
    lower = [c.lower() for c in named]
    return [c if lower.count(low) == 1 else f"{c}{i}" for i, (c, low) in enumerate(zip(named, lower))]


# narrowest first; a column gets the first type that all of its cells have
TYPES = ("int", "bigint", "double", "boolean", "date", "timestamp")
ANY = 1 << len(TYPES)


def infer_types(text: DataFrame) -> dict[str, str]:
    """Type of each text column, from one aggregate of one number per column over all rows.

    A cell tells the types that it does not have as bits; bits of all cells are
    merged, so any order and partitioning of rows gives the same types. Columns
    without a value stay text.
    """
    if not text.columns:
        return {}
    row = text.agg(*[F.bit_or(_lacking(c)).alias(f"m{i}") for i, c in enumerate(text.columns)]).collect()[0]
    out = {}
    for i, c in enumerate(text.columns):
        lacking = row[f"m{i}"] or 0
        out[c] = next((t for k, t in enumerate(TYPES) if lacking & ANY and not lacking >> k & 1), "string")
    return out


def _lacking(c: str) -> Column:
    """Bits of the types that a cell does not have, and one that there is a value; null for none."""
    v = F.col(quote(c))
    whole = v.rlike(r"^[+-]?[0-9]+$")
    day = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    moment = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9:]+)?$")
    has = (
        whole & v.try_cast("int").isNotNull(),
        whole & v.try_cast("bigint").isNotNull(),
        _number(c).isNotNull(),
        F.lower(v).isin("true", "false"),
        day & v.try_cast("date").isNotNull(),
        (day | moment) & v.try_cast("timestamp").isNotNull(),
    )
    bits = sum((F.when(h, 0).otherwise(1 << k) for k, h in enumerate(has)), F.lit(ANY))
    return F.when(v.isNotNull(), bits)


def _typed(c: str, kind: str) -> Column:
    if kind == "string":
        return F.col(quote(c))
    return _number(c) if kind == "double" else F.col(quote(c)).try_cast(kind)


def _number(c: str):
    v = F.col(quote(c))
    text = F.lower(F.trim(v))
    inf = F.lit(float("inf"))
    return F.when(text.isin("inf", "+inf", "infinity"), inf).when(text.isin("-inf", "-infinity"), -inf).otherwise(
        v.try_cast("double")
    )


def fold_tokens(df: DataFrame) -> DataFrame:
    """Text cells that spell a missing value become NULL; other text is trimmed."""
    cols = []
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        if isinstance(f.dataType, T.StringType):
            c = F.when(~F.trim(c).isin(MISSING_TOKENS), F.trim(c)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def fold_missing_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL; infinities stay until cleaning, which may want to count them."""
    cols = []
    for f in df.schema.fields:
        c = F.col(quote(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """A file, or every file below a directory, stacked by name; None with a warning when there is nothing."""
    if not exists(spark, path):
        log.warning("path %s not found, skipped", path)
        return None
    tables = []
    for fmt, files in list_formats(spark, path).items():
        if fmt == "parquet":
            tables.append(trim_names(spark.read.option("mergeSchema", True).parquet(*files)))
        elif schema is not None:
            tables.append(read_csv(spark, files, schema))
        else:
            # files with one header share a scan; others are stacked by name
            tables += [read_csv(spark, group) for group in files_by_header(spark, files)]
    return union_tables(tables) if tables else None


HEAD_BYTES = 1 << 16


def heads(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """First line of each file, from the first bytes of the files alone; files without one are left out."""

    def head(path: str) -> str:
        target, fs = _fs(spark, path)
        stream = fs.open(target)
        try:
            line = bytearray()
            while b"\n" not in line:
                part = bytes(stream.readNBytes(HEAD_BYTES))
                if not part:
                    break
                line += part
        finally:
            stream.close()
        return line.split(b"\n", 1)[0].decode("utf-8-sig", "replace").rstrip("\r")

    with ThreadPoolExecutor(16) as pool:
        found = dict(zip(files, pool.map(head, files)))
    return {path: line for path, line in found.items() if line.strip()}


def files_by_header(spark: SparkSession, files: list[str]) -> list[list[str]]:
    """Files grouped by their first line; empty files are left out."""
    groups: dict[str, list[str]] = {}
    for path, line in sorted(heads(spark, files).items()):
        groups.setdefault(line, []).append(path)
    return [groups[line] for line in sorted(groups)]


def row_ids(df: DataFrame) -> DataFrame:
    """Add ``row_id`` to a Parquet scan: number of the file in name order, then position in the file.

    Unique and the same for every partitioning; read without a shuffle as long as
    the file names fit a broadcast of ``SMALL_BYTES``. 2^22 files of 2^41 rows fit.
    """
    # both sides spell the scheme with one slash
    files = sorted(re.sub(r"^(\w+):/+", r"\1:/", f) for f in df.inputFiles())
    if len(files) > 1 << 22:
        raise ValueError(f"{len(files)} files; compact the table first")
    numbers = df.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "__file string, __no bigint")
    name = F.regexp_replace("_metadata.file_path", r"^(\w+):/+", "$1:/")
    placed = df.select("*", name.alias("__file"), F.col("_metadata.row_index").alias("__pos"))
    joined = attach(placed, (numbers, sum(map(len, files)) <= SMALL_BYTES), ["__file"])
    row_id = F.shiftleft("__no", 41).bitwiseOR(F.col("__pos"))
    return joined.withColumn("row_id", row_id).drop("__file", "__no", "__pos")


def land(df: DataFrame, path: str) -> DataFrame:
    """Write a table as Parquet once and read it back with row ids; for CSV and other scans that have none."""
    df.drop("row_id").write.mode("overwrite").parquet(path)
    return row_ids(df.sparkSession.read.parquet(path))


@dataclass(frozen=True)
class SubFile:
    """One input of a dataset: label by column, or one class for the whole file or directory."""

    path: str
    label_column: str | None = None
    benign: tuple[str, ...] = ()
    label_mapping: dict[str, str] = field(default_factory=dict)
    attack_type: str | None = None
    is_benign: bool | None = None
    schema: str | None = None


def load_dataset(
    spark: SparkSession, subfiles: list[SubFile], features: dict[str, str] | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Read, label and stack the inputs of a dataset, then project to the shared feature names."""
    parts = []
    for s in subfiles:
        df = read_any(spark, s.path, s.schema)
        if df is None:
            continue
        if s.label_column is not None:
            parts.append(label_from_column(df, s.label_column, list(s.benign), s.label_mapping, drop=True))
        else:
            parts.append(label_static(df, s.attack_type or "benign", s.is_benign))
    if not parts:
        raise NoDataLoaded("none of the configured inputs could be loaded")
    stacked = union_tables(parts)
    return feature_mapping(stacked, features, keep) if features else stacked


def load_packets_as_flows(packets: DataFrame, windows: list[TimeWindow] | None = None, **options) -> DataFrame:
    """Decoded packets to labelled flows: by time windows if there are any, else all benign.

    ``options`` are those of ``assemble_flows``. An empty result only warns.
    """
    flows = assemble_flows(packets, **options)
    if flows.isEmpty():
        log.warning("no flows found")
    if not windows:
        return label_static(flows, "BENIGN")
    started = flows.withColumn("flow_start", F.timestamp_millis("bidirectional_first_seen_ms"))
    src, dst = options["src"][0], options["dst"][0]
    return label_time_windows(started, windows, "flow_start", src, dst, out="Label")
