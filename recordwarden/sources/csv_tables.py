"""Reading CSV exports of varying spelling into the conformed tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_id, clean_text, header_key
from ..functions.values import parse_date, parse_number
from ..model import (
    DATE_COLUMNS, HEADER_ALIASES, NUMBER_COLUMNS, OBJECT_TYPES, RAW_COPIES, CrmTables,
    column_type, table_schema, union_all,
)
from .csv_records import has_line_breaks, read_records
from .staging import staged

_CORRUPT = "_unparsed_row"


def resolve_headers(headers: Sequence[str], object_type: str) -> dict[str, int]:
    """Internal column -> position of the raw column that feeds it.

    The first accepted spelling present wins and a raw column is used once. Of
    headers that only differ in case or punctuation the last counts; of exact
    repetitions the first. An internal name is accepted as its own last spelling.
    """
    position: dict[str, int] = {}
    for i, header in enumerate(headers):
        if header not in headers[:i]:
            position[header_key(header)] = i
    resolved: dict[str, int] = {}
    for column, spellings in HEADER_ALIASES[object_type].items():
        hits = (position.get(header_key(s)) for s in (*spellings, column))
        for hit in hits:
            if hit is not None and hit not in resolved.values():
                resolved[column] = hit
                break
    return resolved


def _conformed(column: str, raw: Column | None, is_text: bool) -> Column:
    if column == "record_id":
        value = F.lit("") if raw is None else clean_id(raw)
    elif raw is None:
        value = F.lit(None)
    elif not is_text:
        value = raw
    elif column in DATE_COLUMNS:
        value = parse_date(raw)
    elif column in NUMBER_COLUMNS:
        value = parse_number(raw)
    else:
        value = clean_text(raw)
    return value.cast(column_type(column)).alias(column)


def conform(df: DataFrame, object_type: str, headers: Sequence[str] | None = None) -> DataFrame:
    """Rename, prune, add and type the columns of a table with export headers.

    Text is cleaned and parsed; columns that already are dates or numbers are
    taken over as they are.
    """
    headers = list(headers or df.columns)
    sources = {c: df.columns[i] for c, i in resolve_headers(headers, object_type).items()}
    types = dict(df.dtypes)

    def raw(column: str) -> Column | None:
        return _quoted(sources[column]) if column in sources else None

    columns = [
        _conformed(c, raw(c), types.get(sources.get(c)) == "string")
        for c in HEADER_ALIASES[object_type]
    ]
    copies = [
        (F.lit(None) if raw(c) is None else raw(c)).cast("string").alias(f"{c}_raw")
        for c in RAW_COPIES[object_type]
    ]
    return df.select(*columns, *copies)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def read_export(
    spark: SparkSession, path: str, object_type: str, *, multi_line: bool = True, check_rows: bool = True
) -> DataFrame:
    """Read a CSV file or directory and conform it.

    `multi_line` accepts line breaks inside quotes. A pass over the lines tells whether there are
    any; if so, records are put together from lines by many tasks, else every line is a record.
    Without `multi_line` such a line break stops the read, if rows are checked. `check_rows` fails on
    rows with more cells than the header; turning both off saves the pass and lets the parser skip
    unused columns. All files must share one header, which is verified per file.
    """
    broken = has_line_breaks(spark, path) if multi_line or check_rows else None
    if broken is not None and not multi_line:
        raise ValueError(f"line break inside quotes in {path}, read it with multi_line=True: {broken[:200]}")
    options = {"quote": '"', "escape": '"', "encoding": "UTF-8"}
    # Only the first record is taken.
    first = spark.read.options(header=False, multiLine=broken is not None, **options).csv(path).first()
    if first is None:
        raise ValueError(f"no header row in {path}")
    headers = ["" if h is None else h for h in first]
    if broken is not None:
        return conform(_parsed_records(spark, path, headers, check_rows), object_type, headers)

    distinct_names = {h.lower() for h in headers if h.strip()}
    as_written = len(distinct_names) == len(headers) and _CORRUPT not in distinct_names
    names = headers if as_written else [f"_c{i}" for i in range(len(headers))]
    fields = [T.StructField(n, T.StringType()) for n in names]
    if check_rows:
        fields.append(T.StructField(_CORRUPT, T.StringType()))
        # A parser that skips columns does not see surplus cells.
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "columnPruning": False}
    raw = spark.read.options(header=True, enforceSchema=not as_written, **options).schema(
        T.StructType(fields)
    ).csv(path)
    if check_rows:
        raw = _fail_on_extra_cells(raw, names, path)
    return conform(raw, object_type, headers)


def _fail_on_extra_cells(raw: DataFrame, names: list[str], path: str) -> DataFrame:
    """Short rows are filled with nulls; rows with additional cells stop the read.

    The test is a filter, so it runs whatever columns are read afterwards.
    """
    cells = ", ".join(f"c{i} STRING" for i in range(len(names) + 1))
    again = F.from_csv(F.col(_CORRUPT), cells, {"quote": '"', "escape": '"'})
    extra = F.col(_CORRUPT).isNotNull() & again[f"c{len(names)}"].isNotNull()
    # Spark refuses to read the raw row alone, so the message also names the first cell.
    first = F.coalesce(_quoted(names[0]), F.lit(""))
    message = F.concat(F.lit(f"row with more cells than the header in {path}, at '"), first, F.lit("': "), F.col(_CORRUPT))
    checked = F.when(extra, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return raw.where(checked).select(*[_quoted(n) for n in names])


def _parsed_records(spark: SparkSession, path: str, headers: list[str], check_rows: bool) -> DataFrame:
    """The cells `_c0`, `_c1` and so on of every record but the headers."""
    names = [f"_c{i}" for i in range(len(headers))]
    cells = ", ".join(f"{n} STRING" for n in [*names, "surplus"])
    parsed = F.from_csv("record", cells, {"quote": '"', "escape": '"'})
    other = F.lit(False)
    for name, header in zip(names, headers):
        other = other | (F.coalesce(F.regexp_replace(F.col(f"row.{name}"), "^\\uFEFF", ""), F.lit("")) != header)
    differs = F.raise_error(F.concat(F.lit("another header in "), "file", F.lit(": "), "record")).cast("boolean")
    keep = F.when(F.col("is_header"), F.when(other, differs).otherwise(F.lit(False))).otherwise(F.lit(True))
    if check_rows:
        message = F.concat(F.lit("row with more cells than the header in "), "file", F.lit(": "), "record")
        keep = F.when(~F.col("is_header") & F.col("row.surplus").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(keep)
    records = read_records(spark, path).withColumn("row", parsed)
    return records.where(keep).select(*[f"row.{n}" for n in names])


def empty_table(spark: SparkSession, object_type: str) -> DataFrame:
    return spark.createDataFrame([], table_schema(object_type))


def latest_activity(frames: Sequence[DataFrame]) -> DataFrame:
    """One row with the latest activity or creation date of any table.

    Close dates are forecasts and never move the reference date.
    """
    return union_all([
        f.agg(F.greatest(F.max("create_date"), F.max("last_activity_date")).alias("as_of"))
        for f in frames
    ]).agg(F.max("as_of").alias("as_of"))


def resolve_as_of(frames: Sequence[DataFrame], as_of: str | dt.datetime | None = None) -> dt.datetime:
    """The given date, else the latest one in the data, else today."""
    if as_of is not None:
        return as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
    latest = latest_activity(frames).first()[0]
    return latest or dt.datetime.combine(dt.date.today(), dt.time())


def load_crm(
    spark: SparkSession,
    contacts: str | None = None,
    companies: str | None = None,
    deals: str | None = None,
    as_of: str | dt.datetime | None = None,
    **read_options: bool,
) -> CrmTables:
    """Load any subset of the three exports; absent ones become empty tables.

    An export is parsed once, into the shared staging folder: the reference date and every check
    read the conformed table from there.
    """
    frames = [
        empty_table(spark, o) if path is None else staged(read_export(spark, path, o, **read_options), o)
        for o, path in zip(OBJECT_TYPES, (contacts, companies, deals))
    ]
    return CrmTables(*frames, as_of=resolve_as_of(frames, as_of))
