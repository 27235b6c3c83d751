"""Type normalisation of an all-text table.

The reference decides each column's type from the first 10 / 20 non-null
cells, in row order, one column at a time.  A Spark table has no row
order, so the gates use whole-column ratios with the same strict
thresholds.  All ratios for all columns come from **one** aggregation
(one scan); its single result row is the only thing brought to the driver
and it chooses one ``select`` of casts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Anchored prefix patterns of the date gate.
DATE_PREFIXES = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",   # yyyy-mm-dd
    r"^[0-9]{2}/[0-9]{2}/[0-9]{4}",   # mm/dd/yyyy
    r"^[0-9]{2}-[0-9]{2}-[0-9]{4}",   # dd-mm-yyyy
    r"^[0-9]{4}/[0-9]{2}/[0-9]{2}",   # yyyy/mm/dd
)
# Shapes of the date part of a cell and the parse formats each may stand for.
# On equal success counts the earlier format wins: month before day.
_MONTH = "(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
DATE_FORMATS = (
    ("yyyy-M-d", "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"),
    ("M/d/yyyy", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"),
    ("d/M/yyyy", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"),
    ("M-d-yyyy", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"),
    ("d-M-yyyy", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"),
    ("yyyy/M/d", "[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"),
    ("MMM d yyyy", _MONTH + "[a-z]* [0-9]{1,2},? [0-9]{4}"),
    ("d MMM yyyy", "[0-9]{1,2} " + _MONTH + "[a-z]* [0-9]{4}"),
    ("yyyyMMdd", "[0-9]{8}"),
)
# A time of day after the date (kept out of the parse: only the date is used).
_TIME = r"(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?: ?(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?)?"


def parse_date(x, j: int):
    """Cell -> date with format ``j``; NULL when it does not parse.  A cell is
    parsed only if its shape fits (the parse still validates the values)."""
    fmt, shape = DATE_FORMATS[j]
    day = F.regexp_extract(x, rf"^\s*({shape}){_TIME}\s*$", 1)
    if "MMM" in fmt:   # first three letters of the month, in the parser's case; no comma
        day = F.initcap(F.regexp_replace(F.regexp_replace(day, f"({_MONTH})[A-Za-z]*", "$1"), ",", ""))
    return F.when(day != "", F.try_to_timestamp(day, F.lit(fmt)).cast("date"))


# A plain signed decimal with optional exponent and outer blanks, or inf.
# Spark's cast also takes '1d' / '5f', which the reference rejects, so the
# regex guards the cast.
NUMBER_RE = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)\s*$"
INTEGER_RE = r"^\s*[+-]?[0-9]+\s*$"
TEXT_BLANKS = ("nan", "None")   # whole-cell text replaced by ''
DATE_GATE, DATE_ACCEPT, NUMBER_GATE, NUMBER_ACCEPT = 0.5, 0.5, 0.8, 0.8


@dataclass
class ColumnDecision:
    column: str
    kind: str            # date | long | double | text | empty
    fmt: str | None
    non_null: int
    rows: int


def _c(name):
    return F.col(f"`{name}`")


def profile_columns(df: DataFrame) -> DataFrame:
    """The one aggregation behind N1: per column counts of non-nulls, date
    prefix matches, parses per date format, numeric and integer cells."""
    prefix = "|".join(f"({p})" for p in DATE_PREFIXES)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        x = _c(c)
        aggs += [F.count(x).alias(f"nn{i}"),
                 F.count_if(x.rlike(prefix)).alias(f"dp{i}"),
                 F.count_if(x.rlike(NUMBER_RE)).alias(f"num{i}"),
                 F.count_if(x.rlike(INTEGER_RE) & F.trim(x).try_cast("bigint").isNotNull())
                  .alias(f"int{i}")]
        aggs += [F.count(parse_date(x, j)).alias(f"d{i}_{j}") for j in range(len(DATE_FORMATS))]
    return df.agg(*aggs)


def decide(df: DataFrame) -> list[ColumnDecision]:
    row = profile_columns(df).first().asDict()
    rows = row["rows"]
    out = []
    for i, c in enumerate(df.columns):
        nn = row[f"nn{i}"]
        if nn == 0:
            out.append(ColumnDecision(c, "empty", None, 0, rows))
            continue
        if "date" in c.lower() or row[f"dp{i}"] / nn > DATE_GATE:
            best = max(range(len(DATE_FORMATS)), key=lambda j: (row[f"d{i}_{j}"], -j))
            if rows and row[f"d{i}_{best}"] / rows > DATE_ACCEPT:
                out.append(ColumnDecision(c, "date", DATE_FORMATS[best][0], nn, rows))
                continue
        if row[f"num{i}"] / nn > NUMBER_GATE and row[f"num{i}"] / rows > NUMBER_ACCEPT:
            kind = "long" if row[f"int{i}"] == rows else "double"
            out.append(ColumnDecision(c, kind, None, nn, rows))
            continue
        out.append(ColumnDecision(c, "text", None, nn, rows))
    return out


def normalize(df: DataFrame, fill: bool = True, decisions: list[ColumnDecision] | None = None
              ) -> DataFrame:
    """Apply the per-column decision in one projection.

    dates -> DateType (NULL when unparsed), numbers -> bigint / double
    (unparsed and missing -> 0 with ``fill``), text -> '' for missing and
    whole-cell 'nan' / 'None' with ``fill``; an all-missing column is ''
    (fill) or NULL.  ``fill=False`` keeps NULLs so later checks see them."""
    decisions = decisions or decide(df)
    cols = []
    for d in decisions:
        x = _c(d.column)
        if d.kind == "empty":
            e = F.lit("") if fill else F.lit(None).cast("string")
        elif d.kind == "date":
            e = parse_date(x, [f for f, _ in DATE_FORMATS].index(d.fmt))
        elif d.kind in ("long", "double"):
            e = F.when(x.rlike(NUMBER_RE), F.trim(x).try_cast("bigint" if d.kind == "long" else "double"))
            if fill:
                e = F.coalesce(e, F.lit(0).cast("bigint" if d.kind == "long" else "double"))
        else:
            e = F.when(~x.isin(*TEXT_BLANKS), x)
            if fill:
                e = F.coalesce(e, F.lit(""))
            else:
                e = F.when(x.isin(*TEXT_BLANKS), F.lit("")).otherwise(x)
        cols.append(e.alias(d.column))
    return df.select(*cols)


def decisions_frame(spark, decisions: list[ColumnDecision]) -> DataFrame:
    return spark.createDataFrame(
        [(d.column, d.kind, d.fmt, d.non_null, d.rows) for d in decisions],
        "column string, kind string, format string, non_null bigint, rows bigint")
