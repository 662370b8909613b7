"""Writers: exports of tables as text, and what makes their cells safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_safe(cell: Column) -> Column:
    """Put an apostrophe before text that a spreadsheet would run as a formula."""
    return F.when(F.ltrim(cell).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def write_csv(df: DataFrame, path: str) -> None:
    """Write as CSV with a header and formulas disarmed in all text columns."""
    cells = [csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*cells).write.mode("overwrite").option("header", True).csv(path)


def append_audit(entries: DataFrame, path: str) -> None:
    """Append entries as JSON lines; a run that fails leaves nothing behind."""
    entries.write.mode("append").json(path)


def export_audit(entries: DataFrame, path: str, form: str = "json") -> int:
    """Write entries as ``json`` lines or ``csv``; returns how many."""
    if form not in ("json", "csv"):
        raise ValueError(f"unknown form {form}")
    writer = entries.write.mode("overwrite")
    (writer.json if form == "json" else writer.option("header", True).csv)(path)
    return entries.sparkSession.read.schema(entries.schema).format(form).options(header=True).load(path).count()


def prometheus_lines(metrics: DataFrame) -> DataFrame:
    """Text exposition of ``metrics(name, labels, value)``, one line a sample."""
    return metrics.select(F.concat("name", F.lit("{"), "labels", F.lit("} "), F.col("value").cast("string")).alias("line"))


def export_report(rows: DataFrame, path: str, form: str) -> None:
    """Write a report's rows as lines of ``json``, ``text`` (numbers to the right) or ``html`` (rows of a table, with its marks escaped)."""
    names = rows.columns
    if form == "json":
        line = F.to_json(F.struct(*names))
    elif form == "html":
        escaped = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(escaped(c), F.lit("")), F.lit("</td>")) for c in names], F.lit("</tr>"))
    elif form == "text":
        first, *rest = names
        cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        numbers = [c for c in rest if dict(rows.dtypes)[c] in ("bigint", "int", "double")]
        widths = dict(zip(numbers, (12, *[20] * len(numbers))))
        line = F.concat(F.rpad(cell(first), 20, " "), *[F.lpad(cell(c), widths[c], " ") for c in numbers], F.lit("  "), F.concat_ws(" to ", *[cell(c) for c in rest if c not in numbers]))
    else:
        raise ValueError(f"unknown form {form}")
    rows.select(line.alias("value")).write.text(path)
