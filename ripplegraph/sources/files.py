"""File readers with checked schemas: JSON lines, strict or tolerant, Parquet, and dated rows of a text file."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the malformed ones."""
    wide = StructType([*StructType.fromDDL(schema).fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet whose columns must be those of `schema`, by name and type; others are an error."""
    df, want = spark.read.parquet(path), StructType.fromDDL(schema)
    have = {f.name: f.dataType for f in df.schema}
    bad = [f.name for f in want if have.get(f.name) != f.dataType]
    if bad:
        raise ValueError(f"columns missing or of another type: {', '.join(bad)}")
    return df.select(*want.names)


def read_dated_csv(spark: SparkSession, path: str, columns: list[str], scale: float = 100.0) -> DataFrame:
    """date and the given columns of the lines that begin with an eight-digit date, percentages scaled; headers and notes go."""
    c = F.split(F.col("value"), r"\s*,\s*")
    rows = spark.read.text(path).where(F.regexp_like("value", F.lit(r"^\s*\d{8}\s*,")))
    return rows.select(F.to_date(F.trim(c[0]), "yyyyMMdd").alias("date"), *[(c[i + 1].try_cast("double") / scale).alias(n) for i, n in enumerate(columns)])


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


class _Cells(HTMLParser):
    """The tables of a page as lists of rows of cell texts."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self._open: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self._open = []

    def handle_data(self, data: str) -> None:
        if self._open is not None:
            self._open.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self._open is not None:
            self.tables[-1][-1].append(" ".join("".join(self._open).split()))
            self._open = None


def table_rows(html: str | None, columns: dict[str, str]) -> list[dict[str, str]]:
    """The rows of each table whose first row has every header asked for (header -> name, case free), keyed by name; short rows go."""
    parser = _Cells()
    parser.feed(html or "")
    out = []
    for rows in parser.tables:
        head = [c.lower() for c in rows[0]] if rows else []
        if all(h.lower() in head for h in columns):
            at = {name: head.index(h.lower()) for h, name in columns.items()}
            out += [{name: r[i] for name, i in at.items()} for r in rows[1:] if len(r) > max(at.values())]
    return out


def html_tables(pages: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """key and the named columns of the rows of the tables in the pages' html, a page at a time in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, r) for k, html in zip(pdf[key], pdf["html"]) for r in table_rows(html, columns)]
            yield pd.DataFrame({key: [k for k, _ in found], **{n: pd.Series([r[n] for _, r in found], dtype=object) for n in columns.values()}})

    kind = dict(pages.dtypes)[key]
    return pages.select(key, "html").mapInPandas(run, ", ".join([f"{key} {kind}", *[f"{n} string" for n in columns.values()]]))


def read_factor_archive(spark: SparkSession, path: str, columns: list[str], scale: float = 100.0) -> DataFrame:
    """date and the columns from the text files in zip archives: the first block of lines that begin with an eight-digit date; what follows that block goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        inside = False
                        for line in z.read(name).decode("utf-8", "replace").splitlines():
                            dated = line.split(",")[0].strip().isdigit() and len(line.split(",")[0].strip()) == 8
                            if inside and not dated:
                                break
                            inside = dated
                            if dated:
                                lines.append(line)
            yield pd.DataFrame({"value": pd.Series(lines, dtype=object)})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")
    c = F.split(F.col("value"), r"\s*,\s*")
    return rows.select(F.to_date(F.trim(c[0]), "yyyyMMdd").alias("date"), *[(c[i + 1].try_cast("double") / scale).alias(n) for i, n in enumerate(columns)])


def swap_table(df: DataFrame, path: str) -> None:
    """Replace the Parquet table at the path by the rows of df, which may have been read from it: written beside it, then put in its place."""
    spark = df.sparkSession
    made, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(made)
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(to(path))
    if had and not fs.rename(to(path), to(old)) or not fs.rename(to(made), to(path)):
        raise OSError(f"could not put the new table in place at {path}")
    if had:
        fs.delete(to(old), True)
