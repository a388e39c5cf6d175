"""Price and factor files, as Spark reads them, and sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Price columns in order of preference, and the footer-free line format of the factor file.
PRICE_COLUMNS = ("adj_close", "Adj Close", "close", "Close")
FACTOR_COLUMNS = ("date", "mkt_rf", "smb", "hml", "rf")
CHART_SCHEMA = (
    "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<"
    "quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,"
    "adjclose:array<struct<adjclose:array<double>>>>>>>"
)


def load_prices(spark: SparkSession, root: str, tickers: list[str]) -> DataFrame | None:
    """(series_id, t, close) of cached files root/{ticker}.parquet or .csv, long form.

    A slash in a ticker is - in the name. A file that is missing, or has no
    price column, gives way to the next format, then the ticker is left out.
    The date is the column date or Date, or else the first. None if no ticker
    was found.
    """
    out = None
    for ticker in tickers:
        for kind in ("parquet", "csv"):
            path = f"{root}/{ticker.replace('/', '-')}.{kind}"
            try:
                df = spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True)
            except AnalysisException:
                continue
            price = next((c for c in PRICE_COLUMNS if c in df.columns), None)
            if price is None:
                continue
            date = next((c for c in ("date", "Date") if c in df.columns), df.columns[0])
            part = df.select(F.lit(ticker).alias("series_id"), F.to_date(F.col(f"`{date}`")).alias("t"), F.expr(f"try_cast(`{price}` AS DOUBLE)").alias("close"))
            out = part if out is None else out.unionByName(part)
            break
    return out


def parse_chart(payloads: DataFrame, value: str = "value") -> DataFrame:
    """Bars of landed chart payloads, one JSON text per row, with the other columns kept. Bars without any number are dropped; no adjusted closes: null."""
    chart = F.from_json(value, CHART_SCHEMA)["chart"]["result"][0]
    rest = [c for c in payloads.columns if c != value]
    df = payloads.select(*rest, chart.alias("_c"))
    quote = F.get("_c.indicators.quote", F.lit(0))
    adjusted = F.get("_c.indicators.adjclose", F.lit(0))["adjclose"]
    fields = ("open", "high", "low", "close", "volume")
    bars = F.arrays_zip(F.col("_c.timestamp").alias("ts"), *[quote[f].alias(f) for f in fields], F.coalesce(adjusted, F.array()).alias("adj_close"))
    df = df.select(*rest, F.explode(bars).alias("_b"))
    df = df.select(*rest, F.to_date(F.timestamp_seconds("_b.ts")).alias("date"), *[F.col(f"_b.{f}").alias(f) for f in (*fields, "adj_close")])
    return df.dropna(how="all", subset=[*fields, "adj_close"])


def parse_stooq(raw: DataFrame) -> DataFrame:
    """A daily CSV (read with header) with trimmed lower-case names and typed columns, in order of date. ValueError without a close."""
    names = [c.strip().lower() for c in raw.columns]
    if "close" not in names:
        raise ValueError("no close column")
    return raw.select(*[(F.to_date(F.col(f"`{c}`")) if n == "date" else F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(n) for c, n in zip(raw.columns, names, strict=True)]).orderBy("date")


def parse_factors(lines: DataFrame, value: str = "value") -> DataFrame:
    """Daily factors as parts of one from the lines of a factor file; preamble and footer lines do not begin with a date of 8 digits."""
    parts = F.split(F.col(value), ",")
    dated = lines.where(F.col(value).rlike(r"^\s*\d{8}\s*,"))
    number = lambda i: F.try_divide(F.expr(f"try_cast(trim(get(split({value}, ','), {i})) AS DOUBLE)"), F.lit(100.0))
    date = F.to_date(F.try_to_timestamp(F.trim(parts[0]), F.lit("yyyyMMdd")))
    return dated.select(date.alias("date"), *[number(i).alias(n) for i, n in enumerate(FACTOR_COLUMNS[1:], 1)])


def load_factors(spark: SparkSession, path: str) -> DataFrame:
    return parse_factors(spark.read.option("encoding", "ISO-8859-1").text(path))


def checksums(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """(file, bytes, sha256) of each file under a path.

    Spark lists the files and deals them out by size without reading them;
    each is read by a task in chunks, so it may have any size; Spark lists no
    empty files. Stores that
    pyarrow does not reach are read by Spark, a file as one value of a row
    (2 GB at most).
    """
    listed = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    first = listed.select("path").first()
    try:
        if first:
            pa.fs.FileSystem.from_uri(first["path"])
    except (pa.ArrowException, OSError, ValueError):
        return listed.select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for uri in b.column("path").to_pylist():
                system, place = pa.fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with system.open_input_stream(place) as stream:
                    while part := stream.read(chunk):
                        digest.update(part)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.string())], [*b.schema.names, "sha256"])

    found = listed.select("path", "length").mapInArrow(read, "path string, length long, sha256 string")
    return found.select(name, F.col("length").alias("bytes"), "sha256")


def save_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with header; arrays are joined by |."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).coalesce(1).write.mode("overwrite").csv(path, header=True)


def save_bars(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_notes(spark: SparkSession, notes: list[str], path: str) -> None:
    spark.createDataFrame([(n,) for n in notes], "value string").coalesce(1).write.mode("overwrite").text(path)
