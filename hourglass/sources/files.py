"""Landed files to rows: discovery, CSV with null tokens, year pruning, wide hour columns to long."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cleaning import dedupe
from ..operators.lineage import shared_folder

# Tokens read as missing, archive headers and their canonical names.
NULL_TOKENS = ("NA", "na", "N/A", "n/a", "--", "")
ARCHIVE_COLUMNS = {
    "Timestamp": "ts",
    "PM2.5 (µg/m³)": "pm25",
    "PM10 (µg/m³)": "pm10",
    "NO (µg/m³)": "no_ugm3",
    "NO2 (µg/m³)": "no2_ugm3",
    "NOx (ppb)": "nox_ppb",
    "NH3 (µg/m³)": "nh3_ugm3",
    "SO2 (µg/m³)": "so2_ugm3",
    "CO (mg/m³)": "co_mgm3",
    "Ozone (µg/m³)": "ozone_ugm3",
    "Benzene (µg/m³)": "benzene_ugm3",
    "Toluene (µg/m³)": "toluene_ugm3",
    "Xylene (µg/m³)": "xylene_ugm3",
    "O Xylene (µg/m³)": "o_xylene_ugm3",
    "Eth-Benzene (µg/m³)": "eth_benzene_ugm3",
    "MP-Xylene (µg/m³)": "mp_xylene_ugm3",
    "AT (°C)": "temp_c",
    "RH (%)": "rh_pct",
    "WS (m/s)": "ws_ms",
    "WD (deg)": "wd_deg",
    "RF (mm)": "rf_mm",
    "TOT-RF (mm)": "tot_rf_mm",
    "SR (W/mt2)": "sr_wm2",
    "BP (mmHg)": "bp_mmhg",
    "VWS (m/s)": "vws_ms",
}


def discover(spark: SparkSession, root: str, *, pattern: str = "*") -> DataFrame:
    """Files under ``root`` with extension and the first path part below it as entity folder.

    The listing is the binary-file source without its content, so nothing is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "modificationTime", "length")
    tail = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1), "^/+", "")
    return files.select("path", F.split(tail, "/")[0].alias("entity"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), "length")


def read_csv(spark: SparkSession, path: str | list[str], columns: Mapping[str, str] = ARCHIVE_COLUMNS, *, text: Sequence[str] = ("ts",), recursive: bool = True) -> DataFrame:
    """CSV with a header: known columns renamed, the rest dropped, null tokens and unreadable numbers missing.

    Every column is read as text in one scan and cast once; ``source_file`` and ``file_order`` (file, block, row) keep file
    order available for keep-last rules. A known column absent from the header is NULL.
    """
    raw = spark.read.option("header", True).option("recursiveFileLookup", recursive).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)
    have = set(raw.columns)

    def cell(source: str, name: str):
        if source not in have:
            return F.lit(None).cast("string" if name in text else "double").alias(name)
        value = F.trim(F.col(f"`{source}`"))
        value = F.when(value.isin(*NULL_TOKENS), None).otherwise(value)
        return (value if name in text else value.try_cast("double")).alias(name)

    # scan partitions are packed by size, so the row number alone is no file order
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lineage = [F.col("_metadata.file_path").alias("source_file"), place.alias("file_order")]
    return raw.select(*[cell(s, n) for s, n in columns.items()], *lineage)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Raise when an expected column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_years(spark: SparkSession, path: str, years: Sequence[int], keys: Sequence[str], *, order: str = "file_order") -> DataFrame:
    """Parquet partitioned by ``year``: only the asked partitions are listed, then the last row per key is kept."""
    rows = spark.read.parquet(path).where(F.col("year").isin(*[int(y) for y in years]))
    return dedupe(require_columns(rows, [*keys, order]), keys, [order])


def read_range(spark: SparkSession, path: str, ts: str, first: str, last: str) -> DataFrame:
    """Inclusive time range, written so that the comparison reaches the parquet scan."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (first, last))
    return spark.read.parquet(path).where((F.col(ts) >= lo) & (F.col(ts) <= hi))


def wide_hours_to_long(df: DataFrame, day: str, hours: Sequence[str], file: str, *, value: str = "value", ts: str = "ts") -> DataFrame:
    """One row per day and 24 hour columns to one row per hour.

    Year and month come from the file name, the day from a cell (a trailing ``.0`` is stripped), the hour from the column
    name. A date that does not exist gives a NULL time, which callers count and drop.
    """
    cells = F.array(*[F.struct(F.lit(h).alias("__hour"), F.col(f"`{h}`").cast("string").alias("__v")) for h in hours])
    long = df.select(file, F.col(day).cast("string").alias("__day"), F.inline(cells))
    year, month = (F.regexp_extract(F.col(file), r"_(20\d{2})_([A-Za-z]+)_", i) for i in (1, 2))
    clean_day = F.regexp_replace("__day", r"\.0$", "")
    text = F.concat_ws(" ", F.concat_ws("-", year, month, F.lpad(clean_day, 2, "0")), F.col("__hour"))
    stamp = F.try_to_timestamp(text, F.lit("yyyy-MMMM-dd HH:mm:ss")).cast("timestamp_ntz")
    number = F.when(F.col("__v").isin(*NULL_TOKENS), None).otherwise(F.col("__v")).try_cast("double")
    return long.select(file, stamp.alias(ts), number.alias(value)).where(F.col(value).isNotNull())


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
