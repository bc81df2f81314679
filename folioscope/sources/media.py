"""Kinds of uploads, frames of videos, image headers, binary files and stores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
OFFICE = (".doc", ".docx", ".odt", ".rtf", ".xls", ".xlsx", ".ods", ".ppt", ".pptx", ".odp")
IMAGE = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff", ".bmp", ".gif", ".avif", ".heic", ".heif")
VIDEO = (".mp4", ".mov", ".m4v", ".webm", ".mkv", ".avi", ".mpeg", ".mpg", ".3gp")
DOCUMENT_TYPES = (
    "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.oasis.opendocument.text", "application/rtf", "text/rtf", "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.oasis.opendocument.spreadsheet",
    "application/vnd.ms-powerpoint", "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.oasis.opendocument.presentation",
)
INTERVAL, MOST_FRAMES = 1.0, 3600


def extension(name: Column) -> Column:
    """The last extension, in lower case, of a name that doesn't begin with it."""
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]*)$", 1))


def is_image(name: Column, mime: Column) -> Column:
    return extension(name).isin(*IMAGE) | mime.startswith("image/")


def is_video(name: Column, mime: Column) -> Column:
    return extension(name).isin(*VIDEO) | mime.startswith("video/")


def needs_conversion(name: Column) -> Column:
    return extension(name).isin(*OFFICE)


def accepted(name: Column, mime: Column) -> Column:
    return extension(name).isin(".pdf", *OFFICE) | mime.isin(*DOCUMENT_TYPES) | is_image(name, mime) | is_video(name, mime)


def kind(name: Column, mime: Column) -> Column:
    return F.when(is_video(name, mime), "video").when(is_image(name, mime), "image").otherwise("document")


def frame_plan(videos: DataFrame, interval: float = INTERVAL, most: int = MOST_FRAMES) -> DataFrame:
    """document_id, frame, timestamp_s of videos (document_id, duration_s); those with too many frames are left out."""
    rows = videos.withColumn("__n", F.ceil(F.col("duration_s") / interval).cast("int")).filter((F.col("__n") >= 1) & (F.col("__n") <= most))
    return rows.select("document_id", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("frame")).withColumn("timestamp_s", (F.col("frame") - 1) * F.lit(interval))


def page_size_points(width: Column, height: Column, dpi: Column) -> Column:
    """struct(width, height) in points of an image's page."""
    return F.struct((width * 72 / dpi).alias("width"), (height * 72 / dpi).alias("height"))


def _jpeg_size(data: bytes | None) -> tuple[int | None, int | None]:
    """(height, width) of the first start-of-frame marker."""
    at = 2
    if not data or data[:2] != b"\xff\xd8":
        return None, None
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 7 : at + 9], "big")
        at += 2 if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None, None


@F.pandas_udf(T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType())]))
def jpeg_size(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([_jpeg_size(x) for x in part], columns=["height", "width"]).astype("Int32")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of files in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def parsed(found: DataFrame, parser, schema: str) -> DataFrame:  # noqa: ANN001
    """Rows that a parser makes of files: parser(path, content) gives rows of the schema, a page at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for rows in parser(path, content):
                    yield pd.DataFrame(rows, columns=names)

    return found.mapInPandas(read, schema)


def is_remote(key: Column) -> Column:
    """Whether a storage key is an object store's."""
    return key.contains("/")


def public_url(base: str, key: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), key)


def jdbc_table(spark: SparkSession, url: str, name: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database; partition: (column, lower bound, upper bound, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if partition:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def append_table(rows: DataFrame, url: str, name: str, **options: str) -> None:
    """Appends rows to a table of a database, in one job."""
    rows.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode("append").save()


def publish_table(rows: DataFrame, url: str, name: str, run: str, marks: str = "published_runs", **options: str) -> bool:
    """Rows come into a table of a database all together or not at all, once for each run; gives whether this call did it.

    Tasks write into a table of the run's own, which a later try replaces. One transaction then takes all of its rows over and
    notes the run in `marks` (run_id, its key), so a job that dies before leaves nothing in the table, a run that is noted
    changes nothing more, and of two jobs that publish the same run at once one fails as a whole.
    """
    if not re.fullmatch(r"[A-Za-z0-9_]{1,40}", run) or not all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", x) for x in (name, marks)):
        raise ValueError("a run has letters, digits and underscores, a table's name dots too")
    spark, aside = rows.sparkSession, f"{name}_run_{run}"
    properties = spark._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        said = connection.createStatement()
        if not connection.getMetaData().getTables(None, None, marks.upper(), None).next() and not connection.getMetaData().getTables(None, None, marks, None).next():
            said.execute(f"CREATE TABLE {marks} (run_id VARCHAR(40) NOT NULL PRIMARY KEY)")
            connection.commit()
        if said.executeQuery(f"SELECT run_id FROM {marks} WHERE run_id = '{run}'").next():
            return False
        connection.commit()
        rows.write.format("jdbc").option("url", url).option("dbtable", aside).options(**options).mode("overwrite").save()
        columns = ", ".join(f'"{c}"' for c in rows.columns)
        try:
            said.execute(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {aside}")
            said.execute(f"INSERT INTO {marks} (run_id) VALUES ('{run}')")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        said.execute(f"DROP TABLE {aside}")
        connection.commit()
        return True
    finally:
        connection.rollback()
        connection.close()
