"""Keywords of a source type with their projects, and the mentions that highlights of them make."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import trimmed

# Fixed values.
NEWS_SOURCE_TYPE = 10
TEXT_COLUMNS = ("name", "keyword", "title", "value", "text", "word")
FORBIDDEN = ("update", "delete", "drop", "truncate", "alter", "create", "grant", "revoke", "merge", "replace")
RESULT_COLUMNS = {
    "media_results": ("source_type", "project_id", "result_id", "author", "date", "title", "content", "url", "status", "created_at"),
    "media_result_keywords": ("keyword_id", "keyword_name", "source_type", "project_id", "result_id", "score", "active", "created_at"),
}


def keywords_for_source(keyword: DataFrame, links: DataFrame, projects: DataFrame, source_type: int = NEWS_SOURCE_TYPE) -> DataFrame:
    """keyword_id, text, project_ids of keywords (id, name) linked (keyword_id, source_type_id) to the source type.

    Blank keywords go; those without a project (keyword_id, project_id) have an empty list.
    """
    own = links.filter(F.col("source_type_id") == source_type).join(keyword, F.col("keyword_id") == F.col("id")).select("keyword_id", "name").filter(F.trim("name") != "")
    of = projects.groupBy("keyword_id").agg(F.sort_array(F.collect_list("project_id")).alias("project_ids"))
    return own.join(of, "keyword_id", "left").select("keyword_id", F.trim("name").alias("text"), F.coalesce("project_ids", F.array().cast(of.schema["project_ids"].dataType)).alias("project_ids"))


def without_repeats(keywords: DataFrame) -> DataFrame:
    """Keywords that differ in case only as one: the first by text and id gives both, the projects are united."""
    rows = keywords.groupBy(F.lower("text").alias("key")).agg(F.min(F.struct("text", "keyword_id")).alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("project_ids")))).alias("project_ids"))
    return rows.select("first.keyword_id", "first.text", "project_ids")


def mentions(highlights: DataFrame, keywords: DataFrame) -> DataFrame:
    """A row for each document, page, keyword and project behind it."""
    pages = highlights.select("document_id", "page_number", "keyword_id").distinct()
    return pages.join(keywords, "keyword_id").select("document_id", "page_number", "keyword_id", F.explode("project_ids").alias("project_id"))


def skipped(highlights: DataFrame, keywords: DataFrame) -> DataFrame:
    """Documents none of whose keywords has a project."""
    some = keywords.filter(F.size("project_ids") > 0).select("keyword_id")
    named = highlights.select("document_id", "keyword_id").distinct()
    return named.select("document_id").distinct().join(named.join(some, "keyword_id", "left_semi"), "document_id", "left_anti").withColumn("reason", F.lit("no keyword found in it belongs to a project"))


def published(rows: int, reasons: list[str]) -> int:
    """rows, or an error with the first reason if none was made and some documents were skipped."""
    if not rows and reasons:
        raise ValueError(reasons[0])
    return rows


def resolved_column(df: DataFrame, candidates: tuple[str, ...] = TEXT_COLUMNS) -> str:
    """The first candidate that df has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {', '.join(candidates)} is among {', '.join(df.columns)}")


def column_type(df: DataFrame, column: str) -> str | None:
    return df.schema[column].dataType.simpleString() if column in df.columns else None


def is_textual(df: DataFrame, column: str) -> bool:
    return column in df.columns and isinstance(df.schema[column].dataType, (T.StringType, T.CharType, T.VarcharType))


def insertable(offered: DataFrame, target: DataFrame) -> tuple[DataFrame, list[str]]:
    """offered with only the columns that the target has, and the names of the others; an error if none fits."""
    fit = [c for c in offered.columns if c in target.columns]
    if not fit:
        raise ValueError(f"none of {', '.join(offered.columns)} is among {', '.join(target.columns)}")
    return offered.select(*fit), [c for c in offered.columns if c not in target.columns]


def schema_report(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """column_name, found: what of the wanted columns there is."""
    return df.sparkSession.createDataFrame([(c, c in df.columns) for c in wanted], "column_name string, found boolean")


def columns_of(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)], "ordinal int, column_name string, data_type string, is_nullable boolean")


def statement_error(sql: Column) -> Column:
    """Why a statement is refused, or null: only those that read or append may run."""
    bare = trimmed(F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " "))
    start = bare.rlike(r"(?i)^(select|with|insert)($|[^A-Za-z0-9_])")
    changes = bare.rlike(r"(?i)(^|[^A-Za-z0-9_])(" + "|".join(FORBIDDEN) + r")($|[^A-Za-z0-9_])")
    return F.when(~start, "not a read or an append").when(changes, "would modify rows")


def guarded_sql(spark, sql: str) -> DataFrame:  # noqa: ANN001
    """spark.sql for a statement that only reads or appends."""
    bare = re.sub(r"/\*[\s\S]*?\*/", " ", re.sub(r"--[^\n]*", " ", sql)).strip()
    if not re.match(r"(select|with|insert)\b", bare, re.I) or re.search(rf"\b({'|'.join(FORBIDDEN)})\b", bare, re.I):
        raise ValueError(f"refused: {bare[:60]}")
    return spark.sql(sql)


def result_bounds(results: DataFrame) -> DataFrame:
    return results.agg(F.max("result_id").alias("max_result_id"), F.count(F.lit(1)).alias("n"))
