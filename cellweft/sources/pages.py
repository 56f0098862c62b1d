"""Landed JSON feature pages: scan, envelope check, page-set audit, features as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweft.constants import MAX_PAGES
from cellweft.errors import DataError
from cellweft.session import scratch_path

# Variants keep odd types inside a page from spoiling the whole page.
PAGE_SCHEMA = T.StructType([
    T.StructField("page", T.VariantType()),
    T.StructField("exceededTransferLimit", T.VariantType()),
    T.StructField("error", T.VariantType()),
    T.StructField("features", T.VariantType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def read_pages(spark: SparkSession, path: str, multi_line: bool = True, source: str | None = None) -> DataFrame:
    """One row per page with its source, number, flags, items and the first thing wrong with it.

    The page number is the page's own ``page`` field, else the last digits of the file name.
    """
    reader = spark.read.schema(PAGE_SCHEMA).option("multiLine", multi_line)
    pages = reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    named = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1).try_cast("int")
    items = _items(F.col("features"))
    problem = (
        F.when(F.col("_corrupt_record").isNotNull(), "not a JSON object")
        .when(_is_object(F.col("error")), "error envelope")
        .when(items.isNull(), "no features list")
        .when(F.exists(items, lambda f: ~_is_object(f)), "feature is not an object")
    )
    return pages.select(
        (F.lit(source) if source else F.lit("pages")).alias("source"),
        F.coalesce(F.try_variant_get("page", "$", "int"), named).alias("arrival_page"),
        F.col("_metadata.file_path").alias("arrival_file"),
        F.coalesce(F.try_variant_get("exceededTransferLimit", "$", "boolean"), F.lit(False)).alias("exceeded"),
        items.alias("items"),
        F.try_variant_get("error", "$.code", "string").alias("error_code"),
        problem.alias("problem"),
    )


def envelope_report(pages: DataFrame) -> DataFrame:
    """Pages per problem; good pages have the problem 'none'."""
    problem = F.coalesce(F.col("problem"), F.lit("none")).alias("problem")
    return pages.groupBy(problem).agg(F.count("*").alias("pages"))


def require_good_pages(pages: DataFrame) -> DataFrame:
    """The pages themselves, once none has a problem."""
    bad = pages.filter(F.col("problem").isNotNull()).groupBy("problem").count().limit(4).collect()
    if bad:
        raise DataError("bad pages: " + ", ".join(f"{row['problem']} x{row['count']}" for row in bad))
    return pages


def watch_pages(pages: DataFrame) -> tuple[DataFrame, Observation]:
    """The pages, and a count of bad ones taken while the next action reads them.

    This saves parsing all pages once more just to check them.
    """
    seen = Observation()
    return pages.observe(seen, F.count_if(F.col("problem").isNotNull()).alias("bad")), seen


def require_watched(seen: Observation) -> None:
    """Raise when the action that read the watched pages met a bad one."""
    if seen.get["bad"]:
        raise DataError(f"bad pages: {seen.get['bad']}")


def page_features(pages: DataFrame) -> DataFrame:
    """One row per feature, with the fields the event steps need and its arrival order."""
    good = pages.filter(F.col("problem").isNull())
    rows = good.select("arrival_page", "arrival_file", F.posexplode("items").alias("arrival_position", "_f"))

    def attribute(name: str, kind: str) -> Column:
        return F.try_variant_get("_f", f"$.attributes.{name}", kind).alias(name)

    return rows.select(
        attribute("objectid", "variant"),
        *[attribute(c, "string") for c in ("reqtype", "req_type", "request_type", "category")],
        attribute("createddate", "variant"),
        F.try_variant_get("_f", "$.geometry.x", "string").alias("x"),
        F.try_variant_get("_f", "$.geometry.y", "string").alias("y"),
        F.try_variant_get("_f", "$.geometry", "map<string,variant>").isNotNull().alias("has_geometry"),
        "arrival_page", "arrival_file", "arrival_position",
    )


def page_audit(pages: DataFrame, page_size: int, max_pages: int = MAX_PAGES) -> DataFrame:
    """Per source: pages, features, whether any page was cut off, pages that repeat the one
    before, whether a page follows the last one, and whether the page cap was passed.

    Consecutive pages meet in an equi-join on the page number, not in one long window. The pages are parsed once: their
    facts, a short row each, are written for both sides of the join.
    """
    facts = pages.select(
        "source", "arrival_page", "exceeded", F.coalesce(F.size("items"), F.lit(0)).alias("features"),
        F.sha2(F.to_json(F.struct(F.col("items").alias("f"))), 256).alias("digest"),
    )
    path = scratch_path(pages.sparkSession, "page-facts")
    facts.write.parquet(path)
    facts = pages.sparkSession.read.parquet(path)
    before = facts.select(
        "source", (F.col("arrival_page") + 1).alias("arrival_page"), F.col("digest").alias("digest_before"),
        (~F.col("exceeded") | (F.col("features") < page_size)).alias("was_last"),
    )
    paired = facts.join(before, ["source", "arrival_page"], "left")
    repeats = (F.col("features") > 0) & (F.col("digest") == F.col("digest_before"))
    return paired.groupBy("source").agg(
        F.count("*").alias("pages"),
        F.sum("features").alias("features"),
        F.bool_or("exceeded").alias("exceeded_transfer_limit"),
        F.count_if(repeats).alias("repeated_pages"),
        F.count_if(F.col("was_last")).alias("pages_after_last"),
        (F.count("*") > max_pages).alias("over_page_cap"),
    )


def require_sound_pages(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """The pages themselves, once no source repeats a page or has more than ``max_pages`` of them."""
    audit = page_audit(pages, 1, max_pages).agg(
        F.coalesce(F.sum("repeated_pages"), F.lit(0)).alias("repeated"), F.count_if("over_page_cap").alias("over")).first()
    if audit["repeated"]:
        raise DataError(f"page set is stuck: {audit['repeated']} page(s) repeat the one before")
    if audit["over"]:
        raise DataError(f"page set has more than {max_pages} pages")
    return pages
