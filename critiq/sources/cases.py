"""Case manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.functions.text import strip

_FACTS = "array<struct<answer_terms:array<string>,source_terms:array<string>>>"
# JSON type of each list field when its elements are what they should be.
_LIST_TYPES = {
    "gold_source_ids": "^ARRAY<(STRING|VOID)>$",
    "source_labels": "^ARRAY<(STRING|VOID)>$",
    "reference_facts": (
        r"^ARRAY<(VOID|OBJECT<answer_terms: ARRAY<(STRING|VOID)>, "
        r"source_terms: ARRAY<(STRING|VOID)>>)>$"
    ),
}


def _document(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.try_parse_json("value").alias("manifest"))


def _type_of(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest head as one row, ready for ``manifest_violations``."""
    m = F.col("manifest")
    count = F.try_variant_get(m, "$.dataset.row_count", "bigint")
    cases = F.try_variant_get(m, "$.cases", "array<variant>")
    return _document(spark, path).select(
        F.try_variant_get(m, "$.schema_version", "string").alias("schema_version"),
        F.try_variant_get(m, "$.evaluation_set_id", "string").alias("evaluation_set_id"),
        F.coalesce(F.size(cases), F.lit(0)).alias("case_count"),
        F.coalesce(_type_of(m, "$.dataset").startswith("OBJECT"), F.lit(False)).alias(
            "has_dataset"
        ),
        F.try_variant_get(m, "$.dataset.sha256", "string").alias("sha256"),
        F.when(_type_of(m, "$.dataset.row_count") == "BIGINT", count).alias("row_count"),
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case; ``mistyped`` names list fields of a wrong JSON type."""
    case = F.col("case")
    texts = [
        F.coalesce(strip(F.try_variant_get(case, f"$.{name}", "string")), F.lit("")).alias(name)
        for name in ("id", "question", "category", "split", "difficulty", "expected_action")
    ]
    lists = [
        F.transform(F.try_variant_get(case, f"$.{name}", "array<string>"), strip).alias(name)
        for name in ("gold_source_ids", "source_labels")
    ]
    facts = F.transform(
        F.try_variant_get(case, "$.reference_facts", _FACTS),
        lambda f: F.struct(
            F.transform(f["answer_terms"], strip).alias("answer_terms"),
            F.transform(f["source_terms"], strip).alias("source_terms"),
        ),
    )
    mistyped = F.filter(
        F.array(
            *[
                F.when(
                    ~F.coalesce(_type_of(case, f"$.{name}").rlike(form), F.lit(False)), F.lit(name)
                )
                for name, form in _LIST_TYPES.items()
            ]
        ),
        lambda name: name.isNotNull(),
    )
    return (
        _document(spark, path)
        .select(
            F.explode(F.try_variant_get(F.col("manifest"), "$.cases", "array<variant>")).alias(
                "case"
            )
        )
        .select(*texts, *lists, facts.alias("reference_facts"), mistyped.alias("mistyped"))
    )
