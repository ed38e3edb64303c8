"""Schemas of the engine's tables as DDL text, in one place; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LICENCE = "license string, redistribute boolean, license_note string"
NODE = (f"id string, label string, properties map<string,string>, text_to_embed string, {LICENCE}")
EDGE = ("src_id string, dst_id string, rel_type string, properties map<string,string>")
CULTURAL_CHUNK = (
    "chunk_id string, tradition string, source struct<work_id:string,work_title:string,author:string,date_written:string,is_confessional_text:boolean,anchor_id:string,language:string,translator:string>, "
    f"doctrine_tags array<struct<doctrine_coarse:string,doctrine_fine:string,stance:string,confidence:double,evidence_phrase:string>>, text string, text_to_embed string, {LICENCE}"
)
HISTORICAL_CHUNK = (
    "chunk_id string, source_type string, source struct<source_slug:string,work_id:string,work_title:string,author:string,date_written_range:string,anchor_id:string,anchor_alt_citation:string,language:string,translator:string,edition:string>, "
    "contested_interpolation struct<type:string,note:string,redact_for_embedding:boolean>, provenance struct<original_language:string,witness_chain:array<string>,extant_witnesses:array<string>,loss_status:string>, "
    f"text string, text_to_embed string, {LICENCE}"
)
RULE = ("id string, tradition_a string, ref_a string, tradition_b string, ref_b string, rule_type string, note string")


def unknown_keys(json: Column, declared: list[str]) -> Column:
    """Keys of a JSON object that the schema doesn't declare."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, declared)))


def validated(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with ``_violations``: names of the rules whose Column isn't true."""
    return df.withColumn("_violations", F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)), lambda x: x.isNotNull()))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows)."""
    return df.where(F.size("_violations") == 0).drop("_violations"), df.where(F.size("_violations") > 0)
