"""Catalogs as files: an index and one JSON document per domain.

The index ``{"domains": {name: {"file": path}}}`` names the documents
``{"domain": name, "attributes": {attribute: [value, ...]}}``; a path is a file
or a folder of files, relative to the index's folder. All documents are one
Spark scan and become rows; only the index (a row per domain) is configuration
on the driver. An attribute of more than one domain is an error.
"""

from __future__ import annotations

import json
import posixpath
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "struct<attributes: map<string, array<string>>>"


def read_index(spark: SparkSession, index_path: str) -> list[tuple[str, str]]:
    """(domain, path) in the index's order."""
    text = "".join(r.value for r in spark.read.text(index_path, wholetext=True).collect())
    base = posixpath.dirname(index_path.rstrip("/"))
    return [(name, posixpath.join(base, meta["file"])) for name, meta in json.loads(text)["domains"].items()]


def _domain(path: Column, domains: Sequence[tuple[str, str]]) -> Column:
    """Which of the domains' files (or folders) a file is or lies in."""
    out = None
    for name, where in domains:
        tail = where.split("://")[-1].rstrip("/")
        here = path.endswith(tail) | path.contains(tail + "/")
        out = F.when(here, F.lit(name)) if out is None else out.when(here, F.lit(name))
    return out


def read_catalog(spark: SparkSession, index_path: str) -> DataFrame:
    """``domain, attribute, attribute_pos, code, value``: all domains' documents, unchecked."""
    domains = read_index(spark, index_path)
    docs = spark.read.text([where for _, where in domains], wholetext=True)
    docs = docs.select(_domain(F.col("_metadata.file_path"), domains).alias("domain"), F.from_json("value", DOCUMENT).alias("d"))
    attributes = docs.select("domain", F.posexplode(F.map_entries("d.attributes")).alias("attribute_pos", "a"))
    return attributes.select("domain", F.col("a.key").alias("attribute"), "attribute_pos", F.posexplode("a.value").alias("code", "value"))


def duplicate_attributes(catalog: DataFrame) -> DataFrame:
    """``attribute, domains`` (sorted, comma-joined) of attributes that more than one domain declares."""
    found = catalog.groupBy("attribute").agg(F.sort_array(F.collect_set("domain")).alias("d")).where(F.size("d") > 1)
    return found.select("attribute", F.array_join("d", ",").alias("domains"))


def load_catalog(spark: SparkSession, index_path: str, breakdowns: Sequence[str] = (), non_segment: Sequence[str] = ()) -> DataFrame:
    """``domain, attribute, code, value, is_breakdown, is_segment``; raises ValueError if an attribute has two domains."""
    catalog = read_catalog(spark, index_path)
    twice = duplicate_attributes(catalog).orderBy("attribute").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate catalog attribute: {twice[0].attribute} in {twice[0].domains}")
    return catalog.select("domain", "attribute", "code", "value", F.col("attribute").isin(*breakdowns).alias("is_breakdown"),
                          (~F.col("attribute").isin(*non_segment)).alias("is_segment"))


def write_catalog(values: DataFrame, directory: str) -> str:
    """Writes (domain, attribute, value) rows as a catalog, values and attributes in sorted order; returns the index's path."""
    spark = values.sparkSession
    per_attribute = values.groupBy("domain", "attribute").agg(F.sort_array(F.collect_set("value")).alias("values"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("attribute", "values"))))
    docs = per_attribute.groupBy("domain").agg(entries.alias("attributes"))
    docs = docs.select(F.to_json(F.struct("domain", "attributes")).alias("value"), F.col("domain").alias("part"))
    docs.write.mode("overwrite").partitionBy("part").text(f"{directory}/domains")
    domains = sorted(r.domain for r in per_attribute.select("domain").distinct().collect())  # a row per domain
    index = json.dumps({"domains": {d: {"file": f"domains/part={d}"} for d in domains}})
    spark.createDataFrame([(index,)], "value string").coalesce(1).write.mode("overwrite").text(f"{directory}/index.json")
    return f"{directory}/index.json"
