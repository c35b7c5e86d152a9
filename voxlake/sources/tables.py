"""Readers and writers of text tables: atlases, relabelling lists and append-merged statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """name, label, kind of an atlas text: the lines of three tab-separated fields after `Structures: n`."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^[^\t]+\t-?[0-9]+\t[^\t]+$"))
    part = F.split("value", "\t")
    return lines.select(part[0].alias("name"), part[1].cast("int").alias("label"), part[2].alias("kind"))


def read_relabelling(spark: SparkSession, path: str) -> DataFrame:
    """old, name, new of a relabelling text: the lines of three tab-separated fields that begin and end in a number."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^-?[0-9]+\t[^\t]*\t-?[0-9]+$"))
    part = F.split("value", "\t")
    return lines.select(part[0].cast("int").alias("old"), part[1].alias("name"), part[2].cast("int").alias("new"))


def merged_statistics(old: DataFrame, new: DataFrame, measure: str = "measure") -> DataFrame:
    """New rows after the last old row of the same measure, other measures at the end; `position` orders the rows.

    Both tables need a `position` column of their own."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = Window.partitionBy(measure)
    both = both.withColumn("_seen", F.min(F.struct("_new", "position")).over(first))
    order = Window.orderBy("_seen", measure, "_new", "position")
    return both.withColumn("position", F.row_number().over(order) - 1).drop("_new", "_seen")


def wide_statistics(long: DataFrame, label: str = "label", value: str = "value", labels: list | None = None) -> DataFrame:
    """One column per label, as the text form has them."""
    keys = [c for c in long.columns if c not in (label, value)]
    return long.groupBy(*keys).pivot(label, labels).agg(F.first(value))


def file_parts(path: Column) -> list[Column]:
    """Folder, base name and extension of a path column; a doubled .nii.gz counts as one extension."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.regexp_extract(name, r"((?:\.nii)?\.[A-Za-z0-9]+)$", 1)
    return [F.regexp_replace(path, r"/?[^/]*$", "").alias("folder"), F.regexp_replace(name, r"(?:\.nii)?\.[A-Za-z0-9]+$", "").alias("base"), extension.alias("extension")]


#: A line of a structure's name and three numbers.
_PRIOR = r"^(.*?)[\t ]*(-?[0-9]+\.?[0-9]*)[\t ]+(-?[0-9]+\.?[0-9]*)[\t ]+(-?[0-9]+\.?[0-9]*)\s*$"


def read_priors(spark: SparkSession, path: str) -> DataFrame:
    """atlas, contrast, position, name, median, spread, weight: the lines of a name and three numbers under each
    `Intensity Prior:` heading of atlas texts, up to the first other line; one text a task."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("atlas"), F.col("value"))
    blocks = whole.select("atlas", F.explode(F.slice(F.split("value", "Intensity Prior:"), 2, 1 << 20)).alias("b"))
    contrast = F.regexp_extract(F.col("l")[0], r"^\s*([^\t]*[^\t\s])", 1).alias("contrast")
    lines = blocks.select("atlas", F.split("b", r"\r?\n").alias("l")).select("atlas", contrast, F.posexplode(F.slice("l", 2, 1 << 20)).alias("position", "line"))
    end = F.min(F.when(~F.col("line").rlike(_PRIOR), F.col("position"))).over(Window.partitionBy("atlas", "contrast"))
    kept = lines.withColumn("_end", end).where("_end is null or position < _end")
    numbers = [F.regexp_extract("line", _PRIOR, i).cast("double").alias(n) for i, n in ((2, "median"), (3, "spread"), (4, "weight"))]
    return kept.select("atlas", "contrast", "position", F.trim(F.regexp_extract("line", _PRIOR, 1)).alias("name"), *numbers)


def with_priors(text: str, contrast: str, priors: dict[int, tuple[float, float]]) -> str:
    """An atlas text with the medians and spreads of one contrast replaced, by position under its heading; the weight of
    a replaced line is 1. All other lines and the names stay as they are."""
    out, at = [], None
    for line in text.split("\n"):
        found = re.match(_PRIOR, line)
        if "Intensity Prior:" in line:
            at = 0 if line.split("Intensity Prior:")[1].strip().split("\t")[0].strip() == contrast else None
        elif at is not None and found is None:
            at = None
        elif at is not None:
            if at in priors:
                line = f"{line[: found.start(2)]}{priors[at][0]:.2f}\t{priors[at][1]:.2f}\t1.00"
            at += 1
        out.append(line)
    return "\n".join(out)
