"""Measures of whole source texts and of the history of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.code import decision_points, rating


def deepest(text: Column) -> Column:
    """Greatest depth of braces at the end of any line, 0 at least; one pass over the lines, no shuffle."""
    zero = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("most"))
    change = lambda line: F.regexp_count(line, F.lit(r"\{")) - F.regexp_count(line, F.lit(r"\}"))
    step = lambda acc, line: F.struct((acc["depth"] + change(line)).alias("depth"), F.greatest(acc["most"], acc["depth"] + change(line)).alias("most"))
    return F.aggregate(F.split(text, "\n", -1), zero, step, lambda acc: acc["most"])


def complexity(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, lines, returns, cyclomatic, max_nesting, cognitive, rating) of whole texts; a null text is empty, a last line without text doesn't count."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    rows = files.select(
        F.col(id_col).alias("id"),
        (F.size(lines) - F.when((text == "") | text.endswith("\n"), 1).otherwise(0)).cast("long").alias("lines"),
        F.size(F.filter(lines, lambda x: x.contains("return "))).cast("long").alias("returns"),
        (decision_points(text) + 1).cast("long").alias("cyclomatic"),
        deepest(text).alias("max_nesting"),
    )
    return rows.withColumn("cognitive", F.col("cyclomatic") + 2 * F.col("max_nesting")).withColumn("rating", rating(F.col("cyclomatic")))


def evolution(changes: DataFrame, part: str, author: str, order: list[str]) -> DataFrame:
    """(part, changes, authors, created_by, changed_by) of parts; order names the columns that order changes, ties included."""
    at = F.struct(*order)
    return changes.groupBy(F.col(part).alias("part")).agg(
        F.count("*").alias("changes"), F.countDistinct(author).alias("authors"), F.min_by(author, at).alias("created_by"), F.max_by(author, at).alias("changed_by")
    )
