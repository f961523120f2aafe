"""Retrieval evaluation: hits, evidence groups, recovery by expansion, grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit(ids: Column, groups: Column, k: int | None = None) -> Column:
    """1 if each evidence group (array of arrays) has an id among the first k; groups of none are no hit."""
    top = ids if k is None else F.slice(ids, 1, k)
    return ((F.size(groups) > 0) & F.forall(groups, lambda g: F.arrays_overlap(top, g))).cast("int")


def evidence_groups(any_of: Column, groups: Column) -> Column:
    """Both forms of gold evidence as groups: one any-of list is one group."""
    return F.coalesce(groups, F.array(any_of))


def bundle(selected: Column, expanded: Column) -> Column:
    """Selected then expanded ids, each once."""
    return F.array_distinct(F.concat(selected, F.coalesce(expanded, F.array().cast("array<string>"))))


def recovered(direct: Column, final: Column) -> Column:
    """1 if only expansion found the evidence; a direct hit that is no final hit is an error."""
    return F.when((direct == 1) & (final == 0), F.raise_error(F.lit("a direct hit must be a final hit")).cast("int")).otherwise(((direct == 0) & (final == 1)).cast("int"))


def error_class(final: Column, accurate: Column) -> Column:
    return F.when(accurate.isNull(), "UNGRADED").when((final == 1) & (accurate == 1), "OK").when((final == 0) & (accurate == 1), "GOLD_AUDIT").when(final == 0, "EVIDENCE_MISS").otherwise("GENERATION")


def scored(cases: DataFrame, k: int) -> DataFrame:
    """Cases (selected, expanded, groups, accurate) with direct_hit, final_hit, recovered and error_class."""
    at = cases.withColumn("direct_hit", hit(F.col("selected"), F.col("groups"), k)).withColumn("final_hit", hit(bundle(F.slice("selected", 1, k), F.col("expanded")), F.col("groups")))
    at = at.withColumn("recovered", recovered(F.col("direct_hit"), F.col("final_hit")))
    return at.withColumn("error_class", error_class(F.col("final_hit"), F.col("accurate")))


def summary(rows: DataFrame, group: str = "group") -> DataFrame:
    """One row for each group and one for all (Overall): n, rates of direct and final hits, recovery of direct misses, accuracy of graded rows."""
    at = rows.rollup(group).agg(
        F.grouping(group).alias("_all"), F.count("*").alias("n"), F.sum("direct_hit").alias("direct"), F.sum("final_hit").alias("final"),
        F.count_if(F.col("direct_hit") == 0).alias("missed"), F.sum("recovered").alias("recovered"), F.count("accurate").alias("graded"), F.sum("accurate").alias("accurate"),
    )
    percent = lambda a, b: F.round(100.0 * F.col(a) / F.nullif(F.col(b), F.lit(0)), 1)
    return at.select(
        F.when(F.col("_all") == 1, "Overall").otherwise(F.col(group)).alias(group), "n", percent("direct", "n").alias("direct_rate"), percent("final", "n").alias("final_rate"),
        "missed", "recovered", percent("recovered", "missed").alias("recovery_rate"), percent("accurate", "graded").alias("accuracy"),
    )


def check_cases(cases: DataFrame, groups: list[str]) -> DataFrame:
    """Faults (id, fault) of evaluation cases: ids that repeat, unknown groups, none or both forms of evidence, too few or unnamed evidence groups."""
    twice = cases.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("fault"))
    one, many = F.size(F.coalesce("any_of", F.array().cast("array<string>"))) > 0, F.col("evidence_groups").isNotNull()
    fault = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("group").isin(*groups), F.lit(False)), F.lit("unknown group")), F.when(one == many, F.lit("needs one form of evidence")),
        F.when(many & (F.size("evidence_groups") < 2), F.lit("needs two evidence groups")), F.when(many & F.exists("evidence_groups", lambda g: (F.trim(g["name"]) == "") | (F.size(g["any_of"]) == 0)), F.lit("unnamed or empty evidence group")),
    ))
    return cases.select("id", F.explode(fault).alias("fault")).unionByName(twice)


def ordered(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows of a run in the order of the cases (id, pos), rows of unknown cases after them by id: with ``pos`` and ``known``.

    The order is a sort key, so that nothing is gathered; cases without a row have none here.
    """
    at = rows.join(cases.select("id", "pos"), "id", "left")
    return at.withColumn("known", F.col("pos").isNotNull()).orderBy(F.desc("known"), "pos", "id")


def graded(rows: DataFrame, grades: DataFrame) -> DataFrame:
    """Rows (id, final_hit, accurate, error_class) after grades (id, grade) by hand: the grade counts, and the class of
    error is derived again, errors at run time (RUNTIME_...) staying. Null grades and rows without one change nothing."""
    at = rows.join(grades.where(F.col("grade").isNotNull()).select("id", "grade"), "id", "left")
    new = F.when(F.col("error_class").startswith("RUNTIME_"), F.col("error_class")).otherwise(error_class(F.coalesce("final_hit", F.lit(0)), F.col("grade")))
    given = F.col("grade").isNotNull()
    at = at.withColumn("error_class", F.when(given, new).otherwise(F.col("error_class"))).withColumn("accurate", F.coalesce("grade", "accurate"))
    return at.drop("grade")


def stored_k(rows: DataFrame, by: str = "run") -> DataFrame:
    """(by, top_k, fault) of stored runs: the one positive value that all rows of a run share, else null and why."""
    k = F.col("top_k").try_cast("int")
    at = rows.groupBy(by).agg(F.count_if(k.isNull() | (k <= 0)).alias("bad"), F.min(k).alias("low"), F.max(k).alias("high"))
    fault = F.when(F.col("bad") > 0, "invalid top_k").when(F.col("low") != F.col("high"), "more than one top_k")
    return at.select(by, F.when(fault.isNull(), F.col("low")).alias("top_k"), fault.alias("fault"))
