"""Rewriting of queries with a record of what was rewritten."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text

#: Stands at a cut beside a protected value: word characters, so that a word which touches a value is no whole word.
MARK = "Z9"
LOG = "array<struct<type:string, source:string, target:string>>"
KINDS = (("abbreviation", text.ABBREVIATIONS, text.KEPT_ABBREVIATIONS), ("synonym", text.SYNONYMS, frozenset()), ("typo", text.TYPOS, frozenset()))


def rules() -> list[tuple[str, str, str]]:
    """(kind, pattern, replacement) in the order in which they apply: kinds, within each the longest word first."""
    return [(kind, *text.rule(key, table[key], key in kept)) for kind, table, kept in KINDS for key in sorted(table, key=len, reverse=True)]


def audited(rows: DataFrame, text_col: str, out: str = "normalised", log: str = "rewrites") -> DataFrame:
    """Rows with the text as ``text.normalised_query`` gives it, and each word that was rewritten, in the order of the rules
    and within one of its places: (type, source as it stood, target). A word that only changes its case is not listed.

    A null text is empty, without rewrites. Each rule is a projection over the one before, so that no rule's work is
    repeated; columns of the names ``out`` and ``log`` are replaced, all others stay.
    """
    keep = [c for c in rows.columns if c not in (out, log)]
    either = f"(?iU)(?:{'|'.join(text.PROTECTED)})"
    at = rows.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), text.spaced(F.col(text_col)).alias("clean"))
    parts = F.split("clean", either)
    fenced = F.transform(parts, lambda p, i: F.concat(F.when(i > 0, MARK).otherwise(""), p, F.when(i < F.size(parts) - 1, MARK).otherwise("")))
    at = at.select("row", F.regexp_extract_all("clean", F.lit(either), F.lit(0)).alias("values"), fenced.alias("parts"), F.array().cast(LOG).alias("log"))
    for kind, pattern, target in rules():

        def noted(found: Column) -> Column:
            return F.transform(F.filter(found, lambda x: F.lower(x) != target.lower()), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("source"), F.lit(target).alias("target")))

        found = F.flatten(F.transform("parts", lambda p: F.regexp_extract_all(p, F.lit(pattern), F.lit(0))))
        at = at.select("row", "values", F.transform("parts", lambda p: F.regexp_replace(p, pattern, target)).alias("parts"), F.concat("log", noted(found)).alias("log"))
    last = F.size("parts") - 1
    bare = F.transform("parts", lambda p, i: F.substring(p, F.when(i > 0, 3).otherwise(1), F.length(p) - F.when(i > 0, 2).otherwise(0) - F.when(i < last, 2).otherwise(0)))
    whole = F.array_join(F.flatten(F.zip_with(bare, F.col("values"), lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
    # in two steps: a column of the caller's may have the name of one used here
    return at.select("row", F.struct(text.spaced(whole).alias(out), F.col("log").alias(log)).alias("done")).select("row.*", "done.*")
