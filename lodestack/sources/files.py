"""Reading and writing the engine's files: page items, document trees, evaluation cases and results, graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<loai:string, bbox:array<double>, noi_dung:string, du_lieu:array<array<string>>, dang:string, tieu_de_bang:string>"
PAGES = f"ten_file string, trang array<struct<so_trang:int, kich_thuoc:array<double>, items:array<{ITEM}>>>"
CASES = "id string, `group` string, question string, gold_answer string, required_facts array<string>, gold_evidence_any_of array<string>, evidence_groups array<struct<name:string, any_of:array<string>>>"


def _section(depth: int) -> str:
    inner = f", muc_con:array<{_section(depth - 1)}>" if depth else ""
    return f"struct<id:string, ky_hieu:string, noi_dung:array<string>, bang:array<struct<tieu_de_bang:string, cot:array<string>, du_lieu:array<array<string>>>>{inner}>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files with one JSON object each; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def page_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, pos, kind, x0, y0, x1, y1, width, height, text, cells) of page files; a bad rectangle is all zeros, a null cell ''."""
    at = read_json(spark, path, PAGES).select(F.col("ten_file").alias("file"), F.explode("trang").alias("p"))
    at = at.select("file", F.col("p.so_trang").alias("page"), F.col("p.kich_thuoc").alias("size"), F.posexplode("p.items").alias("pos", "i"))
    box = [F.when(F.size("i.bbox") == 4, F.get("i.bbox", F.lit(k))).otherwise(0.0).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    cells = F.transform("i.du_lieu", lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    kind = F.when(F.col("i.loai") == "bang", "table").otherwise("text")
    return at.select("file", "page", "pos", kind.alias("kind"), *box, F.get("size", F.lit(0)).alias("width"), F.get("size", F.lit(1)).alias("height"), F.col("i.noi_dung").alias("text"), cells.alias("cells"))


def sections(spark: SparkSession, path: str, depth: int = 4) -> DataFrame:
    """Sections (notice, document, parent_id, id, symbol, depth, text, tables) of document trees, nested up to ``depth`` levels; a deeper file fails."""
    schema = f"metadata struct<ma_van_ban:string, ten_file:string, tieu_de:string, ngay_ban_hanh:string>, tai_lieu array<struct<id:string, thu_tu:int, ten_tai_lieu:string, muc:array<{_section(depth)}>>>"
    at = read_json(spark, path, schema).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_chunks)?\.json$", 1).alias("notice"), F.explode("tai_lieu").alias("d"))
    level = at.select("notice", F.col("d.id").alias("document"), F.lit(None).cast("string").alias("parent_id"), F.posexplode("d.muc").alias("pos", "m"))
    out = None
    for d in range(1, depth + 2):
        here = level.select("notice", "document", "parent_id", F.col("m.id").alias("id"), F.col("m.ky_hieu").alias("symbol"), F.lit(d).alias("depth"), "pos", F.array_join("m.noi_dung", "\n").alias("text"), F.col("m.bang").alias("tables"))
        out = here if out is None else out.unionByName(here)
        if d <= depth:
            level = level.select("notice", "document", F.col("m.id").alias("parent_id"), F.posexplode("m.muc_con").alias("pos", "m"))
    return out


def cases(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    """Evaluation cases, checked: a fault in any of them is an error. A file of a single kind has no groups; its cases are Multi-node."""
    from lodestack.operators.evaluate import check_cases

    at = read_json(spark, path, f"cases array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in _fields(CASES))}>>").select(F.inline("cases"))
    at = at.withColumn("group", F.coalesce("group", F.lit("Multi-node"))).withColumnRenamed("gold_evidence_any_of", "any_of")
    if faults := check_cases(at, groups).limit(5).collect():
        raise ValueError("; ".join(f"{r['id']}: {r['fault']}" for r in faults))
    return at


def _fields(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def stage_name(path: Column, done: str, next_stage: str) -> Column:
    """The name of a file that a stage writes for one of the stage before: its stem, without that stage's ending and the number that a
    download added, with the ending of the next."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^./]*$", "")
    return F.concat(F.regexp_replace(stem, rf"(?i)_{done}(?:\(\d+\))?$", ""), F.lit(f"_{next_stage}.json"))


def without_metadata(items: Column) -> Column:
    """A page's items (with dang, their form) less those that were read as the document's metadata."""
    return F.filter(items, lambda i: ~i["dang"].eqNullSafe(F.lit("metadata")))


def metadata(documents: DataFrame) -> DataFrame:
    """The head that a document's tree carries: code, file, title and date, '' where they are missing."""
    return documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("ma_van_ban", "ten_file", "tieu_de", "ngay_ban_hanh")))


def migrated(rows: DataFrame, gone: tuple[str, ...], props_col: str | None = None) -> DataFrame:
    """Rows without columns of an older schema, or without those keys of a map of properties; those that are not there are no fault."""
    if props_col is None:
        return rows.drop(*gone)
    return rows.withColumn(props_col, F.map_filter(props_col, lambda k, v: ~k.isin(*gone)))


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """One object a line in UTF-8, nulls kept; in a folder of its own for each value of ``by``. Earlier files under the path go."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", False).option("encoding", "UTF-8")
    (writer.partitionBy(by) if by else writer).json(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Results with exactly these columns; files of another shape are refused."""
    at = spark.read.option("header", True).csv(path)
    if set(at.columns) != set(columns):
        raise ValueError(f"other columns: {sorted(set(at.columns) ^ set(columns))}")
    return at.select(*columns)


def refresh(table: DataFrame, path: str, key: str) -> None:
    """Overwrites only the partitions of the keys in ``table``: a notice with all below it is replaced as one."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
