"""Catalogue: rules for texts, cells, properties and files, each over whole tables; their SQL reads the texts by patterns of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import blocks, render, text, vector
from lodestack.operators import audit, cleaning, curriculum, docs, regulations, rewriting, tables
from lodestack.plans import views
from lodestack.plans.items import REG, regulation_lines
from lodestack.plans.registry import query
from lodestack.plans.texts import LINES, _letters
from lodestack.plans.views import SQL, table
from lodestack.sources import files
from lodestack.streaming import uploads

WORD = r"\p{L}\p{N}\p{M}_"
# a word that is rewritten by an earlier rule never meets these two
NEVER = ("mã sv", "mã số sv")


def _values() -> str:
    rows = [(kind, key, f"{to[key]} ({key.upper()})" if key in kept else to[key]) for kind, to, kept in rewriting.KINDS for key in to if key not in NEVER]
    return ", ".join(f"('{kind}', '{key}', '{target}')" for kind, key, target in rows)


@query(f"""WITH {SQL['questions']}, r(type, key, target) AS (VALUES {_values()}),
           q AS (SELECT conv_id, turn, ' ' || regexp_replace(regexp_replace(question, '\\s+', ' ', 'g'), '([^{WORD}])', '\\1\\1', 'g') || ' ' AS s FROM questions),
           f AS (SELECT conv_id, turn, type, target, unnest(regexp_extract_all(s, '(?i)[^{WORD}](' || replace(key, ' ', '  ') || ')[^{WORD}]', 1)) AS found FROM q, r)
           SELECT conv_id, turn, type, replace(found, '  ', ' ') AS source, target, count(*) AS n FROM f GROUP BY ALL""")
def query_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was rewritten in every question, and into what."""
    at = rewriting.audited(views.questions(spark, sf_dir), "question")
    return at.select("conv_id", "turn", F.inline("rewrites")).groupBy("conv_id", "turn", "type", "source", "target").agg(F.count("*").alias("n"))


@query(rf"""WITH {LINES}, h AS (SELECT *, CAST((doc_id + pos) % 4 AS INT) AS form, left(line, CAST(length(line) // 2 AS INT)) AS l, substr(line, length(line) // 2 + 1) AS r FROM lines),
           c AS (SELECT doc_id, pos, form, CASE form WHEN 0 THEN l || '-' WHEN 1 THEN l WHEN 2 THEN l || ' 12/QĐ' ELSE l || ' 7-' END AS a, CASE form WHEN 2 THEN '- ĐHCT ' || r WHEN 3 THEN '8 ' || r ELSE r END AS b FROM h)
           SELECT doc_id, pos, form = 2 AS is_code, md5(CASE WHEN form = 2 THEN rtrim(a, ' ') || regexp_replace(b, '^- ', '-') WHEN form <> 3 AND regexp_matches(a, '[^ ]-$') AND regexp_matches(regexp_extract(b, '[A-Za-zÀ-ỹĐđ]'), '\p{{Ll}}') AND NOT (regexp_matches(a, '\d-$') AND regexp_matches(b, '^\d'))
                THEN left(a, length(a) - 1) || b ELSE trim(a || ' ' || b, ' ') END) AS digest FROM c""")
def line_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, cut in half in four ways, as one again: at a hyphen, at a blank, within a document's number, between numbers."""
    form, half = (F.col("doc_id") + F.col("pos")) % 4, F.floor(F.length("line") / 2).cast("int")
    left, right = F.left("line", half), F.substring(F.col("line"), half + 1, F.length("line"))
    ends = F.when(form == 0, "-").when(form == 1, "").when(form == 2, " 12/QĐ").otherwise(" 7-")
    begins = F.when(form == 2, "- ĐHCT ").when(form == 3, "8 ").otherwise("")
    at = docs.lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.concat(left, ends).alias("a"), F.concat(begins, right).alias("b"))
    return at.select("doc_id", "pos", blocks.split_code(F.col("a"), F.col("b")).alias("is_code"), F.md5(blocks.continued(F.col("a"), F.col("b"))).alias("digest"))


@query(f"""WITH {SQL['headed_rows']}, b AS (SELECT *, CASE WHEN l_linenumber = 2 OR l_orderkey % 9 = 0 THEN list_transform(cells, lambda x: '  ') ELSE list_transform(cells, lambda x: ' ' || x || '  ') END AS c FROM headed_rows),
           t AS (SELECT l_orderkey, list(list_transform(c, lambda x: trim(x)) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, c) FILTER (trim(array_to_string(c, '')) <> '') AS rows FROM b GROUP BY l_orderkey)
           SELECT l_orderkey, len(rows) AS n, md5(CAST(to_json(rows) AS VARCHAR)) AS digest FROM t""")
def cleaned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's rows as a table, tidied, without blank rows, and as JSON; every ninth order has nothing left."""
    blank = (F.col("l_linenumber") == 2) | (F.col("l_orderkey") % 9 == 0)
    cells = F.transform("cells", lambda x: F.when(blank, "  ").otherwise(F.concat(F.lit(" "), x, F.lit("  "))))
    at = views.headed_rows(spark, sf_dir).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", cells.alias("c")).alias("r"))
    rows = at.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["c"]).alias("rows")).select("l_orderkey", tables.cleaned(F.col("rows")).alias("rows"))
    return rows.select("l_orderkey", F.when(F.col("rows").isNotNull(), F.size("rows")).cast("long").alias("n"), F.md5(F.to_json("rows")).alias("digest"))


@query(f"WITH {LINES} SELECT doc_id, count(*) FILTER (pos % 37 <> 5) AS n_text, count(*) FILTER (pos % 37 = 5) AS n_table, 0::BIGINT AS n_others FROM lines GROUP BY doc_id")
def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each kind in every file."""
    return audit.item_counts(_letters(spark, sf_dir), "doc_id")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN source IS NULL OR doc_id % 5 = 0 THEN 'không trích được mã văn bản' END,
          CASE doc_id % 4 WHEN 0 THEN 'không trích được ngày ban hành' WHEN 1 THEN 'ngày ban hành chỉ có năm' WHEN 2 THEN 'ngày ban hành chỉ có tháng và năm' END,
          CASE WHEN coalesce(text, '') = '' THEN 'không trích được tiêu đề' END, CASE WHEN n_chars < 200 THEN 'tài liệu không có trang' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM documents""")
def extraction_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was not read from every document; its text is its title, two hundred characters a page."""
    k = F.col("doc_id")
    issued = F.when(k % 4 == 1, "2024").when(k % 4 == 2, "2024-05").when(k % 4 == 3, "2024-05-06")
    at = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 5 > 0, F.col("source")).alias("code"), issued.alias("issued"), F.col("text").alias("title"), F.floor(F.col("n_chars") / 200).alias("pages"))
    return audit.extraction_warnings(at, "doc_id").select("doc_id", F.array_join("warnings", "; ").alias("warnings"))


@query(f"""WITH {SQL['questions']}, k AS (SELECT *, conv_id * 8 + turn AS k FROM questions)
           SELECT conv_id, turn, CASE k % 6 WHEN 0 THEN 'viết lại' WHEN 1 THEN 'cũ' ELSE question END AS rewrite, CASE k % 6 WHEN 0 THEN 'HocPhan=CT1;=x' WHEN 1 THEN 'Nganh=' ELSE '' END AS entities, CASE k % 6 WHEN 0 THEN 'GOM,LA' WHEN 1 THEN '' ELSE '' END AS relations,
                  CASE k % 6 WHEN 0 THEN 'list' WHEN 1 THEN 'path' ELSE 'description' END AS query_type, CAST(CASE k % 6 WHEN 0 THEN 40 + turn END AS INT) AS cohort, CASE k % 6 WHEN 0 THEN 'CLC' END AS mode, CASE k % 6 WHEN 0 THEN 'HocPhan,VanBanPhapLy' ELSE '' END AS targets,
                  CASE k % 6 WHEN 0 THEN 'HocPhan' WHEN 1 THEN 'Khoa' ELSE '' END AS anchors, CASE k % 6 WHEN 0 THEN 'GOM' WHEN 1 THEN 'CO' ELSE '' END AS focus, CAST(CASE k % 6 WHEN 1 THEN 1 ELSE 2 END AS INT) AS max_depth, CAST(CASE k % 6 WHEN 0 THEN greatest(10, least(120, k)) ELSE 60 END AS INT) AS max_paths,
                  CASE k % 6 WHEN 0 THEN 'list' WHEN 1 THEN 'single' ELSE 'summary' END AS shape FROM k""")
def analysis_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model about every question, made safe: a whole one within other text, one with a plan, and four that are of no use."""
    k = F.col("conv_id") * 8 + F.col("turn")
    whole = F.concat(
        F.lit('Here:\n```json\n{"rewrite": " viết lại ", "query_type": " LIST", "entities": [{"type": " HocPhan", "value": "CT1"}, {"type": "", "value": " "}, {"value": "x"}], "relations": ["gom", " ", "la"], "ctdt_filters": {"khoa": "K'),
        F.col("turn") + 40, F.lit('", "he": " CLC "}, "vector_targets": ["HocPhan", "Lop", "VanBanPhapLy", "ChuanDauRa"], "graph_plan": {"anchor_node_types": ["Lop"], "expansion_policy": {"max_depth": 7, "max_paths": '), k, F.lit('}}}\n``` done'),
    )
    planned = F.lit('{"rewritten_query": "cũ", "query_type": "path", "entities": [{"type": "Nganh"}], "constraints": {"depth": 0}, "graph_plan": {"anchor_node_types": [" Khoa", "Lop"], "focus_relations": ["co", "CO", "la"], "answer_shape": "Single"}}')
    answer = F.when(k % 6 == 0, whole).when(k % 6 == 1, planned).when(k % 6 == 2, "no object").when(k % 6 == 3, "{}").when(k % 6 == 4, '{"rewrite": ')
    at = views.questions(spark, sf_dir).select("conv_id", "turn", curriculum.analysis(answer, F.col("question")).alias("a"))
    entities = F.array_join(F.transform("a.entities", lambda e: F.concat_ws("=", e["type"], e["value"])), ";")
    return at.select(
        "conv_id", "turn", "a.rewrite", entities.alias("entities"), F.array_join("a.relations", ",").alias("relations"), "a.query_type", "a.cohort", "a.mode", F.array_join("a.vector_targets", ",").alias("targets"),
        F.array_join("a.plan.anchors", ",").alias("anchors"), F.array_join("a.plan.relations", ",").alias("focus"), "a.plan.max_depth", "a.plan.max_paths", "a.plan.shape",
    )


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'HocPhan' WHEN 1 THEN 'HocPhan' ELSE 'Khac' END AS label, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_brand ELSE '' END AS node_id, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE round(p_retailprice, 2) END AS score,
          CASE p_partkey % 4 WHEN 0 THEN 'id,ma_hoc_phan' WHEN 1 THEN 'id,ma_hoc_phan' WHEN 2 THEN 'ma_hoc_phan' ELSE '' END AS shown FROM part""")
def vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a hit of an index: with the label asked for, without labels, with others; with an id, a blank one, a code alone, nothing."""
    k, one = F.col("p_partkey"), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    labels = F.when(F.col("p_size") % 3 == 0, one("Khac", "HocPhan")).when(F.col("p_size") % 3 == 2, one("Khac"))
    ids = F.create_map(F.lit("id"), F.when(k % 4 == 0, F.col("p_name")).otherwise(""), F.lit("ma_hoc_phan"), F.col("p_brand"), F.lit("Embedding_v2"), F.lit("[1]"))
    props = F.when(k % 4 < 2, ids).when(k % 4 == 2, F.create_map(F.lit("ma_hoc_phan"), F.col("p_brand"), F.lit("vector"), F.lit("[1]")))
    hit = vector.candidate(F.lit("HocPhan"), labels, props, F.when(k % 5 > 0, F.round(F.col("p_retailprice").cast("double"), 2)), F.lit("hp_index"))
    return table(spark, sf_dir, "part").select("p_partkey", hit.alias("c")).select("p_partkey", "c.label", "c.node_id", "c.score", F.array_join(F.array_sort(F.map_keys("c.props")), ",").alias("shown"))


@query(f"""WITH {REG}, heads AS (SELECT doc_id, s, c, p, any_value(last_chapter) AS chapter FROM r3 GROUP BY doc_id, s, c, p), o AS (SELECT doc_id, s, c, p, min(pos) AS pos, any_value(CAST(head % 50 + 1 AS VARCHAR)) AS article, string_agg(body, ' ' ORDER BY pos) AS text FROM r3 GROUP BY doc_id, s, c, p),
           s AS (SELECT doc_id, pos, p = 0 AND c = 0 AS is_article, concat_ws(' ', CASE WHEN chapter IS NOT NULL AND lag(chapter) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL THEN 'CHƯƠNG II' END,
           CASE WHEN p = 0 AND c = 0 THEN 'Điều ' || article END, text) AS said FROM o JOIN heads USING (doc_id, s, c, p))
           SELECT doc_id, CAST(sum(length(said) + 1) - 1 AS BIGINT) AS n_chars, count(*) FILTER (is_article) AS n_sections, md5(left(string_agg(said, ' ' ORDER BY pos), 12000)) AS digest FROM s GROUP BY doc_id""")
def regulation_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every regulation as plain text, its articles, and the preview of it."""
    at = regulations.plain_text(regulations.parts(regulation_lines(spark, sf_dir)))
    return at.select("doc_id", "n_chars", "n_sections", F.md5("preview").alias("digest"))


@query("""SELECT doc_id, coalesce(source, 'x') || '.' || doc_id || '_metadata.json' AS name, CASE WHEN doc_id % 4 = 0 THEN coalesce(source, 'x') || '.' || doc_id || '_document_hierarchy.json' ELSE coalesce(source, 'x') || '.' || doc_id || '_Clean' || CASE WHEN doc_id % 2 = 0 THEN '(' || doc_id || ')' ELSE '' END || '_hierarchy.json' END AS other,
          CASE WHEN lang = 'en' THEN 'Quy chế học vụ ' || doc_id WHEN lang = 'de' THEN 'Điều khoản' ELSE 'Văn bản quy chế' END AS title FROM documents WHERE doc_id % 4 <> 0
          UNION ALL SELECT doc_id, coalesce(source, 'x') || '.' || doc_id || '_document(' || doc_id || ')_metadata.json', coalesce(source, 'x') || '.' || doc_id || '_hierarchy.json', CASE WHEN lang = 'en' THEN 'Quy chế học vụ ' || doc_id WHEN lang = 'de' THEN 'Điều khoản' ELSE 'Văn bản quy chế' END FROM documents WHERE doc_id % 4 = 0""")
def stage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the files that two stages write for a file of every document, and the regulation's name by its first article."""
    k = F.col("doc_id")
    ending = F.when(k % 4 == 0, F.concat(F.lit("_document("), k, F.lit(")"))).when(k % 2 == 0, F.concat(F.lit("_Clean("), k, F.lit(")"))).otherwise("_Clean")
    path = F.concat(F.lit("s3://b/in.put/"), F.coalesce("source", F.lit("x")), F.lit("."), k, ending, F.lit(".json"))
    first = F.when(F.col("lang") == "en", F.concat(F.lit('Ban hành kèm theo Quyết định này "Quy chế học vụ '), k, F.lit('"'))).when(F.col("lang") == "de", "Điều khoản")
    return table(spark, sf_dir, "documents").select("doc_id", files.stage_name(path, "clean", "metadata").alias("name"), files.stage_name(path, "document", "hierarchy").alias("other"), regulations.regulation_name(first).alias("title"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'name missing' WHEN coalesce(source, '') NOT IN (SELECT s FROM (SELECT min(source) AS s FROM documents)) AND doc_id % 3 = 0 THEN 'unknown category' WHEN doc_id % 5 = 0 THEN 'no pdf' WHEN n_chars * 10000 > 52428800 THEN 'too large' END AS reason FROM documents""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a file of every document may not be taken; those of other sources than the first come with no known category, a third of them."""
    docs_ = table(spark, sf_dir, "documents")
    first = F.broadcast(docs_.agg(F.min("source").alias("first")))  # one row
    k = F.col("doc_id")
    name = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("f"), k, F.when(k % 5 == 0, ".doc").otherwise(".PDF")))
    category = F.when(~F.col("source").eqNullSafe(F.col("first")) & (k % 3 == 0), F.col("source")).otherwise(uploads.CATEGORIES[0])
    return docs_.join(first).select("doc_id", uploads.refused(name, category, F.col("n_chars") * 10_000).alias("reason"))


@query(r"""SELECT doc_id, md5(CASE WHEN regexp_matches(text, '(?i)https?://|www\.') THEN text ELSE regexp_replace(regexp_replace(text, '[\s\x{0B}]+([,.;:!?])', '\1', 'g'), '([,;!?]+)([^\s\x{0B},.;:!?)])', '\1 \2', 'g') END) AS digest FROM documents""")
def punctuated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text with tidy blanks at its punctuation; those with a URL stay as they are."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.punctuated(F.col("text"))).alias("digest"))


@query(rf"""WITH {LINES}, f AS (SELECT doc_id, pos, CASE (doc_id + pos) % 4 WHEN 0 THEN '**' || (pos + 1) || '.1. ' || line || '**' WHEN 1 THEN ' # **' || line || '**' WHEN 2 THEN '__' || (pos + 1) || '.__ ' || line ELSE line || ' __x__' END AS l FROM lines),
           p AS (SELECT *, replace(replace(l, '**', ''), '__', '') AS plain FROM f), n AS (SELECT *, regexp_extract(plain, '^\s*(\d+(\.\d+)*)\.?\s+\S', 1) AS n FROM p)
           SELECT doc_id, pos, md5(CASE WHEN NOT regexp_matches(l, '^\s*#') AND regexp_matches(l, '^\s*(\*\*|__)\s*\d') AND n <> '' THEN repeat('#', len(string_split(n, '.')) + 1) || ' ' || trim(plain, ' ') ELSE plain END) AS digest FROM n""")
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as numbered bold ones of two depths, headers, and with emphasis inside: headers of their depth, without emphasis."""
    k, n, line = (F.col("doc_id") + F.col("pos")) % 4, F.col("pos") + 1, F.col("line")
    bold = F.when(k == 0, F.concat(F.lit("**"), n, F.lit(".1. "), line, F.lit("**"))).when(k == 1, F.concat(F.lit(" # **"), line, F.lit("**"))).when(k == 2, F.concat(F.lit("__"), n, F.lit(".__ "), line))
    at = docs.lines(table(spark, sf_dir, "documents"))
    return at.select("doc_id", "pos", F.md5(render.markdown_headers(F.coalesce(bold, F.concat(line, F.lit(" __x__"))))).alias("digest"))


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{{0B}}]+', ' ', 'g'), ' ')), lambda x: x <> '') AS items FROM documents)
           SELECT doc_id, len(items) AS n, md5(array_to_string(items, chr(10))) AS digest FROM l""")
def listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of every whole text as a list, each line of it one with a bullet of five kinds."""
    marked = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.lit(" "), F.element_at(F.split(F.lit("-+•*–"), ""), i % 5 + 1), F.lit(" "), x))
    at = table(spark, sf_dir, "documents").select("doc_id", render.bullets(F.array_join(marked, "\n")).alias("items"))
    return at.select("doc_id", F.size("items").cast("long").alias("n"), F.md5(F.array_join("items", "\n")).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::DOUBLE + 0.5 WHEN l_linenumber % 3 = 0 THEN -1.0 ELSE l_quantity::DOUBLE END AS number, CASE WHEN l_linenumber = 1 THEN 'N/A' ELSE printf('%d/%d = %.1f%%', l_suppkey % l_linenumber, l_linenumber - 1, 100.0 * (l_suppkey % l_linenumber) / (l_linenumber - 1)) END AS share,
          CAST(CASE WHEN l_partkey % 5 = 0 THEN 20 ELSE greatest(10, least(120, l_partkey)) END AS INT) AS bound FROM lineitem""")
def read_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of every line item from texts with a decimal comma, or none; shares as text; bounds in their range."""
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    said = F.when(n % 2 == 0, F.concat(F.lit(" "), q, F.lit(",5 "))).when(n % 3 == 0, "none").otherwise(q)
    bound = F.when(F.col("l_partkey") % 5 == 0, "two").otherwise(F.col("l_partkey").cast("string"))
    at = table(spark, sf_dir, "lineitem")
    return at.select("l_orderkey", n, "l_partkey", "l_suppkey", render.number(said, -1.0).alias("number"), render.percent(F.col("l_suppkey") % n, n - 1).alias("share"), render.clamped(bound, 10, 120, 20).alias("bound"))


@query(f"""WITH {SQL['headed_rows']} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_orderkey % 4 WHEN 0 THEN 'Mã HP|cot_2|Số lượng|Mã HP_2|cot_5' WHEN 1 THEN 'Mã sinh viên|cot_2|Mã sinh viên_2|cot_4' WHEN 2 THEN 'Nội dung|cot_2|Nội dung_2|cot_4' ELSE 'STT|cot_2|STT_2|cot_4' END AS names,
           array_to_string(list_resize(cells, CASE WHEN l_orderkey % 4 = 0 THEN 5 ELSE 4 END, ''), '|') AS cells FROM headed_rows""")
def unique_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row under headers of which one is blank and one repeats, with names that are unique, as wide as these."""
    names = F.concat(F.transform("headers", lambda h, i: F.when(i == 1, " ").otherwise(h)), F.array(F.concat(F.lit(" "), F.get("headers", F.lit(0))), F.lit(None).cast("string")))
    at = views.headed_rows(spark, sf_dir)
    return at.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(tables.unique_names(names), "|").alias("names"), F.array_join(tables.fitted_row(F.col("cells"), F.size(names)), "|").alias("cells"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 AND text IS NOT NULL THEN md5(text) END AS digest, CASE WHEN doc_id % 3 < 2 THEN doc_id END AS id FROM documents""")
def salvaged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a value of an object inside an answer: fenced, among words, or cut off."""
    k = F.col("doc_id")
    json = F.to_json(F.struct(F.col("text").alias("said"), k.alias("id")))
    answer = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("Answer: "), json, F.lit(" as asked"))).otherwise(F.concat(F.lit('{"said": "'), k, F.lit('", "id": ')))
    got = render.salvaged_json(answer, "said string, id long")
    return table(spark, sf_dir, "documents").select("doc_id", got.alias("g")).select("doc_id", F.md5("g.said").alias("digest"), "g.id")


@query(f"""WITH {SQL['questions']}, k AS (SELECT *, conv_id * 8 + turn AS k, trim(question) <> '' AND length(question) + 8 <= 500 AS fits FROM questions)
           SELECT conv_id, turn, fits AND (k % 5 IN (0, 3) OR (k % 5 = 1 AND NOT regexp_matches(question, '[0-9]'))) AS safe FROM k""")
def safe_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether rewritings of every question are safe: words added, digits gone, a code more, blanks, none at all."""
    k, q = F.col("conv_id") * 8 + F.col("turn"), F.col("question")
    new = F.when(k % 5 == 0, F.concat(q, F.lit(" ạ"))).when(k % 5 == 1, F.regexp_replace(q, r"\d", "")).when(k % 5 == 2, F.concat(q, F.lit(" XYZ123"))).when(k % 5 == 3, F.concat(F.lit("  "), q)).otherwise("")
    return views.questions(spark, sf_dir).select("conv_id", "turn", text.same_identifiers(q, new).alias("safe"))


@query("""SELECT p_partkey, concat_ws(' / ', CASE WHEN p_partkey % 3 = 0 THEN 'ma_hoc_phan: ' || p_brand END, 'ten: ' || p_name, CASE WHEN p_size % 2 = 0 THEN 'gia_tri: ' || p_size END, 'a_size: ' || p_size, 'b_type: ' || trim(p_type)) AS shown,
          CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS name FROM part""")
def shown_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's properties as lines, known ones first: without vectors, blanks and empty lists; and its name."""
    size = F.col("p_size").cast("string")
    props = F.create_map(
        F.lit("b_type"), F.concat(F.lit("  "), F.col("p_type")), F.lit("gia_tri"), F.when(F.col("p_size") % 2 == 0, size).otherwise("[]"), F.lit("a_size"), size, F.lit("ten"), F.col("p_name"),
        F.lit("ma_hoc_phan"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(" "), F.lit("Embedding"), F.lit("[1]"), F.lit("embedding_v2"), F.lit("[2]"), F.lit("none"), F.lit(None).cast("string"),
    )
    name = render.display_name(props, F.lit("?"), ("ten_hoc_phan", "ma_hoc_phan", "ten"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(render.useful_properties(props), " / ").alias("shown"), name.alias("name"))


@query("""WITH i AS (SELECT user_id AS doc_id, event_id AS pos, CAST(event_id % 7 AS INT) AS n FROM events), t AS (SELECT *, ['Học phầnii', 'Sinh viêni'][n + 1] AS w FROM i WHERE n < 2), m AS (SELECT *, CASE n WHEN 5 THEN 'ii' ELSE 'i' END AS marker FROM i WHERE n >= 5)
          SELECT m.doc_id, m.pos, marker, max(t.pos) AS ref_pos FROM m JOIN t ON t.doc_id = m.doc_id AND t.pos < m.pos AND ((m.n = 5 AND t.n = 0) OR (m.n = 6 AND t.n = 1)) GROUP BY ALL""")
def footnote_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that every Roman footnote of a user's items belongs to: the nearest before it that marks a word of the note."""
    forms = ("Học phầnii, theo kế hoạch", "Sinh viêni và học viên", "Không có gì.", "Ghi chú", "Sinh viên", "(ii) phần tự chọn", "i. viên chức không tính")
    n = (F.col("event_id") % 7).cast("int")
    at = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.when(n >= 5, "note").otherwise("text").alias("kind"), F.element_at(F.array(*map(F.lit, forms)), n + 1).alias("text"))
    return cleaning.footnotes(at)
