"""Catalogue: trees, paths, seeds, audits, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text
from lodestack.operators import audit, graph, ingest
from lodestack.plans import views
from lodestack.plans.registry import query
from lodestack.plans.views import SQL, table

E, V = SQL["edges"], SQL["nodes"]
BOTH = f"{E}, und AS (SELECT src AS a, dst AS b, src || '|' || type || '|' || dst AS edge, type FROM edges UNION ALL SELECT dst, src, src || '|' || type || '|' || dst, type FROM edges)"


@query("""SELECT r_name, n_name, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_customers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
          FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def tree_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    path = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(t("customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    path = path.join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    money = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return path.groupBy("r_name", "n_name").agg(F.count("*").alias("n_rows"), F.count_distinct("c_custkey").alias("n_customers"), F.round(F.sum(money), 2).alias("revenue"))


@query(f"""WITH RECURSIVE {E}, walk AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS id, 0 AS depth, 'region:' || r_regionkey AS path FROM region
           UNION ALL SELECT root, e.dst, depth + 1, path || '>' || e.dst FROM walk JOIN edges e ON e.src = walk.id) SELECT * FROM walk""")
def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = views.nodes(spark, sf_dir).where("label = 'region'").select("id")
    return graph.descent(views.edges(spark, sf_dir), roots, 4).withColumn("path", F.array_join("path", ">"))


LINKS = f"{E}, links AS (SELECT src, dst FROM edges UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey FROM lineitem)"


@query(f"""WITH RECURSIVE {LINKS}, walk AS (SELECT 'nation:' || n_nationkey AS id, 0 AS depth, ['nation:' || n_nationkey] AS path FROM nation WHERE n_regionkey = 0
           UNION ALL SELECT l.dst, depth + 1, list_append(path, l.dst) FROM walk JOIN links l ON l.src = walk.id WHERE depth < 3 AND NOT list_contains(path, l.dst)),
           best AS (SELECT id, depth, array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY id ORDER BY depth, path) AS r FROM walk) SELECT id, depth, path FROM best WHERE r = 1""")
def shallowest_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are reached from nations both directly and through orders; each node keeps its shortest path."""
    extra = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order:"), "l_orderkey").alias("src"), F.concat(F.lit("supplier:"), "l_suppkey").alias("dst")).distinct()
    links = views.edges(spark, sf_dir).select("src", "dst").unionByName(extra)
    roots = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    return graph.shallowest(graph.descent(links, roots, 3)).withColumn("path", F.array_join("path", ">"))


GOALS = "goals AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 9900)"


@query(f"""WITH {V}, {BOTH}, {GOALS}, near AS (SELECT id FROM goals UNION SELECT u.b FROM goals JOIN und u ON u.a = id UNION SELECT w.b FROM goals JOIN und u ON u.a = id JOIN und w ON w.a = u.b)
           SELECT n.* FROM nodes n WHERE id IN (SELECT id FROM near)""")
def neighbourhood_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))
    return views.nodes(spark, sf_dir).join(graph.within(views.edges(spark, sf_dir), goals, 2), "id", "left_semi")


SEEDS = "seeds AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal < 200 UNION ALL SELECT 'lonely:1')"
PATHS = f"""{BOTH}, {SEEDS}, paths AS (SELECT id AS seed, [id, u.b] AS nodes, [u.edge] AS edges, [u.type] AS types FROM seeds JOIN und u ON u.a = id
    UNION ALL SELECT id, [id, u.b, w.b], [u.edge, w.edge], [u.type, w.type] FROM seeds JOIN und u ON u.a = id JOIN und w ON w.a = u.b AND w.edge <> u.edge),
    every AS (SELECT id AS seed, coalesce(nodes, [id]) AS nodes, coalesce(edges, []) AS edges, coalesce(types, []) AS types, coalesce(len(edges), 0) AS depth FROM seeds LEFT JOIN paths ON seed = id)"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = table(spark, sf_dir, "supplier").where("s_acctbal < 200").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"))
    return few.unionByName(spark.createDataFrame([("lonely:1",)], "id string"))


@query(f"WITH {PATHS} SELECT seed, array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types, CAST(depth AS INT) AS depth FROM every")
def bounded_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = graph.expanded(views.edges(spark, sf_dir), _seeds(spark, sf_dir), 2)
    return paths.select("seed", F.array_join("nodes", ">").alias("nodes"), F.array_join("types", ">").alias("types"), "depth")


@query(f"""WITH {PATHS} SELECT id AS seed, coalesce(array_to_string(nodes, '>'), id) AS nodes FROM seeds LEFT JOIN (SELECT * FROM paths WHERE list_contains(types, 'HAS_NATION')) p ON p.seed = id""")
def hinted_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = graph.expanded(views.edges(spark, sf_dir), _seeds(spark, sf_dir), 2, ["HAS_NATION"])
    return paths.select("seed", F.array_join("nodes", ">").alias("nodes"))


CAPPED = f"""{PATHS}, first AS (SELECT *, row_number() OVER (ORDER BY depth, array_to_string(nodes, '>')) AS p FROM every ORDER BY p LIMIT 120),
    stands AS (SELECT p, seed, unnest(nodes) AS id, unnest(range(len(nodes))) AS i FROM first), once AS (SELECT id, min((p, i)) AS place, bool_or(id = seed) AS is_seed FROM stands GROUP BY id),
    ranked AS (SELECT *, row_number() OVER (ORDER BY place) AS n FROM once), kept AS (SELECT id, n, is_seed FROM ranked WHERE n <= 100 OR is_seed)"""


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = graph.expanded(views.edges(spark, sf_dir), _seeds(spark, sf_dir), 2, most=120)
    return graph.capped(paths, [F.col("depth"), F.array_join("nodes", ">")], 120, 100)


@query(f"WITH {CAPPED} SELECT id, n, is_seed FROM kept")
def subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir).withColumn("n", F.col("n").cast("long"))


@query(f"WITH {CAPPED} SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)")
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.between(views.edges(spark, sf_dir), _capped(spark, sf_dir)).select("src", "dst", "type")


WORDS = ["red", "Small", "ring", "ECONOMY", "red "]
HITS = f"""{V}, things AS (SELECT id, label, name, '' AS kind FROM nodes UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, p_type FROM part),
    hits AS (SELECT id, label, list_filter(['red', 'Small', 'ring', 'ECONOMY', '1'], lambda w: contains(lower(name), lower(w)) OR contains(lower(kind), lower(w))) AS hits,
             CASE label WHEN 'part' THEN 3 WHEN 'supplier' THEN 2 WHEN 'nation' THEN 1 WHEN 'order' THEN -1 ELSE 0 END AS bias FROM things)"""


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lit("part").alias("label"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    things = views.nodes(spark, sf_dir).withColumn("kind", F.lit("")).unionByName(parts)
    bias = F.when(F.col("label") == "part", 3).when(F.col("label") == "supplier", 2).when(F.col("label") == "nation", 1).when(F.col("label") == "order", -1).otherwise(0)
    return graph.seeds(things, [*WORDS, "1"], ["name", "kind"], bias, k)


@query(f"WITH {HITS} SELECT id, label, len(hits) AS n_hits, bias FROM hits WHERE len(hits) > 0 ORDER BY len(hits) DESC, bias DESC, id LIMIT 40")
def keyword_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, 40).select("id", "label", F.size("hits").cast("long").alias("n_hits"), "bias")


@query(f"""WITH {HITS}, top AS (SELECT *, row_number() OVER (ORDER BY len(hits) DESC, bias DESC, id) AS pos FROM hits WHERE len(hits) > 0 ORDER BY pos LIMIT 40)
           SELECT id, label, CASE WHEN id LIKE '%7' THEN 0 WHEN label = 'supplier' THEN 2 ELSE 1 END AS bucket FROM top ORDER BY bucket, pos LIMIT 15""")
def seed_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored seeds first, then others, suppliers (the broadest) last, each in the order found."""
    bucket = F.when(F.col("id").endswith("7"), 0).when(F.col("label") == "supplier", 2).otherwise(1)
    at = _hits(spark, sf_dir, 40).withColumn("bucket", bucket)
    return at.orderBy("bucket", F.desc(F.size("hits")), F.desc("bias"), "id").limit(15).select("id", "label", "bucket")


@query(f"""WITH {E}, r AS (SELECT src, dst, type, row_number() OVER (PARTITION BY src ORDER BY type, dst) AS i FROM edges WHERE type IN ('HAS_SUPPLIER', 'HAS_CUSTOMER') AND src LIKE 'nation:1%')
           SELECT src, dst, type FROM (SELECT *, row_number() OVER (ORDER BY i, src) AS j FROM r WHERE i <= 4) WHERE j <= 12""")
def relation_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step by allowed types, at most 4 from each origin and 12 in all."""
    from pyspark.sql import Window

    at = views.edges(spark, sf_dir).where(F.col("type").isin("HAS_SUPPLIER", "HAS_CUSTOMER") & F.col("src").startswith("nation:1"))
    at = at.withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("type", "dst"))).where("i <= 4")
    return at.orderBy("i", "src").limit(12).select("src", "dst", "type")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce('part:' || p_partkey, 'supplier:' || s_suppkey, 'order:' || o_orderkey) AS target
          FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size <= 10 LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 5000 LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'O'""")
def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most exact target that exists: of three left joins the first that found one."""
    t = lambda name: table(spark, sf_dir, name)
    at = t("lineitem").join(t("part").where("p_size <= 10"), F.col("l_partkey") == F.col("p_partkey"), "left")
    at = at.join(t("supplier").where("s_acctbal > 5000"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(t("orders").where("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    target = F.coalesce(F.concat(F.lit("part:"), "p_partkey"), F.concat(F.lit("supplier:"), "s_suppkey"), F.concat(F.lit("order:"), "o_orderkey"))
    return at.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", target.alias("target"))


@query(f"""WITH {V}, {E} SELECT label, count(*) AS n FROM nodes WHERE label <> 'region' AND id NOT IN (SELECT dst FROM edges WHERE type <> 'HAS_ORDER' OR src LIKE '%1') GROUP BY 1""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.edges(spark, sf_dir).where("type <> 'HAS_ORDER' OR src LIKE '%1'")
    return graph.orphans(views.nodes(spark, sf_dir).where("label <> 'region'"), e).groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT 'events' AS label, 'props' AS property, count(*) AS total, count(*) FILTER (nullif(props, '{}') IS NULL) AS absent, 0 AS blank FROM events
          UNION ALL SELECT 'events', 'event_type', count(*), count(*) FILTER (event_type IS NULL), count(*) FILTER (trim(event_type) = '') FROM events
          UNION ALL SELECT 'part', 'p_brand', count(*), count(*) FILTER (CASE WHEN p_size % 9 > 0 THEN p_brand END IS NULL), 0 FROM part
          UNION ALL SELECT 'part', 'p_name', count(*), 0, count(*) FILTER (trim(CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_name END) = '') FROM part""")
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("props", F.nullif("props", F.lit("{}")))
    part = table(spark, sf_dir, "part").withColumn("p_brand", F.when(F.col("p_size") % 9 > 0, F.col("p_brand"))).withColumn("p_name", F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_name")))
    return audit.missing({"events": events, "part": part}, {"events": ["props", "event_type"], "part": ["p_brand", "p_name"]})


@query("""SELECT event_type AS label, k AS property, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) WHERE k NOT IN ('page') GROUP BY ALL""")
def property_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.from_json("props", "map<string,string>").alias("props"))
    return audit.unexpected(at, ["page"])


@query("""SELECT label, count(*) AS total, count(CASE WHEN vec_id % 10 > 0 THEN embedding END) AS embedded, 64 AS size FROM embeddings GROUP BY label""")
def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 10 > 0, F.col("embedding")))
    return audit.vector_coverage(at).select("label", "total", "embedded", F.element_at("sizes", -1).alias("size"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dedupe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH o AS (SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey % 3 < 2), n AS (SELECT p_partkey, upper(p_name) AS p_name, CASE WHEN p_size > 25 THEN p_type END AS p_type FROM part WHERE p_partkey % 3 > 0)
          SELECT coalesce(o.p_partkey, n.p_partkey) AS id, coalesce(n.p_name, o.p_name) AS name, o.p_brand AS brand, n.p_type AS type FROM o FULL JOIN n ON o.p_partkey = n.p_partkey""")
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the parts are there; two thirds come, twice, the second time with their names in upper case and some with a type."""
    part = table(spark, sf_dir, "part")
    m = lambda **c: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in c.items())), lambda e: e["v"].isNotNull()))
    node = lambda df, props: df.select(F.lit("part").alias("label"), F.col("p_partkey").alias("id"), props.alias("props"), *(["seq"] if "seq" in df.columns else []))
    old = node(part.where("p_partkey % 3 < 2"), m(name=F.col("p_name"), brand=F.col("p_brand")))
    new = part.where("p_partkey % 3 > 0")
    batch = node(new.withColumn("seq", F.lit(1)), m(name=F.col("p_name"))).unionByName(node(new.withColumn("seq", F.lit(2)), m(name=F.upper("p_name"), type=F.when(F.col("p_size") > 25, F.col("p_type")))))
    return ingest.upserted_nodes(old, batch).select("id", *(F.col("props")[k].alias(k) for k in ("name", "brand", "type")))


@query(f"""WITH {E}, {V}, old AS (SELECT * FROM edges WHERE type <> 'HAS_ORDER'), batch AS (SELECT * FROM edges WHERE dst LIKE '%1' UNION ALL SELECT * FROM edges WHERE type = 'HAS_ORDER' UNION ALL SELECT 'part:1', dst, 'HAS_ORDER' FROM edges)
           SELECT src, dst, type FROM old UNION SELECT src, dst, type FROM batch WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)""")
def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.edges(spark, sf_dir)
    batch = e.where("dst LIKE '%1'").unionByName(e.where("type = 'HAS_ORDER'")).unionByName(e.select(F.lit("part:1").alias("src"), "dst", F.lit("HAS_ORDER").alias("type")))
    return ingest.upserted_edges(e.where("type <> 'HAS_ORDER'"), batch, views.nodes(spark, sf_dir))


@query("""SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
          UNION ALL SELECT l_orderkey, l_quantity + 1 FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) GROUP BY 1""")
def replace_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    again = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    new = li.join(again, "l_orderkey", "left_semi").where("l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") + 1)
    # orders that come without rows lose theirs, too
    out = ingest.replaced(li.join(again, "l_orderkey", "left_anti"), new, "l_orderkey")
    return out.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""WITH a AS (SELECT event_id, unnest(json_keys(props)) AS k, props FROM events), x AS (SELECT event_id, k, json_extract_string(props, '$.' || k) AS v FROM a),
          y AS (SELECT event_id, k, CASE WHEN event_id % 11 = 0 THEN v || '!' ELSE v END AS v FROM x WHERE NOT (event_id % 7 = 0 AND k = 'page')),
          d AS (SELECT coalesce(x.event_id, y.event_id) AS event_id, coalesce(x.k, y.k) AS path, x.v AS left_value, y.v AS right_value FROM x FULL JOIN y ON x.event_id = y.event_id AND x.k = y.k WHERE x.v IS DISTINCT FROM y.v)
          SELECT event_id, min(path) AS path, arg_min(coalesce(left_value, '-'), path) AS left_value, arg_min(coalesce(right_value, '-'), path) AS right_value FROM d GROUP BY 1""")
def json_first_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))
    changed = at.where("NOT (event_id % 7 = 0 AND path = 'page')").withColumn("value", F.when(F.col("event_id") % 11 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    out = ingest.first_difference(at, changed, ["event_id"])
    return out.select("event_id", "path", F.coalesce("left_value", F.lit("-")).alias("left_value"), F.coalesce("right_value", F.lit("-")).alias("right_value"))


@query("""SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') AS slug, CASE WHEN p_size <= 15 THEN ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV'][p_size] ELSE CAST(p_size AS VARCHAR) END AS numeral FROM part""")
def slugs_and_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.roman(F.col("p_size")).alias("numeral"))
