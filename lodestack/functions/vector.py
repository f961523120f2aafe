"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import render


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def candidate(target: Column, labels: Column, props: Column, score: Column, index: Column) -> Column:
    """A hit of a vector index as a candidate: its label is the target if the node has that, or no labels at all, else its first label; its id
    the node's, or its course's; vectors among the properties go, and a score of null is 0."""
    named = F.coalesce(labels, F.array().cast("array<string>"))
    label = F.when(F.array_contains(named, target) | (F.size(named) == 0), target).otherwise(F.get(named, F.lit(0)))
    plain = render.without_vectors(F.coalesce(props, F.expr("cast(map() as map<string,string>)")))
    node = F.trim(F.coalesce(F.nullif(plain["id"], F.lit("")), plain["ma_hoc_phan"], F.lit("")))
    return F.struct(F.lit("vector").alias("origin"), target.alias("target"), label.alias("label"), node.alias("node_id"), index.alias("index_name"), F.coalesce(score, F.lit(0.0)).alias("score"), named.alias("labels"), plain.alias("props"))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, of length zero, or of another size."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def scored(vectors: DataFrame, query: list[float], vector_col: str = "embedding", score_col: str = "score") -> DataFrame:
    """Cosine with one query vector, a literal whose own length is computed once."""
    length = sum(x * x for x in query) ** 0.5
    literal = F.array(*(F.lit(float(x)) for x in query))
    size = norm(F.col(vector_col)) * F.lit(length)
    ok = F.col(vector_col).isNotNull() & (F.size(vector_col) == len(query)) & (size > 0)
    return vectors.withColumn(score_col, F.when(ok, dot(F.col(vector_col), literal) / size))


def top_k(scores: DataFrame, k: int, by: list[str] | None = None, score_col: str = "score", id_col: str = "id") -> DataFrame:
    """The k best rows, or of each group of ``by``, of equal scores the smaller id; rows without a score never."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = [F.desc(score_col), F.asc(id_col)]
    scores = scores.where(F.col(score_col).isNotNull())
    if not by:
        return scores.orderBy(*order).limit(k)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def searched(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", id_col: str = "id", vector_col: str = "embedding", per_block: tuple[int, int] = (512, 16_384)) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors by cosine of each query, exactly, for a batch of queries.

    Queries and vectors are dealt into blocks of about ``per_block`` rows by hash; a task multiplies one block of
    queries with one of vectors and passes on k rows a query, and a window ranks what the blocks give. Scores count
    to nine decimals, of equal ones the smaller id. Null vectors, those of length zero and of another size than the
    query's have no score; vectors that repeat count each.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    n_queries, n_vectors = (max(1, -(-df.count() // n)) for df, n in zip((queries, vectors), per_block))

    def usable(df: DataFrame, key: str, name: str) -> DataFrame:
        at = df.select(F.col(key).alias(name), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (norm(F.col("v")) > 0))
        return at.withColumn("d", F.size("v"))

    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = usable(queries, query_id, "q").select("q", "v", "d", block("q", n_queries).cast("int").alias("qb"), every(n_vectors).alias("vb"))
    right = usable(vectors, id_col, "i").select("i", "v", "d", block("i", n_vectors).cast("int").alias("vb"), every(n_queries).alias("qb"))

    def nearest(a, b):
        import numpy as np
        import pandas as pd

        columns = {"q": a["q"].iloc[:0], "i": b["i"].iloc[:0], "s": np.empty(0)}
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame(columns)
        unit = lambda v: (m := np.stack(v.to_numpy())) / np.sqrt((m * m).sum(axis=1, keepdims=True))
        scores, ids, parts = np.round(unit(a["v"]) @ unit(b["v"]).T, 9), b["i"].to_numpy(), []
        for one, q in zip(scores, a["q"]):
            least = np.partition(one, len(one) - k)[len(one) - k] if len(one) > k else -np.inf
            at = np.flatnonzero(one >= least)
            at = at[np.lexsort((ids[at], -one[at]))][:k]
            parts.append(pd.DataFrame({"q": q, "i": ids[at], "s": one[at]}))
        return pd.concat(parts)

    types = {**dict(left.dtypes), **dict(right.dtypes)}
    keys = ["d", "qb", "vb"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, f"q {types['q']}, i {types['i']}, s double")
    ranked = Window.partitionBy("q").orderBy(F.desc("s"), F.asc("i"))
    at = best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return at.select(F.col("q").alias(query_id), F.col("i").alias(id_col), F.col("s").alias("score"), "rank")


def identity(embedding: Column) -> Column:
    """128 bits that name a vector's values; null for none."""
    part = lambda *x: F.lpad(F.hex(F.xxhash64(*x, embedding)), 16, "0")
    return F.when(embedding.isNotNull(), F.unhex(F.concat(part(), part(F.lit(1)))))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(v, c, embedding, d, zero) of the distinct vectors of ``vectors (embedding)``: identity, the same once more, values, size, whether of length zero."""
    at = vectors.where("embedding is not null").select(identity(F.col("embedding")).alias("v"), "embedding").dropDuplicates(["v"])
    return at.select("v", F.col("v").alias("c"), "embedding", F.size("embedding").alias("d"), (norm(F.col("embedding")) == 0).alias("zero"))


def numbered_vectors(vectors: DataFrame) -> DataFrame:
    """The same of ``vectors (v, embedding)`` that have names of their own: ``c`` is the least name of those with the same values."""
    at = vectors.where("embedding is not null").select("v", "embedding", identity(F.col("embedding")).alias("_i"))
    least = at.groupBy("_i").agg(F.min("v").alias("c"))
    return at.join(least, "_i").select("v", "c", "embedding", F.size("embedding").alias("d"), (norm(F.col("embedding")) == 0).alias("zero"))


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, grp, q) of the queries that have a vector, and (grp, q, embedding, d) of the vectors of each group, written once."""
    from lodestack.sources.shared import written

    named = queries.where("embedding is not null").select("query_id", "grp", identity(F.col("embedding")).alias("q"), "embedding")
    asked = named.dropDuplicates(["grp", "q"]).select("grp", "q", "embedding", F.size("embedding").alias("d"))
    return named.drop("embedding"), asked


def searched_within(queries: DataFrame, vectors: DataFrame, k: int | None, per_block: tuple[int, int] = (16_384, 32_768), stored: DataFrame | None = None) -> DataFrame:
    """(query_id, label, id, table_id, score): of each label the k nearest vectors of a query's group, one of each table; with k of
    None the best of every table, as ``scored_tables()`` gives them.

    ``queries`` are (query_id, grp, embedding), ``vectors`` (grp, label, id, table_id, embedding), or with ``v`` for the embedding and
    ``stored``, their ``distinct_vectors()`` or ``numbered_vectors()``; the ids of both and of tables are strings, and rows without a
    table count each.

    Queries of a group with one vector are one here. Of rows with one vector only the first k tables can be among the
    k nearest, as each of these comes before the others: so many go on, as one row. Groups are dealt into blocks of
    about ``per_block`` vectors; a task multiplies one block of queries with one of vectors, some queries at a time, in
    single precision, and in double precision those pairs that can be among the k best by more than what single
    precision is off. Scores count to nine decimals; of equal ones the smaller id. Vectors that are null, of length zero or of
    another size than the query's have no score.
    """
    from lodestack.sources.shared import written

    if k is not None and k <= 0:
        raise ValueError("k must be positive")
    if stored is None:
        stored, vectors = written(distinct_vectors(vectors), "distinct-vectors"), vectors.withColumn("v", identity(F.col("embedding")))
    if k is None:
        return scored_tables(queries, vectors, stored)
    named, asked = _asked(queries)
    asked = written(asked.where(norm(F.col("embedding")) > 0), "asked-vectors")
    own = F.when(F.col("table_id").isNull(), F.col("id")).alias("alone")
    first = lambda df, v: df.groupBy("grp", "label", v, "table_id", own).agg(F.min("id").alias("id")).drop("alone").withColumn("_r", F.row_number().over(Window.partitionBy("grp", "label", v).orderBy("id"))).where(F.col("_r") <= k).drop("_r")
    # names first, of which many may stand for the same values
    some = first(first(vectors.where("v is not null"), "v").join(stored.where("NOT zero").select("v", "c"), "v").drop("v"), "c")
    rows = F.sort_array(F.collect_list(F.struct("id", "table_id")))  # k at most
    some = written(some.groupBy("grp", "label", "c").agg(rows.alias("r")).select("grp", "label", "c", F.col("r.id").alias("ids"), F.col("r.table_id").alias("tables")), "searched-rows")
    blocks = lambda df, n, name: df.groupBy("grp").agg(F.ceil(F.count("*") / n).cast("int").alias(name), F.count("*").alias(f"{name}_all"))
    sizes = blocks(asked, per_block[0], "nq").join(blocks(some, per_block[1], "nv"), "grp")
    pairs = sizes.agg(F.coalesce(F.sum((F.col("nq_all") * F.col("nv_all")).cast("double")), F.lit(0.0))).first()[0]
    sizes = sizes.select("grp", "nq", "nv")
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "grp").select("grp", "d", "q", "embedding", block("q", "nq").alias("qb"), every("nv").alias("vb"))
    values = stored.where("v = c AND NOT zero").select("c", "embedding", "d")
    right = some.join(values, "c").join(sizes, "grp").select("grp", "d", "label", "ids", "tables", "embedding", block("c", "nv").alias("vb"), every("nq").alias("qb"))

    def nearest(a, b):
        import numpy as np
        import pandas as pd

        columns = ("grp", "q", "label", "id", "table_id", "score")
        if not (len(a) and len(b)):
            return pd.DataFrame({c: pd.Series(dtype=float if c == "score" else object) for c in columns})
        unit = lambda v: (m := np.stack(v.to_numpy()).astype(np.float64)) / np.sqrt((m * m).sum(axis=1, keepdims=True))
        asked, q, grp, found = unit(a["embedding"]), a["q"].to_numpy(), a["grp"].iloc[0], []
        quick = asked.astype(np.float32)
        # twice what a product of two unit vectors is off in single precision, and more
        off = 4 * (asked.shape[1] + 8) * 2.0**-24 + 1e-8

        for label, part in b.groupby("label", sort=False):
            units, width = unit(part["embedding"]), part["ids"].map(len).to_numpy()
            rough, n, edge = units.astype(np.float32), len(part), np.cumsum(width) - width
            ids, tables = np.concatenate(part["ids"].to_numpy()), np.concatenate(part["tables"].to_numpy())
            order = np.unique(ids.astype(str), return_inverse=True)[1]
            table = pd.factorize(np.array([f"i{i}" if t is None else f"t{t}" for i, t in zip(ids, tables)], dtype=object))[0]
            enough = min(k, table.max() + 1)

            def best(at, m):
                """Of queries ``at``: places of queries, rows and scores of the first tables, from the m best vectors; queries for which these are too few."""
                scores = quick[at] @ rough.T
                if m >= n:
                    who, what = (x.ravel() for x in np.indices(scores.shape))
                else:
                    w = max(1, min(64, n // (4 * m)))
                    whole = n // w * w
                    most = scores[:, :whole].reshape(len(at), -1, w).max(axis=2)
                    if whole < n:
                        most = np.concatenate([most, scores[:, whole:].max(axis=1, keepdims=True)], axis=1)
                    least = np.partition(most, most.shape[1] - m, axis=1)[:, most.shape[1] - m] - off
                    who, what = np.nonzero(most >= least[:, None])
                    who, what = np.repeat(who, w), (what[:, None] * w + np.arange(w)).ravel()
                    who, what = who[what < n], what[what < n]
                    near = scores[who, what] >= least[who]
                    who, what = who[near], what[near]
                exact, step = np.empty(len(who)), max(1, 8_000_000 // asked.shape[1])
                for low in range(0, len(who), step):
                    s = slice(low, low + step)
                    exact[s] = np.einsum("ij,ij->i", asked[at[who[s]]], units[what[s]])
                exact = np.round(exact, 9)
                if m < n:
                    # vectors are complete down to the m-th best
                    sort = np.lexsort((-exact, who))
                    start = np.searchsorted(who[sort], np.arange(len(at)))
                    keep = exact >= exact[sort][start + m - 1][who]
                    who, what, exact = who[keep], what[keep], exact[keep]
                n_rows = width[what]
                rows = np.repeat(edge[what] - np.cumsum(n_rows) + n_rows, n_rows) + np.arange(n_rows.sum())
                who, exact = np.repeat(who, n_rows), np.repeat(exact, n_rows)
                sort = np.lexsort((order[rows], -exact, who))
                who, rows, exact = who[sort], rows[sort], exact[sort]
                once = np.sort(np.unique(who * (table.max() + 1) + table[rows], return_index=True)[1])
                who, rows, exact = who[once], rows[once], exact[once]
                start = np.searchsorted(who, np.arange(len(at)))
                counts = np.bincount(who, minlength=len(at))
                few = (counts < enough) if m < n else np.zeros(len(at), bool)
                keep = (np.arange(len(who)) - start[who] < k) & ~few[who]
                return at[who[keep]], rows[keep], exact[keep], at[few]

            todo, m, room = np.arange(len(asked)), 2 * k, 8_000_000
            while len(todo):
                left_over, step = [], max(1, room // n)
                for low in range(0, len(todo), step):
                    who, rows, exact, few = best(todo[low : low + step], m)
                    left_over.append(few)
                    found.append(pd.DataFrame({"grp": grp, "q": q[who], "label": label, "id": ids[rows], "table_id": tables[rows], "score": exact}))
                todo, m, room = np.concatenate(left_over), 4 * m, 1_000_000
        return pd.concat(found)

    keys = ["grp", "d", "qb", "vb"]
    tasks = int(min(20_000, max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // 100_000_000 + 1)))
    dealt = lambda df: df.repartition(tasks, *keys).groupBy(*keys)
    at = dealt(left).cogroup(dealt(right)).applyInPandas(nearest, "grp string, q binary, label string, id string, table_id string, score double")
    order = [F.desc("score"), F.asc("id")]
    one = Window.partitionBy("grp", "q", "label", F.coalesce("table_id", "id")).orderBy(*order)
    at = at.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    at = at.withColumn("_r", F.row_number().over(Window.partitionBy("grp", "q", "label").orderBy(*order))).where(F.col("_r") <= k).drop("_r")
    return at.join(named, ["grp", "q"]).select("query_id", "label", "id", "table_id", "score")


def scored_tables(queries: DataFrame, rows: DataFrame, stored: DataFrame, blank: float | None = None, keep: list[str] | None = None, rows_per_block: int = 2048, pairs: int = 500_000) -> DataFrame:
    """(query_id, label, id, table_id, keep, score): for each query the best row of each table of its group, all of them.

    As ``searched_within()`` takes them, ``rows`` with ``v`` or with ``c`` and ``d`` of it; ``keep`` are more columns of the rows, strings that a table has one of. Rows without
    a vector, or with one of length zero, have the score ``blank``, for queries of any vector; with None they do not count.
    The result is queries times tables, so blocks are dealt by their pairs: a task makes about ``pairs`` of them and has
    about ``rows_per_block`` rows, whole tables of them, so that nothing has to be merged afterwards but tables of 32 times as many.
    """
    from lodestack.sources.shared import written

    keep = keep or []
    named, asked = _asked(queries)
    asked = written(asked if blank is not None else asked.where(norm(F.col("embedding")) > 0), "asked-vectors")
    own = F.when(F.col("table_id").isNull(), F.col("id")).alias("alone")
    by = ["grp", "label", "table_id", own, *keep]
    some = rows if "c" in rows.columns else rows.join(stored.where("NOT zero").select("v", "c", "d"), "v", "left")
    some = some if blank is not None else some.where("c is not null")
    some = written(some.groupBy(*by, "c", "d").agg(F.min("id").alias("id")).drop("alone"), "scored-rows")
    q = named.join(asked.select("grp", "q", "d"), ["grp", "q"])
    sizes = q.groupBy("grp", "d").agg(F.count("*").alias("nq"))
    # rows without a vector meet queries of every size
    with_d = some.where("d is not null").groupBy("grp", "d").agg(F.count("*").alias("n"))
    blanks = some.where("d is null").groupBy("grp").agg(F.count("*").alias("n0"))
    sizes = sizes.join(with_d, ["grp", "d"], "left").join(blanks, "grp", "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).where("n > 0").drop("n0")
    sizes = sizes.withColumn("vb_n", F.ceil(F.col("n") / rows_per_block).cast("int")).withColumn("qb_n", F.ceil(F.col("nq") * F.least("n", F.lit(rows_per_block)) / pairs).cast("int"))
    sizes = written(sizes.withColumn("qb_n", F.least("nq", "qb_n").cast("int")), "scored-sizes")
    total = sizes.agg(F.coalesce(F.sum((F.col("nq") * F.col("n")).cast("double")), F.lit(0.0))).first()[0]
    name = F.coalesce(F.concat(F.lit("t"), "table_id"), F.concat(F.lit("i"), "id"))
    large = written(some.groupBy("grp", "label", name.alias("_name")).agg(F.count("*").alias("n")).where(F.col("n") > 32 * rows_per_block).select("grp", "label", "_name"), "large-tables")
    merged = not large.isEmpty()
    key = F.xxhash64(name)
    if merged:
        some = some.withColumn("_name", name).join(large.withColumn("_large", F.lit(True)), ["grp", "label", "_name"], "left").drop("_name")
        key = F.when(F.col("_large"), F.xxhash64("id")).otherwise(key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(sizes.select("grp", "d", "vb_n", "qb_n"), ["grp", "d"]).select("grp", "d", "q", "query_id", F.pmod(F.xxhash64("query_id"), "qb_n").cast("int").alias("qb"), every("vb_n").alias("vb"))
    left = left.join(asked.select("grp", "q", "embedding"), ["grp", "q"]).drop("q")
    values = stored.where("v = c AND NOT zero").select("c", "embedding")
    of = sizes.select("grp", "d", "vb_n", "qb_n")
    right = some.where("d is not null").join(of, ["grp", "d"]).unionByName(some.where("d is null").drop("d").join(of, "grp"))
    right = right.join(values, "c", "left").select("grp", "d", "label", "id", "table_id", *keep, "embedding", F.pmod(key, "vb_n").cast("int").alias("vb"), every("qb_n").alias("qb"))

    def best(a, b):
        import numpy as np
        import pandas as pd

        columns = ["query_id", "label", "id", "table_id", *keep, "score"]
        if not (len(a) and len(b)):
            return pd.DataFrame({c: pd.Series(dtype=float if c == "score" else object) for c in columns})
        b = b.assign(t=b["table_id"].where(b["table_id"].notna(), b["id"]), own=b["table_id"].isna()).sort_values(["label", "own", "t", "id"], kind="stable")
        size = len(a["embedding"].iloc[0])
        values = np.stack(a["embedding"].to_numpy()).astype(np.float64)
        length = np.sqrt((values * values).sum(axis=1, keepdims=True))
        asked, lost = values / np.where(length > 0, length, 1), length[:, 0] == 0
        plain = b["embedding"].isna().to_numpy()
        units = np.zeros((len(b), size))
        if not plain.all():
            m = np.stack(b["embedding"].to_numpy()[~plain]).astype(np.float64)
            units[~plain] = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
        label, own, same = b["label"].to_numpy(), b["own"].to_numpy(), b["t"].to_numpy()
        edge = np.flatnonzero(np.r_[True, (same[1:] != same[:-1]) | (label[1:] != label[:-1]) | (own[1:] != own[:-1])])
        width = np.diff(np.r_[edge, len(b)])
        number, at_q, at_row, scored = np.repeat(np.arange(len(edge)), width), [], [], []
        step = max(1, 2_000_000 // len(b))
        for low in range(0, len(asked), step):
            scores = np.round(asked[low : low + step] @ units.T, 9)
            scores[lost[low : low + step]] = -np.inf
            if plain.any():
                scores[:, plain] = blank
            top = np.maximum.reduceat(scores, edge, axis=1)
            for n, (one, most) in enumerate(zip(scores, top), low):
                first = np.flatnonzero((one == np.repeat(most, width)) & (one > -np.inf))
                first = first[np.unique(number[first], return_index=True)[1]]
                at_q.append(np.full(len(first), n))
                at_row.append(first)
                scored.append(one[first])
        who, row = np.concatenate(at_q), np.concatenate(at_row)
        out = {"query_id": a["query_id"].to_numpy()[who]} | {c: b[c].to_numpy()[row] for c in columns[1:-1]}
        return pd.DataFrame(out | {"score": np.concatenate(scored)})

    keys = ["grp", "d", "qb", "vb"]
    tasks = int(min(20_000, max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // pairs + 1)))
    dealt = lambda df: df.repartition(tasks, *keys).groupBy(*keys)
    at = dealt(left).cogroup(dealt(right)).applyInPandas(best, ", ".join(f"{c} string" for c in ("query_id", "label", "id", "table_id", *keep)) + ", score double")
    if merged:
        one = Window.partitionBy("query_id", "label", F.coalesce(F.concat(F.lit("t"), "table_id"), F.concat(F.lit("i"), "id"))).orderBy(F.desc("score"), F.asc("id"))
        at = at.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    return at
