"""Queries on duplicates, groups, splits, joins, sets, resampling and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import probs as P
from ..functions.images import dct_hash
from ..operators import dedup as D
from ..operators import metrics as M
from ..operators import resample as B
from ..operators import select as S
from ..operators.ranks import places
from ..session import stored
from .adapters import K, PREDS, draw_sql, predictions
from .evidence import gated, r
from .registry import query, table

REPS, SEED = 600, "boot"
#: Shingles of test items (16 bytes each) are broadcast up to this many.
SHINGLES = 2_000_000

# ---- duplicates


@query("dup_exact", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_exact(spark: SparkSession, d: str) -> DataFrame:
    return D.exact_groups(table(spark, d, "documents"), "text", "doc_id")


#: Labels with conflicts put in: quality is flipped where the id is a multiple of 7.
FLIPPED = "flipped AS (SELECT d.doc_id, d.text, d.source, CASE WHEN d.doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS q FROM documents d JOIN labels USING (doc_id))"


def flipped(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return x.select("doc_id", F.sha2("text", 256).alias("hash"), F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("q"))


@query("dup_conflict_exact", f"WITH {FLIPPED}, bad AS (SELECT sha256(text) AS hash FROM flipped GROUP BY 1 HAVING count(DISTINCT q) > 1) SELECT doc_id, q FROM flipped WHERE sha256(text) NOT IN (SELECT hash FROM bad)")
def dup_conflict_exact(spark, d):
    return D.without_conflicts(flipped(spark, d), "hash", "q").select("doc_id", "q")


@query("agg_distinct", f"WITH {FLIPPED} SELECT sha256(text) AS hash, count(*) AS n, min(q) || ',' || max(q) AS labels FROM flipped GROUP BY 1 HAVING count(DISTINCT q) > 1")
def agg_distinct(spark, d):
    return D.conflicts(flipped(spark, d), "hash", "q").select("hash", "n", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query("dup_hardfail", "SELECT count(*) - count(DISTINCT sha256(text)) AS violations FROM documents")
def dup_hardfail(spark, d):
    n = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return n.agg(F.sum(F.col("n") - 1).alias("violations"))


BITS, RADIUS = 60, 4
#: The sign hashes of all components but the last four, and near and equal copies of every tenth and fifteenth.
BASE_HASH = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i} ELSE 0 END)" for i in range(BITS))
HASHED = f"h0 AS (SELECT vec_id, label % 4 AS class, CAST({BASE_HASH} AS BIGINT) AS h FROM embeddings), hashed AS (SELECT * FROM h0 UNION ALL SELECT vec_id + 1000000000, class, xor(h, (5::BIGINT << CAST(vec_id % 50 AS INTEGER))) FROM h0 WHERE vec_id % 10 = 0 UNION ALL SELECT vec_id + 2000000000, (class + 1) % 4, h FROM h0 WHERE vec_id % 15 = 0)"
PAIRS = f"kinds AS (SELECT h, min(vec_id) AS id, count(*) AS n FROM hashed GROUP BY h), near AS (SELECT x.id AS i, y.id AS j, x.n AS n1, y.n AS n2, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance FROM kinds x JOIN kinds y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= {RADIUS}), pairs AS (SELECT least(i, j) AS a, greatest(i, j) AS b, distance FROM near UNION ALL SELECT id, vec_id, 0 FROM hashed JOIN kinds USING (h) WHERE vec_id <> id)"
GROUPED = "walk AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT vec_id AS node, vec_id AS seen FROM hashed UNION SELECT reach.node, walk.b FROM reach JOIN walk ON walk.a = reach.seen), grouped AS (SELECT node AS vec_id, min(seen) AS component FROM reach GROUP BY node)"


def hashed(spark, d) -> DataFrame:
    h = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 4).alias("class"), D.sign_hash("embedding", BITS).alias("h"))
    near = h.where("vec_id % 10 = 0").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), "class", F.expr("h ^ shiftleft(5L, cast(vec_id % 50 as int))").alias("h"))
    same = h.where("vec_id % 15 = 0").select((F.col("vec_id") + 2_000_000_000).alias("vec_id"), ((F.col("class") + 1) % 4).alias("class"), "h")
    return h.unionByName(near).unionByName(same)


def grouped(spark, d) -> DataFrame:
    h = hashed(spark, d)
    return D.groups(h, D.near_links(h, "vec_id", "h", RADIUS, BITS), "vec_id")


@query("dup_phash", f"WITH {HASHED} SELECT vec_id, h FROM hashed")
def dup_phash(spark, d):
    return hashed(spark, d).select("vec_id", "h")


@query("dup_phash_dct")
def dup_phash_dct(spark, d):
    """Picture hashes of 32 x 32 grey values that are made of the vectors; tested against sums of cosines."""
    at = F.sequence(F.lit(0), F.lit(1023))
    grey = F.transform(at, lambda i: F.element_at("embedding", ((i * 7 + F.floor(i / 32)) % 64 + 1).cast("int")).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", dct_hash(grey).alias("h"))


@query("dup_near", f"WITH {HASHED}, {PAIRS} SELECT a, b, distance FROM pairs")
def dup_near(spark, d):
    """Links of near hashes: least ids of two, and rows of one with its least."""
    return D.near_links(hashed(spark, d), "vec_id", "h", RADIUS, BITS)


@query("join_self_theta", f"WITH {HASHED}, {PAIRS}, c AS (SELECT distance, n1 * n2 AS pairs FROM near UNION ALL SELECT 0, n * (n - 1) // 2 FROM kinds WHERE n > 1) SELECT distance, CAST(sum(pairs) AS BIGINT) AS pairs FROM c GROUP BY distance")
def join_self_theta(spark, d):
    return D.near_counts(hashed(spark, d), "vec_id", "h", RADIUS, BITS)


@query("dup_components", f"WITH RECURSIVE {HASHED}, {PAIRS}, {GROUPED} SELECT vec_id, component FROM grouped")
def dup_components(spark, d):
    return grouped(spark, d).select("vec_id", "component")


@query("agg_group_sizes", f"WITH RECURSIVE {HASHED}, {PAIRS}, {GROUPED}, s AS (SELECT component, count(*) AS n FROM grouped GROUP BY component) SELECT n AS size, count(*) AS groups FROM s GROUP BY n")
def agg_group_sizes(spark, d):
    return D.size_distribution(grouped(spark, d))


@query("dup_conflict_comp", f"""WITH RECURSIVE {HASHED}, {PAIRS}, {GROUPED}, g AS (SELECT component, vec_id, class FROM grouped JOIN hashed USING (vec_id)), c AS (SELECT component, CAST(class AS VARCHAR) AS k, count(*) AS n FROM g GROUP BY 1, 2),
x AS (SELECT component, CAST(sum(n) AS BIGINT) AS size, string_agg(k || ':' || n, ' | ' ORDER BY k) AS classes FROM c GROUP BY component HAVING count(*) > 1),
p AS (SELECT component, vec_id, row_number() OVER (PARTITION BY component ORDER BY vec_id) AS place FROM g)
SELECT x.component, size, classes, string_agg(CAST(vec_id AS VARCHAR), ' | ' ORDER BY place) AS names FROM x JOIN p ON p.component = x.component AND place <= 20 GROUP BY x.component, size, classes""")
def dup_conflict_comp(spark, d):
    return D.conflict_components(grouped(spark, d), "class", "vec_id")


@query("win_canonical", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def win_canonical(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return D.canonical(docs, "hash", "doc_id", "doc_id", "source")


@query("split_group_dp")
def split_group_dp(spark, d):
    """Whole near-duplicate groups dealt to splits of exact sizes; rows only, as the choice is a seeded one."""
    return D.split_groups(grouped(spark, d), "class", "component", 20, 20)


@query("split_group_sizes", f"""WITH RECURSIVE {HASHED}, {PAIRS}, {GROUPED}, g AS (SELECT class, component, CAST(count(*) AS BIGINT) AS size FROM grouped JOIN hashed USING (vec_id) GROUP BY 1, 2),
t AS (SELECT class, CAST(sum(size) AS BIGINT) AS total, CASE WHEN sum(size) >= 60 THEN 20 ELSE greatest(1, CAST(round_even(0.15::DOUBLE * sum(size), 0) AS BIGINT)) END AS target FROM g GROUP BY class),
-- bit i of the fold is whether groups can sum to i
m AS (SELECT class, total, target, list_reduce(list_prepend(1::BIGINT, coalesce(list(size) FILTER (size <= target), []::BIGINT[])), lambda a, s: (a | (a << s)) & ((1::BIGINT << (target + 1)) - 1)) AS reach FROM g JOIN t USING (class) GROUP BY class, total, target)
SELECT class, total, CAST(floor(log2(reach)) AS BIGINT) AS test FROM m""")
def split_group_sizes(spark, d):
    """Rows of each class and of its test split, which are the most that whole groups can sum to."""
    s = D.split_groups(grouped(spark, d), "class", "component", 20, 20)
    return s.groupBy("class").agg(F.sum("size").alias("total"), F.sum(F.when(F.col("split") == "test", F.col("size")).otherwise(0)).alias("test"))


@query("split_target_rule", "SELECT label, count(*) AS total, CAST(CASE WHEN count(*) >= 3 * 20 THEN 20 ELSE greatest(1, CAST(round_even(0.15::DOUBLE * count(*), 0) AS BIGINT)) END AS BIGINT) AS target FROM embeddings GROUP BY label")
def split_target_rule(spark, d):
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("total"))
    return n.select("label", "total", F.when(F.col("total") >= 60, 20).otherwise(F.greatest(F.lit(1), F.bround(F.col("total") * 0.15))).cast("long").alias("target"))


@query("split_leak_check", f"WITH RECURSIVE {HASHED}, {PAIRS}, {GROUPED}, g AS (SELECT DISTINCT class, component FROM grouped JOIN hashed USING (vec_id)), n AS (SELECT count(*) AS vectors FROM hashed) SELECT count(*) AS groups, any_value(vectors) AS vectors, 0::BIGINT AS leaking_groups FROM g, n")
def split_leak_check(spark, d):
    g = grouped(spark, d)
    s = D.split_groups(g, "class", "component", 20, 20).select("class", "component", "split")
    # groups are dealt class by class, so a group of several classes is checked within each
    rows = g.join(s, ["class", "component"]).withColumn("component", F.concat_ws("|", "class", "component"))
    whole = rows.agg(F.count_distinct("component").alias("groups"), F.count("*").alias("vectors"))
    return whole.crossJoin(D.leaks(rows).agg(F.count("*").alias("leaking_groups")))


RANKED = f"ranked AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"


@query("win_stratified_split", f"WITH {RANKED} SELECT vec_id, label, CASE WHEN place <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN place <= round_even(n * 0.85::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM ranked")
def win_stratified_split(spark, d):
    return D.stratified(table(spark, d, "embeddings"), "label", "vec_id", "42", [("train", 0.7), ("val", 0.15), ("test", 0.15)]).select("vec_id", "label", "split")


@query("win_balanced_sample", f"WITH {RANKED} SELECT vec_id, label FROM ranked WHERE place <= 25")
def win_balanced_sample(spark, d):
    e = table(spark, d, "embeddings")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.concat_ws("|", F.lit("42"), "vec_id").cast("binary")), "vec_id"))
    return e.withColumn("place", place).where("place <= 25").select("vec_id", "label")


@query("split_contam", """WITH w AS (SELECT item_id, string_split_regex(lower(text), '\\s+') AS w FROM benchmark), s AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS shingle FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 6))) AS i)),
x AS (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS w FROM documents), t AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS shingle FROM x, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 6))) AS i))
SELECT item_id, doc_id, count(*) AS shared FROM s JOIN t USING (shingle) GROUP BY item_id, doc_id""")
def split_contam(spark, d):
    """Shingles as 64-bit hashes; the benchmark's are counted, and broadcast below a size, so the corpus' aren't shuffled."""

    def shingles(df: DataFrame, id: str) -> DataFrame:
        # the words are a column of their own, used twice, so they are split once a row and not once a shingle
        df = df.select(id, F.split(F.lower("text"), r"\s+").alias("w"))
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 7))
        return df.select(id, F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(8)), " "))))).alias("shingle"))

    items = stored(shingles(table(spark, d, "benchmark"), "item_id"), "shingles")
    items = F.broadcast(items) if items.count() <= SHINGLES else items
    return shingles(table(spark, d, "documents"), "doc_id").join(items, "shingle").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


# ---- joins and sets


@query("join_pair", f"WITH {PREDS} SELECT a.id, a.y, a.pred_a, b.pred_b FROM preds a JOIN preds b ON a.id = b.id WHERE a.pred_a <> b.pred_b")
def join_pair(spark, d):
    p = predictions(spark, d)
    a, b = p.select("id", "y", P.argmax("pa").alias("pred_a")), p.select("id", P.argmax("pb").alias("pred_b"))
    return a.join(b, "id").where("pred_a <> pred_b")


@query("assert_align", f"WITH {PREDS}, a AS (SELECT id, y FROM preds WHERE id % 50 <> 0), b AS (SELECT id, CASE WHEN id % 60 = 1 THEN 9 ELSE y END AS y FROM preds WHERE id % 70 <> 0) SELECT count(*) AS mismatches FROM a FULL JOIN b ON a.id = b.id WHERE a.y IS DISTINCT FROM b.y")
def assert_align(spark, d):
    p = predictions(spark, d).select("id", "y")
    a, b = p.where("id % 50 <> 0"), p.where("id % 70 <> 0").select("id", F.when(F.col("id") % 60 == 1, 9).otherwise(F.col("y")).alias("y2"))
    return a.join(b, "id", "full").where(~F.col("y").eqNullSafe(F.col("y2"))).agg(F.count("*").alias("mismatches"))


@query("join_lookup", "SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 300000")
def join_lookup(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name", "r_name")


@query("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("join_semi", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 400000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("join_cross", "SELECT t AS threshold, l_returnflag, count(*) AS n, count_if(l_discount >= t) AS at_least FROM lineitem, (SELECT unnest([0.02::DOUBLE, 0.05::DOUBLE, 0.08::DOUBLE]) AS t) GROUP BY t, l_returnflag")
def join_cross(spark, d):
    l = table(spark, d, "lineitem").select("l_returnflag", "l_discount", F.explode(F.array(F.lit(0.02), F.lit(0.05), F.lit(0.08))).alias("threshold"))  # noqa: E741
    return l.groupBy("threshold", "l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") >= F.col("threshold")).alias("at_least"))


@query("denylist", "SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src5', 'src13') GROUP BY source")
def denylist(spark, d):
    deny = spark.createDataFrame([("src1",), ("src5",), ("src13",)], "source string")
    return table(spark, d, "documents").join(F.broadcast(deny), "source", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("set_union_all", f"WITH {PREDS} SELECT regime, count(*) AS n, CAST(sum(y) AS BIGINT) AS s FROM (SELECT 'expert' AS regime, y FROM preds WHERE part = 'train' UNION ALL SELECT 'pseudo', pred_b FROM preds WHERE part <> 'test' AND conf_b > 0.8) GROUP BY regime")
def set_union_all(spark, d):
    p = predictions(spark, d)
    a = p.where("part = 'train'").select(F.lit("expert").alias("regime"), "y")
    b = p.where((F.col("part") != "test") & (P.top("pb") > 0.8)).select(F.lit("pseudo").alias("regime"), P.argmax("pb").alias("y"))
    return a.unionByName(b).groupBy("regime").agg(F.count("*").alias("n"), F.sum("y").alias("s"))


@query("set_dedup_last", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def set_dedup_last(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("e"))
    return e.select("user_id", "e.event_id", "e.event_type")


@query("set_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def set_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("set_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("set_product", "SELECT a, b, c FROM (SELECT DISTINCT o_orderpriority AS a FROM orders), (SELECT DISTINCT r_name AS b FROM region), (SELECT unnest([1, 2, 3]) AS c)")
def set_product(spark, d):
    """The grid of settings: every kind of order with every region and step; a row per kind, region and step."""
    a = table(spark, d, "orders").select(F.col("o_orderpriority").alias("a")).distinct()
    b = table(spark, d, "region").select(F.col("r_name").alias("b")).distinct()
    return a.crossJoin(F.broadcast(b)).select("a", "b", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("c"))


@query("reshape_pivot", "SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def reshape_pivot(spark, d):
    x = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)
    return x.select("o_orderpriority", *[F.col(c).alias(c.lower()) for c in "FOP"])


@query("reshape_prefix", f"WITH {PREDS} SELECT " + ", ".join(f"round(avg(CAST(pred_{b} = y AS DOUBLE)) FILTER (part = '{s}'), 9) AS {s}_accuracy_{b}" for s in ("val", "test") for b in "ab") + " FROM preds")
def reshape_prefix(spark, d):
    p = predictions(spark, d)
    return p.agg(*[F.round(F.avg(F.when(F.col("part") == s, (P.argmax(f"p{b}") == F.col("y")).cast("double"))), 9).alias(f"{s}_accuracy_{b}") for s in ("val", "test") for b in "ab"])


@query("reshape_transpose", "SELECT 'orders' AS metric, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'max_price', max(o_totalprice) FROM orders UNION ALL SELECT 'min_price', min(o_totalprice) FROM orders")
def reshape_transpose(spark, d):
    one = table(spark, d, "orders").agg(F.count("*").cast("double").alias("orders"), F.max("o_totalprice").alias("max_price"), F.min("o_totalprice").alias("min_price"))
    return one.unpivot([], one.columns, "metric", "value")


# ---- resampling


DRAWN = f"n AS (SELECT count(*) AS n FROM gated), rows_ AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS idx FROM gated), d AS (SELECT rep.range AS rep, {draw_sql(f"'{SEED}'", 'rep.range', "'0'", 'pos.range')} % n AS idx FROM n, range({REPS}) rep, LATERAL (SELECT unnest(range(n.n)) AS range) pos), boot AS (SELECT d.rep, rows_.* FROM d JOIN rows_ ON rows_.idx = d.idx)"


@query("boot_index", f"WITH {PREDS}, {DRAWN} SELECT rep, count(*) AS n, CAST(sum(id) AS BIGINT) AS s FROM boot GROUP BY rep")
def boot_index(spark, d):
    """Draws of each replicate and the sum of the ids drawn, each from all rows."""
    return B.drawn_sums(gated(spark, d).select("id"), "id", REPS, SEED, "id").select("rep", "n", F.col("id").alias("s"))


def counted_sql(cells: str, by: list[str]) -> str:
    """CTEs up to ``boot``(rep, by, n): the multinomial counts of each replicate for ``cells``, a query of the columns ``by`` (booleans, but for y).

    Cell after cell, the count is the number of outcomes whose binomial sum stays below the draw.
    """
    keys, steps = ", ".join(by), K * 2 ** (len(by) - 1) if by[0] == "y" else 2 ** len(by)
    pmf = "exp(lgamma(free + 1) - lgamma(j + 1) - lgamma(free - j + 1) + j * ln(p) + (free - j) * ln(1 - p))"
    out = f"cells AS (SELECT *, row_number() OVER (ORDER BY {keys}) - 1 AS i FROM (SELECT {keys}, count(*) AS c FROM ({cells}) GROUP BY {keys})), k0 AS (SELECT r.range AS rep, sum(c)::BIGINT AS free, sum(c)::BIGINT AS pool, NULL::BIGINT AS n FROM cells, range({REPS}) r GROUP BY r.range)"
    for i in range(steps):
        out += f""",
        u{i} AS (SELECT rep, free, pool, coalesce(c, 0) AS c, coalesce(c, 0)::DOUBLE / greatest(pool, 1) AS p, ({draw_sql(f"'{SEED}'", "rep", f"'{i}'")} + 0.5) / 4294967296::DOUBLE AS u FROM k{i} LEFT JOIN cells ON i = {i}),
        q{i} AS (SELECT rep, u, sum({pmf}) OVER (PARTITION BY rep ORDER BY j) AS f FROM (SELECT *, unnest(range(free + 1)) AS j FROM u{i} WHERE c > 0 AND c < pool AND free > 0)),
        n{i} AS (SELECT rep, count(CASE WHEN f < u THEN 1 END) AS n FROM q{i} GROUP BY rep),
        k{i + 1} AS (SELECT rep, free - n AS free, pool - c AS pool, n FROM (SELECT u.rep, free, pool, c, CASE WHEN c = pool THEN free ELSE coalesce(x.n, 0) END AS n FROM u{i} u LEFT JOIN n{i} x ON x.rep = u.rep))"""
    return out + ", boot AS (" + " UNION ALL ".join(f"SELECT k.rep, {keys}, CAST(k.n AS BIGINT) AS n FROM k{i + 1} k JOIN cells ON i = {i}" for i in range(steps)) + ")"


def counts(df: DataFrame, *by: str) -> DataFrame:
    return B.bootstrap_counts(df, REPS, SEED, *by)


def share(condition: str) -> Column:
    """Of a replicate's draws, those with the condition."""
    return F.sum(F.when(F.col(condition), F.col("n")).otherwise(0)) / F.sum("n")


def share_sql(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE"


@query("boot_metric", f"WITH {PREDS}, {counted_sql('SELECT y, ok FROM gated', ['y', 'ok'])} SELECT rep, round({share_sql('ok')}, 9) AS accuracy FROM boot WHERE n > 0 GROUP BY rep HAVING count(DISTINCT y) = 4")
def boot_metric(spark, d):
    """Accuracy of the replicates that hold all classes."""
    b = counts(gated(spark, d), "y", "ok").where("n > 0").groupBy("rep").agg(F.round(share("ok"), 9).alias("accuracy"), F.count_distinct("y").alias("k"))
    return b.where(F.col("k") == K).select("rep", "accuracy")


@query("boot_cells", f"WITH {PREDS}, {counted_sql('SELECT ok, full_gate FROM gated', ['ok', 'full_gate'])} SELECT rep, ok, full_gate, n FROM boot")
def boot_cells(spark, d):
    return counts(gated(spark, d), "ok", "full_gate").select("rep", "ok", "full_gate", "n")


PAIRED = counted_sql("SELECT pred_a = y AS ok, pred_b = y AS ok_b FROM preds", ["ok", "ok_b"])
DELTA = f"SELECT rep, {share_sql('ok')} - {share_sql('ok_b')} AS delta FROM boot GROUP BY rep"


def paired(spark, d) -> DataFrame:
    g = gated(spark, d).select("ok", (F.col("pred_b") == F.col("y")).alias("ok_b"))
    return counts(g, "ok", "ok_b").groupBy("rep").agg((share("ok") - share("ok_b")).alias("delta"))


@query("boot_paired", f"WITH {PREDS}, {PAIRED} SELECT rep, round(delta, 9) AS delta FROM ({DELTA})")
def boot_paired(spark, d):
    return paired(spark, d).select("rep", r("delta"))


REFERRED = counted_sql("SELECT single, full_gate FROM gated", ["single", "full_gate"]) + f", x AS (SELECT rep, {share_sql('single')} AS c1, {share_sql('full_gate')} AS c2 FROM boot GROUP BY rep)"


@query("join_pivot", f"WITH {PREDS}, {REFERRED} SELECT rep, round(c1, 9) AS single, round(c2, 9) AS \"full\" FROM x")
def join_pivot(spark, d):
    b = counts(gated(spark, d), "single", "full_gate")
    m = b.select("rep", "n", F.explode(F.create_map(F.lit("single"), "single", F.lit("full"), "full_gate")).alias("rule", "kept"))
    return m.groupBy("rep").pivot("rule", ["single", "full"]).agg(F.round(share("kept"), 9))


@query("agg_ci", f"WITH {PREDS}, {REFERRED} SELECT 'full' AS metric, round(quantile_cont(c2, 0.025), 9) AS low, round(quantile_cont(c2, 0.5), 9) AS median, round(quantile_cont(c2, 0.975), 9) AS high FROM x UNION ALL SELECT 'single', round(quantile_cont(c1, 0.025), 9), round(quantile_cont(c1, 0.5), 9), round(quantile_cont(c1, 0.975), 9) FROM x")
def agg_ci(spark, d):
    x = counts(gated(spark, d), "single", "full_gate").groupBy("rep").agg(share("single").alias("single"), share("full_gate").alias("full"))
    return B.interval(x, "single", "full").select("metric", r("low"), r("median"), r("high"))


@query("test_verdict", f"WITH {PREDS}, {PAIRED}, x AS ({DELTA}), q AS (SELECT round(quantile_cont(delta, 0.025), 9) AS low, round(quantile_cont(delta, 0.975), 9) AS high FROM x) SELECT low, high, CASE WHEN low > 0 OR high < 0 THEN 'Supported' ELSE 'Interval includes zero' END AS verdict FROM q")
def test_verdict(spark, d):
    return B.interval(paired(spark, d), "delta").select(r("low"), r("high"), B.verdict("low", "high").alias("verdict"))


@query("test_mcnemar", f"WITH {PREDS}, m AS (SELECT count_if(pred_a = y AND pred_b <> y) AS b, count_if(pred_a <> y AND pred_b = y) AS c FROM preds), t AS (SELECT b, c, sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2::DOUBLE))) AS tail FROM (SELECT b, c, unnest(range(least(b, c) + 1)) AS i FROM m) GROUP BY b, c) SELECT b, c, round(least(1, 2 * tail), 9) AS p FROM t")
def test_mcnemar(spark, d):
    g = gated(spark, d).select("ok", (F.col("pred_b") == F.col("y")).alias("ok_b"))
    return B.mcnemar(g, "ok", "ok_b").select("b", "c", r("p"))


EXACT = """
WITH RECURSIVE {preds}, k AS (SELECT y, CAST(count_if(pred_a = y) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS n FROM preds GROUP BY y),
-- P(X >= least) grows with p: the low end is where that of the hits is 0.025, the high end where that of one more is 0.975
side AS (SELECT y, n, hits AS least, 0.025::DOUBLE AS goal, 'low' AS side FROM k UNION ALL SELECT y, n, hits + 1, 0.975::DOUBLE, 'high' FROM k),
cut AS (
    SELECT 0 AS step, y, side, n, least, goal, 0::DOUBLE AS lo, 1::DOUBLE AS hi FROM side
    UNION ALL
    SELECT step + 1, y, side, n, least, goal, CASE WHEN f < goal THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < goal THEN hi ELSE (lo + hi) / 2 END
    FROM (SELECT *, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)) FOR i IN range(least, n + 1)]) AS f FROM cut WHERE step < 45)
), ends AS (SELECT y, max(CASE WHEN side = 'low' THEN CASE WHEN least = 0 THEN 0 ELSE (lo + hi) / 2 END END) AS low, max(CASE WHEN side = 'high' THEN CASE WHEN least > n THEN 1 ELSE (lo + hi) / 2 END END) AS high FROM cut WHERE step = 45 GROUP BY y)
SELECT k.y, hits, n, round(low, 9) AS low, round(high, 9) AS high FROM k JOIN ends ON k.y = ends.y
"""


@query("test_cp", EXACT.format(preds=PREDS))
def test_cp(spark, d):
    """Exact intervals of accuracy per class; the twin halves binomial sums."""
    n = gated(spark, d).groupBy("y").agg(F.count_if("ok").alias("hits"), F.count("*").alias("n"))
    return n.withColumn("ci", B.clopper_pearson("hits", "n")).select("y", "hits", "n", F.round("ci.low", 9).alias("low"), F.round("ci.high", 9).alias("high"))


# ---- selection


@query("fit_temperature")
def fit_temperature(spark, d):
    """The temperature fitted on validation rows, with log loss on test rows before and after; rows only."""
    p = predictions(spark, d)
    t = S.fit_temperature(p.where("part = 'val'"), "y", "pa")
    loss = lambda q: F.avg(-F.ln(F.element_at(q, F.col("y") + 1)))
    return p.where("part = 'test'").agg(F.lit(t).alias("temperature"), F.round(loss(F.col("pa")), 9).alias("before"), F.round(loss(P.temperature("pa", t)), 9).alias("after"))


MODELS = "m AS (SELECT label AS model, label % 3 AS family, round(avg(embedding[1]::DOUBLE), 6) + 1 AS f1, round(avg(embedding[2]::DOUBLE), 2) AS ba FROM embeddings GROUP BY label)"


def models(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").groupBy(F.col("label").alias("model")).agg((F.round(F.avg(F.col("embedding")[0].cast("double")), 6) + 1).alias("f1"), F.round(F.avg(F.col("embedding")[1].cast("double")), 2).alias("ba"))
    return e.withColumn("family", F.col("model") % 3)


@query("sel_ensemble_w", f"WITH {MODELS} SELECT model, round(pow(greatest(f1, 0.01), 3) / sum(pow(greatest(f1, 0.01), 3)) OVER (), 9) AS weight FROM m")
def sel_ensemble_w(spark, d):
    m = models(spark, d)
    return m.select("model", F.round(S.weights(m, "f1", 3.0), 9).alias("weight"))


@query("win_best_family", f"WITH {MODELS}, o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY f1 DESC, model) AS place FROM m) SELECT family, model, round(f1, 6) AS f1 FROM o WHERE place = 1")
def win_best_family(spark, d):
    return S.best(models(spark, d), [F.desc("f1"), F.asc("model")], "family").select("family", "model", r("f1", 6))


@query("win_best_lex", f"WITH {MODELS} SELECT model, ba, round(f1, 6) AS f1 FROM m ORDER BY ba DESC, f1 DESC, model LIMIT 1")
def win_best_lex(spark, d):
    return models(spark, d).orderBy(F.desc("ba"), F.desc("f1"), "model").limit(1).select("model", "ba", r("f1", 6))


SWEPT = "g AS (SELECT i.range / 20::DOUBLE AS w FROM range(21) i), q AS (SELECT w, y, list_transform(list_zip(pa, pb), lambda x: x[1] * w + x[2] * (1 - w)) AS p FROM preds, g WHERE part = 'val'), s AS (SELECT w, count(*) AS n, count_if(list_position(p, list_max(p)) - 1 = y) AS hits, round(avg(-ln(greatest(p[y + 1], 1e-12::DOUBLE))), 9) AS loss FROM q GROUP BY w)"


@query("sel_mixture", f"WITH {PREDS}, {SWEPT} SELECT w, n, hits, loss, row_number() OVER (ORDER BY hits DESC, loss, w) AS place FROM s")
def sel_mixture(spark, d):
    s = S.mixture_sweep(predictions(spark, d).where("part = 'val'")).withColumn("loss", F.round("loss", 9))
    return s.select("w", "n", "hits", "loss", F.row_number().over(Window.orderBy(F.desc("hits"), "loss", "w")).cast("long").alias("place"))


CENTRED = "cen AS (SELECT label, i.range AS dim, avg(embedding[i.range + 1]::DOUBLE) AS m, stddev_pop(embedding[i.range + 1]::DOUBLE) AS s FROM embeddings, range(64) i GROUP BY 1, 2), far AS (SELECT vec_id, e.label, round(avg(((embedding[dim + 1]::DOUBLE - m) / (s + 1e-3)) ** 2), 9) AS distance FROM embeddings e JOIN cen ON cen.label = e.label GROUP BY vec_id, e.label)"


def distances(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = M.centroids(e, "label", "embedding")
    return e.join(F.broadcast(c), "label").select("vec_id", "label", F.round(S.standard_distance("embedding", "mean", "std"), 9).alias("distance"))


@query("win_topk_frac", f"WITH {CENTRED}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM far) SELECT vec_id, label, distance FROM o WHERE place <= round_even(n * 0.25::DOUBLE, 0)")
def win_topk_frac(spark, d):
    return S.nearest_share(distances(spark, d), "label", "distance", "vec_id", 0.25)


@query("sel_gate_grid", f"WITH {CENTRED}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM far), g AS (SELECT unnest([0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 1::DOUBLE]) AS share), x AS (SELECT share, count_if(place <= round_even(n * share, 0)) AS admitted, round(coalesce(avg(distance) FILTER (place <= round_even(n * share, 0)), 0), 6) AS mean_distance FROM o, g GROUP BY share) SELECT share, admitted, mean_distance, row_number() OVER (ORDER BY mean_distance, share) = 1 AS chosen FROM x")
def sel_gate_grid(spark, d):
    far = distances(spark, d)
    o = places(far, ["distance", "vec_id"], "label").join(far.groupBy("label").agg(F.count("*").alias("n")), "label")
    o = o.withColumn("share", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 1.0)))))
    inside = F.col("place") <= F.bround(F.col("n") * F.col("share"))
    x = o.groupBy("share").agg(F.count_if(inside).alias("admitted"), F.round(F.coalesce(F.avg(F.when(inside, F.col("distance"))), F.lit(0.0)), 6).alias("mean_distance"))
    return x.withColumn("chosen", F.row_number().over(Window.orderBy("mean_distance", "share")) == 1)


HISTORY = "h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value AS score FROM events)"


@query("early_stop", f"""WITH {HISTORY}, u AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-6, true) AS up FROM h), l AS (SELECT *, max(CASE WHEN up THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM u),
s AS (SELECT run, coalesce(min(CASE WHEN epoch >= 10 AND epoch - last >= 6 THEN epoch END), max(epoch)) AS stop_epoch FROM l GROUP BY run) SELECT l.run, max(epoch) AS best_epoch, arg_max(score, epoch) AS best, stop_epoch FROM l JOIN s ON s.run = l.run WHERE epoch <= stop_epoch AND up GROUP BY l.run, stop_epoch""")
def early_stop(spark, d):
    h = table(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("epoch"), F.col("value").alias("score"))
    return S.early_stop(h, "run", "epoch", "score")


@query("agg_lc", "SELECT o_orderpriority AS size, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1")
def agg_lc(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("size"))
    return o.agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("agg_epoch", "SELECT l_linenumber AS epoch, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS weighted, round(avg(l_discount), 9) AS plain FROM lineitem GROUP BY 1")
def agg_epoch(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 9).alias("weighted"), F.round(F.avg("l_discount"), 9).alias("plain"))
