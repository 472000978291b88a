"""Queries on scalar functions: bits, rounding, strings, JSON, arrays, hashes, and draws from a normal distribution."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from .adapters import PREDS, draw, draw_sql, predictions
from .registry import query, table


@query("fn_bits", "SELECT o_orderkey, (o_orderkey << 3) | (o_custkey & 7) AS packed, CAST(bit_count(xor(o_orderkey, o_custkey)) AS INTEGER) AS apart, o_orderkey >> 2 AS quarter FROM orders")
def fn_bits(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    packed = F.shiftleft(k, 3).bitwiseOR(c.bitwiseAND(F.lit(7)))
    return table(spark, d, "orders").select("o_orderkey", packed.alias("packed"), F.bit_count(k.bitwiseXOR(c)).alias("apart"), F.shiftright(k, 2).alias("quarter"))


@query("fn_round", "SELECT p_partkey, round_even(p_size / 4::DOUBLE, 0) AS even, round(p_size / 4::DOUBLE, 0) AS up, abs(p_size / 4::DOUBLE - round_even(p_size / 4::DOUBLE, 0)) <= 1e-8 AS whole FROM part")
def fn_round(spark, d):
    x = F.col("p_size") / 4.0
    return table(spark, d, "part").select("p_partkey", F.bround(x).alias("even"), F.round(x).alias("up"), (F.abs(x - F.bround(x)) <= 1e-8).alias("whole"))


@query("fn_math", f"WITH {PREDS} SELECT id, round(ln(greatest(conf_a, 1e-12)), 9) AS ln, round(exp(conf_a), 9) AS exp, round(sqrt(conf_a), 9) AS sqrt, round(ln(1 + conf_a), 9) AS log1p, abs(conf_a - conf_b) <= 0.05::DOUBLE AS near FROM preds")
def fn_math(spark, d):
    p = predictions(spark, d).select("id", F.array_max("pa").alias("a"), F.array_max("pb").alias("b"))
    return p.select("id", F.round(F.ln(F.greatest("a", F.lit(1e-12))), 9).alias("ln"), F.round(F.exp("a"), 9).alias("exp"), F.round(F.sqrt("a"), 9).alias("sqrt"), F.round(F.log1p("a"), 9).alias("log1p"), (F.abs(F.col("a") - F.col("b")) <= 0.05).alias("near"))


@query("fn_string", "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, concat_ws(' | ', page_id, regexp_extract(url, '://([^/?#]*)', 1)) AS label, len(regexp_extract_all(url, '[0-9]+')) AS numbers, printf('%+.3f', ((page_id % 100) - 50) / 8::DOUBLE) AS signed FROM pages")
def fn_string(spark, d):
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^([A-Za-z]+)://", 1)).alias("scheme"), F.concat_ws(" | ", F.col("page_id").cast("string"), host).alias("label"), F.size(F.regexp_extract_all("url", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("numbers"), F.format_string("%+.3f", (F.col("page_id") % 100 - 50) / 8.0).alias("signed"))


@query("fn_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{\"id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS report FROM events")
def fn_json(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("report"))


@query("fn_array", "SELECT vec_id, round(list_sum(list_transform(embedding[1:61:4], lambda v: v::DOUBLE)), 6) AS stride_sum, round(list_max(embedding)::DOUBLE, 6) AS top, len(list_filter(embedding, lambda v: v > 0)) AS positive FROM embeddings")
def fn_array(spark, d):
    stride = F.transform(F.filter("embedding", lambda v, i: i % 4 == 0), lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(stride, F.lit(0.0), lambda a, v: a + v), 6).alias("stride_sum"), F.round(F.array_max("embedding").cast("double"), 6).alias("top"), F.size(F.filter("embedding", lambda v: v > 0)).cast("long").alias("positive"))


@query("fn_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def fn_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5(F.col("text").cast("binary")).alias("md5"))


LATENT = f"c AS (SELECT label, avg(embedding[1]::DOUBLE) AS m, stddev_pop(embedding[1]::DOUBLE) AS s, greatest(0, 60 - count(*)) AS n FROM embeddings GROUP BY label), g AS (SELECT label, m, s, i.range AS i FROM c, LATERAL (SELECT unnest(range(n::BIGINT)) AS range) i), u AS (SELECT *, ({draw_sql("'u'", 'label', 'i')} + 1) / 4294967297::DOUBLE AS u1, {draw_sql("'v'", 'label', 'i')} / 4294967296::DOUBLE AS u2 FROM g)"


@query("gen_latent", f"WITH {LATENT} SELECT label, i AS draw, round(m + 0.55::DOUBLE * s * greatest(-1.5::DOUBLE, least(1.5::DOUBLE, sqrt(-2 * ln(u1)) * cos({2 * math.pi!r}::DOUBLE * u2))), 6) AS value FROM u")
def gen_latent(spark, d):
    """Normal draws around a class's mean, clipped at 1.5 deviations, for classes with fewer than 60 rows."""
    c = table(spark, d, "embeddings").groupBy("label").agg(F.avg(F.col("embedding")[0].cast("double")).alias("m"), F.stddev_pop(F.col("embedding")[0].cast("double")).alias("s"), F.greatest(F.lit(0), F.lit(60) - F.count("*")).alias("n"))
    g = c.where("n > 0").select("label", "m", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("draw"))
    u1, u2 = (draw("u", F.col("label"), F.col("draw")) + 1) / 4294967297.0, draw("v", F.col("label"), F.col("draw")) / 4294967296.0
    z = F.sqrt(-2 * F.ln(u1)) * F.cos(u2 * (2 * math.pi))
    return g.select("label", "draw", F.round(F.col("m") + F.col("s") * 0.55 * F.greatest(F.lit(-1.5), F.least(F.lit(1.5), z)), 6).alias("value"))


@query("report_json", f"WITH {PREDS}, m AS (SELECT part, count(*) AS n, count_if(pred_a = y) AS hits FROM preds GROUP BY part) SELECT string_agg('\"' || part || '\":{{\"n\":' || n || ',\"hits\":' || hits || '}}', ',' ORDER BY part) AS report FROM m")
def report_json(spark, d):
    """A nested report as one JSON text."""
    from ..functions import probs as P

    m = predictions(spark, d).groupBy("part").agg(F.count("*").alias("n"), F.count_if(P.argmax("pa") == F.col("y")).alias("hits"))
    each = F.struct("part", F.to_json(F.struct("n", "hits")).alias("j"))
    rows = m.agg(F.array_sort(F.collect_list(each)).alias("x"))
    return rows.select(F.array_join(F.transform("x", lambda r: F.concat(F.lit('"'), r["part"], F.lit('":'), r["j"])), ",").alias("report"))


@query("agg_macro_auc", f"WITH {PREDS}, pts AS (SELECT CAST(c.range AS INTEGER) AS c, pb[c.range + 1] AS score, y = c.range AS hit FROM preds, range(4) c), a AS (SELECT c, score, hit, rank() OVER w + (count(*) OVER (PARTITION BY c, score) - 1) / 2::DOUBLE AS r FROM pts WINDOW w AS (PARTITION BY c ORDER BY score)), s AS (SELECT c, (sum(r) FILTER (hit) - count_if(hit) * (count_if(hit) + 1) / 2::DOUBLE) / (count_if(hit)::DOUBLE * count_if(NOT hit)) AS auc FROM a GROUP BY c) SELECT round(avg(auc), 9) AS macro_auc FROM s")
def agg_macro_auc(spark, d):
    return M.auc(M.scored(predictions(spark, d), 4, "y", "pb")).agg(F.round(F.avg("auc"), 9).alias("macro_auc"))
