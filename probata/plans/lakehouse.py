"""Queries on sources, contracts, provenance, the lake and its streams, and model fitting."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Tokenizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import probs as P
from ..operators import audit as A
from ..operators import lake as L
from ..operators import metrics as M
from ..operators import referral as R
from ..operators import select as SE
from ..operators import text as TX
from ..operators import train as TR
from ..session import scratch, stored
from ..sources import files as IO
from ..streaming import stream as ST
from .adapters import K, PREDS, predictions
from .evidence import gated
from .registry import query, table

# ---- sources and sinks


@query("src_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    IO.write_report(table(spark, d, "nation"), path := scratch(spark, "csv"))
    return IO.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("snk_csv", "SELECT r_regionkey, r_name, 'a,b \"c\"' AS quoted FROM region")
def snk_csv(spark, d):
    IO.write_report(table(spark, d, "region").withColumn("quoted", F.lit('a,b "c"')), path := scratch(spark, "csv"))
    return spark.read.option("escape", "\\").schema("r_regionkey int, r_name string, quoted string").csv(path, header=True)


@query("src_json", "SELECT r_regionkey, r_name FROM region")
def src_json(spark, d):
    one = table(spark, d, "region").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))
    one.coalesce(1).write.text(path := scratch(spark, "json"))
    return IO.read_json(spark, path, "r_regionkey int, r_name string")


@query("snk_json", "SELECT l_returnflag, count(*) AS n, CAST(NULL AS DOUBLE) AS undefined FROM lineitem GROUP BY l_returnflag")
def snk_json(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("undefined"))
    IO.write_report(t, path := scratch(spark, "json"), "json")
    return spark.read.schema("l_returnflag string, n long, undefined double").json(path)


@query("src_npz", "SELECT vec_id, len(embedding) AS width, embedding[1]::DOUBLE AS first, label FROM embeddings")
def src_npz(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("width"), F.col("embedding")[0].cast("double").alias("first"), "label")


@query("snk_npz", f"WITH {PREDS} SELECT id, y, pa[1] AS p0, part FROM preds")
def snk_npz(spark, d):
    p = stored(predictions(spark, d).select("id", "y", "pa", "part"), "predictions")
    return p.select("id", "y", F.col("pa")[0].alias("p0"), "part")


@query("cache", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 20 GROUP BY l_returnflag")
def cache(spark, d):
    return stored(table(spark, d, "lineitem").where("l_quantity > 20").select("l_returnflag"), "cache").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("src_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000 AND o_orderstatus = 'O'")
def src_parquet(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 450000 and o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")


PARTS = 4
#: What a text file of the documents of a language and a part holds: a line per document, by id.
FILES = f"f AS (SELECT 'folder=class-' || lang AS label, doc_id % {PARTS} AS part, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1, 2)"


def class_files(spark, d) -> str:
    """All documents as text files in folders named by language, in four parts."""
    docs = table(spark, d, "documents").select("text", "doc_id", (F.col("doc_id") % PARTS).alias("part"), F.concat_ws("-", F.lit("class"), F.col("lang")).alias("folder"))
    docs = docs.withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("none")))
    rows = IO.dealt(docs, docs.groupBy("part", "folder").agg(F.count("*").alias("n")), ["part", "folder"], "n").sortWithinPartitions("part", "folder", "doc_id").drop("doc_id")
    rows.write.partitionBy("part", "folder").text(path := scratch(spark, "files"))
    return path


def hashed_files(spark, d) -> DataFrame:
    """(name, label, part, bytes, sha256) of the files."""
    files = IO.labelled_files(spark, class_files(spark, d), "*.txt")
    part = F.regexp_extract("path", r"part=(\d+)/", 1).cast("long")
    return files.withColumn("part", part).withColumn("name", F.concat_ws("/", "part", "label"))


@query("src_glob", f"WITH {FILES} SELECT label, count(*) AS files, CAST(sum(octet_length(encode(body))) AS BIGINT) AS bytes FROM f GROUP BY label")
def src_glob(spark, d):
    """Files in class folders, labelled by folder."""
    return hashed_files(spark, d).groupBy("label").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query("src_bytes", f"WITH {FILES} SELECT label, part, CAST(octet_length(encode(body)) AS BIGINT) AS bytes, sha256(body) AS sha256 FROM f")
def src_bytes(spark, d):
    """Sizes and hashes of raw file bytes."""
    return hashed_files(spark, d).select("label", "part", "bytes", "sha256")


@query("snk_sums", f"WITH {FILES} SELECT part || '/' || label AS name, sha256(body) AS sha256 FROM f")
def snk_sums(spark, d):
    """A SHA256SUMS file, written and read back."""
    lines = IO.sums(hashed_files(spark, d).withColumn("path", F.concat_ws("/", F.lit(""), F.regexp_replace("name", "/", "|"))))
    lines.repartition(1).write.text(path := scratch(spark, "SHA256SUMS"))  # coalesce(1) would hash all files in one task
    read = spark.read.text(path)
    return read.select(F.regexp_replace(F.substring_index("value", "  ", -1), r"\|", "/").alias("name"), F.substring_index("value", "  ", 1).alias("sha256"))


@query("prov_audit_hash", f"WITH {FILES}, n AS (SELECT count(*) AS n FROM f) SELECT 'ok' AS status, n - 2 AS n FROM n UNION ALL SELECT s, 1 FROM (VALUES ('mismatch'), ('extra'), ('missing')) t(s)")
def prov_audit_hash(spark, d):
    """A manifest with one entry changed, one dropped and one too many, held against the files."""
    files = stored(hashed_files(spark, d).select("name", "sha256"), "manifest")
    names = [r.name for r in files.select("name").orderBy("name").limit(2).collect()]
    listed = files.where(F.col("name") != names[1]).withColumn("sha256", F.when(F.col("name") == names[0], F.concat(F.lit("-"), F.substring("sha256", 2, 63))).otherwise(F.col("sha256")))
    listed = listed.unionByName(spark.createDataFrame([("none", "0" * 64)], "name string, sha256 string"))
    return IO.reconcile(listed, files, "name", "sha256").groupBy("status").agg(F.count("*").alias("n"))


@query("join_full", "WITH a AS (SELECT o_orderkey AS k, md5(CAST(o_custkey AS VARCHAR)) AS h FROM orders WHERE o_orderkey % 50 <> 1), b AS (SELECT o_orderkey AS k, md5(CAST(CASE WHEN o_orderkey % 60 = 2 THEN 0 ELSE o_custkey END AS VARCHAR)) AS h FROM orders WHERE o_orderkey % 70 <> 3) SELECT CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.h = b.h THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def join_full(spark, d):
    o, h = table(spark, d, "orders"), lambda c: F.md5(c.cast("string").cast("binary")).alias("h")
    a = o.where("o_orderkey % 50 <> 1").select(F.col("o_orderkey").alias("k"), h(F.col("o_custkey")))
    b = o.where("o_orderkey % 70 <> 3").select(F.col("o_orderkey").alias("k"), h(F.when(F.col("o_orderkey") % 60 == 2, 0).otherwise(F.col("o_custkey"))))
    return IO.reconcile(a, b, "k", "h").groupBy("status").agg(F.count("*").alias("n"))


# ---- provenance and contracts

EVIDENCE = "ev AS (SELECT doc_id, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 0 THEN 'expert' WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 1 THEN 'pseudo' ELSE 'generated' END AS level, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS part FROM documents)"


def evidence(spark, d) -> DataFrame:
    n, i = F.substring("source", 4, 9).cast("int") % 3, F.col("doc_id") % 10
    return table(spark, d, "documents").select("doc_id", F.when(n == 0, "expert").when(n == 1, "pseudo").otherwise("generated").alias("level"), F.when(i < 7, "train").when(i < 8, "validation").otherwise("test").alias("part"))


@query("prov_filter", f"WITH {EVIDENCE} SELECT doc_id, part FROM ev WHERE level = 'expert'")
def prov_filter(spark, d):
    admitted = L.admitted(evidence(spark, d), "level", "expert")
    # nothing else is left, or the strict filter would end the job
    return L.admitted(admitted, "level", "expert", strict=True).select("doc_id", "part")


@query("prov_firewall", f"WITH {EVIDENCE}, ok AS (SELECT * FROM (VALUES ('expert', 'train'), ('expert', 'validation'), ('expert', 'test'), ('pseudo', 'train')) t(level, part)) SELECT level, part, count(*) AS violations FROM ev WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.level = ev.level AND ok.part = ev.part) GROUP BY level, part")
def prov_firewall(spark, d):
    ok = spark.createDataFrame([("expert", "train"), ("expert", "validation"), ("expert", "test"), ("pseudo", "train")], "level string, part string")
    return evidence(spark, d).join(F.broadcast(ok), ["level", "part"], "left_anti").groupBy("level", "part").agg(F.count("*").alias("violations"))


@query("pseudo_filter", "SELECT d.doc_id, lang FROM documents d JOIN labels USING (doc_id) WHERE quality = 1")
def pseudo_filter(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang")


@query("pseudo_rule", f"WITH {PREDS}, t AS (SELECT * FROM (VALUES (0, 0.6::DOUBLE, 0.3::DOUBLE), (1, 0.7::DOUBLE, 0.4::DOUBLE), (2, 0.65::DOUBLE, 0.3::DOUBLE), (3, 0.75::DOUBLE, 0.5::DOUBLE)) v(c, least_conf, least_margin)) SELECT id, pred_a AS label FROM preds JOIN t ON c = pred_a WHERE pred_a = pred_b AND conf_a > least_conf AND list_sort(pa, 'DESC')[1] - list_sort(pa, 'DESC')[2] > least_margin")
def pseudo_rule(spark, d):
    t = spark.createDataFrame([(0, 0.6, 0.3), (1, 0.7, 0.4), (2, 0.65, 0.3), (3, 0.75, 0.5)], "label int, least_conf double, least_margin double")
    p = predictions(spark, d).withColumn("label", P.argmax("pa")).where(F.size(F.array_distinct(F.array(P.argmax("pa"), P.argmax("pb")))) == 1)
    return p.join(F.broadcast(t), "label").where((P.top("pa") > F.col("least_conf")) & (P.margin("pa") > F.col("least_margin"))).select("id", "label")


LIMITS = [(0, 0.6, 0.3), (1, 0.7, 0.4), (2, 0.65, 0.3), (3, 0.75, 0.5)]
#: Test rows, copies of some of them and of training rows under other ids, and some whose content can't be read; names end in png, each seventh in jpg.
POOL = "e AS (SELECT p.*, v.embedding FROM preds p JOIN embeddings v ON v.vec_id = p.id), pool AS (SELECT * FROM e WHERE part = 'test' UNION ALL SELECT * REPLACE (id + 1000000 AS id) FROM e WHERE id % 10 = 1 UNION ALL SELECT * REPLACE (id + 2000000 AS id) FROM e WHERE id % 25 = 2 UNION ALL SELECT * REPLACE (id + 3000000 AS id, NULL AS embedding) FROM e WHERE id % 20 = 1)"


@query("pseudo_rule_full", f"WITH {PREDS}, {POOL}, t AS (SELECT * FROM (VALUES {', '.join(f'({c}, {a}::DOUBLE, {b}::DOUBLE)' for c, a, b in LIMITS)}) v(c, least_conf, least_margin)), ok AS (SELECT pool.id, pred_a AS label, embedding FROM pool JOIN t ON c = pred_a WHERE id % 7 <> 0 AND pred_a = pred_b AND conf_a > least_conf AND list_sort(pa, 'DESC')[1] - list_sort(pa, 'DESC')[2] > least_margin AND embedding IS NOT NULL AND embedding NOT IN (SELECT embedding FROM e WHERE part = 'train')) SELECT min(id) AS id, arg_min(label, id) AS label FROM ok GROUP BY embedding")
def pseudo_rule_full(spark, d):
    """The whole rule of acceptance: right kind of file, branches agree, confidence and margin above those of the class, readable, no copy of a training row or of an accepted one."""
    e = predictions(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    copies = lambda rule, more: e.where(rule).withColumn("id", F.col("id") + more)
    pool = e.where("part = 'test'").unionByName(copies("id % 10 = 1", 1_000_000)).unionByName(copies("id % 25 = 2", 2_000_000))
    pool = pool.unionByName(copies("id % 20 = 1", 3_000_000).withColumn("embedding", F.lit(None).cast("array<float>")))
    name = F.concat(F.col("id").cast("string"), F.when(F.col("id") % 7 == 0, ".jpg").otherwise(".png"))
    t = F.broadcast(spark.createDataFrame(LIMITS, "label int, least_conf double, least_margin double"))
    pool = pool.select("id", P.argmax("pa").alias("label"), P.argmax("pb").alias("other"), P.top("pa").alias("top"), P.margin("pa").alias("margin"), name.alias("name"), "embedding").join(t, "label")
    holds = F.col("name").endswith(".png") & (F.col("label") == F.col("other")) & (F.col("top") > F.col("least_conf")) & (F.col("margin") > F.col("least_margin"))
    return SE.accepted(pool, e.where("part = 'train'"), "id", "embedding", holds).select("id", "label")


@query("suffix_filter", "SELECT page_id, regexp_extract(lower(url), '\\.([a-z]+)$', 1) AS suffix FROM pages WHERE regexp_matches(lower(url), '\\.html$')")
def suffix_filter(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract(F.lower("url"), r"\.([a-z]+)$", 1).alias("suffix"))
    return p.where("suffix = 'html'")


@query("part_slice", f"WITH {PREDS} SELECT part, count(*) AS n, min(id) AS first, max(id) AS last FROM preds GROUP BY part")
def part_slice(spark, d):
    return predictions(spark, d).groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("label_map", "SELECT doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END AS idx FROM documents")
def label_map(spark, d):
    index = F.create_map(*[F.lit(x) for i, c in enumerate(("de", "en", "es", "fr")) for x in (c, i)])
    return table(spark, d, "documents").select("doc_id", F.element_at(index, F.col("lang")).alias("idx"))


PATHS = "CASE doc_id % 5 WHEN 0 THEN '/abs/' || doc_id WHEN 1 THEN 'a/../b' WHEN 2 THEN '' WHEN 3 THEN 'a..b/' || doc_id ELSE lang || '/' || doc_id || '.txt' END"


@query("path_safe", f"WITH p AS (SELECT doc_id, {PATHS} AS path FROM documents) SELECT doc_id, path <> '' AND NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS safe FROM p")
def path_safe(spark, d):
    return table(spark, d, "documents").select("doc_id", IO.safe_path(F.expr(PATHS)).alias("safe"))


@query("contract_array", "WITH e AS (SELECT *, len(embedding) AS w FROM embeddings) SELECT 'width' AS rule, CAST(max(w) - min(w) AS BIGINT) AS violations FROM e UNION ALL SELECT 'finite', count_if(len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) > 0) FROM e UNION ALL SELECT 'label_range', count_if(label < 0 OR label >= 10) FROM e UNION ALL SELECT 'absent_classes', 10 - count(DISTINCT label) FROM e UNION ALL SELECT 'empty', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM e")
def contract_array(spark, d):
    e = table(spark, d, "embeddings").select("label", F.size("embedding").alias("w"), F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("odd"))
    one = e.agg((F.max("w") - F.min("w")).cast("long").alias("width"), F.count_if("odd").alias("finite"), F.count_if((F.col("label") < 0) | (F.col("label") >= 10)).alias("label_range"), (F.lit(10) - F.count_distinct("label")).cast("long").alias("absent_classes"), F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("empty"))
    return one.unpivot([], one.columns, "rule", "violations")


@query("contract_data", r"""WITH d AS (SELECT *, md5(lower(trim(text))) AS norm FROM documents) SELECT 'null_text' AS rule, count_if(text IS NULL) AS violations FROM d UNION ALL SELECT 'allowed_lang', count_if(lang NOT IN ('en', 'de', 'fr', 'es')) FROM d
UNION ALL SELECT 'duplicate_rows', count(*) - count(DISTINCT norm) FROM d UNION ALL SELECT 'email', count_if(regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+')) FROM d UNION ALL SELECT 'class_bounds', (SELECT count(*) FROM (SELECT lang FROM d GROUP BY lang HAVING count(*) < 50)) UNION ALL SELECT 'line_key', count(*) - count(DISTINCT l_orderkey * 100 + l_linenumber) FROM lineitem""")
def contract_data(spark, d):
    x = table(spark, d, "documents")
    n = x.groupBy(F.md5(F.lower(F.trim("text")).cast("binary")).alias("norm")).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("v"))
    one = x.agg(F.count_if(F.col("text").isNull()).alias("null_text"), F.count_if(~F.col("lang").isin("en", "de", "fr", "es")).alias("allowed_lang"), F.count_if(F.col("text").rlike(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+")).alias("email"))
    out = one.unpivot([], one.columns, "rule", "violations").unionByName(n.select(F.lit("duplicate_rows").alias("rule"), F.col("v").alias("violations")))
    small = x.groupBy("lang").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") < 50).alias("violations"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("violations"))
    return out.unionByName(small.select(F.lit("class_bounds").alias("rule"), "violations")).unionByName(lines.select(F.lit("line_key").alias("rule"), "violations"))


CLASSWISE = "m AS (SELECT 'single' AS rule, y, ok, single AS kept FROM gated UNION ALL SELECT 'full', y, ok, full_gate FROM gated), cw AS (SELECT rule, y, count(*) AS support, count_if(kept) AS retained, count_if(NOT kept) AS referred, count_if(kept AND ok) AS hits, count_if(NOT ok) AS errors, count_if(NOT ok AND NOT kept) AS errors_referred FROM m GROUP BY rule, y)"


@query("agg_audit", f"""WITH {PREDS}, {CLASSWISE}, t AS (SELECT rule, count(*) AS rows, sum(support) AS total, sum(retained) AS kept, sum(hits) AS hits, sum(errors) AS errors, sum(errors_referred) AS errors_referred FROM cw GROUP BY rule), rep AS (SELECT rule, total, kept, hits, rows, errors, errors_referred, errors_referred + CASE WHEN rule = 'full' THEN 1 ELSE 0 END AS told, kept::DOUBLE / total + CASE WHEN rule = 'single' THEN 1e-6::DOUBLE ELSE 0 END AS coverage FROM t)
SELECT rule, c.check AS "check", CASE c.check WHEN 'classes' THEN rows = 4 WHEN 'cases' THEN total = (SELECT count(*) FROM preds) WHEN 'retained_n' THEN true WHEN 'coverage' THEN abs(kept::DOUBLE / total - coverage) <= 1e-9 WHEN 'errors_referred' THEN errors - (kept - hits) = told ELSE errors - (kept - hits) = errors_referred END AS ok
FROM rep, (VALUES ('classes'), ('cases'), ('counts'), ('whole_numbers'), ('retained_n'), ('coverage'), ('retained_accuracy'), ('errors_referred'), ('error_capture')) c("check")""")
def agg_audit(spark, d):
    """Reported figures held against rows per class; one rule's coverage is off by a millionth, the other's referred errors by one."""
    g = gated(spark, d)
    m = g.select("y", "pred", "ok", F.explode(F.create_map(F.lit("single"), "single", F.lit("full"), "full_gate")).alias("rule", "retained"))
    told = R.totals(m, "rule").withColumn("coverage", F.col("coverage") + F.when(F.col("rule") == "single", 1e-6).otherwise(0.0))
    told = told.withColumn("errors_referred", F.col("errors_referred") + F.when(F.col("rule") == "full", 1).otherwise(0))
    return A.reconcile_rules(told, R.by_class(m, "rule"), K, g.count())


def _cells(p: str) -> str:
    return f"SELECT c.range AS c, count_if(y = c.range AND pred_{p} = c.range) AS h, count_if(y = c.range) AS s, count_if(pred_{p} = c.range) AS q FROM preds, range(4) c GROUP BY c.range"


def _ece(p: str) -> str:
    return f"SELECT sum(abs(ok - conf) * n) / sum(n) AS v FROM (SELECT avg(CAST(pred_{p} = y AS DOUBLE)) AS ok, avg(conf_{p}) AS conf, count(*) AS n FROM preds JOIN range(10) b ON conf_{p} >= b.range * 0.1::DOUBLE AND (conf_{p} < (b.range + 1) * 0.1::DOUBLE OR b.range = 9) GROUP BY b.range)"


F1 = "SELECT avg(coalesce(2 * h::DOUBLE / nullif(s + q, 0), 0)) AS v FROM"


@query("gate_regress", f"WITH {PREDS}, ca AS ({_cells('a')}), cb AS ({_cells('b')}), m AS (SELECT 'accuracy' AS metric, avg(CAST(pred_a = y AS DOUBLE)) AS base, avg(CAST(pred_b = y AS DOUBLE)) AS cand, 0.01::DOUBLE AS tol, 1 AS good FROM preds UNION ALL SELECT 'macro_f1', ({F1} ca), ({F1} cb), 0.02::DOUBLE, 1 UNION ALL SELECT 'ece', ({_ece('a')}), ({_ece('b')}), 0.005::DOUBLE, -1 UNION ALL SELECT 'recall_' || y, avg(CAST(pred_a = y AS DOUBLE)), avg(CAST(pred_b = y AS DOUBLE)), 0.05::DOUBLE, 1 FROM preds GROUP BY y UNION ALL SELECT 'provenance', 1::DOUBLE, NULL, 0::DOUBLE, 1) SELECT metric, round(base, 9) AS base, round(cand, 9) AS candidate, round(cand - base, 9) AS delta, tol AS tolerance FROM m WHERE cand IS NULL OR good * (cand - base) < -tol")
def gate_regress(spark, d):
    """The release gate: accuracy, macro F1, recall per class, calibration error, and the share of rows with provenance, which the candidate doesn't report."""
    def long(c: str) -> DataFrame:
        p = predictions(spark, d)
        rows = p.select("y", (P.argmax(c) == F.col("y")).cast("double").alias("ok"))
        each = rows.groupBy("y").agg(F.avg("ok").alias("value")).select(F.concat(F.lit("recall_"), F.col("y").cast("string")).alias("metric"), "value")
        f1 = M.summary(M.confusion(p.withColumn("pred", P.argmax(c)), K)).select(F.lit("macro_f1").alias("metric"), F.col("macro_f1").alias("value"))
        ece = M.ece(M.calibration(p, 10, "y", c)).select(F.lit("ece").alias("metric"), F.col("ece").alias("value"))
        return rows.agg(F.avg("ok").alias("value")).select(F.lit("accuracy").alias("metric"), "value").unionByName(each).unionByName(f1).unionByName(ece)

    base = long("pa").unionByName(predictions(spark, d).agg(F.avg(F.col("part").isNotNull().cast("double")).alias("value")).select(F.lit("provenance").alias("metric"), "value"))
    x = A.regressions(base, long("pb"), {"accuracy": 0.01, "macro_f1": 0.02, "ece": 0.005, "provenance": 0.0} | {f"recall_{i}": 0.05 for i in range(4)}, errors=("ece",))
    return x.select("metric", *[F.round(c, 9).alias(c) for c in ("base", "candidate", "delta")], "tolerance")


@query("parity", f"WITH {PREDS} SELECT round(max(list_max(list_transform(list_zip(pa, pb), lambda x: abs(x[1] - x[2])))), 9) AS max_abs_diff, count_if(pred_a <> pred_b) AS decisions_changed FROM preds")
def parity(spark, d):
    diff = F.array_max(F.zip_with("pa", "pb", lambda a, b: F.abs(a - b)))
    return predictions(spark, d).agg(F.round(F.max(diff), 9).alias("max_abs_diff"), F.count_if(P.argmax("pa") != P.argmax("pb")).alias("decisions_changed"))


EDGES = "e AS (SELECT 'order' || o_orderkey AS child, 'customer' || o_custkey AS parent FROM orders UNION ALL SELECT 'customer' || c_custkey, 'nation' || c_nationkey FROM customer UNION ALL SELECT 'nation' || n_nationkey, 'region' || n_regionkey FROM nation)"


@query("prov_lineage", f"WITH RECURSIVE {EDGES}, up AS (SELECT child AS node, parent AS source, 1 AS depth FROM e WHERE child LIKE 'order%' UNION ALL SELECT node, parent, depth + 1 FROM up JOIN e ON e.child = up.source) SELECT node, source, depth FROM up")
def prov_lineage(spark, d):
    """All ancestors of all orders."""
    return L.ancestors(lineage(spark, d), F.col("child").startswith("order"))


def lineage(spark, d) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda t, child, own, parent, key, kind: table(spark, d, t).select(name(child, own).alias("child"), name(parent, key).alias("parent"), F.lit(kind).alias("kind"))
    e = edge("orders", "order", "o_orderkey", "customer", "o_custkey", "placed").unionByName(edge("customer", "customer", "c_custkey", "nation", "c_nationkey", "resides"))
    return e.unionByName(edge("nation", "nation", "n_nationkey", "region", "n_regionkey", "lies"))


@query("prov_lineage_kinds", f"WITH RECURSIVE {EDGES}, k AS (SELECT child, parent, CASE WHEN child LIKE 'order%' THEN 'placed' WHEN child LIKE 'customer%' THEN 'resides' ELSE 'lies' END AS kind FROM e), up AS (SELECT child AS node, parent AS source, 1 AS depth, [kind] AS kinds FROM k UNION ALL SELECT node, parent, depth + 1, list_append(kinds, kind) FROM up JOIN k ON k.child = up.source) SELECT node, source, depth, array_to_string(list_sort(list_distinct(kinds)), ' ') AS kinds FROM up")
def prov_lineage_kinds(spark, d):
    """All ancestors of everything, with the kinds of steps on the way."""
    return L.ancestors(lineage(spark, d), F.lit(True), "kind").withColumn("kinds", F.array_join("kinds", " "))


# ---- the lake

TYPES = ("signup", "click", "view", "purchase", "error")
BRONZE = "b0 AS (SELECT event_id, ts, user_id, event_type, value, 0 AS copy FROM events UNION ALL SELECT event_id, ts, user_id, event_type, value, 1 FROM events WHERE event_id % 10 = 0), bronze AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN ts - INTERVAL 3 HOUR ELSE ts END AS ts, user_id, CASE WHEN event_id % 29 = 0 THEN 'unknown' ELSE event_type END AS event_type, CASE WHEN event_id % 23 = 0 AND copy = 0 THEN -1 ELSE value END AS value, copy FROM b0), judged AS (SELECT *, CASE WHEN value < 0 THEN 'negative_value' WHEN event_type = 'unknown' THEN 'event_type' END AS reason FROM bronze)"


def bronze(spark, d) -> DataFrame:
    """Events with duplicates, late times and invalid values put in by rule."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e = e.withColumn("copy", F.lit(0)).unionByName(e.where("event_id % 10 = 0").withColumn("copy", F.lit(1)))
    e = e.withColumn("ts", F.when(F.col("event_id") % 17 == 0, F.col("ts") - F.expr("INTERVAL 3 HOUR")).otherwise(F.col("ts")))
    e = e.withColumn("event_type", F.when(F.col("event_id") % 29 == 0, "unknown").otherwise(F.col("event_type")))
    return e.withColumn("value", F.when((F.col("event_id") % 23 == 0) & (F.col("copy") == 0), -1.0).otherwise(F.col("value")))


def judged(df: DataFrame) -> DataFrame:
    return L.reasoned(df, [("negative_value", F.col("value") >= 0), ("event_type", F.col("event_type").isin(*TYPES))])


def bronze_files(spark, d) -> str:
    bronze(spark, d).repartition(4, "event_id").write.parquet(path := scratch(spark, "bronze"))
    return path


@query("win_latest_valid", f"WITH {BRONZE}, o AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS versions, row_number() OVER (PARTITION BY event_id ORDER BY reason IS NULL DESC, ts DESC, copy DESC) AS place FROM judged) SELECT event_id, value, reason, versions FROM o WHERE place = 1")
def win_latest_valid(spark, d):
    x = L.latest_valid(judged(bronze(spark, d)), "event_id", [F.desc("ts"), F.desc("copy")])
    return x.select("event_id", "value", "reason", "versions")


#: Event columns by contract: the table lacks ``channel``, has ``props`` besides, and its times are without a zone.
CONTRACT = "event_id bigint not null, ts timestamp, user_id bigint, event_type string, value double, channel string"


@query("agg_dq", f"WITH {BRONZE}, o AS (SELECT ts, max(ts) OVER (ORDER BY event_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM bronze), l AS (SELECT count_if(ts < seen - INTERVAL 1 HOUR)::DOUBLE / count(*) AS late_rate FROM o), c AS (SELECT 1 + count_if(column_name = 'ts' AND column_type = 'TIMESTAMP') + count_if(column_name NOT IN ('event_id', 'ts', 'user_id', 'event_type', 'value')) AS drift_count FROM (DESCRIBE events)) SELECT count(*) AS ingested, count_if(reason IS NOT NULL) AS quarantined, round((count(*) - count(DISTINCT event_id))::DOUBLE / count(*), 9) AS duplicate_rate, round(any_value(late_rate), 9) AS late_rate, any_value(drift_count) AS drift_count, 0::BIGINT AS reconciliation, CAST(floor(epoch(max(ts))) - floor(epoch(max(ts) FILTER (reason IS NULL))) AS BIGINT) AS freshness_seconds FROM judged, l, c")
def agg_dq(spark, d):
    """The seven figures of a batch that a stream has routed to its sinks."""
    path, silver, bad = bronze_files(spark, d), scratch(spark, "silver"), scratch(spark, "quarantine")
    ST.route(judged(ST.file_stream(spark, path)), silver, bad)
    own = T.StructType([T.StructField(f.name, f.dataType, f.name != "event_id") for f in table(spark, d, "events").schema])
    changes = L.drift(spark, T.StructType.fromDDL(CONTRACT), own)
    x = L.quality(judged(spark.read.parquet(path)), "event_id", "ts", ["event_id", "copy"], "1 HOUR", changes, [spark.read.parquet(silver), spark.read.parquet(bad)])
    return x.select("ingested", "quarantined", F.round("duplicate_rate", 9).alias("duplicate_rate"), F.round("late_rate", 9).alias("late_rate"), "drift_count", "reconciliation", "freshness_seconds")


@query("join_ref_dim", "SELECT s_suppkey, n_name, CASE WHEN s_acctbal < 0 THEN 'overdrawn' WHEN s_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def join_ref_dim(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select("s_suppkey", "n_name", F.when(F.col("s_acctbal") < 0, "overdrawn").when(F.col("s_acctbal") < 5000, "low").otherwise("high").alias("band"))


@query("set_merge_reports", "SELECT o_orderpriority AS run, count(*) AS size FROM orders GROUP BY 1")
def set_merge_reports(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.count("*").alias("size"))
    t.repartition("run").write.json(path := scratch(spark, "reports"))
    return spark.read.schema("run string, size long").json(path).orderBy("size", "run")


@query("st_drift", "WITH c AS (SELECT column_name AS field, row_number() OVER () AS i, count(*) OVER () AS n FROM (DESCRIBE orders)) SELECT field, CASE i WHEN 1 THEN 'incompatible' ELSE 'removed' END AS change FROM c WHERE i = 1 OR i = n UNION ALL SELECT 'note', 'added_optional' UNION ALL SELECT 'code', 'added_required'")
def st_drift(spark, d):
    """The table of orders against a later version: the key as text, the last column gone, two new ones."""
    old = table(spark, d, "orders").schema
    new = T.StructType([T.StructField(old[0].name, T.StringType()), *old.fields[1:-1], T.StructField("note", T.StringType()), T.StructField("code", T.LongType(), False)])
    return L.drift(spark, old, new)


DOCUMENT = "event_id bigint not null, user struct<id: bigint not null, kind: string> not null, value double not null, tags array<string>"


def documents_of_two_versions(spark, d) -> DataFrame:
    """Events as JSON: of the odd ones, which are of a later version, all have a new field and some a new one inside, a number as text, a value left out or a list of other things."""
    e = table(spark, d, "events").where(F.col("event_id").isNotNull())
    later = lambda n: (F.col("event_id") % 2 == 1) & (F.col("event_id") % n == 0)
    text = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    user = F.concat(F.lit('{"id":'), F.when(later(7), F.concat(F.lit('"'), F.col("user_id"), F.lit('"'))).otherwise(F.col("user_id").cast("string")), F.lit(',"kind":'), text, F.when(later(3), F.lit(',"zone":1')).otherwise(""), F.lit("}"))
    value = F.when(later(11), "").otherwise(F.concat(F.lit(',"value":'), F.col("value").cast("decimal(20,2)").cast("string")))
    tags = F.when(later(13), ',"tags":["a",{"b":2}]').otherwise(',"tags":["a","b"]')
    whole = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"user":'), user, value, tags, F.when(F.col("event_id") % 2 == 1, ',"channel":"web"').otherwise(""), F.lit("}"))
    return e.select("event_id", F.when(F.col("event_id") % 17 == 0, F.substring(whole, 2, 20)).otherwise(whole).alias("payload"))


@query("st_drift_rows", "WITH e AS (SELECT event_id AS i, event_id % 2 = 1 AS later FROM events), r AS (SELECT CASE WHEN i % 17 = 0 THEN '' WHEN later AND i % 3 = 0 THEN 'channel user.zone' WHEN later THEN 'channel' ELSE '' END AS rescued, CASE WHEN i % 17 = 0 THEN 'unreadable' WHEN later AND i % 7 = 0 THEN 'user.id incompatible' WHEN later AND i % 11 = 0 THEN 'value missing' WHEN later AND i % 13 = 0 THEN 'tags[] incompatible' END AS reason, i FROM e) SELECT rescued, reason, count(*) AS n, CAST(sum(i) AS BIGINT) AS ids FROM r GROUP BY rescued, reason")
def st_drift_rows(spark, d):
    """Documents of two versions judged by one contract, row by row: what is new is kept aside, what breaks it is routed."""
    rows = L.conformed(documents_of_two_versions(spark, d), "payload", T.StructType.fromDDL(DOCUMENT))
    return rows.groupBy(F.array_join(F.array_sort("rescued"), " ").alias("rescued"), "reason").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# ---- streams; each has the SQL of what a batch over the same rows gives


@query("src_batch_stream", f"WITH {BRONZE} SELECT 'batch' AS kind, reason, count(*) AS n FROM judged GROUP BY reason UNION ALL SELECT 'stream', reason, count(*) FROM judged GROUP BY reason")
def src_batch_stream(spark, d):
    batch, stream = ST.parity(spark, bronze_files(spark, d), judged)
    count = lambda x, k: x.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "reason", "n")
    return count(batch, "batch").unionByName(count(stream, "stream"))


@query("st_parity", f"WITH {BRONZE} SELECT coalesce(reason, 'valid') AS reason, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, 0::BIGINT AS only_batch, 0::BIGINT AS only_stream FROM judged GROUP BY reason")
def st_parity(spark, d):
    """What a stream gives of each kind, and rows that only it or only the batch over the same files has."""
    batch, stream = ST.parity(spark, bronze_files(spark, d), judged)
    kinds = stream.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    a = batch.exceptAll(stream).agg(F.count("*").alias("only_batch"))
    return kinds.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(stream.exceptAll(batch).agg(F.count("*").alias("only_stream"))))


@query("st_dedup", f"WITH {BRONZE} SELECT count(*) AS n, count(*) AS keys FROM (SELECT DISTINCT event_id FROM bronze)")
def st_dedup(spark, d):
    s = ST.drain(ST.deduplicated(ST.file_stream(spark, bronze_files(spark, d)), "event_id", "ts", "60 days"), what="dedup")
    return s.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("keys"))


@query("st_late", f"WITH {BRONZE}, o AS (SELECT ts, max(ts) OVER (ORDER BY event_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM bronze) SELECT count(*) AS n, count_if(ts < seen - INTERVAL 1 HOUR) AS late FROM o")
def st_late(spark, d):
    """Rows that come over an hour behind the newest before them."""
    return L.late(bronze(spark, d), "ts", ["event_id", "copy"], "1 HOUR")


@query("st_quarantine", f"WITH {BRONZE} SELECT coalesce(reason, 'silver') AS sink, count(*) AS n, CAST(sum(CASE WHEN reason IS NOT NULL THEN event_id END) AS BIGINT) AS ids, CASE WHEN reason IS NOT NULL THEN 'events v1 open' END AS record FROM judged GROUP BY reason")
def st_quarantine(spark, d):
    """Valid rows to one sink, the others to the other as records: payload, rule, ingest time, source, run version, status."""
    silver, bad = scratch(spark, "silver"), scratch(spark, "quarantine")
    payload = ["event_id", "ts", "user_id", "event_type", "value", "copy"]
    ST.route(judged(ST.file_stream(spark, bronze_files(spark, d))), silver, bad, lambda b: L.quarantined(b, payload, "events", "v1"))
    good = spark.read.parquet(silver).agg(F.lit("silver").alias("sink"), F.count("*").alias("n"), F.lit(None).cast("long").alias("ids"), F.lit(None).cast("string").alias("record"))
    rows = spark.read.parquet(bad).where("ingested_at is not null")
    ids = F.sum(F.get_json_object("payload", "$.event_id").cast("long")).alias("ids")
    rows = rows.groupBy(F.col("failed_rule").alias("sink"), F.concat_ws(" ", "source", "run_version", "status").alias("record")).agg(F.count("*").alias("n"), ids)
    return good.unionByName(rows)


@query("st_replay", f"WITH {BRONZE} SELECT true AS same, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(CASE WHEN reason IS NULL THEN value END), 4) AS valid_total FROM judged")
def st_replay(spark, d):
    """Two runs from the same bronze with fresh state give the same silver, and what that is."""
    path = bronze_files(spark, d)
    run = lambda: ST.drain(judged(ST.file_stream(spark, path)), what="replay")
    whole = lambda x, h: x.agg(F.sum(F.xxhash64("event_id", "copy", "value", "reason").cast("decimal(38,0)")).alias(h))
    one, two = run(), run()
    figures = one.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum(F.when(F.col("reason").isNull(), F.col("value"))), 4).alias("valid_total"))
    return whole(one, "h").crossJoin(whole(two, "h2")).crossJoin(figures).select((F.col("h") == F.col("h2")).alias("same"), "n", "ids", "valid_total")


@query("st_freshness", f"WITH {BRONZE} SELECT event_type, CAST(floor(epoch(max(max(ts)) OVER ())) - floor(epoch(max(ts))) AS BIGINT) AS lag_seconds FROM bronze GROUP BY event_type")
def st_freshness(spark, d):
    """How far the newest event of each type lies behind the newest of all, after the last trigger of a stream."""
    m = ST.drain(ST.freshness(ST.file_stream(spark, bronze_files(spark, d)), "ts", "event_type"), "update", "fresh").groupBy("event_type").agg(F.max("last").alias("last"))
    return m.select("event_type", (F.unix_seconds(F.max("last").over(Window.partitionBy())) - F.unix_seconds("last")).alias("lag_seconds"))


@query("st_windows", f"WITH {BRONZE}, w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM bronze GROUP BY 1, 2) SELECT strftime(start, '%Y-%m-%d') AS day, event_type, n, total FROM w WHERE start < (SELECT max(start) - INTERVAL 1 DAY FROM w)")
def st_windows(spark, d):
    """Daily figures from a stream; only windows that the watermark has closed are compared."""
    path = bronze_files(spark, d)
    s = ST.drain(ST.tumbling(ST.file_stream(spark, path, 4), "ts", "1 day", "1 hour", "event_type"), what="monitor")
    last = spark.read.parquet(path).agg(F.date_trunc("day", F.max("ts")).alias("m"))
    s = s.crossJoin(F.broadcast(last)).where(F.col("start") < F.col("m") - F.expr("INTERVAL 1 DAY"))
    return s.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


LEGAL = [(None, "signup"), ("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view")]
STEPS = "s AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type AS state FROM events), legal AS (SELECT * FROM (VALUES ('', 'signup'), ('signup', 'view'), ('view', 'click'), ('view', 'view'), ('click', 'purchase'), ('click', 'view'), ('purchase', 'view')) t(b, e))"


@query("st_state", f"WITH {STEPS} SELECT user_id, count(*) AS steps, count_if(legal.b IS NULL) AS illegal FROM s LEFT JOIN legal ON b = coalesce(before, '') AND e = state GROUP BY user_id")
def st_state(spark, d):
    legal = spark.createDataFrame(LEGAL, "before string, state string")
    t = L.transitions(table(spark, d, "events"), "user_id", "event_id", "event_type", legal)
    return t.groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(~F.col("legal")).alias("illegal"))


@query("st_state_stream", f"WITH {STEPS} SELECT user_id, count(*) AS steps, count_if(legal.b IS NULL) AS illegal FROM s LEFT JOIN legal ON b = coalesce(before, '') AND e = state GROUP BY user_id")
def st_state_stream(spark, d):
    table(spark, d, "events").repartitionByRange(2, "event_id").write.parquet(path := scratch(spark, "events"))
    legal = {(a or "", b) for a, b in LEGAL}
    s = ST.drain(ST.checked_transitions(ST.file_stream(spark, path, 2), "user_id", "event_id", "event_type", legal), "update", "state")
    return s.groupBy("user_id").agg(F.max_by("steps", "batch").alias("steps"), F.max_by("illegal", "batch").alias("illegal"))


@query("st_slot_conflict", "WITH s AS (SELECT user_id % 20 AS resource, date_trunc('hour', ts) AS slot, count(*) AS bookings FROM events WHERE hour(ts) BETWEEN 9 AND 22 GROUP BY 1, 2) SELECT resource, strftime(slot, '%Y-%m-%d %H') AS slot, bookings FROM s WHERE bookings > 1")
def st_slot_conflict(spark, d):
    e = table(spark, d, "events").where(F.hour("ts").between(9, 22))
    s = e.groupBy((F.col("user_id") % 20).alias("resource"), F.date_trunc("hour", "ts").alias("slot")).agg(F.count("*").alias("bookings"))
    return s.where("bookings > 1").select("resource", F.date_format("slot", "yyyy-MM-dd HH").alias("slot"), "bookings")


@query("slots", "SELECT strftime(d + to_hours(9 + h.range), '%Y-%m-%d %H') AS slot FROM (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM events), range(14) h")
def slots(spark, d):
    day = table(spark, d, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d")).distinct()
    hours = F.expr("sequence(d + INTERVAL 9 HOUR, d + INTERVAL 22 HOUR, INTERVAL 1 HOUR)")
    return day.select(F.explode(hours).alias("s")).select(F.date_format("s", "yyyy-MM-dd HH").alias("slot"))


@query("psi_drift", "WITH p AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS period, event_type, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT event_type, coalesce(sum(n) FILTER (period = 'even'), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (period = 'odd'), 0)::DOUBLE AS b FROM p GROUP BY 1), q AS (SELECT greatest(a / sum(a) OVER (), 1e-6) AS a, greatest(b / sum(b) OVER (), 1e-6) AS b FROM w) SELECT round(sum((a - b) * ln(a / b)), 9) AS psi FROM q")
def psi_drift(spark, d):
    c = table(spark, d, "events").groupBy(F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("period"), "event_type").agg(F.count("*").alias("n"))
    return L.psi(c, "period", "event_type", "even", "odd").select(F.round("psi", 9).alias("psi"))


@query("trace_contract", "WITH o AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, row_number() OVER w - 1 AS place, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, count(*) AS turns, count_if(turn - first <> place) AS gaps, count_if(role = before) AS repeats, count_if(before IS NULL AND role NOT IN ('user', 'system')) AS bad_start FROM o GROUP BY conv_id")
def trace_contract(spark, d):
    w = Window.partitionBy("conv_id")
    o = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w.orderBy("turn")).alias("before"), (F.row_number().over(w.orderBy("turn")) - 1).alias("place"), F.min("turn").over(w).alias("first"))
    return o.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("turn") - F.col("first") != F.col("place")).alias("gaps"), F.count_if(F.col("role") == F.col("before")).alias("repeats"), F.count_if(F.col("before").isNull() & ~F.col("role").isin("user", "system")).alias("bad_start"))


# ---- model fitting with Spark ML


@query("fit_scale", "SELECT i.range AS dim, round(avg(embedding[i.range + 1]::DOUBLE), 6) AS mean, round(stddev_pop(embedding[i.range + 1]::DOUBLE), 6) AS std FROM embeddings, range((SELECT max(len(embedding)) FROM embeddings)) i WHERE vec_id % 5 > 1 GROUP BY i.range")
def fit_scale(spark, d):
    """Means and population deviations of the training rows, by which all rows are scaled."""
    m = TR.fit_scaler(features(spark, d).where("part = 'train'"), "x")
    return spark.createDataFrame([(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(zip(m.mean, m.std, strict=True))], "dim long, mean double, std double")


def features(spark, d) -> DataFrame:
    part = F.when(F.col("vec_id") % 5 == 0, "val").when(F.col("vec_id") % 5 == 1, "test").otherwise("train")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % K).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("x"), part.alias("part"))


@query("fit_pca")
def fit_pca(spark, d):
    """The components that keep 97 % of the variance of the scaled training rows: their eigenvalues and the deviation of the whitened scores; tested against a dense eigensolver."""
    x = features(spark, d)
    train = x.where("part = 'train'")
    s = TR.fit_scaler(train, "x")
    m = TR.fit_pca(train.withColumn("x", s.scaled("x")), "x", 0.97)
    w = train.select(F.posexplode(m.whitened(s.scaled("x"))).alias("component", "v")).groupBy("component").agg(F.round(F.stddev_samp("v"), 6).alias("deviation"))
    e = spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(m.eigenvalues)], "component int, eigenvalue double")
    return e.join(F.broadcast(w), "component")


@query("fit_logistic")
def fit_logistic(spark, d):
    """The flow of training: scale, whiten, logistic regression with balanced weights on the training rows, temperature on validation rows, figures of the test rows; tested against a plain solver."""
    return TR.train(features(spark, d), K).select(*[F.round(c, 6).alias(c) for c in ("temperature", "accuracy", "balanced_accuracy", "macro_f1", "mcc", "log_loss")])


@query("fit_trees_svm_mlp")
def fit_trees_svm_mlp(spark, d):
    """Other models on the same rows: forest, support vectors, perceptron; tested on planted classes."""
    return TR.alternatives(features(spark, d), K)


@query("fit_kernel_boosted")
def fit_kernel_boosted(spark, d):
    """Support vectors with a Gaussian kernel and boosted trees on the same rows; tested on rings, which no line parts."""
    return TR.curved(features(spark, d), K)


LANGS = ["de", "en", "es", "fr"]
TEXTS = f"""t AS (SELECT doc_id, lang, doc_id % 5 > 1 AND lang IN ({", ".join(f"'{c}'" for c in LANGS)}) AS learned, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, term, any_value(lang) AS lang, any_value(learned) AS learned, count(*) AS n FROM t GROUP BY doc_id, term),
own AS (SELECT lang, count(*) AS docs FROM documents WHERE doc_id % 5 > 1 AND lang IN ({", ".join(f"'{c}'" for c in LANGS)}) GROUP BY lang), every AS (SELECT sum(docs)::DOUBLE AS docs FROM own),
v AS (SELECT term, ln((1 + any_value(every.docs)) / (1 + count(*))) + 1 AS idf, {", ".join(f"sum(CASE WHEN lang = '{c}' THEN n ELSE 0 END)::DOUBLE AS n{i}" for i, c in enumerate(LANGS))} FROM k, every WHERE learned GROUP BY term HAVING count(*) >= 2),
s AS (SELECT count(*) AS terms, {", ".join(f"sum(n{i}) AS n{i}" for i in range(len(LANGS)))} FROM v),
x AS (SELECT doc_id, sqrt(sum((n * idf) * (n * idf))) AS norm, {", ".join(f"sum(n * idf * ln((v.n{i} + 1) / (s.n{i} + terms))) AS z{i}" for i in range(len(LANGS)))} FROM k JOIN v ON k.term = v.term, s GROUP BY doc_id),
z AS (SELECT d.doc_id, [{", ".join(f"coalesce(z{i} / norm, 0) + ln((coalesce((SELECT docs FROM own WHERE lang = '{c}'), 0) + 1) / (every.docs + {len(LANGS)}))" for i, c in enumerate(LANGS))}] AS z FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id, every WHERE d.doc_id IS NOT NULL),
p AS (SELECT doc_id, [exp(a - list_max(z)) FOR a IN z] AS e FROM z)"""


@query("text_export_score", f"WITH {TEXTS} SELECT doc_id, {", ".join(f"round(e[{i + 1}] / list_sum(e), 6) AS p_{c}" for i, c in enumerate(LANGS))} FROM p")
def text_export_score(spark, d):
    """Every document scored from an export (terms, idf, weights per language, intercepts) whose weights are in closed form."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", "text", "lang")
    export, intercepts = TX.bayes(docs.where("doc_id % 5 > 1"), "doc_id", "text", "lang", LANGS)
    p = TX.score(docs, stored(export, "text-export"), intercepts, "doc_id", "text")
    return p.select("doc_id", *[F.round(F.col("p")[i], 6).alias(f"p_{c}") for i, c in enumerate(LANGS)])


@query("text_logistic")
def text_logistic(spark, d):
    """The logistic model on TF-IDF and its export: documents, hits of the unseen ones by either, and the largest difference of any probability; tested to agree on every document."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", "text", "lang")
    model = TX.fit(docs.where("doc_id % 5 > 1"), "doc_id", "text", "lang", LANGS)
    export, intercepts = model.export(docs)
    export.write.parquet(path := scratch(spark, "text-export"))
    other = TX.score(docs, spark.read.parquet(path), intercepts, "doc_id", "text").withColumnRenamed("p", "q")
    both = model.transform(docs).join(other, "doc_id")
    unseen = (F.col("doc_id") % 5 <= 1) & F.col("lang").isin(*LANGS)
    hit = lambda p: F.count_if(unseen & (F.element_at(F.array(*[F.lit(c) for c in LANGS]), P.argmax(p) + 1) == F.col("lang")))
    gap = F.max(F.array_max(F.zip_with("p", "q", lambda a, b: F.abs(a - b))))
    return both.agg(F.count("*").alias("documents"), F.count_if(unseen).alias("unseen"), hit("p").alias("hits"), hit("q").alias("export_hits"), F.round(gap, 9).alias("largest_difference"))


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, df, squares) of documents (lang, w): how many hold the term, and their squared counts; partial sums."""

    def out() -> pa.RecordBatch:
        cols = [pa.array([x[i] for x in sums], pa.string()) for i in (0, 1)] + [pa.array([x[i] for x in sums.values()], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(cols, ["lang", "term", "df", "squares"])

    sums: dict = {}
    for batch in batches:
        for lang, w in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for term, n in Counter(w.as_py()).items():
                x = sums.setdefault((lang, term), [0, 0])
                x[0] += 1
                x[1] += n * n
            if len(sums) > 300_000:
                yield out()
                sums.clear()
    yield out()


@query("text_tfidf")
def text_tfidf(spark, d):
    """TF-IDF weights over the corpus' whole vocabulary of terms in two documents or more: mean sum of squares per language.

    The weight of a term is its count in the document times ln((documents + 1) / (documents with it + 1)), so the sums
    per language need only the sums of squared counts per term and language.
    """
    docs = table(spark, d, "documents").select("lang", "text")
    words = Tokenizer(inputCol="text", outputCol="w").transform(docs.where("text is not null"))
    parts = words.select("lang", "w").mapInArrow(term_counts, "lang string, term string, df long, squares long")
    terms = stored(parts.groupBy("term", "lang").agg(F.sum("df").alias("df"), F.sum("squares").alias("squares")), "tfidf-terms")
    df = terms.groupBy("term").agg(F.sum("df").alias("n")).where("n >= 2")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("docs"))
    idf = F.ln((F.col("all") + 1) / (F.col("n") + 1))
    x = terms.join(df, "term").crossJoin(F.broadcast(docs.agg(F.count("*").alias("all")))).groupBy(F.col("lang").alias("l2")).agg(F.sum(F.col("squares") * idf * idf).alias("total"))
    x = sizes.join(F.broadcast(x), F.col("lang").eqNullSafe(F.col("l2")), "left")
    return x.select("lang", "docs", F.round(F.coalesce("total", F.lit(0.0)) / F.col("docs"), 4).alias("mean_square"))
