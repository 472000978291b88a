"""Deterministic inputs made of the test tables, in Spark and as SQL: predictions of two branches, a binary score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

K = 4
#: Per branch: percent of right predictions, least extra weight of the predicted class.
BRANCHES = {"A": (75, 20), "B": (65, 10)}


def draw(*parts: str | Column) -> Column:
    """The first 32 bits of the md5 of the parts joined by |, as a number."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({" || '|' || ".join(f'CAST({p} AS VARCHAR)' for p in parts)}), 1, 8) AS BIGINT)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, pa, pb, part): a class per vector and two branches' probabilities for it."""
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % K).cast("int").alias("y"))
    for b, (hit, boost) in BRANCHES.items():
        guess = F.when(draw(b, F.col("id")) % 100 < hit, F.col("y")).otherwise(draw(b, "m", F.col("id")) % K)
        extra = F.lit(boost) + draw(b, "c", F.col("id")) % 200
        w = F.array(*[1 + draw(b, F.col("id"), str(i)) % 30 + F.when(guess == i, extra).otherwise(0) for i in range(K)])
        d = d.withColumn("w", w).withColumn("s", F.aggregate("w", F.lit(0).cast("long"), lambda a, v: a + v))
        d = d.withColumn(f"p{b.lower()}", F.transform("w", lambda v: v / F.col("s"))).drop("w", "s")
    part = F.when(F.col("id") % 5 == 0, "val").when(F.col("id") % 5 == 1, "test").otherwise("train")
    return d.withColumn("part", part)


def _branch_sql(b: str) -> tuple[str, str]:
    hit, boost = BRANCHES[b]
    guess = f"CASE WHEN {draw_sql(f"'{b}'", 'id')} % 100 < {hit} THEN y ELSE {draw_sql(f"'{b}'", "'m'", 'id')} % {K} END"
    w = ", ".join(f"1 + {draw_sql(f"'{b}'", 'id', f"'{i}'")} % 30 + CASE WHEN t{b} = {i} THEN {boost} + {draw_sql(f"'{b}'", "'c'", 'id')} % 200 ELSE 0 END" for i in range(K))
    return f"{guess} AS t{b}", f"[{w}] AS w{b}"


#: Common table expressions: preds(id, y, pa, pb, part, and of both branches the prediction, confidence and entropy).
PREDS = (
    f"b0 AS (SELECT vec_id AS id, label % {K} AS y FROM embeddings), b1 AS (SELECT id, y, {_branch_sql('A')[0]}, {_branch_sql('B')[0]} FROM b0), "
    f"b2 AS (SELECT id, y, {_branch_sql('A')[1]}, {_branch_sql('B')[1]} FROM b1), "
    "b3 AS (SELECT id, y, list_transform(wA, lambda v: v::DOUBLE / list_sum(wA)::DOUBLE) AS pa, list_transform(wB, lambda v: v::DOUBLE / list_sum(wB)::DOUBLE) AS pb FROM b2), "
    "preds AS (SELECT id, CAST(y AS INTEGER) AS y, pa, pb, CASE WHEN id % 5 = 0 THEN 'val' WHEN id % 5 = 1 THEN 'test' ELSE 'train' END AS part, "
    + ", ".join(
        f"CAST(list_position(p{b}, list_max(p{b})) - 1 AS INTEGER) AS pred_{b}, list_max(p{b}) AS conf_{b}, -list_sum(list_transform(p{b}, lambda v: v * ln(greatest(v, 1e-9::DOUBLE)))) / ln(4::DOUBLE) + 0::DOUBLE AS ent_{b}" for b in "ab"
    )
    + " FROM b3), gated AS (SELECT *, pred_a = y AS ok, conf_a >= 0.70::DOUBLE AND ent_a <= 0.65::DOUBLE AS single, "
    "conf_a >= 0.70::DOUBLE AND ent_a <= 0.65::DOUBLE AND pred_a = pred_b AND conf_b >= 0.50::DOUBLE AND ent_b <= 0.75::DOUBLE AS full_gate FROM preds)"
)


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, truth, score): the toxicity label with a score from 0 to 1 made of integers."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = labels.select("doc_id", F.col("toxic").alias("truth")).join(docs.select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", "truth", (((F.col("n_chars") * 37 + F.col("doc_id")) % 101 + F.col("truth") * 20) / 121.0).alias("score"))


SCREENED = "screened AS (SELECT doc_id, toxic AS truth, ((n_chars * 37 + doc_id) % 101 + toxic * 20)::DOUBLE / 121::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
