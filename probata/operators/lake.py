"""Bronze to silver: rules with reasons, quarantine, latest valid version, quality figures, drift, state machines.

Every function here is one DataFrame expression, so batch and stream use the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


def reasoned(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``df`` with ``reason``: the first rule that a row fails, null if none; a rule is (name, what must hold)."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return df.withColumn("reason", reason)


def admitted(df: DataFrame, column: str, level: str, strict: bool = False) -> DataFrame:
    """The rows of one provenance level; if ``strict``, any other row, a null one too, ends the job."""
    fits = F.coalesce(F.col(column) == level, F.lit(False))
    if not strict:
        return df.where(fits)
    return df.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{column} has to be {level}, not "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("boolean")))


def quarantined(df: DataFrame, payload: Sequence[str], source: str, version: str) -> DataFrame:
    """The rows with a reason: payload as JSON, the rule that failed, ingest time, source, run version and remediation status."""
    record = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    return df.where("reason is not null").select(record.alias("payload"), F.col("reason").alias("failed_rule"), F.current_timestamp().alias("ingested_at"), F.lit(source).alias("source"), F.lit(version).alias("run_version"), F.lit("open").alias("status"))


def late(df: DataFrame, ts: str, order: Sequence[str], delay: str, width: int = 1024) -> DataFrame:
    """(n, late): rows that come more than ``delay`` behind the newest before them, by arrival.

    The first column of ``order`` is a whole number that grows with arrival. Running maxima go by ranges of it, by ranges
    of ranges, and then over those, so a task holds ``width`` ranges, and the last one a row for ``width`` * ``width`` numbers.
    """
    b = df.withColumn("__p", F.expr(f"`{order[0]}` div {width}"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = b.groupBy("__p").agg(F.max(ts).alias("top")).withColumn("__g", F.expr(f"__p div {width}"))
    over = tops.groupBy("__g").agg(F.max("top").alias("top"))
    over = over.select("__g", F.max("top").over(upto(Window.orderBy("__g"))).alias("far"))
    tops = tops.withColumn("near", F.max("top").over(upto(Window.partitionBy("__g").orderBy("__p")))).join(over, "__g")
    tops = tops.select("__p", F.greatest("near", "far").alias("before"))
    b = b.withColumn("inside", F.max(ts).over(upto(Window.partitionBy("__p").orderBy(*order)))).join(tops, "__p")
    return b.agg(F.count("*").alias("n"), F.count_if(F.col(ts) < F.greatest("inside", "before") - F.expr(f"INTERVAL {delay}")).alias("late"))


def latest_valid(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Per key the first row in ``order`` among those without a reason, else among all; ``versions`` counts them."""
    w = Window.partitionBy(key)
    place = F.row_number().over(w.orderBy(F.col("reason").isNull().desc(), *order))
    return df.withColumn("versions", F.count("*").over(w)).withColumn("__r", place).where("__r = 1").drop("__r")


def quality(df: DataFrame, key: str, ts: str, order: Sequence[str], delay: str, changes: DataFrame, sinks: Sequence[DataFrame]) -> DataFrame:
    """The figures of one batch in one row: ingested, quarantined, duplicate_rate, late_rate, drift_count, reconciliation (rows in no sink) and freshness_seconds (what the newest valid row lies behind the newest)."""
    d = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNotNull()).alias("bad"), F.max(ts).alias("newest"), F.max(F.when(F.col("reason").isNull(), F.col(ts))).alias("valid"))
    d = d.agg(F.sum("n").alias("ingested"), F.sum("bad").alias("quarantined"), F.try_divide(F.sum(F.col("n") - 1), F.sum("n")).alias("duplicate_rate"), (F.unix_seconds(F.max("newest")) - F.unix_seconds(F.max("valid"))).alias("freshness_seconds"))
    behind = late(df, ts, order, delay).select(F.try_divide("late", "n").alias("late_rate"))
    stored_rows = None
    for sink in sinks:
        n = sink.agg(F.count("*").alias("stored"))
        stored_rows = n if stored_rows is None else stored_rows.unionByName(n)
    d = d.crossJoin(behind).crossJoin(changes.agg(F.count("*").alias("drift_count"))).crossJoin(stored_rows.agg(F.sum("stored").alias("stored")))  # one row each
    return d.select("ingested", "quarantined", "duplicate_rate", "late_rate", "drift_count", (F.col("ingested") - F.col("stored")).alias("reconciliation"), "freshness_seconds")


#: Changes of a type that keep every value.
WIDER = {("byte", "short"), ("short", "integer"), ("byte", "integer"), ("integer", "long"), ("short", "long"), ("byte", "long"), ("float", "double"), ("integer", "double"), ("date", "timestamp")}


def changes(old: T.DataType, new: T.DataType, path: str = "") -> list[tuple[str, str]]:
    """(path, change) between two types, into structs (a.b), elements of arrays (a[]), and keys and values of maps (a{key}, a{value})."""
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        a, b = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}
        out = []
        for name in sorted(a | b):
            at = f"{path}.{name}" if path else name
            x, y = a.get(name), b.get(name)
            if x is None:
                out.append((at, "added_optional" if y.nullable else "added_required"))
            elif y is None:
                out.append((at, "removed"))
            else:
                out += changes(x.dataType, y.dataType, at) + [(at, "tightened")] * (x.nullable and not y.nullable)
        return out
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return changes(old.elementType, new.elementType, f"{path}[]") + [(f"{path}[]", "tightened")] * (old.containsNull and not new.containsNull)
    if isinstance(old, T.MapType) and isinstance(new, T.MapType):
        inner = changes(old.keyType, new.keyType, f"{path}{{key}}") + changes(old.valueType, new.valueType, f"{path}{{value}}")
        return inner + [(f"{path}{{value}}", "tightened")] * (old.valueContainsNull and not new.valueContainsNull)
    if old == new:
        return []
    return [(path, "widened" if (old.typeName(), new.typeName()) in WIDER else "incompatible")]


def drift(spark: SparkSession, old: T.StructType, new: T.StructType) -> DataFrame:
    """(field, change) between two schemas at any depth: added_optional, added_required, removed, widened, incompatible or tightened."""
    return spark.createDataFrame(changes(old, new), "field string, change string")


def _fits(v: Column, kind: T.DataType) -> Column:
    """Whether a value of a document, neither an object nor a list, holds what the type can."""
    own = F.schema_of_variant(v)
    read = F.try_variant_get(v, "$", kind.simpleString()).isNotNull()
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return (own == "BIGINT") & read
    if isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
        return own.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$") & read
    if isinstance(kind, T.BooleanType):
        return own == "BOOLEAN"
    return (own == "STRING") & read


def misfits(v: Column, kind: T.DataType, path: str = "", required: bool = False) -> Column:
    """array(struct(path, change)) of what in a parsed document (VARIANT) is not as in the contract: missing, incompatible, or added."""
    one = lambda at, change: F.array(F.struct(F.lit(at).alias("path"), F.lit(change).alias("change")))
    none = F.filter(one("", ""), lambda x: F.lit(False))
    absent = v.isNull() | F.is_variant_null(v)
    inside = lambda inner: F.when(absent, one(path, "missing") if required else none).otherwise(inner)
    if isinstance(kind, T.StructType):
        known = F.array(*[F.lit(f.name) for f in kind.fields])
        added = F.array_sort(F.array_except(F.json_object_keys(F.to_json(v)), known))
        parts = [misfits(F.try_variant_get(v, f"$['{f.name}']", "variant"), f.dataType, f"{path}.{f.name}" if path else f.name, not f.nullable) for f in kind.fields]
        more = F.transform(added, lambda k: F.struct(F.concat(F.lit(f"{path}." if path else ""), k).alias("path"), F.lit("added").alias("change")))
        return inside(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.concat(*parts, more)).otherwise(one(path, "incompatible")))
    if isinstance(kind, T.ArrayType | T.MapType):
        listed = isinstance(kind, T.ArrayType)
        element, at, strict = (kind.elementType, f"{path}[]", not kind.containsNull) if listed else (kind.valueType, f"{path}{{value}}", not kind.valueContainsNull)
        values = F.try_variant_get(v, "$", "array<variant>") if listed else F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
        each = F.array_distinct(F.flatten(F.transform(values, lambda e: misfits(e, element, at, strict))))
        return inside(F.when(F.schema_of_variant(v).startswith("ARRAY" if listed else "OBJECT"), each).otherwise(one(path, "incompatible")))
    return inside(F.when(_fits(v, kind), none).otherwise(one(path, "incompatible")))


def conformed(df: DataFrame, payload: str, contract: T.StructType) -> DataFrame:
    """``df`` with ``rescued``, the paths in the document that the contract doesn't know, and ``reason``, the first thing in which
    the row breaks it (``path change``; "unreadable" if it is no object in JSON), null if it fits. Fields may come and go unseen by the reader,
    so rows are judged one by one, by what is in them: added fields are kept aside, all else routes the row.
    """
    d = df.withColumn("__m", misfits(F.try_parse_json(F.col(payload)), contract, "", True))
    added = F.transform(F.filter("__m", lambda x: x["change"] == "added"), lambda x: x["path"])
    bad = F.filter("__m", lambda x: x["change"] != "added")
    reason = F.when(F.size(bad) > 0, F.when(F.get(bad, 0)["path"] == "", "unreadable").otherwise(F.concat_ws(" ", F.get(bad, 0)["path"], F.get(bad, 0)["change"])))
    return d.withColumns({"rescued": added, "reason": reason}).drop("__m")


def transitions(df: DataFrame, key: str, order: str, state: str, legal: DataFrame) -> DataFrame:
    """(key, order, before, state, legal): each row's step from the one before; ``legal`` has (before, state), a null before for the start."""
    d = df.select(key, order, F.lag(state).over(Window.partitionBy(key).orderBy(order)).alias("before"), F.col(state).alias("state"))
    ok = legal.select(F.coalesce("before", F.lit("")).alias("__b"), F.col("state").alias("__s"), F.lit(True).alias("ok"))
    d = d.join(F.broadcast(ok), (F.coalesce("before", F.lit("")) == F.col("__b")) & (F.col("state") == F.col("__s")), "left")
    return d.select(key, order, "before", "state", F.coalesce("ok", F.lit(False)).alias("legal"))


def psi(counts: DataFrame, period: str, bin: str, first: str, second: str, guard: float = 1e-6) -> DataFrame:
    """(psi): population stability index of the shares per bin in two periods."""
    wide = counts.where(F.col(period).isin(first, second)).groupBy(bin).pivot(period, [first, second]).agg(F.sum("n")).fillna(0)
    total = wide.agg(F.sum(first).alias("ta"), F.sum(second).alias("tb"))
    a, b = F.greatest(F.col(first) / F.col("ta"), F.lit(guard)), F.greatest(F.col(second) / F.col("tb"), F.lit(guard))
    return wide.crossJoin(F.broadcast(total)).agg(F.sum((a - b) * F.ln(a / b)).alias("psi"))


#: Rows that a task of a shuffle takes in lineage. Names compress so well that tasks cut by shuffled bytes would hold millions of rows.
TASK_ROWS = 250_000


def _dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` by hash of the keys in a partition per TASK_ROWS of ``n`` rows; as it is if that is one."""
    parts = -(-n // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > 1 else df


def _linked(a: DataFrame, b: DataFrame, mid: str = "mid") -> DataFrame:
    """The join on ``mid`` of two stored tables. What shares a ``mid`` with more than TASK_ROWS rows of ``a`` (all that lies in a
    country) is cut into pieces, each of which meets a copy of its rows of ``b``.

    Rows are counted by hashes of ``mid``, 16 a task, so that counting moves nothing but these, and few rows of ``b`` are copied.
    """
    n = a.count() + b.count()
    if n <= TASK_ROWS:
        return a.join(b, mid)
    bucket = F.pmod(F.xxhash64(mid), F.lit(16 * -(-n // TASK_ROWS)))
    hot = a.groupBy(bucket.alias("__b")).agg(F.count("*").alias("n")).where(F.col("n") > TASK_ROWS).collect()  # a row per TASK_ROWS rows at most
    if not hot:
        return _dealt(a, n, mid).join(_dealt(b, n, mid).hint("merge"), mid)
    cut = F.broadcast(a.sparkSession.createDataFrame([(r["__b"], -(-r.n // TASK_ROWS)) for r in hot], "__b long, __pieces long"))
    pieces = F.coalesce("__pieces", F.lit(1))
    a = a.withColumn("__b", bucket).join(cut, "__b", "left").withColumn("__piece", F.pmod(F.xxhash64("node", F.lit(1)), pieces)).drop("__b", "__pieces")
    b = b.withColumn("__b", bucket).join(cut, "__b", "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("__b", "__pieces")
    return _dealt(a, n, mid, "__piece").join(_dealt(b, n, mid, "__piece").hint("merge"), [mid, "__piece"]).drop("__piece")


def ancestors(edges: DataFrame, start: Column, kind: str | None = None) -> DataFrame:
    """(node, source, depth[, kinds]): all ancestors of the nodes of the edges (child, parent) where ``start`` holds, each with its
    least depth and, if the edges have a column ``kind``, the kinds of edges on its shortest paths, in order.

    Paths double: with all walks of exactly 2, 4, 8, ... edges, what lies up to twice as far is what was reached before and one
    such walk. So a chain takes as many rounds as its length has binary digits, and a round that reaches nothing new is the
    last, so cycles end. Edges without a child or parent are left out. A node on a cycle is its own ancestor.

    A set of kinds is a bit per kind, 64 to a column, so that sets are merged without lists; the driver sees a row per kind.
    What is joined is stored before it is grouped, and tasks are cut by its rows, so a task holds no more of them on larger tables.
    """
    rows = edges.where(F.col("child").isNotNull() & F.col("parent").isNotNull())
    names = [r[0] for r in rows.select(kind).distinct().orderBy(F.asc_nulls_last(kind)).collect()] if kind else []
    words = [f"k{i}" for i in range(-(-len(names) // 64))]
    if words:
        place = F.array_position(F.array(*[F.lit(v) for v in names if v is not None]), F.col(kind)) if names[0] is not None else F.lit(None)
        rows = rows.withColumn("__bit", F.coalesce(place - 1, F.lit(len(names) - 1)))
        rows = rows.withColumns({w: F.expr(f"if(__bit div 64 = {i}, shiftleft(1L, cast(__bit % 64 as int)), 0L)") for i, w in enumerate(words)})
    merged = [F.bit_or(w).alias(w) for w in words]
    own = stored(rows.select(F.col("child").alias("node"), F.col("parent").alias("source"), *words, F.coalesce(start, F.lit(False)).alias("begins")), "lineage")
    n = own.count()
    walks = _dealt(own, n, "node", "source").groupBy("node", "source").agg(F.count("*").alias("n"), *merged).drop("n")
    starts = _dealt(own.where("begins").select("node"), n, "node").distinct().withColumn("begins", F.lit(True))
    # whether any edge of the node begins; carried along from here
    walks = _dealt(walks, n, "node").join(starts.hint("merge") if n > TASK_ROWS else starts, "node", "left")
    walks = stored(walks.withColumn("begins", F.coalesce("begins", F.lit(False))), "lineage")
    reached = [stored(walks.where("begins").drop("begins").withColumn("depth", F.lit(1)), "lineage")]
    length = 1

    def met(a: DataFrame, *more: str) -> DataFrame:
        """``a`` and then a walk from where it ends, with the kinds of both."""
        ends = a.withColumnRenamed("source", "mid")
        on = walks.select(F.col("node").alias("mid"), "source", *[F.col(w).alias(f"__{w}") for w in words])
        return _linked(ends, on).select("node", "source", *more, *[F.col(w).bitwiseOR(F.col(f"__{w}")).alias(w) for w in words])

    while not reached[-1].isEmpty():
        length *= 2
        far = stored(met(walks, "begins"), "lineage")
        walks = stored(_dealt(far, far.count(), "node", "source").groupBy("node", "source").agg(F.bool_or("begins").alias("begins"), *merged), "lineage")
        if walks.isEmpty():
            break
        known = reduce(DataFrame.unionByName, reached)
        far = met(known, "depth").withColumn("depth", F.col("depth") + length)
        far = stored(far.unionByName(walks.where("begins").drop("begins").withColumn("depth", F.lit(length))), "lineage")
        pairs = known.select("node", "source")
        n = far.count() + pairs.count()
        far = _dealt(far, n, "node", "source").join(_dealt(pairs, n, "node", "source").hint("merge") if n > TASK_ROWS else pairs, ["node", "source"], "left_anti")
        far = far.groupBy("node", "source", "depth").agg(F.count("*").alias("n"), *merged)
        far = far.groupBy("node", "source").agg(F.min("depth").alias("depth"), *[F.min_by(w, "depth").alias(w) for w in words])
        reached.append(stored(far, "lineage"))
    out = reduce(DataFrame.unionByName, reached)
    if not kind:
        return out.select("node", "source", "depth")
    every = F.array(*[F.lit(v) for v in names]).cast(T.ArrayType(edges.schema[kind].dataType))
    held = F.filter(every, lambda x, i: F.getbit(F.get(F.array(*words), F.floor(i / 64).cast("int")), i % 64) == 1) if words else every
    return out.select("node", "source", "depth", held.alias("kinds"))
