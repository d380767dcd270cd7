"""Junction cost tables: primers, synthesis, and the cheaper of both, by (l, r, span).

Efficiency of two primers depends only on the sum of their extensions, so the grid of all pairs is first reduced to the
cheapest pair of each sum; only then spans are crossed in. In the synthesis grid only lookups that can succeed
are crossed. All tables are a few thousand rows, whatever the data; build once per parameter key (see span_cost_cached).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixar.functions import shared
from helixar.sources import params as P

INF = float("inf")


def _num(x) -> float:
    return INF if x == "inf" else float(x)


def _bands(spark: SparkSession, table: dict, cols: dict[str, str]) -> DataFrame:
    """A row per integer of each half-open band."""
    at = {c: i for i, c in enumerate(table["columns"])}
    rows = [(int(r[at["min"]]), int(r[at["max"]]), *[_num(r[at[c]]) for c in cols]) for r in table["data"]]
    df = spark.createDataFrame(rows, "lo int, hi int, " + ", ".join(f"{x} double" for x in cols.values())).filter("hi > lo")
    return df.select(F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("x"), *cols.values())


def primer_model(spark: SparkSession, params: dict | None = None) -> DataFrame:
    """(l, r, span, cost, efficiency, material, left_ext, right_ext, time); impossible: cost and material infinite, efficiency 0.

    l, r: whether the left and right primer can be extended. Ties go to the lower efficiency, then the shorter primers.
    """
    p = params or P.DEFAULTS
    c = F.col
    priced = _bands(spark, p["primer_cost"], {"base cost": "base", "cost per bp": "per_bp", "time (days)": "days"})
    none = spark.createDataFrame([(int(p["primer_min_anneal"]), 0.0, 0.0, 0.0)], "x int, base double, per_bp double, days double")
    own = lambda df, e: df.select(F.lit(e).alias("e"), (c("x") - int(p["primer_min_anneal"])).alias("ext"), (c("x") * c("per_bp") + c("base")).alias("m"), "days")
    primers = own(none, 0).unionByName(own(priced, 1))
    left, right = (primers.select(*[c(x).alias(f"{s}_{x}") for x in primers.columns]) for s in "ij")
    days = F.greatest("i_days", "j_days")
    modifier, time_cost = float(p["global_material_modifier"]), float(p["global_time_cost"])
    material = F.round((c("i_m") + c("j_m")) * modifier + 2 * days * time_cost, 9)
    pair = F.struct(material.alias("material"), c("i_ext").alias("left_ext"), c("j_ext").alias("right_ext"), days.alias("time"))
    best = left.coalesce(1).crossJoin(F.broadcast(right)).groupBy(c("i_e").alias("l"), c("j_e").alias("r"), (c("i_ext") + c("j_ext")).alias("ext")).agg(F.min(pair).alias("pair"))
    widest = int(max(r[p["primer_cost"]["columns"].index("max")] for r in p["primer_cost"]["data"]))
    low = int(p["_primer_min_span"])
    spans = spark.range(low, 2 * widest - low).select(c("id").cast("int").alias("span"))
    eff = F.broadcast(_bands(spark, p["primer_efficiency"], {"efficiency": "efficiency"}))
    last = int(max(r[1] for r in p["primer_efficiency"]["data"])) - 1
    grid = best.crossJoin(F.broadcast(spans)).withColumn("x", F.least(F.greatest(c("ext") - c("span"), F.lit(0)), F.lit(last))).join(eff, "x")
    cost = F.round(F.when(c("efficiency") > 0, c("pair.material") / c("efficiency")).otherwise(F.lit(INF)), 9)
    won = grid.groupBy("l", "r", "span").agg(F.min(F.struct(cost.alias("cost"), "efficiency", c("pair.left_ext").alias("left_ext"), c("pair.right_ext").alias("right_ext"), c("pair.material").alias("material"), c("pair.time").alias("time"))).alias("w"))
    w = won.select("l", "r", "span", "w.*")
    return w.select("l", "r", "span", "cost", "efficiency", F.when(c("cost") == INF, F.lit(INF)).otherwise(c("material")).alias("material"), "left_ext", "right_ext", "time")


def synthesis_model(spark: SparkSession, params: dict | None = None, primers: DataFrame | None = None) -> DataFrame:
    """(l, r, span, cost, efficiency, material, size, lshift, time) of a gap filled by one synthesized piece."""
    p = params or P.DEFAULTS
    c = F.col
    primers = primers if primers is not None else primer_model(spark, p)
    step = int(p["_synthesis_step_size"])
    low, high = (int(x) for x in p["_synthesis_left_span_range"])
    genes = _bands(spark, p["synthesis_cost"], {"base": "gene", "time": "days"}).filter((c("x") % step == 0) & (c("gene") < INF)).withColumnRenamed("x", "size")
    top = int(max(r[1] for r in p["synthesis_cost"]["data"]))
    possible = primers.filter("efficiency > 0")
    left = possible.filter((c("r") == 0) & (c("span") >= low) & (c("span") < high) & (F.pmod(c("span") - low, F.lit(step)) == 0)).select("l", c("span").alias("lshift"), c("efficiency").alias("le"), c("material").alias("lm"), c("time").alias("lt"))
    right = possible.filter(c("l") == 0).select("r", c("span").alias("rspan"), c("efficiency").alias("re"), c("material").alias("rm"), c("time").alias("rt"))
    span = c("size") + c("lshift") + c("rspan")
    grid = left.repartition(32).crossJoin(F.broadcast(genes)).crossJoin(F.broadcast(right)).filter((span >= 0) & (span < top))
    material = F.round(c("lm") + c("rm") + c("gene") * float(p["global_material_modifier"]), 9)
    cost = F.round((material + c("days") * float(p["global_time_cost"])) / (c("le") * c("re")), 9)
    best = grid.groupBy("l", "r", span.cast("int").alias("span")).agg(F.min(F.struct(cost.alias("cost"), (c("le") * c("re")).alias("efficiency"), "size", "lshift", material.alias("material"), F.greatest("lt", "rt", "days").alias("time"))).alias("w"))
    ends = spark.createDataFrame([(i, j) for i in (0, 1) for j in (0, 1)], "l int, r int")
    every = ends.crossJoin(spark.range(top).select(c("id").cast("int").alias("span")))
    return every.join(best, ["l", "r", "span"], "left").select("l", "r", "span", F.coalesce("w.cost", F.lit(INF)).alias("cost"), F.coalesce("w.efficiency", F.lit(0.0)).alias("efficiency"), F.coalesce("w.material", F.lit(INF)).alias("material"), "w.size", "w.lshift", "w.time")


def span_cost(spark: SparkSession, params: dict | None = None, primers: DataFrame | None = None, synthesis: DataFrame | None = None) -> DataFrame:
    """The cheaper model for every (l, r, span); primers win ties. Columns of the other model are null.

    Both models' tables, a few thousand rows bounded by the parameters, are checkpointed: every lookup reads them again.
    """
    c = F.col
    shared.folder(spark)
    primers = primers if primers is not None else primer_model(spark, params).coalesce(1).checkpoint()
    synthesis = synthesis if synthesis is not None else synthesis_model(spark, params, primers)
    top = int(max(r[1] for r in (params or P.DEFAULTS)["synthesis_cost"]["data"])) - 1
    a = primers.select("l", "r", "span", *[c(x).alias(f"p_{x}") for x in ("cost", "efficiency", "material", "time")], "left_ext", "right_ext")
    b = synthesis.select("l", "r", "span", *[c(x).alias(f"s_{x}") for x in ("cost", "efficiency", "material", "time")], "size", "lshift")
    d = a.join(b, ["l", "r", "span"], "full").filter(c("span") < top)
    primer = c("p_cost").isNotNull() & (c("s_cost").isNull() | (c("p_cost") <= c("s_cost")))
    pick = lambda x: F.when(primer, c(f"p_{x}")).otherwise(c(f"s_{x}")).alias(x)
    return d.select("l", "r", "span", *[pick(x) for x in ("cost", "efficiency", "material", "time")], *[F.when(primer, c(x)).alias(x) for x in ("left_ext", "right_ext")], *[F.when(~primer, c(x)).alias(x) for x in ("size", "lshift")]).coalesce(1).checkpoint()


def span_cost_cached(spark: SparkSession, root: str, params: dict | None = None) -> DataFrame:
    """The table kept under root by the parameters' key; built if it is not there or not whole."""
    path = f"{root.rstrip('/')}/span_cost_{P.key(params or P.DEFAULTS)}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        span_cost(spark, params).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def lookup(edges: DataFrame, table: DataFrame, invalidate: bool = True, spans: tuple[int, int] | None = None) -> DataFrame:
    """edges(l, r, span, ..) with the table's columns; beyond the table's spans the nearest row, made impossible if invalidate.

    The table is a few thousand rows, bounded by its parameters: it is broadcast. spans: its least and greatest, if known.
    """
    c = F.col
    low, high = spans or table.agg(F.min("span"), F.max("span")).first()
    t = F.broadcast(table.withColumnRenamed("span", "_span"))
    e = edges.withColumn("_span", F.least(F.greatest(c("span"), F.lit(low)), F.lit(high)).cast("int"))
    out = e.join(t, ["l", "r", "_span"], "left").drop("_span")
    if invalidate:
        beyond = (c("span") < low) | (c("span") > high)
        out = out.withColumns({"cost": F.when(beyond, F.lit(INF)).otherwise(c("cost")), "efficiency": F.when(beyond, F.lit(0.0)).otherwise(c("efficiency"))})
    return out


def adjust(material: Column, efficiency: Column) -> Column:
    """Cost of material at an efficiency; infinite if it never works."""
    return F.when(efficiency == 0, F.lit(INF)).otherwise(F.try_divide(material, efficiency))
