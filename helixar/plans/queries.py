"""Queries of the operators over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixar import constants as K
from helixar.functions import intervals as I
from helixar.functions import sequences as S
from helixar.functions import shared
from helixar.operators import cost, expand, frame, graph, library, match, output, paths, score
from helixar.sources import params

c = F.col
L = 1000
ALPHABET, DNA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"
_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bases(df: DataFrame, key: str) -> DataFrame:
    """Texts as DNA: letters alone, mapped to the four bases. All bytes that are no letter, those of longer characters too, are left out in an Arrow kernel."""
    table = bytes.maketrans((ALPHABET + ALPHABET.lower()).encode(), (DNA + DNA).encode())
    others = bytes(x for x in range(256) if not chr(x).isascii() or not chr(x).isalpha())

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                made = [None if x is None else x.translate(table, others) for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary()).cast(pa.string())], ["key", "bases"])

    return df.select(c(key).cast("string").alias("key"), "text").mapInArrow(run, "key string, bases string")


def by_order(spark, sf):
    """Order lines dealt by order in as many parts as the session names: they are sorted in them, so these are not put together to fewer."""
    return read(spark, sf, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")


def spans(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    """Line items, all or `lines`, as regions of a circle of 1000 positions, one circle per order."""
    l = read(spark, sf, "lineitem") if lines is None else lines
    a, n = (c("l_partkey") % L).cast("int"), c("l_quantity").cast("int") * 10
    d = l.select(c("l_orderkey").alias("query_key"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", a.alias("a"), n.alias("n"))
    return d.withColumn("b", F.pmod(c("a") + c("n") - 1, F.lit(L)) + 1).withColumns({"length": F.lit(L), "cyclic": F.lit(True)})


_SPANS = "spans as (select l_orderkey query_key, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, cast(l_partkey % 1000 as int) a, cast(l_quantity as int) * 10 n, (cast(l_partkey % 1000 as int) + cast(l_quantity as int) * 10 - 1) % 1000 + 1 b from lineitem)"
_DNA = "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
_GROUPS = _SPANS + ", groups as (select distinct query_key, case l_returnflag when 'A' then 'PRE-MADE DNA FRAGMENT' when 'N' then 'PCR_PRODUCT' else 'PCR_PRODUCT_WITH_PRIMERS' end atype, a, b, n from spans)"


def groups(spark: SparkSession, sf: str, lines: DataFrame | None = None) -> DataFrame:
    atype = F.when(c("l_returnflag") == "A", K.FRAGMENT).when(c("l_returnflag") == "N", K.PCR).otherwise(K.PCR_PRIMERS)
    return spans(spark, sf, lines).select("query_key", atype.alias("atype"), "a", "b", "n", "length", "cyclic").distinct()


@query(f"with {_SPANS} select query_key, a, b, n, a + n c_end, case when a + n > 1000 then 2 else 1 end n_pieces, least(a + n, 1000) hi1, case when a + n > 1000 then a + n - 1000 end hi2, (a + n) % 1000 inv_a, (a + 999) % 1000 + 1 inv_b, 1000 - n inv_n from spans")
def region_ranges(spark, sf):
    d = spans(spark, sf).withColumn("r", I.make(c("a"), c("a") + c("n"), c("length"), c("cyclic"))).withColumn("p", I.pieces(c("r.a"), c("r.n"), c("length"))).withColumn("i", I.invert(c("r.a"), c("r.n"), c("length")))
    return d.select("query_key", c("r.a").alias("a"), c("r.b").alias("b"), c("r.n").alias("n"), c("r.c").alias("c_end"), F.size("p").alias("n_pieces"), F.get("p", F.lit(0))["hi"].alias("hi1"), F.get("p", F.lit(1))["hi"].alias("hi2"), c("i.a").alias("inv_a"), c("i.b").alias("inv_b"), c("i.n").alias("inv_n"))


@query(f"with {_SPANS}, u as (select distinct query_key, a, n from spans), p as (select query_key, a, n, a lo, least(a + n, 1000) hi from u union all select query_key, a, n, 0, a + n - 1000 from u where a + n > 1000) select x.query_key, x.a a1, x.n n1, y.a a2, y.n n2, cast(sum(least(x.hi, y.hi) - greatest(x.lo, y.lo)) as bigint) overlap from p x join p y on x.query_key = y.query_key and (x.a, x.n) < (y.a, y.n) and x.lo < y.hi and y.lo < x.hi group by 1, 2, 3, 4, 5")
def region_overlap(spark, sf):
    u = spans(spark, sf).select("query_key", "a", "n", "length").distinct()
    p = u.select("query_key", "a", "n", F.explode(I.pieces(c("a"), c("n"), c("length"))).alias("p")).select("query_key", "a", "n", "p.lo", "p.hi")
    x, y = (p.select("query_key", *[c(k).alias(f"{k}{i}") for k in ("a", "n", "lo", "hi")]) for i in (1, 2))
    both = x.join(y, "query_key").filter((F.struct("a1", "n1") < F.struct(c("a2").alias("a1"), c("n2").alias("n1"))) & (c("lo1") < c("hi2")) & (c("lo2") < c("hi1")))
    return both.groupBy("query_key", "a1", "n1", "a2", "n2").agg(F.sum(F.least("hi1", "hi2") - F.greatest("lo1", "lo2")).alias("overlap"))


@query(f"with {_GROUPS} select query_key, atype, a, b, n from groups where n >= case when atype = 'PRE-MADE DNA FRAGMENT' then 0 else 100 end")
def size_filter(spark, sf):
    return groups(spark, sf).filter(expand.size_ok(c("n"), c("atype"))).select("query_key", "atype", "a", "b", "n")


@query(f"with {_SPANS} select query_key, a, b, l_returnflag atype, n, count(distinct l_suppkey) n_alignments, string_agg(distinct cast(l_suppkey as varchar), ',' order by cast(l_suppkey as varchar)) subjects from spans group by all")
def group_alignments(spark, sf):
    d = spans(spark, sf).select("query_key", c("l_suppkey").cast("string").alias("subject_key"), c("l_returnflag").alias("atype"), "a", "b", "n", "length", "cyclic")
    g = expand.group_alignments(expand.dedup_alignments(d))
    return g.select("query_key", "a", "b", "atype", "n", "n_alignments", F.array_join("subjects", ",").alias("subjects"))


@query(f"with {_SPANS} select query_key, l_suppkey subject_key, l_returnflag atype, a, b, n, min(l_linestatus) direction from spans group by all")
def dedup_alignments(spark, sf):
    d = spans(spark, sf).select("query_key", c("l_suppkey").alias("subject_key"), c("l_returnflag").alias("atype"), "a", "b", "n", c("l_linestatus").alias("direction"))
    return expand.dedup_alignments(d)


@query(f"""with {_SPANS}, g as (select distinct query_key, a, b, n from spans where n >= 100),
p as (select x.*, y.a oa, (y.a - x.a + 1000) % 1000 k from g x join g y on x.query_key = y.query_key and (x.a, x.b) <> (y.a, y.b) and (y.a - x.a + 1000) % 1000 < x.n where not (y.b < 1000 and (y.b - x.a + 1000) % 1000 < x.n) and y.a <> x.a)
select query_key, a, (oa + 999) % 1000 + 1 b, k n, 'left' side from p where k >= 100 union all select query_key, oa, b, n - k, 'overlap' from p where n - k >= 100""")
def overlap_expand(spark, sf):
    g = spans(spark, sf).filter("n >= 100").select("query_key", "a", "b", "n", "length").distinct().withColumn("gid", F.concat_ws("|", "query_key", "a", "b"))
    return expand.overlap_products(g).select("query_key", "a", "b", "n", "side")


@query(f"""with {_SPANS}, u as (select distinct query_key, l_returnflag f, a, b, n from spans), g as (select * from u where f = 'N'), p as (select * from u where f <> 'N'),
fw as (select g.*, p.a fa, p.b fb, p.n fn from g join p on g.query_key = p.query_key and p.f = 'A' and (p.b - g.a + 999) % 1000 + 1 between 14 and g.n),
rv as (select g.*, p.a ra, p.b rb, p.n rn from g join p on g.query_key = p.query_key and p.f = 'R' and (p.a - g.a + 1000) % 1000 <= g.n - 14),
bo as (select fw.*, ra, rb, rn from fw join rv using (query_key, a, b) where (case when fw.a + fw.n > 1000 then (fa - fw.a + 1000) % 1000 >= fw.n or (ra - fw.a + 1000) % 1000 >= (fa - fw.a + 1000) % 1000 else ra >= fa end) and not ((fa - ra + 1000) % 1000 < rn and fa <> ra) and not (rb < 1000 and (rb - fa + 1000) % 1000 < fn and rb <> fb)),
x as (select query_key, 'PCR_PRODUCT_WITH_PRIMERS' atype, fa a, rb b from bo union all select query_key, 'PCR_PRODUCT_WITH_LEFT_PRIMER', fa, b from fw union all select query_key, 'PCR_PRODUCT_WITH_RIGHT_PRIMER', a, rb from rv)
select query_key, atype, a, b, (b - a + 999) % 1000 + 1 n from x where (b - a + 999) % 1000 + 1 >= 100""")
def interval_join_expand(spark, sf):
    u = spans(spark, sf).select("query_key", "l_returnflag", "a", "b", "n", "length").distinct().withColumn("gid", F.concat_ws("|", "query_key", "l_returnflag", "a", "b"))
    p = u.filter("l_returnflag <> 'N'").withColumn("pid", c("gid")).withColumn("direction", F.when(c("l_returnflag") == "A", 1).otherwise(-1))
    return expand.primer_pairs(u.filter("l_returnflag = 'N'"), p).select("query_key", "atype", "a", "b", "n")


_INNER = _GROUPS + """, t(atype, l, r, material, efficiency) as (values ('PRE-MADE DNA FRAGMENT', false, false, 0.0::double, 0.98::double), ('PCR_PRODUCT', true, true, 10.0, 0.95), ('PCR_PRODUCT_WITH_PRIMERS', false, false, 10.0, 0.95)),
inner_e as (select g.query_key, g.atype, l, r, material, efficiency, n span, i, j from groups g join t using (atype), lateral (select case when k = 0 then g.a when g.b < g.a then g.a + 1000 else g.a + 1000 end i, case when k = 0 then (case when g.b < g.a then g.b + 1000 else g.b end) else (case when g.b < g.a then g.b else g.b + 1000 end) end j from (values (0), (1)) v(k)) z)"""


@query(f"with {_INNER} select query_key, i, l, j, r, o1, o2, atype mtype, span, round(material / efficiency, 6) as cost from inner_e, (values (true), (false)) a(o1), (values (true), (false)) b(o2)")
def internal_edges(spark, sf):
    e = graph.internal_edges(groups(spark, sf))
    return e.select("query_key", c("src.index").alias("i"), "l", c("dst.index").alias("j"), "r", c("src.overhang").alias("o1"), c("dst.overhang").alias("o2"), "mtype", "span", F.round("cost", 6).alias("cost"))


_OUTER = _INNER + """, an as (select distinct query_key, i, l x from inner_e), bn as (select distinct query_key, j, r x from inner_e),
pr as (select bn.query_key, j, bn.x bx, i, an.x ax, i % 1000 qa, (j + 999) % 1000 + 1 qb, abs(cast(floor((j - 1) / 1000) as int) - cast(floor(i / 1000) as int)) w from an join bn using (query_key)),
pl as (select *, case when i = j then 0 when qb <= qa and w = 0 then 1000 - qa + qb else qb + w * 1000 - qa end n from pr),
gs as (select query_key, list(distinct a) st from groups group by 1)"""


@query(f"""with {_OUTER},
o as (select query_key, j, bx, i, ax, i - j span, 0 origin from pl join gs using (query_key) where n <> 0 and j > i and len(list_filter(st, lambda s: s >= qa and s <= qb)) > 0
union all select query_key, j, bx, i, ax, -n, 1 from pl join gs using (query_key) where n <> 0 and i <= 1000 and j >= 1000 and len(list_filter(st, lambda s: s >= qa or s <= qb)) > 0)
select query_key, j, bx, i, ax, cast(max_by(span, origin) as int) span, max(origin) origin from o where span <= 0 group by 1, 2, 3, 4, 5""")
def overlap_edges(spark, sf):
    g = groups(spark, sf, by_order(spark, sf))
    e = graph.external_edges(graph.nodes_of(graph.internal_edges(g)), g.select("query_key", c("a").alias("start"))).filter(c("mtype") == K.OVERLAP)
    return e.select("query_key", c("src.index").alias("j"), c("l").alias("bx"), c("dst.index").alias("i"), c("r").alias("ax"), "span", "origin")


_GAPS = """, gp as (select query_key, j, bx, i, ax, i - j span, 0 origin from pl where j <= i
union all select query_key, j, bx, i, ax, case when j = 1000 then (case when i = 0 then 0 else (i + 999) % 1000 + 1 + 1000 * cast(floor((i - 1) / 1000) as int) end)
 else (case when i = j then 0 when (i + 999) % 1000 + 1 <= j % 1000 and cast(floor((i - 1) / 1000) as int) = cast(floor(j / 1000) as int) then 1000 - j % 1000 + (i + 999) % 1000 + 1 else (i + 999) % 1000 + 1 + 1000 * abs(cast(floor((i - 1) / 1000) as int) - cast(floor(j / 1000) as int)) - j % 1000 end) end, 1 from pl where i <= 1000 and j >= 1000)"""


@query(f"with {_OUTER}{_GAPS} select query_key, j, bx, i, ax, cast(max_by(span, origin) as int) span, max(origin) origin from gp group by 1, 2, 3, 4, 5")
def gap_edges(spark, sf):
    g = groups(spark, sf, by_order(spark, sf))
    e = graph.external_edges(graph.nodes_of(graph.internal_edges(g)), g.select("query_key", c("a").alias("start"))).filter(c("mtype") == K.GAP)
    return e.select("query_key", c("src.index").alias("j"), c("l").alias("bx"), c("dst.index").alias("i"), c("r").alias("ax"), "span", "origin")


_P = params.DEFAULTS
_STEP, (_LOW, _HIGH) = _P["_synthesis_step_size"], _P["_synthesis_left_span_range"]
_TOP = max(int(x[1]) for x in _P["synthesis_cost"]["data"])
_BAND = "(values " + ", ".join(f"({lo}, {hi}, {f}::double)" for lo, hi, f in _P["primer_efficiency"]["data"]) + ")"
_OWN = " union all ".join(f"select 1, x - {_P['primer_min_anneal']}, x * {per}::double + {base}, {days} from range({int(lo)}, {int(hi)}) t(x)" for _, lo, hi, base, per, days in _P["primer_cost"]["data"])
_PRIMER = f"""p as (select 0 e, 0 ext, 0.0::double m, 0.0::double d union all {_OWN}),
bst as (select i.e l, j.e r, i.ext + j.ext ext, min({{'m': round((i.m + j.m) * {_P['global_material_modifier']}::double + {2 * _P['global_time_cost']}::double * greatest(i.d, j.d), 9), 'le': i.ext, 're': j.ext}}) k from p i, p j group by all),
eff as (select x, f from {_BAND} b(lo, hi, f), lateral (select unnest(range(lo, hi)) x)),
primer as (select l, r, cast(s as int) span, min(round(case when f > 0 then k.m / f end, 9)) as cost, min({{'c': round(k.m / f, 9), 'f': f, 'le': k.le, 're': k.re, 'm': k.m}}) filter (where f > 0) w from bst, range({_P['_primer_min_span']}, 700) t(s) join eff on x = least(greatest(ext - s, 0), {max(x[1] for x in _P["primer_efficiency"]["data"]) - 1}) group by all)"""
_KEYS = "q as (select o_orderkey, cast(o_orderkey % 2 as int) l, cast(o_custkey % 2 as int) r, cast(o_orderkey * 13 % {n} as int) + {low} span from orders)"


def _keys(spark, sf, n: int, low: int) -> DataFrame:
    """Every order as a junction to be priced."""
    return read(spark, sf, "orders").select("o_orderkey", (c("o_orderkey") % 2).cast("int").alias("l"), (c("o_custkey") % 2).cast("int").alias("r"), (c("o_orderkey") * 13 % n + low).cast("int").alias("span"))


@query(f"with {_PRIMER}, {_KEYS.format(n=1000, low=-300)} select o_orderkey, l, r, span, round(cost, 6) as cost, w.f efficiency, round(w.m, 6) material, w.le::int left_ext, w.re::int right_ext from q left join primer using (l, r, span)")
def primer_cost(spark, sf):
    """The two primers of a junction, by the primer model alone."""
    t = cost.primer_model(spark).filter(c("cost") < float("inf"))
    t = _keys(spark, sf, 1000, -300).join(F.broadcast(t), ["l", "r", "span"], "left")
    return t.select("o_orderkey", "l", "r", "span", F.round("cost", 6).alias("cost"), "efficiency", F.round("material", 6).alias("material"), "left_ext", "right_ext")


_GENES = ", ".join(f"({lo}, {hi}, {float(base)}::double, {float(days)}::double)" for lo, hi, base, days in _P["synthesis_cost"]["data"] if base != "inf")
_SYNTH = (
    _PRIMER
    + f""", gene(lo, hi, base, days) as (values {_GENES}),
genes as (select size, base, days from gene, lateral (select unnest(range(lo, hi)) size) where size % {_STEP} = 0),
lf as (select l, span ls, w.f le, w.m lm from primer where r = 0 and cost is not null and span >= {_LOW} and span < {_HIGH} and (span - {_LOW}) % {_STEP} = 0),
rg as (select r, span rs, w.f re, w.m rm from primer where l = 0 and cost is not null),
syn as (select *, k.c as cost from (select l, r, cast(size + ls + rs as int) span, min({{'c': round((round(lm + rm + base, 9) + days * {_P['global_time_cost']}::double) / (le * re), 9), 'e': le * re, 'size': size, 'ls': ls}}) k from lf, genes, rg where size + ls + rs between 0 and {_TOP - 1} group by l, r, size + ls + rs))"""
)


@query(f"with {_SYNTH}, {_KEYS.format(n=_TOP, low=0)} select o_orderkey, l, r, span, round(cost, 6) as cost, round(k.e, 8) efficiency, k.size::int size, k.ls::int lshift from q left join syn using (l, r, span)")
def synthesis_cost(spark, sf):
    """The gene that fills a junction and where it lies, by the synthesis model alone."""
    t = cost.synthesis_model(spark).filter(c("cost") < float("inf"))
    t = _keys(spark, sf, _TOP, 0).join(F.broadcast(t), ["l", "r", "span"], "left")
    return t.select("o_orderkey", "l", "r", "span", F.round("cost", 6).alias("cost"), F.round("efficiency", 8).alias("efficiency"), c("size").cast("int").alias("size"), c("lshift").cast("int").alias("lshift"))


@query(f"""with {_SYNTH}, bo as (select coalesce(p.l, s.l) l, coalesce(p.r, s.r) r, coalesce(p.span, s.span) span, least(p.cost, s.cost) as cost from primer p full join syn s on p.l = s.l and p.r = s.r and p.span = s.span),
q as (select o_orderkey, cast(o_orderkey % 2 as int) l, cast(o_custkey % 2 as int) r, cast(floor(o_totalprice / 100) as int) - 400 span from orders)
select o_orderkey, q.span, case when q.span between -300 and 2248 then round(cost, 6) end as cost from q left join bo on bo.l = q.l and bo.r = q.r and bo.span = q.span""")
def span_cost_lookup(spark, sf):
    o = read(spark, sf, "orders")
    q = o.select("o_orderkey", (c("o_orderkey") % 2).cast("int").alias("l"), (c("o_custkey") % 2).cast("int").alias("r"), (F.floor(c("o_totalprice") / 100).cast("int") - 400).alias("span"))
    t = cost.lookup(q, cost.span_cost(spark))
    return t.select("o_orderkey", "span", F.when(c("cost") < float("inf"), F.round("cost", 6)).alias("cost"))


@query("select o_orderkey, cast(floor(o_totalprice / 10) as int) span, case when cast(floor(o_totalprice / 10) as int) between 4000 and 4999 then 0.8 when cast(floor(o_totalprice / 10) as int) between 5000 and 5999 then 0.5 else 1.0 end::double multiplier from orders")
def band_multiplier(spark, sf):
    d = read(spark, sf, "orders").select("o_orderkey", F.floor(c("o_totalprice") / 10).cast("int").alias("span"))
    return d.withColumn("multiplier", graph.band_multiplier(c("span")))


@query("with e as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice m, (case when l_quantity / 10 >= 1 then 0.1 / (l_quantity / 10) else 1 - l_discount end) * power(0.5, l_linenumber) e from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(e, 8) efficiency, round(m / e, 4) as cost from e where m / e <= 1000000")
def efficiency_adjust(spark, sf):
    l = read(spark, sf, "lineitem")
    e = graph.mispriming_efficiency(c("l_linenumber"), graph.complexity_efficiency(c("l_quantity"), 1 - c("l_discount")))
    d = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_extendedprice").alias("m"), e.alias("e")).withColumn("x", cost.adjust(c("m"), c("e"))).filter("x <= 1000000")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("e", 8).alias("efficiency"), F.round("x", 4).alias("cost"))


@query("select l_orderkey query_key, round(sum(l_extendedprice), 4) material, round(product(1 - l_discount), 8) efficiency, round(sum(l_extendedprice) / product(1 - l_discount), 4) as cost, count(*) n_edges from lineitem group by 1")
def assembly_cost(spark, sf):
    l = read(spark, sf, "lineitem").select(c("l_orderkey").alias("query_key"), c("l_extendedprice").alias("material"), (1 - c("l_discount")).alias("efficiency"))
    return paths.total_cost(l, ["query_key"]).select("query_key", F.round("material", 4).alias("material"), F.round("efficiency", 8).alias("efficiency"), F.round("cost", 4).alias("cost"), "n_edges")


@query("with a as (select o_custkey, o_orderkey, round(sum(l_extendedprice) / product(1 - l_discount), 4) as cost, count(*) n_nodes from orders join lineitem on o_orderkey = l_orderkey group by 1, 2) select *, row_number() over (partition by o_custkey order by cost, n_nodes, o_orderkey) as rank from a qualify rank <= 3")
def top_n_assemblies(spark, sf):
    l = read(spark, sf, "lineitem").select(c("l_orderkey").alias("o_orderkey"), c("l_extendedprice").alias("material"), (1 - c("l_discount")).alias("efficiency"))
    a = paths.total_cost(l, ["o_orderkey"]).join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    a = a.select("o_custkey", "o_orderkey", F.round("cost", 4).alias("cost"), c("n_edges").alias("n_nodes"))
    return paths.top(a, ["o_custkey"], [c("cost"), c("n_nodes"), c("o_orderkey")], 3)


_CHAIN = "ch as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) i, l_extendedprice m, 1 - l_discount e from lineitem)"


def _chain(spark, sf):
    l = by_order(spark, sf)
    w = F.row_number().over(paths.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    return l.select(c("l_orderkey").alias("query_key"), w.alias("src"), c("l_extendedprice").alias("material"), (1 - c("l_discount")).alias("efficiency")).withColumn("dst", c("src") + 1)


@query(f"with {_CHAIN} select a.k query_key, a.i src, b.i + 1 dst, round(sum(x.m), 4) material, round(sum(x.m) / product(x.e), 4) as cost from ch a join ch b on a.k = b.k and b.i >= a.i join ch x on x.k = a.k and x.i between a.i and b.i group by 1, 2, 3")
def all_pairs_paths(spark, sf):
    d = paths.path_distances(_chain(spark, sf)).filter("src <> dst")
    return d.select("query_key", "src", "dst", F.round("material", 4).alias("material"), F.round("cost", 4).alias("cost"))


@query(f"with {_CHAIN} select k query_key, i src, m material, coalesce(lead(m) over (partition by k order by i), first(m) over (partition by k order by i)) as next from ch")
def pairwise_close(spark, sf):
    return paths.closed_pairs(_chain(spark, sf), ["query_key"], [c("src")], "material").select("query_key", "src", "material", "next")


@query("with a as (select l_orderkey k, list(l_suppkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) x from lineitem group by 1) select k query_key, array_to_string(list_concat(x[list_position(x, list_min(x)):], x[1:list_position(x, list_min(x)) - 1]), ',') cycle from a")
def cyclic_sort(spark, sf):
    l = read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("query_key")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("x"))
    return l.select("query_key", F.array_join(S.sort_cycle(F.transform("x", lambda r: r["l_suppkey"])), ",").alias("cycle"))


@query(f"with n as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) pos, l_returnflag f, l_linestatus s, o_custkey g from lineitem join orders on l_orderkey = o_orderkey), a as (select *, k - lag(k) over (partition by g, pos order by k) as gap, lag(k) over (partition by g, pos order by k) prev from n), one as (select o_custkey g, min(o_orderkey) k1, max(o_orderkey) k2 from orders group by 1 having count(*) > 1), l as (select one.g, pos, f, s from one join n on n.k = k1), r as (select one.g, pos, f, s from one join n on n.k = k2) select coalesce(l.g, r.g) g, coalesce(l.pos, r.pos) pos, cast(case when l.g is null or r.g is null then 2 else (l.f <> r.f)::int + (l.s <> r.s)::int end as int) n_differ from l full join r on l.g = r.g and l.pos = r.pos")
def edit_distance(spark, sf):
    o = read(spark, sf, "orders")
    one = o.groupBy(c("o_custkey").alias("g")).agg(F.min("o_orderkey").alias("k1"), F.max("o_orderkey").alias("k2"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    l = read(spark, sf, "lineitem")
    w = F.row_number().over(paths.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    n = l.select(c("l_orderkey").alias("k"), w.alias("pos"), c("l_returnflag").alias("f"), c("l_linestatus").alias("s"))
    side = lambda k: one.select("g", c(k).alias("k")).join(n, "k").drop("k")
    return paths.edit_steps(side("k1"), side("k2"), ["g"], ["f", "s"])


_KMERS = f"s as (select doc_id, {_DNA} s from documents), u as (select doc_id, s, unnest(range(1, greatest(len(s) - 12, 1))) i from s where len(s) >= 14), f as (select doc_id, s, unnest(range(1, greatest(len(s) - 18, 1))) i from s where len(s) >= 20)"


@query(f"""with {_KMERS}, a as (select doc_id, count(*) n from (select doc_id, s[i:i + 13] x from u group by 1, 2 having count(*) > 1) group by 1),
k as (select doc_id, i, s[i:i + 19] x from f), h2 as (select doc_id, count(*) n from (select doc_id, x from k group by 1, 2 having count(*) > 1) group by 1),
h1 as (select doc_id, count(*) n from (select doc_id, x from (select doc_id, x from k union all select doc_id, reverse(translate(x, 'ACGT', 'TGCA')) x from k) group by 1, 2 having count(*) > 1) group by 1),
w as (select doc_id, cast(sum((len(x) - len(replace(x, 'A', '')) > 15)::int + (len(x) - len(replace(x, 'C', '')) > 15)::int + (len(x) - len(replace(x, 'G', '')) > 15)::int + (len(x) - len(replace(x, 'T', '')) > 15)::int) as bigint) b, count(*) filter (where len(replace(replace(x, 'A', ''), 'T', '')) > 17) g, count(*) filter (where len(replace(replace(x, 'C', ''), 'G', '')) > 18) t from k group by 1)
select s.doc_id::varchar as key, coalesce(a.n, 0) n_repeats, coalesce(h1.n, 0) - 2 * coalesce(h2.n, 0) n_hairpins, coalesce(w.b, 0) n_base_windows, coalesce(w.g, 0) n_gc_windows, coalesce(w.t, 0) n_at_windows,
round(case when len(s.s) > 0 then abs(100.0 * len(replace(replace(s.s, 'A', ''), 'T', '')) / len(s.s) - 50) * 17 / 25 else 0 end, 6) gc_cost
from s left join a using (doc_id) left join h1 using (doc_id) left join h2 using (doc_id) left join w using (doc_id)""")
def complexity_score(spark, sf):
    d = bases(read(spark, sf, "documents"), "doc_id").select("key", S.complexity_parts(c("bases")).alias("p")).select("key", "p.*")
    return d.select("key", "n_repeats", "n_hairpins", "n_base_windows", "n_gc_windows", "n_at_windows", F.round("gc_cost", 6).alias("gc_cost"))


_MATCH = f"""d as (select doc_id, {_DNA} s from documents), b as (select item_id, 1 strand, {_DNA} s from benchmark), bb as (select * from b union all select item_id, -1, reverse(translate(s, 'ACGT', 'TGCA')) from b),
q as (select doc_id, i, s[i:i + 29] x from d, lateral (select unnest(range(1, greatest(len(s) - 28, 1))) i) where len(s) >= 30), p as (select item_id, strand, len(s) n, j, s[j:j + 29] x from bb, lateral (select unnest(range(1, greatest(len(s) - 28, 1))) j) where len(s) >= 30),
h as (select doc_id, item_id, strand, n, i, i - j dg from q join p using (x)), r as (select *, i - row_number() over (partition by doc_id, item_id, strand, dg order by i) grp from h)"""


@query(f"with {_MATCH} select doc_id::varchar query_key, item_id::varchar subject_key, strand, cast(min(i) as int) q_start, cast(max(i) + 29 as int) q_raw_end, cast(case when strand = 1 then min(i) - dg else n - (min(i) - dg) + 1 end as int) s_start, cast(max(i) - min(i) + 30 as int) n from r group by doc_id, item_id, strand, n, dg, grp")
def seq_match_both_strands(spark, sf):
    goals = bases(read(spark, sf, "documents"), "doc_id").withColumn("is_circular", F.lit(False))
    hits = match.exact_matches(goals, bases(read(spark, sf, "benchmark"), "item_id"), 30, sieved=True)
    return hits.select("query_key", "subject_key", "strand", "q_start", "q_raw_end", "s_start", "n")


@query("select d.doc_id::varchar query_key, count(*) n_items from documents d join benchmark b on contains(d.text, b.text) group by 1")
def whole_subject_match(spark, sf):
    """Whole benchmark passages in raw texts."""
    doc = read(spark, sf, "documents").select(c("doc_id").cast("string").alias("key"), c("text").alias("bases"), F.lit(False).alias("is_circular"))
    items = read(spark, sf, "benchmark").select(c("item_id").cast("string").alias("key"), c("text").alias("bases"))
    hits = match.whole_matches(doc, items, 32, both_strands=False, fold=False, sieved=True)
    return hits.select("query_key", "subject_key").distinct().groupBy("query_key").agg(F.count(F.lit(1)).alias("n_items"))


@query("with h as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linestatus = 'O' then 1 else -1 end strand, cast(l_quantity as int) s_length, case when l_linestatus = 'O' then (case when l_returnflag = 'A' then 1 else 2 end) else cast(l_quantity as int) end s_start, case when l_linestatus = 'O' then cast(l_quantity as int) else (case when l_returnflag = 'A' then 1 else 2 end) end s_raw_end from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, least(s_start, s_raw_end) - 1 sa, greatest(s_start, s_raw_end) sb, strand direction from h where least(s_start, s_raw_end) = 1 and greatest(s_start, s_raw_end) = s_length and (strand = 1 or s_raw_end = 1) and (strand = -1 or s_start = 1)")
def perfect_subject_filter(spark, sf):
    l, q = read(spark, sf, "lineitem"), c("l_quantity").cast("int")
    plus, first = c("l_linestatus") == "O", F.when(c("l_returnflag") == "A", 1).otherwise(2)
    h = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(plus, 1).otherwise(-1).alias("strand"), q.alias("s_length"), F.when(plus, first).otherwise(q).alias("s_start"), F.when(plus, q).otherwise(first).alias("s_raw_end"))
    h = h.filter(match.perfect_subject()).withColumns({"query_key": F.lit(""), "subject_key": F.lit(""), "q_start": F.lit(1), "q_raw_end": c("s_length"), "n": c("s_length"), "q_length": c("s_length"), "q_circular": F.lit(False)})
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    r = match.to_regions(h.withColumn("query_key", F.to_json(F.struct(*keys))), K.FRAGMENT)
    back = r.withColumn("k", F.from_json("query_key", "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"))
    return back.select(*[c(f"k.{x}").alias(x) for x in keys], "sa", "sb", "direction").withColumn("l_linenumber", c("l_linenumber").cast(dict(l.dtypes)["l_linenumber"]))


@query(f"with {_SPANS}, p as (select query_key, a lo, least(a + n, 1000) hi from spans union all select query_key, 0, a + n - 1000 from spans where a + n > 1000), e as (select query_key, lo pos, 1 s from p union all select query_key, hi, -1 from p), g as (select query_key, pos, sum(s) s from e group by 1, 2), r as (select query_key, pos as start, lead(pos) over w as stop, cast(sum(s) over w as bigint) depth from g window w as (partition by query_key order by pos)) select query_key, start, stop, depth from r where depth > 0 and stop > start")
def coverage_profile(spark, sf):
    return score.coverage(spans(spark, sf), ["query_key"]).select("query_key", "start", c("end").alias("stop"), "depth")


@query("with recursive e as (select distinct o_custkey a, 1000000000 + l_partkey b from orders join lineitem on o_orderkey = l_orderkey where l_quantity > 49 and l_discount > 0.08), u as (select a x, b y from e union select b, a from e), r(x, c) as (select distinct x, x from u union select u.y, r.c from r join u on r.x = u.x) select x node, min(c) component from r group by 1")
def shared_components(spark, sf):
    e = read(spark, sf, "orders").join(read(spark, sf, "lineitem").filter("l_quantity > 49 and l_discount > 0.08"), c("o_orderkey") == c("l_orderkey")).select(c("o_custkey").alias("a"), (1_000_000_000 + c("l_partkey")).alias("b")).distinct()
    return library.connected(e)


def all_links(spark, sf):
    """Links of customers and parts, one for each order line; hardly any comes twice, so they are not made distinct."""
    return read(spark, sf, "orders").join(read(spark, sf, "lineitem"), c("o_orderkey") == c("l_orderkey")).select("o_custkey", "l_partkey")


@query()
def shared_components_all(spark, sf):
    """shared_components over all order lines."""
    return library.connected(all_links(spark, sf).select(c("o_custkey").alias("a"), (1_000_000_000 + c("l_partkey")).alias("b")))


def _reactions(spark, sf):
    l = read(spark, sf, "lineitem")
    mol = lambda t, s: F.struct(F.lit(t).alias("mtype"), s.alias("seq"))
    dna = lambda k: F.translate(k.cast("string"), "0123456789", "ACGTACGTAC")
    name = F.when(c("l_returnflag") == "A", "Assembly").otherwise("PCR")
    return l.select(c("l_orderkey").cast("string").alias("design_key"), c("l_linenumber").cast("int").alias("assembly_id"), c("l_suppkey").alias("reaction_id"), name.alias("name"), F.array(mol("PRIMER", dna(c("l_suppkey"))), mol("TEMPLATE", dna(c("l_partkey") % 50))).alias("inputs"), F.array(mol("PCR_PRODUCT", dna(c("l_partkey")))).alias("outputs"))


_RX = "rx as (select l_orderkey::varchar dk, cast(l_linenumber as int) ai, case when l_returnflag = 'A' then 'Assembly' else 'PCR' end nm, translate(l_suppkey::varchar, '0123456789', 'ACGTACGTAC') i1, translate((l_partkey % 50)::varchar, '0123456789', 'ACGTACGTAC') i2, translate(l_partkey::varchar, '0123456789', 'ACGTACGTAC') o1, l_suppkey from lineitem)"
_MOL = "k as (select *, 'molecule|PRIMER|' || sha1(i1) k1, 'molecule|TEMPLATE|' || sha1(i2) k2, 'molecule|PCR_PRODUCT|' || sha1(o1) k3 from rx), m as (select dk, ai, unnest([k1, k2, k3]) mk from k)"


@query(f"with {_RX} select dk design_key, ai assembly_id, l_suppkey reaction_id, nm reaction_name, r.role, r.t as type, r.s as sequence, len(r.s)::int as length from (select *, unnest([{{'role': 'INPUT', 't': 'PRIMER', 's': i1}}, {{'role': 'INPUT', 't': 'TEMPLATE', 's': i2}}, {{'role': 'OUTPUT', 't': 'PCR_PRODUCT', 's': o1}}]) r from rx)")
def reaction_rows(spark, sf):
    return output.reaction_rows(_reactions(spark, sf))


@query(f"with {_RX}, {_MOL} select mk molecule_key, count(distinct (dk, ai)) n_used from m group by 1")
def plan_dag_dedup(spark, sf):
    molecules, _ = output.plan_dag(_reactions(spark, sf))
    return molecules.select("molecule_key", F.size("used_in").cast("long").alias("n_used"))


_DAG = "dag as (select nm, case when nm = 'Assembly' then ai::varchar else '' end rk, k1, k2, k3, list(distinct dk) dks from k group by all)"


@query(f"with {_RX}, {_MOL}, {_DAG}, x as (select k3, count(*) n from dag group by 1 having count(*) > 1) select k3 molecule_key, n n_producers from x")
def dag_extra_producers(spark, sf):
    _, dag = output.plan_dag(_reactions(spark, sf))
    return output.extra_producers(dag).groupBy("molecule_key").agg(F.max("nth").cast("long").alias("n_producers"))


@query(f"with {_RX}, {_MOL}, fs as (select o_orderkey::varchar dk from orders where o_orderpriority = '1-URGENT'), used as (select distinct nm, case when nm = 'Assembly' then ai::varchar else '' end rk, k1, k2, k3 from k semi join fs on k.dk = fs.dk), ks as (select unnest([k1, k2, k3]) mk from used) select distinct mk molecule_key from ks")
def filter_by_key(spark, sf):
    keys = read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(c("o_orderkey").cast("string").alias("design_key"))
    kept, _ = output.filter_designs(_reactions(spark, sf), keys)
    return kept.select("molecule_key")


@query("select l_orderkey query_key, count(*) n_edges from lineitem group by 1")
def output_json(spark, sf):
    l = read(spark, sf, "lineitem").select(c("l_orderkey").alias("query_key"), c("l_linenumber").alias("rank"), c("l_suppkey").alias("pos"), c("l_extendedprice").alias("material"), c("l_returnflag").alias("type"))
    j = output.output_json(l)
    n = F.from_json("json", "struct<assemblies:array<struct<edges:array<struct<pos:long>>>>>")["assemblies"]
    return j.select("query_key", F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + F.size(x["edges"])).alias("n_edges"))


@query("with f as (select l_orderkey k, l_linenumber i, sum(l_quantity) q, max(l_tax) t from lineitem group by 1, 2) select k, round(sum(q), 4) q, round(sum(t), 6) t, count(*) n from f group by 1")
def frame_aggregate(spark, sf):
    f = read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("k"), c("l_linenumber").alias("i")).agg(F.sum("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    f = f.withColumn("n", F.lit(1).cast("long"))
    return frame.apply(frame.aggregate(f, ["k", "i"], "i", F.sum), ["k"], lambda x: F.round(x, 6)).select("k", F.round("q", 4).alias("q"), "t", c("n").cast("long").alias("n"))


@query("select p_brand, arg_min(p_partkey, (p_retailprice, p_size, p_partkey)) p_partkey, min(p_retailprice) p_retailprice from part group by 1")
def lex_argmin(spark, sf):
    return frame.lex_argmin(read(spark, sf, "part").select("p_brand", "p_retailprice", "p_size", "p_partkey"), ["p_brand"], ["p_retailprice", "p_size", "p_partkey"]).select("p_brand", "p_partkey", "p_retailprice")


_MISPRIME = f"""with d as (select doc_id, s, len(s) - 50 j from (select doc_id, {_DNA} s from documents) where len(s) >= 200),
kk as (select doc_id, p - 1 p, s[p:p + 11] x from d, lateral (select unnest(range(1, len(s) - 10)) p)),
e as (select doc_id, 1 side, 50 lo, least(80, len(s) - 1) hi from d union all select doc_id, 2, j - 30, j from d),
src as (select e.doc_id, side, x, reverse(translate(x, 'ACGT', 'TGCA')) rx from e join kk on kk.doc_id = e.doc_id and p >= lo and p <= hi - 12),
dst as (select distinct e.doc_id, side, x from e join kk on kk.doc_id = e.doc_id and (p < lo or p >= hi)),
t as (select src.doc_id, side, count(*) n from src semi join dst on src.doc_id = dst.doc_id and src.side = dst.side and src.x = dst.x group by 1, 2),
b as (select src.doc_id, side, count(*) n from src semi join dst on src.doc_id = dst.doc_id and src.side = dst.side and src.rx = dst.x group by 1, 2),
own as (select doc_id, side, count(*) - count(distinct rx) r from src group by 1, 2),
rep as (select doc_id, side, count(*) n from (select doc_id, side, x from src group by 1, 2, 3 having count(*) > 1) group by 1, 2)
select own.doc_id::varchar as key, cast(sum(r + coalesce(t.n, 0) + coalesce(b.n, 0) + coalesce(rep.n, 0)) as bigint) n_misprimings from own left join t using (doc_id, side) left join b using (doc_id, side) left join rep using (doc_id, side) group by 1"""


def _amplicons(spark, sf):
    return bases(read(spark, sf, "documents"), "doc_id").filter("length(bases) >= 200").select("key", "bases", F.lit(50).alias("i"), (F.length("bases") - 50).alias("j"))


@query(_MISPRIME)
def misprimings(spark, sf):
    d = _amplicons(spark, sf)
    return d.select("key", S.misprimings(c("bases"), c("i"), c("j"), F.lit(False)).alias("n_misprimings"))


@query()
def partition_points(spark, sf):
    d = bases(read(spark, sf, "documents"), "doc_id").withColumn("is_circular", F.lit(False))
    return score.partition_points(d)


@query()
def plan_assemblies(spark, sf):
    """The whole plan: benchmark passages as templates, documents that hold one as goals; ranked assemblies."""
    return entry(spark, sf)


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Every match of a benchmark passage in a document, with its region, its group's size and the goal's best assembly, if any."""
    goals = bases(read(spark, sf, "documents"), "doc_id").withColumn("is_circular", F.lit(True))
    hits = match.exact_matches(goals, bases(read(spark, sf, "benchmark"), "item_id"), 30, sieved=True)
    aligned = shared.held(match.to_regions(hits, K.PCR), "alignments")  # read by every later step
    g = aligned.filter(expand.size_ok(c("n"), c("atype"))).select("query_key", "atype", "a", "b", "n", "length", "cyclic").distinct()
    plans = paths.assemblies(graph.assembly_graph(g, cost.span_cost(spark)), 1).select("query_key", F.round("cost", 4).alias("best_cost"), "n_nodes")
    return aligned.join(plans, "query_key", "left").select("query_key", "subject_key", "a", "b", "n", "direction", "best_cost", "n_nodes")


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
