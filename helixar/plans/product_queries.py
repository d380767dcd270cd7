"""Queries of joined products, features, sets of regions, objectives and the output document over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixar.functions import intervals as I
from helixar.functions import sequences as S
from helixar.functions import shared, thermo
from helixar.operators import assemble, document, features, lab, paths, routes
from helixar.operators.objective import MAX, PRODUCT, Objective
from helixar.plans.queries import _DNA, _MOL, _RX, _SPANS, _reactions, bases, by_order, c, query, read, spans
from helixar.sources import sequences as files

_LAPS = (20, 60, 80, 25)


def _pieces(spark, sf):
    """Benchmark passages as circles, cut in four pieces that overlap by 20, 60, 80 and 25 bases; every other piece is turned."""
    b = bases(read(spark, sf, "benchmark"), "item_id").filter("length(bases) >= 200").withColumn("_n", F.length("bases"))
    laps = F.array(*[F.lit(x) for x in _LAPS])
    p = b.select(c("key").alias("mix"), F.concat("bases", "bases").alias("_s"), "_n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    lo, hi = F.floor(c("i") * c("_n") / 4), F.floor((c("i") + 1) * c("_n") / 4)
    s = F.substring("_s", (lo + 1).cast("int"), (hi - lo + laps[c("i")]).cast("int"))
    return p.select("mix", F.concat(F.lit("p"), "i").alias("key"), F.when(c("i") % 2 == 1, S.reverse_complement(s)).otherwise(s).alias("bases"))


_PIECES = f"""b as (select item_id::varchar mix, {_DNA} s from benchmark), pc as (select mix, 'p' || i as key, (s || s)[i * len(s) // 4 + 1:(i + 1) * len(s) // 4 + [{", ".join(map(str, _LAPS))}][i + 1]] x, i from b, range(4) t(i) where len(s) >= 200),
p as (select mix, key, case when i % 2 = 1 then reverse(translate(x, 'ACGT', 'TGCA')) else x end s from pc), o as (select mix, key, 1 st, s from p union all select mix, key, -1, reverse(translate(s, 'ACGT', 'TGCA')) from p),
e as (select l.mix, l.key l, l.st ls, r.key r, r.st rs, l.s lseq, r.s rseq, max(t.n) n from o l join o r on l.mix = r.mix and l.key <> r.key, lateral (select unnest(range(15, least(len(l.s), len(r.s)) + 1)) n) t where right(l.s, t.n) = left(r.s, t.n) group by all)"""
_MELTS = "case when len(x) < 14 then 2.0 * (len(x) - g) + 4.0 * g else 64.9 + 41.0 * (g - 16.4) / len(x) end"


@query(f'with {_PIECES}, m as (select *, right(lseq, least(n, 60)) x from e), t as (select *, len(x) - len(replace(replace(x, \'G\', \'\'), \'C\', \'\')) g from m) select mix, l as "left", ls left_strand, r as "right", rs right_strand, n::int n, round({_MELTS}, 6) tm from t')
def junctions_of_any_length(spark, sf):
    return lab.junctions(_pieces(spark, sf), mix="mix").withColumn("tm", F.round("tm", 6))


@query(f"""with recursive {_PIECES}, r(mix, first, last, ls, seen, name, product, closed) as (
select mix, l, r, rs, [l], l || '+', left(lseq, len(lseq) - n), false from e where ls = 1 and r > l
union all select e.mix, first, e.r, e.rs, list_append(seen, last), name || ',' || last || case when r.ls = 1 then '+' else '-' end, product || left(lseq, len(lseq) - n), e.r = first and e.rs = 1
from r join e on e.mix = r.mix and e.l = r.last and e.ls = r.ls where not closed and ((e.r = first and e.rs = 1) or (e.r > first and not list_contains(seen, e.r))))
select mix, name as cycle, len(seen)::int n_pieces, len(product)::int as length, md5(product) product from r where closed""")
def cyclic_assemblies(spark, sf):
    """All circles that the pieces of each passage can be joined to."""
    p = _pieces(spark, sf)
    found = assemble.cycles(lab.junctions(p, mix="mix"))
    return assemble.products(found, p).select("mix", "cycle", "n_pieces", "length", F.md5(c("bases").cast("binary")).alias("product"))


_REGION = f"{_SPANS}, l as (select query_key, l_linenumber, l_partkey, l_suppkey, l_returnflag f, a, max(n) n from spans group by all)"
_IDS = ["l_linenumber", "l_partkey", "l_suppkey"]


def _regions(spark, sf, lines=None):
    s = spans(spark, sf, lines)
    return s.groupBy("query_key", *_IDS, "l_returnflag", "a", "length").agg(F.max("n").alias("n"))


_UNWRAPPED = "u as (select l.*, a + o u from l, lateral (select unnest(range(n)) o))"


def _islands(keep: str) -> str:
    """Runs of the positions u of `keep`, per region."""
    return f"i as (select *, u - row_number() over (partition by query_key, l_linenumber, l_partkey, l_suppkey order by u) g from ({keep})) select query_key, l_linenumber, l_partkey, l_suppkey, cast(min(u) % 1000 as int) a, cast(count(*) as int) n from i group by query_key, l_linenumber, l_partkey, l_suppkey, g"


@query(f"with {_REGION}, {_UNWRAPPED}, r as (select distinct query_key, u % 1000 p from u where f = 'R'), {_islands('select u.* from u anti join r on u.query_key = r.query_key and u.u % 1000 = r.p where f = ' + chr(39) + 'A' + chr(39))}")
def region_difference(spark, sf):
    """The parts of regions of one kind that none of the other kind covers."""
    r = _regions(spark, sf)
    d = I.difference(r.filter("l_returnflag = 'A'"), r.filter("l_returnflag = 'R'"), ["query_key"], _IDS, width=200)
    return d.select("query_key", *_IDS, "a", "n")


@query(f"with {_REGION}, {_UNWRAPPED}, r as (select query_key, u % 1000 p from u group by all having count(*) > 1), {_islands('select u.* from u anti join r on u.query_key = r.query_key and u.u % 1000 = r.p')}")
def region_exclusive(spark, sf):
    """The parts of each region that no other region of its circle covers."""
    return I.exclusive(_regions(spark, sf, by_order(spark, sf)), ["query_key"], _IDS).select("query_key", *_IDS, "a", "n")


@query(f"with {_REGION}, {_UNWRAPPED}, r as (select distinct query_key, u % 1000 p from u where f = 'R') select distinct query_key, l_linenumber, l_partkey, l_suppkey from u semi join r on u.query_key = r.query_key and u.u % 1000 = r.p where f <> 'R'")
def regions_touched(spark, sf):
    """Regions that share a position with one of another kind."""
    r = _regions(spark, sf)
    return I.touched(r.filter("l_returnflag <> 'R'"), r.filter("l_returnflag = 'R'"), ["query_key"], _IDS, width=200).select("query_key", *_IDS)


_POSITIONS = f"{_REGION}, {_UNWRAPPED}, k as (select distinct query_key from l), cov as (select distinct query_key, u % 1000 p from u), allp as (select query_key, p, cov.p is not null here from k cross join range(1000) t(p) left join cov using (query_key, p)), z as (select query_key, min(p) filter (where here) first_in, min(p) filter (where not here) first_out from allp group by 1)"


@query(f"with {_POSITIONS}, t as (select query_key, (p - first_in + 1000) % 1000 + first_in u from allp join z using (query_key) where not here), i as (select *, u - row_number() over (partition by query_key order by u) g from t) select query_key, cast(min(u) % 1000 as int) a, cast(count(*) as int) n from i group by query_key, g")
def region_gaps(spark, sf):
    return I.gaps(_regions(spark, sf), ["query_key"]).select("query_key", "a", "n")


@query(f"with {_POSITIONS}, t as (select query_key, case when first_out is null then p else (p - first_out + 1000) % 1000 + first_out end u from allp join z using (query_key) where here), i as (select *, u - row_number() over (partition by query_key order by u) g from t) select query_key, cast(min(u) % 1000 as int) a, cast(count(*) as int) n from i group by query_key, g")
def region_union(spark, sf):
    return I.union(_regions(spark, sf), ["query_key"]).select("query_key", "a", "n")


_STEPS = "ch as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) i, count(*) over (partition by l_orderkey) n, l_extendedprice m, 1 - l_discount e, 1 - l_tax t from lineitem), ed as (select k, i s, i + 1 d, m, e, n from ch union all select k, i, i + 2, 1.6 * m, t, n from ch where i < n)"
_WAYS = f"{_STEPS}, way(k, s, d, m, e, most, path, n) as (select k, s, d, m, e, m, s || ',' || d, n from ed union all select way.k, way.s, ed.d, way.m + ed.m, way.e * ed.e, greatest(most, ed.m), path || ',' || ed.d, way.n from way join ed on ed.k = way.k and ed.s = way.d)"


def _steps(spark, sf):
    """An order's lines as a graph with many ways: from each line to the next, and past it at 1.6 times the price."""
    l = by_order(spark, sf)
    w = paths.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    d = l.select(c("l_orderkey").alias("query_key"), F.row_number().over(w).alias("src"), F.count(F.lit(1)).over(paths.Window.partitionBy("l_orderkey")).alias("n"), "l_extendedprice", "l_discount", "l_tax")
    step = lambda k, m, e: F.struct((c("src") + k).alias("dst"), m.alias("material"), (1 - c(e)).alias("efficiency"))
    one, two = step(1, c("l_extendedprice"), "l_discount"), step(2, 1.6 * c("l_extendedprice"), "l_tax")
    return d.select("query_key", "src", F.explode(F.when(c("src") < c("n"), F.array(one, two)).otherwise(F.array(one))).alias("x"), "n").select("query_key", "src", "x.*", "n")


def _sizes(spark, sf):
    """The number of lines of each order."""
    return read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("query_key")).agg(F.count(F.lit(1)).alias("n"))


_LOG = Objective("material - 20000 * log(efficiency)", {"efficiency": PRODUCT})


@query(f"with recursive {_WAYS} select k query_key, s src, d dst, round(min(m - 20000 * ln(e)), 4) as cost from way group by 1, 2, 3")
def objective_all_pairs(spark, sf):
    """An objective with an optimal substructure, over graphs with many ways between two nodes."""
    return routes.all_pairs(_steps(spark, sf), _LOG).select("query_key", "src", "dst", F.round("cost", 4).alias("cost"))


@query(f"with recursive {_WAYS} select k query_key, s src, d dst, round(min(most), 4) as cost from way group by 1, 2, 3")
def bottleneck_all_pairs(spark, sf):
    """The way whose dearest step is cheapest."""
    return routes.all_pairs(_steps(spark, sf), Objective("material", {"material": MAX})).select("query_key", "src", "dst", F.round("cost", 4).alias("cost"))


_BEST = f"{_WAYS}, best as (select k, s, d, n, min(m - 20000 * ln(e)) as cost, arg_min(path, m - 20000 * ln(e)) path from way group by 1, 2, 3, 4)"


def _points(spark, sf):
    e = _sizes(spark, sf).filter("n >= 2")
    middle = (1 + F.floor(c("n") / 2)).cast("long")
    at = F.array(F.lit(1).cast("long"), middle, c("n") + 1)
    return e.select("query_key", F.lit("all").alias("route"), F.posexplode(at).alias("pos", "node"))


@query(f"with recursive {_BEST} select a.k query_key, round(a.cost + b.cost, 4) as cost, a.path || substring(b.path, len(split_part(b.path, ',', 1)) + 1) path from best a join best b on a.k = b.k and b.s = a.d where a.n >= 2 and a.s = 1 and a.d = 1 + a.n // 2 and b.d = b.n + 1")
def routes_through_points(spark, sf):
    r = routes.routes(_steps(spark, sf), _points(spark, sf), _LOG)
    return r.select("query_key", F.round("cost", 4).alias("cost"), F.array_join("path", ",").alias("path"))


@query(f"with recursive {_BEST} select a.k query_key, round(a.cost + b.cost + 1 - 20000 * ln(0.5), 4) as cost, regexp_replace(a.path || substring(b.path, len(split_part(b.path, ',', 1)) + 1), ',[0-9]+$', '') || ',' || (a.n + 1) path from best a join best b on a.k = b.k and b.s = a.d where a.n >= 2 and a.s = 1 and a.d = 1 + a.n // 2 and b.d = b.n + 1")
def rings_through_points(spark, sf):
    """The same points as a ring, with one edge from the last node back to the first; given from the middle on, so the ring is turned."""
    e = _steps(spark, sf)
    back = _sizes(spark, sf).select("query_key", (c("n") + 1).alias("src"), F.lit(1).alias("dst"), F.lit(1.0).alias("material"), F.lit(0.5).alias("efficiency"))
    p = _points(spark, sf).withColumn("pos", (c("pos") + 2) % 3)
    r = routes.routes(e.drop("n").unionByName(back), p, _LOG, cyclic=True)
    return r.select("query_key", F.round("cost", 4).alias("cost"), F.array_join("path", ",").alias("path"))


_NUMBERED = f"""{_RX}, {_MOL}, dg as (select distinct nm, case when nm = 'Assembly' then ai::varchar else '' end rk, k1, k2, k3 from k),
dr as (select *, sha1(nm || chr(10) || rk || chr(10) || k1 || ',' || k2 || chr(10) || '->' || chr(10) || k3) rkey from dg), rn as (select *, row_number() over (order by rkey) - 1 ri from dr),
mn as (select mk, row_number() over (order by mk) - 1 mi from (select distinct mk from m))"""


def _document(spark, sf):
    r = _reactions(spark, sf)
    return document.document(r.withColumns({"material": c("reaction_id").cast("double"), "efficiency": F.lit(0.9)}), hold=False)


@query(f"with {_NUMBERED} select ri as index, nm as name, a.mi || ',' || b.mi inputs, x.mi::varchar outputs, u.n n_used, u.cost material_cost from rn join mn a on a.mk = k1 join mn b on b.mk = k2 join mn x on x.mk = k3 join (select nm, case when nm = 'Assembly' then ai::varchar else '' end rk, k1, k2, k3, count(distinct (dk, ai)) n, min(l_suppkey)::double as cost from k group by 1, 2, 3, 4, 5) u using (nm, rk, k1, k2, k3)")
def document_reactions(spark, sf):
    r = _document(spark, sf).reactions
    return r.select("index", "name", F.array_join("inputs", ",").alias("inputs"), F.array_join("outputs", ",").alias("outputs"), F.size("used_in_assemblies").cast("long").alias("n_used"), "metadata.material_cost")


@query(f"with {_NUMBERED}, i as (select mk, string_agg(ri::varchar, ',' order by ri) x from (select k1 mk, ri from rn union select k2, ri from rn) group by 1), o as (select k3 mk, string_agg(ri::varchar, ',' order by ri) x from rn group by 1) select mi as index, mk molecule_key, split_part(mk, '|', 2) as name, md5(coalesce(i.x, '')) as_inputs, coalesce(o.x, '') as_outputs from mn left join i using (mk) left join o using (mk)")
def document_molecules(spark, sf):
    m = _document(spark, sf).molecules
    joined = lambda x: F.array_join(x, ",")
    return m.select("index", "molecule_key", "name", F.md5(joined("used_as_input_to_reactions").cast("binary")).alias("as_inputs"), joined("used_as_output_to_reactions").alias("as_outputs"))


@query(f"with {_NUMBERED}, s as (select k.*, ri from k join rn on k.nm = rn.nm and (case when k.nm = 'Assembly' then ai::varchar else '' end) = rk and k.k1 = rn.k1 and k.k2 = rn.k2 and k.k3 = rn.k3) select dk design_key, ai assembly, coalesce(string_agg(ri::varchar, ',' order by l_suppkey, ri) filter (where nm <> 'Assembly'), '') summary, coalesce(string_agg(distinct ri::varchar, ',' order by ri::varchar) filter (where nm = 'Assembly'), '') final_assembly from s group by 1, 2")
def document_designs(spark, sf):
    d = _document(spark, sf).designs.select("design_key", F.explode("assemblies").alias("a"))
    return d.select("design_key", "a.assembly", F.array_join(F.transform("a.summary", lambda x: x["reaction_index"]), ",").alias("summary"), F.array_join(F.sort_array(F.transform("a.final_assembly_reaction", lambda x: x.cast("string"))), ",").alias("final_assembly"))


@query(f"""with {_NUMBERED}, made as (select k3 from rn group by 1 having count(*) > 1), fin as (select dk, ai, count(distinct sha1(k1 || k2 || k3)) filter (where nm = 'Assembly') n from k group by 1, 2)
select 'molecule made by several reactions' as rule, mi::varchar as key from made join mn on mk = k3 union all select 'design has no or several final assemblies', dk from fin where n <> 1""")
def document_problems(spark, sf):
    """What validation finds in a document made of order lines, which are no plan: several makers of a molecule, and several ends or none."""
    return _document(spark, sf).problems()


@query("select doc_id::varchar as key, case doc_id % 4 when 0 then '3..9' when 1 then 'join(2..5,11..20)' when 2 then 'complement(join(2..5,11..20))' else 'join(' || (n - 4) || '..' || n || ',1..6)' end as location, n::int as length, doc_id % 4 = 3 is_circular from (select doc_id, len(" + _DNA + ") n from documents) where n > 30")
def genbank_locations(spark, sf):
    """Features with several parts, on both strands and over the origin, written to files and read again."""
    path = f"{shared.folder(spark)}/genbank-{uuid.uuid4().hex}"
    d = bases(read(spark, sf, "documents"), "doc_id").filter("length(bases) > 30").withColumn("kind", c("key").cast("long") % 4)
    n = F.length("bases")
    part = lambda a, b, s: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(s).alias("strand"))
    two = lambda s: F.array(part(F.lit(1), F.lit(5), s), part(F.lit(10), F.lit(20), s))
    parts = F.when(c("kind") == 0, F.array(part(F.lit(2), F.lit(9), 1))).when(c("kind") == 1, two(1)).when(c("kind") == 2, two(-1)).otherwise(F.array(part(n - 5, n, 1), part(F.lit(0), F.lit(6), 1)))
    strand = F.when(c("kind") == 2, -1).otherwise(1)
    one = F.struct(parts[0]["start"].alias("start"), F.element_at(parts, -1)["end"].alias("end"), strand.alias("strand"), F.lit("part").alias("name"), F.lit("gene").alias("type"), parts.alias("parts"))
    files.write_genbank(d.select("key", c("key").alias("name"), "bases", n.alias("length"), (c("kind") == 3).alias("is_circular"), F.array(one).alias("features")), path)
    r = files.read_genbank(spark, path, parts=True).select("key", "length", "is_circular", F.explode("features").alias("f"))
    place = F.array_join(F.transform("f.parts", lambda p: F.concat_ws("..", (p["start"] + 1).cast("string"), p["end"].cast("string"))), ",")
    text = F.when(F.size("f.parts") > 1, F.concat(F.lit("join("), place, F.lit(")"))).otherwise(place)
    return r.select("key", F.when(c("f.strand") == -1, F.concat(F.lit("complement("), text, F.lit(")"))).otherwise(text).alias("location"), "length", "is_circular")


@query(f"select doc_id::varchar as key, doc_id || ' promoter->gene >x' as name, md5({_DNA}) bases_md5 from documents where len({_DNA}) > 0")
def fasta_headers_with_marks(spark, sf):
    path = f"{shared.folder(spark)}/fasta-{uuid.uuid4().hex}"
    files.write_fasta(bases(read(spark, sf, "documents"), "doc_id").filter("bases <> ''").withColumn("name", F.concat("key", F.lit(" promoter->gene >x"))), path)
    return files.read_fasta(spark, path).select("key", "name", F.md5(c("bases").cast("binary")).alias("bases_md5"))


@query(f"with {_REGION}, {_UNWRAPPED}, q as (select *, (u - query_key * 37 % 1000 + 1000) % 1000 p, case when f = 'A' then -1 else 1 end st from u), i as (select *, p - row_number() over (partition by query_key, l_linenumber, l_partkey, l_suppkey order by p) g from q where p < 400), r as (select query_key, l_linenumber, l_partkey, l_suppkey, st, n, min(p) lo, max(p) + 1 hi, count(*) k from i group by query_key, l_linenumber, l_partkey, l_suppkey, st, n, g) select query_key, l_linenumber || '|' || l_partkey || '|' || l_suppkey as name, st strand, string_agg(lo || '-' || hi, ',' order by lo) parts, sum(k) = any_value(n) whole from r group by query_key, l_linenumber, l_partkey, l_suppkey, st")
def feature_slices(spark, sf):
    """Order lines as features of circles of 1000 bases, of which each order's slice of 400 keeps what lies in it."""
    r = _regions(spark, sf)
    one = features.annotation(F.concat_ws("|", *_IDS), c("a"), c("n"), c("length"))
    f = F.struct(one["start"].alias("start"), one["end"].alias("end"), F.when(c("l_returnflag") == "A", -1).otherwise(1).alias("strand"), one["name"].alias("name"), one["type"].alias("type"), one["parts"].alias("parts"))
    by = r.groupBy("query_key", "length").agg(F.collect_list(f.cast(features.LOCATED[6:-1])).alias("features"))
    a = (c("query_key") * 37 % 1000).cast("int")
    some, whole = (features.sliced(c("features"), a, F.lit(400), c("length"), partial) for partial in (True, False))
    d = by.select("query_key", F.explode(some).alias("f"), F.transform(whole, lambda x: x["name"]).alias("_w"))
    return d.select("query_key", "f.name", "f.strand", F.array_join(F.transform("f.parts", lambda p: F.concat_ws("-", p["start"].cast("string"), p["end"].cast("string"))), ",").alias("parts"), F.array_contains("_w", c("f.name")).alias("whole"))


@query(f"with f as (select item_id::varchar as name, {_DNA}[11:60] x from benchmark where len({_DNA}) >= 60), ff as (select name, 1 st, x from f union all select name, -1, reverse(translate(x, 'ACGT', 'TGCA')) from f), d as (select doc_id::varchar as key, {_DNA} s from documents), w as (select key, i, s[i:i + 49] x from d, lateral (select unnest(range(1, len(s) - 48)) i) where len(s) >= 50) select key, name, st strand, cast(i - 1 as int) as start, cast(i + 49 as int) as end from w join ff using (x)")
def features_found_again(spark, sf):
    """A feature of 50 bases in every passage, found wherever a document holds it."""
    b = bases(read(spark, sf, "benchmark"), "item_id").filter("length(bases) >= 60")
    b = b.select("key", "bases", F.array(features.annotation(c("key"), F.lit(10), F.lit(50), F.length("bases"))).alias("features"))
    d = bases(read(spark, sf, "documents"), "doc_id").withColumn("is_circular", F.lit(False))
    return features.restored(d, b).select("key", F.explode("features").alias("f")).select("key", "f.name", "f.strand", "f.start", "f.end")


_TOKENS = "n as (select o_custkey g, l_orderkey k, chr(65 + cast(l_suppkey % 7 as int)) x, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) pos from lineitem join orders on l_orderkey = o_orderkey), one as (select o_custkey g, min(o_orderkey) k1, max(o_orderkey) k2 from orders group by 1 having count(*) > 1), t as (select k, string_agg(x, '' order by pos) s from n group by 1), p as (select g, coalesce(a.s, '') a, coalesce(b.s, '') b from one left join t a on a.k = k1 left join t b on b.k = k2)"


@query(f"with {_TOKENS} select g, levenshtein(a, b)::int as line, list_min(list_transform(range(1, greatest(len(a), 1) + 1), lambda i: levenshtein(a[i:] || a[1:i - 1], b)))::int circle from p")
def token_edit_distance(spark, sf):
    """Edits between a customer's first and last order as sequences and as circles of suppliers' kinds."""
    o = read(spark, sf, "orders")
    one = o.groupBy(c("o_custkey").alias("g")).agg(F.min("o_orderkey").alias("k1"), F.max("o_orderkey").alias("k2"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    l = read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))).alias("x"))
    l = l.select("k", F.transform("x", lambda r: r["l_suppkey"] % 7).alias("x"))
    p = one.join(l.select(c("k").alias("k1"), c("x").alias("a")), "k1", "left").join(l.select(c("k").alias("k2"), c("x").alias("b")), "k2", "left")
    return p.select("g", paths.token_edits(c("a"), c("b"), cyclic=False).alias("line"), paths.token_edits(c("a"), c("b")).alias("circle"))


_STACK = ", ".join(f"('{k}', {h}::double, {s}::double)" for k, (h, s) in thermo.ALL_STACKS.items())
_END = "case when {0} in ('A', 'T') then {1} else {2} end"


@query(f"""with st(k, h, s) as (values {_STACK}), b as (select item_id::varchar as key, {_DNA}[:24] s from benchmark), w as (select key, b.s, sum(st.h) h, sum(st.s) e from b, lateral (select unnest(range(1, len(b.s))) i) join st on st.k = b.s[i:i + 1] group by 1, 2),
x as (select key, len(s) n, h + {_END.format("s[1]", thermo.END_AT[0], thermo.END_GC[0])} + {_END.format("s[-1]", thermo.END_AT[0], thermo.END_GC[0])} h, e + {_END.format("s[1]", thermo.END_AT[1], thermo.END_GC[1])} + {_END.format("s[-1]", thermo.END_AT[1], thermo.END_GC[1])} e from w)
select key, round(1000 * h / (e + 0.368 * (n - 1) * ln(0.05) + 1.987 * ln(12.5e-9)) - 273.15, 6) tm from x""")
def nearest_neighbour_melting(spark, sf):
    """Melting temperature of every passage's first 24 bases."""
    b = bases(read(spark, sf, "benchmark"), "item_id").filter("length(bases) >= 2")
    return b.select("key", F.round(thermo.melting(F.substring("bases", 1, 24)), 6).alias("tm"))


@query()
def primer_pairs(spark, sf):
    """The primer pair that amplifies each passage; tested by enumeration of all pairs."""
    b = bases(read(spark, sf, "benchmark"), "item_id")
    return b.select("key", thermo.primer_pair(c("bases")).alias("p")).select("key", "p.*")
