"""More queries over the driver's tables: bench operations, sources, tidy frames, libraries, single steps of a plan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixar import constants as K
from helixar.functions import sequences as S
from helixar.functions import shared
from helixar.operators import cost, expand, frame, lab, library, output, paths, score
from helixar.plans.queries import _CHAIN, _DNA, _KEYS, _MOL, _RX, _SPANS, _SYNTH, _chain, _keys, _reactions, all_links, bases, c, query, read, spans
from helixar.sources import sequences as files

_KEYED = f"d as (select doc_id::varchar as key, doc_id % 2 = 0 is_circular, {_DNA} s from documents)"


def _keyed(spark, sf):
    d = read(spark, sf, "documents")
    return bases(d, "doc_id").withColumn("is_circular", c("key").cast("long") % 2 == 0)


@query(f"""with {_KEYED}, x as (select *, case when is_circular then s || s[1:5] else s end t from d),
h as (select key, is_circular, len(s) n, list_filter(range(1, len(t) + 1), lambda i: substring(t, i, 6) = 'GACGAC') hits from x),
k as (select *, list_sort(list_distinct(case when is_circular then list_transform(hits, lambda i: i % n) else list_concat([0], hits) end)) cuts from h),
p as (select key, is_circular, n, unnest(case when len(cuts) = 0 then [null] else cuts end) as start, generate_subscripts(case when len(cuts) = 0 then [null] else cuts end, 1) - 1 piece, cuts from k)
select key, cast(piece as int) piece, cast(coalesce(start, 0) as int) as start, cast(case when start is null then n when piece + 1 < len(cuts) then cuts[piece + 2] - start when is_circular then cuts[1] + n - start else n - start end as int) n from p
where (case when start is null then n when piece + 1 < len(cuts) then cuts[piece + 2] - start when is_circular then cuts[1] + n - start else n - start end) > 0""")
def restriction_digest(spark, sf):
    d = lab.digest(_keyed(spark, sf), "GACGAC", 1)
    return d.select("key", *[c(x).cast("int").alias(x) for x in ("piece", "start", "n")])


_ENDS = f"""b as (select item_id, {_DNA} s from benchmark), pr as (select item_id || '-f' primer_key, 'ACGTACGT' || s[1:24] pr from b where len(s) >= 60 union all select item_id || '-r', 'TTTTAAAA' || reverse(translate(s[-24:], 'ACGT', 'TGCA')) from b where len(s) >= 60),
t as (select doc_id::varchar as key, {_DNA} s from documents), tt as (select key, 1 strand, s from t where len(s) >= 14 union all select key, -1, reverse(translate(s, 'ACGT', 'TGCA')) from t where len(s) >= 14),
sd as (select key, strand, s, unnest(range(0, len(s) - 13)) i from tt), hit as (select primer_key, pr, key, strand, s, i from pr join sd on s[i + 1:i + 14] = right(pr, 14)),
an as (select *, 14 + len(list_filter(range(1, len(pr) - 13), lambda k: i - k >= 0 and s[i - k + 1:i] = pr[len(pr) - 14 - k + 1:len(pr) - 14])) n from hit)"""


def _primers(spark, sf):
    b = bases(read(spark, sf, "benchmark"), "item_id").filter("length(bases) >= 60")
    f = b.select(F.concat("key", F.lit("-f")).alias("primer_key"), F.expr("concat('ACGTACGT', substring(bases, 1, 24))").alias("primer"))
    r = b.select(F.concat("key", F.lit("-r")).alias("primer_key"), F.concat(F.lit("TTTTAAAA"), S.reverse_complement(F.expr("right(bases, 24)"))).alias("primer"))
    return f.unionByName(r)


@query(f"with {_ENDS} select primer_key, key, strand, cast(case when strand = 1 then i + 14 else len(s) - i - 14 end as int) as end, cast(n as int) n, right(pr, n) annealed, left(pr, len(pr) - n) overhang from an")
def primer_annealing(spark, sf):
    return lab.anneal(_primers(spark, sf), bases(read(spark, sf, "documents"), "doc_id"))


@query(f"""with {_ENDS}, f as (select key, i + 14 - n i, left(pr, len(pr) - n) head from an where strand = 1), r as (select an.key, len(s) - i - 14 + n j, left(pr, len(pr) - n) tail from an where strand = -1)
select distinct md5(head || t.s[f.i + 1:r.j] || reverse(translate(tail, 'ACGT', 'TGCA'))) product from f join r using (key) join t using (key) where r.j > f.i""")
def pcr_products(spark, sf):
    """In-silico PCR of the documents with primers for both ends of every passage."""
    t = bases(read(spark, sf, "documents"), "doc_id")
    return lab.pcr(lab.anneal(_primers(spark, sf), t), t).select(F.md5(c("product").cast("binary")).alias("product")).distinct()


@query(f"""with b as (select item_id, {_DNA} s from benchmark), pc as (select item_id || ':' || i as key, s[greatest(i * 100 - 19, 1):i * 100 + 100] s from b, lateral (select unnest(range(0, len(s) // 100)) i)),
both_s as (select key, 1 strand, s from pc union all select key, -1, reverse(translate(s, 'ACGT', 'TGCA')) from pc),
e as (select key, strand, right(s, n) x from both_s, lateral (select unnest(range(15, len(s) + 1)) n)), st as (select key, strand, left(s, n) x from both_s, lateral (select unnest(range(15, len(s) + 1)) n))
select e.key "left", e.strand left_strand, st.key "right", st.strand right_strand, cast(max(len(e.x)) as int) n from e join st using (x) where e.key <> st.key group by 1, 2, 3, 4""")
def junction_overlaps(spark, sf):
    b = bases(read(spark, sf, "benchmark"), "item_id").filter("length(bases) >= 100").withColumn("i", F.explode(F.expr("sequence(0, length(bases) div 100 - 1)")))
    p = b.select(F.concat_ws(":", "key", "i").alias("key"), F.expr("substring(bases, greatest(i * 100 - 19, 1), i * 100 + 100 - greatest(i * 100 - 19, 1) + 1)").alias("bases"))
    return lab.junctions(p).select("left", "left_strand", "right", "right_strand", c("n").cast("int").alias("n"))


_TM = "case when len(p) < 14 then 2.0 * (len(p) - g) + 4.0 * g else 64.9 + 41.0 * (g - 16.4) / len(p) end"


@query(f"with b as (select item_id::varchar as key, {_DNA} s from benchmark), q as (select key, s, left(s, n) p, n, len(left(s, n)) - len(replace(replace(left(s, n), 'G', ''), 'C', '')) g from b, range(12, 61) t(n)), f as (select key, arg_min(p, n) p from q where {_TM} >= 60 and len(p) >= 12 group by 1), w as (select b.key, coalesce(f.p, left(b.s, 60)) p from b left join f using (key)), x as (select *, len(p) - len(replace(replace(p, 'G', ''), 'C', '')) g from w) select key, p primer, round({_TM}, 6) tm from x")
def designed_primers(spark, sf):
    b = bases(read(spark, sf, "benchmark"), "item_id").select("key", S.design_primer(c("bases")).alias("primer"))
    return b.select("key", "primer", F.round(S.primer_tm(c("primer")), 6).alias("tm"))


@query(f"with {_KEYED} select key, md5(reverse(translate(s, 'ACGT', 'TGCA'))) rc_md5, sha1(s) content_sha1, len(s) > 10 is_dna, round(case when len(s) > 0 then abs(100.0 * len(replace(replace(s, 'A', ''), 'T', '')) / len(s) - 50) * 17 / 25 else 0 end, 6) gc_cost from d")
def sequence_scalars(spark, sf):
    d = _keyed(spark, sf)
    return d.select("key", F.md5(S.reverse_complement(c("bases")).cast("binary")).alias("rc_md5"), S.content_key(c("bases")).alias("content_sha1"), S.dna_like(c("bases")).alias("is_dna"), F.round(F.coalesce(S.gc_cost(c("bases")), F.lit(0.0)), 6).alias("gc_cost"))


@query("with recursive e as (select distinct o_custkey a, l_partkey b from orders join lineitem on o_orderkey = l_orderkey where l_quantity > 49 and l_discount > 0.08), g as (select 'c' || a || ':0:100' x, 'p' || b || ':' || a % 2 || ':100' y from e), u as (select x, y from g union select y, x from g), r(x, c) as (select distinct x, x from u union select u.y, r.c from r join u on r.x = u.x), m as (select x, min(c) c from r group by 1), k as (select x, c, split_part(x, ':', 1) q, cast(split_part(x, ':', 2) as int) a, cast(split_part(x, ':', 3) as int) b from m), bad as (select distinct c from k group by c, q having count(*) > 1) select q query_key, a, b, c component, count(*) over (partition by c) n_clusters from k where c not in (select c from bad)")
def shared_clusters(spark, sf):
    e = read(spark, sf, "orders").join(read(spark, sf, "lineitem").filter("l_quantity > 49 and l_discount > 0.08"), c("o_orderkey") == c("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    return library.clusters(_shared_regions(e))


@query()
def shared_clusters_all(spark, sf):
    """shared_clusters over all order lines."""
    return library.clusters(_shared_regions(all_links(spark, sf)))


def _shared_regions(e):
    return e.select(F.concat(F.lit("c"), "o_custkey").alias("query_key"), F.lit(0).alias("a"), F.lit(100).alias("b"), F.concat(F.lit("p"), "l_partkey").alias("subject_key"), (c("o_custkey") % 2).cast("int").alias("sa"), F.lit(100).alias("sb"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when l_returnflag = 'A' then l_extendedprice / l_linenumber / 2 else l_extendedprice end, 6) material, round(case when l_returnflag = 'A' then l_extendedprice / l_linenumber / 2 else l_extendedprice end / (1 - l_discount), 6) as cost from lineitem")
def shared_discount(spark, sf):
    l = read(spark, sf, "lineitem")
    e = l.withColumns({"mtype": F.when(c("l_returnflag") == "A", K.SHARED).otherwise(K.PCR), "material": c("l_extendedprice"), "n_clusters": c("l_linenumber"), "efficiency": 1 - c("l_discount")})
    return library.discount(e).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("material", 6).alias("material"), F.round("cost", 6).alias("cost"))


@query(f"""with {_SPANS}, p as (select distinct query_key, l_returnflag f, a, b, n from spans), x as (select f.query_key, f.a, r.b, f.b fb, f.n fn from p f join p r on f.query_key = r.query_key and f.f = 'A' and r.f = 'R' and (r.a - f.a + 1000) % 1000 < f.n - 13)
select query_key, a, b, (b - a + 999) % 1000 + 1 n, count(*) n_pairs from x where not (b < 1000 and (b - a + 1000) % 1000 < fn and b <> fb) group by 1, 2, 3, 4""")
def extension_products(spark, sf):
    u = spans(spark, sf).filter("l_returnflag <> 'N'").select("query_key", "l_returnflag", "a", "b", "n", "length").distinct()
    p = u.withColumns({"pid": F.concat_ws("|", "l_returnflag", "a", "b"), "direction": F.when(c("l_returnflag") == "A", 1).otherwise(-1)})
    return expand.extension_products(p).groupBy("query_key", "a", "b", "n").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, cast(l_partkey % 1000 as int) sa, cast(l_partkey % 1000 as int) + cast(l_quantity as int) * 10 sb, cast(l_linenumber as int) i, cast(l_quantity as int) n from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linestatus = 'O' then sa + i else sb - i - n end sa, case when l_linestatus = 'O' then sa + i + n else sb - i end sb from s")
def sub_alignments(spark, sf):
    l = read(spark, sf, "lineitem")
    sa, n = (c("l_partkey") % 1000).cast("int"), c("l_quantity").cast("int")
    s = expand.sub_alignment(c("l_linenumber").cast("int"), n, sa, sa + n * 10, F.when(c("l_linestatus") == "O", 1).otherwise(-1))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.sa", "s.sb")


@query(f"""with {_SYNTH}, bo as (select coalesce(p.l, s.l) l, coalesce(p.r, s.r) r, coalesce(p.span, s.span) span, least(p.cost, s.cost) as cost, coalesce(p.cost <= s.cost, p.cost is not null) primers, w.le left_ext, w.re right_ext, s.k.size size, s.k.ls lshift from primer p full join syn s on p.l = s.l and p.r = s.r and p.span = s.span),
{_KEYS.format(n=2549, low=-300)}
select o_orderkey, l, r, span, round(bo.cost, 6) as cost, case when primers then left_ext end::int left_ext, case when primers then right_ext end::int right_ext, case when not primers then size end::int size, case when not primers then lshift end::int lshift from q left join bo using (l, r, span)""")
def span_cost_table(spark, sf):
    """Orders as junctions: the cheaper model's price, with the primers' extensions or the gene's size and place."""
    t = cost.span_cost(spark).filter(c("cost") < float("inf"))
    t = _keys(spark, sf, 2549, -300).join(F.broadcast(t), ["l", "r", "span"], "left")
    return t.select("o_orderkey", "l", "r", "span", F.round("cost", 6).alias("cost"), *[c(x).cast("int").alias(x) for x in ("left_ext", "right_ext", "size", "lshift")])


@query("select l_orderkey query_key, l_linenumber as rank, round(sum(l_extendedprice), 4) material, round(product(1 - l_discount), 8) efficiency, round(sum(l_extendedprice) / product(1 - l_discount), 4) as cost, count(*) n_edges, max(l_quantity) max_complexity from lineitem group by 1, 2")
def design_status(spark, sf):
    e = read(spark, sf, "lineitem").select(c("l_orderkey").alias("query_key"), c("l_linenumber").alias("rank"), c("l_extendedprice").alias("material"), (1 - c("l_discount")).alias("efficiency"), "l_quantity")
    s = output.status(e, "l_quantity")
    return s.select("query_key", "rank", F.round("material", 4).alias("material"), F.round("efficiency", 8).alias("efficiency"), F.round("cost", 4).alias("cost"), "n_edges", "max_complexity")


@query(f"with {_RX}, {_MOL}, u as (select distinct mk, dk, ai from m) select mk molecule_key, md5(string_agg(dk || '/' || ai, ',' order by dk, ai)) used_in from u group by 1")
def molecule_usage(spark, sf):
    molecules, _ = output.plan_dag(_reactions(spark, sf))
    used = F.array_join(F.transform("used_in", lambda u: F.concat_ws("/", u["design_key"], u["assembly_id"].cast("string"))), ",")
    return molecules.select("molecule_key", F.md5(used.cast("binary")).alias("used_in"))


@query(f"with {_SPANS}, al as (select distinct query_key, l_suppkey sk, a, b from spans where l_returnflag = 'A'), e as (select query_key, l_linenumber as rank, l_partkey pos, l_suppkey, l_extendedprice, a, b, n, l_returnflag f from spans), j as (select query_key, a, b, string_agg(sk::varchar, ',' order by sk::varchar) subjects from al group by all) select e.query_key, e.rank, e.pos, e.a query_start, e.b query_end, case when f <> 'N' then subjects end subjects, e.n span, case when f <> 'N' then 'internal' else 'external' end internal_or_external, e.l_extendedprice material from e left join j using (query_key, a, b)")
def summary_rows(spark, sf):
    s = spans(spark, sf)
    e = s.select("query_key", c("l_linenumber").alias("rank"), c("l_partkey").alias("pos"), F.struct(c("a").alias("index")).alias("src"), F.struct((c("a") + c("n")).alias("index")).alias("dst"), "length", c("n").alias("span"), F.when(c("l_returnflag") != "N", "internal").otherwise("external").alias("kind"), F.lit(K.PCR).alias("mtype"), c("l_extendedprice").alias("material"), F.lit(1.0).alias("efficiency"), c("l_extendedprice").alias("cost"))
    al = s.filter("l_returnflag = 'A'").select("query_key", c("l_suppkey").cast("string").alias("subject_key"), "a", "b", F.lit(0).alias("sa"), F.lit(1).alias("sb")).distinct()
    d = output.summary_rows(e, al)
    return d.select("query_key", "rank", "pos", "query_start", "query_end", F.array_join("subject_keys", ",").alias("subjects"), "span", "internal_or_external", "material")


@query(f"with {_CHAIN} select k query_key, i + 1 node, round(sum(m) over w, 4) material, round(sum(m) over w / exp(sum(ln(e)) over w), 3) as cost from ch window w as (partition by k order by i)")
def shortest_from_source(spark, sf):
    """Single-source paths with accumulators, from the first node of each order's chain."""
    e = _chain(spark, sf)
    d = paths.distances_from(e, e.groupBy("query_key").agg(F.min("src").alias("source")))
    return d.filter("node > 1").select("query_key", c("node").alias("node"), F.round("material", 4).alias("material"), F.round("cost", 3).alias("cost"))


@query(f"with {_CHAIN}, r as (select k, i, case when i >= 3 then avg(m) over (partition by k order by i rows 2 preceding) end a from ch) select k query_key, i src, round(a, 4) mean from r")
def rolling_mean(spark, sf):
    return score.rolling_mean(_chain(spark, sf), ["query_key"], ["src"], "material", 3).select("query_key", "src", F.round("mean", 4).alias("mean"))


@query("with a as (select l_orderkey k, list(l_suppkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) x from lineitem group by 1) select k query_key, array_to_string(case when len(x) >= 3 then list_concat([x[3], x[1], x[2]], x[4:]) else x end, ',') items from a")
def prioritized(spark, sf):
    l = read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("query_key")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("x"))
    return l.select("query_key", F.array_join(frame.prioritize(F.transform("x", lambda r: r["l_suppkey"]), F.array(F.lit(2), F.lit(0))), ",").alias("items"))


_CELLS = "f as (select p_brand k, p_size i, sum(p_retailprice) v, count(*) n from part group by 1, 2), g as (select p_brand k, p_size i, min(p_retailprice) v, max(p_partkey) w from part where p_size > 10 group by 1, 2)"


def _cells(spark, sf):
    p = read(spark, sf, "part").select(c("p_brand").alias("k"), c("p_size").alias("i"), "p_retailprice", "p_partkey")
    f = p.groupBy("k", "i").agg(F.sum("p_retailprice").alias("v"), F.count(F.lit(1)).alias("n"))
    g = p.filter("i > 10").groupBy("k", "i").agg(F.min("p_retailprice").alias("v"), F.max("p_partkey").alias("w"))
    return f, g


@query(f"with {_CELLS} select k, i, n, g.v, g.w from f join g using (k, i)")
def frame_merge(spark, sf):
    return frame.merge(*_cells(spark, sf), ["k", "i"]).select("k", "i", "n", "v", "w")


@query(f"with {_CELLS} select k, i, round(f.v - g.v, 4) v from f join g using (k, i)")
def frame_arithmetic(spark, sf):
    f, g = _cells(spark, sf)
    return frame.apply(frame.arithmetic(f, g, ["k", "i"], lambda x, y: x - y), ["k", "i"], lambda x: F.round(x, 4))


@query(f"with {_CELLS} select 0 part, k, i, round(v, 4) col_v, n col_n, null::bigint col_w from f union all select 1, k, i, round(v, 4), null, w from g")
def frame_concat(spark, sf):
    d = frame.prefix(frame.concat(list(_cells(spark, sf)), "part"), ["part", "k", "i"], "col_")
    return d.select("part", "k", "i", F.round("col_v", 4).alias("col_v"), "col_n", "col_w")


@query("select p_brand, p_size, count(*) n from part group by 1, 2 having count(*) > 1")
def duplicate_values(spark, sf):
    return frame.duplicates(read(spark, sf, "part"), ["p_brand", "p_size"])


@query("select e_label as label, e_type as type, user_id, arg_max(event_id, event_id) last_id from (select event_type e_label, event_type e_type, * from events) group by 1, 2, 3")
def feature_dedup(spark, sf):
    e = read(spark, sf, "events").select(c("event_type").alias("label"), c("event_type").alias("type"), "user_id", "event_id")
    return frame.last_of(e, ["label", "type", "user_id"], ["event_id"], {"event_id": "last_id"})


@query(f"select doc_id::varchar as key, md5({_DNA}) bases_md5, cast(len({_DNA}) as int) as length from documents where len({_DNA}) > 0")
def fasta_round_trip(spark, sf):
    path = f"{shared.folder(spark)}/fasta-{uuid.uuid4().hex}"
    files.write_fasta(bases(read(spark, sf, "documents"), "doc_id").filter("bases <> ''").withColumn("name", c("key")), path)
    r = files.read_fasta(spark, path)
    return r.select("key", F.md5(c("bases").cast("binary")).alias("bases_md5"), "length")


@query(f"select doc_id::varchar as key, md5(lower({_DNA})) bases_md5, cast(len({_DNA}) as int) as length, doc_id % 2 = 0 is_circular, doc_id % 7 + 0 feature_start from documents where len({_DNA}) > 10")
def genbank_round_trip(spark, sf):
    path = f"{shared.folder(spark)}/genbank-{uuid.uuid4().hex}"
    d = _keyed(spark, sf).filter("length(bases) > 10")
    one = F.struct((c("key").cast("long") % 7).cast("int").alias("start"), F.lit(9).alias("end"), F.lit(-1).alias("strand"), F.lit("part").alias("name"), F.lit("gene").alias("type"))
    files.write_genbank(d.select("key", c("key").alias("name"), "bases", F.length("bases").alias("length"), "is_circular", F.array(one).alias("features")), path)
    r = files.read_genbank(spark, path)
    return r.select("key", F.md5(F.lower("bases").cast("binary")).alias("bases_md5"), "length", "is_circular", F.element_at("features", 1)["start"].cast("long").alias("feature_start"))


@query()
def tiled_complexity(spark, sf):
    """Complexity of windows of every size around the documents taken as circles."""
    d = score.tiled_complexity(bases(read(spark, sf, "documents"), "doc_id"))
    return d.select("key", "size", "start", F.round("complexity", 6).alias("complexity"))


@query()
def template_misprimings(spark, sf):
    """The template with the fewest misprimings for every region where a passage matches a document."""
    from helixar.operators import match

    goals = bases(read(spark, sf, "documents"), "doc_id").withColumn("is_circular", F.lit(False))
    items = bases(read(spark, sf, "benchmark"), "item_id")
    al = match.to_regions(match.exact_matches(goals, items, 100, sieved=True), K.PCR)
    return score.template_misprimings(al.withColumn("mtype", F.lit(K.PCR)), al, items)
