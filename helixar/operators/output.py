"""Plans as rows and documents: summary and reaction rows, the plan DAG with content keys, filters, JSON, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixar import constants as K
from helixar.functions import sequences as S
from helixar.functions import thermo
from helixar.operators import frame, paths


def summary_rows(edges: DataFrame, alignments: DataFrame) -> DataFrame:
    """A row per assembly edge, with the subjects of the alignments that lie exactly there."""
    c = F.col
    start, stop = F.pmod(c("src.index"), c("length")), F.pmod(c("dst.index") - 1, c("length")) + 1
    e = edges.withColumns({"query_start": start, "query_end": stop})
    a = alignments.groupBy("query_key", c("a").alias("query_start"), c("b").alias("query_end")).agg(F.sort_array(F.collect_list(F.struct("subject_key", "sa", "sb"))).alias("subjects"))
    out = e.join(a, ["query_key", "query_start", "query_end"], "left")
    pick = lambda f: F.when(c("kind") == "internal", F.transform("subjects", lambda x: x[f]))
    return out.select("query_key", "rank", "pos", "query_start", "query_end", pick("subject_key").alias("subject_keys"), pick("sa").alias("subject_starts"), pick("sb").alias("subject_ends"), "cost", "material", "span", c("mtype").alias("type"), c("kind").alias("internal_or_external"), "efficiency")


def reaction_rows(reactions: DataFrame) -> DataFrame:
    """A row per molecule of reactions(design_key, assembly_id, reaction_id, name, inputs, outputs), whose inputs and
    outputs are arrays of (mtype, seq)."""
    sides = F.array(F.struct(F.lit("INPUT").alias("role"), F.col("inputs").alias("m")), F.struct(F.lit("OUTPUT").alias("role"), F.col("outputs").alias("m")))
    d = reactions.select("design_key", "assembly_id", "reaction_id", F.col("name").alias("reaction_name"), F.explode(sides).alias("s"))
    d = d.select("design_key", "assembly_id", "reaction_id", "reaction_name", "s.role", F.explode("s.m").alias("x"))
    return d.select("design_key", "assembly_id", "reaction_id", "reaction_name", "role", F.col("x.mtype").alias("type"), F.col("x.seq").alias("sequence"), F.length("x.seq").alias("length"))


def molecule_key(mtype, seq):
    return F.concat_ws("|", F.lit("molecule"), mtype, S.content_key(seq))


def with_keys(reactions: DataFrame) -> DataFrame:
    """reactions with the content keys of their molecules, in_keys and out_keys, and their own, reaction_key.

    An assembly reaction is a reaction of its own for each assembly rank; others are shared by content.
    """
    keys = lambda side: F.sort_array(F.transform(side, lambda m: molecule_key(m["mtype"], m["seq"])))
    r = reactions.withColumns({"in_keys": keys("inputs"), "out_keys": keys("outputs")})
    rank = F.when(F.col("name") == "Assembly", F.col("assembly_id").cast("string")).otherwise("")
    return r.withColumn("reaction_key", F.sha1(F.concat_ws("\n", "name", rank, F.array_join("in_keys", ","), F.lit("->"), F.array_join("out_keys", ",")).cast("binary")))


def plan_dag(reactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(molecules, dag reactions): one row per content key with the designs that use it.

    A reaction's key tells its name and molecules, so these are no keys of the groups, and what is not read is not shuffled.
    """
    r = reactions if "reaction_key" in reactions.columns else with_keys(reactions)
    used = F.sort_array(F.collect_set(F.struct("design_key", "assembly_id"))).alias("used_in")
    dag = r.groupBy(F.unhex("reaction_key").alias("_key")).agg(*[F.first(x).alias(x) for x in ("name", "in_keys", "out_keys")], used)
    dag = dag.select(F.lower(F.hex("_key")).alias("reaction_key"), "name", "in_keys", "out_keys", "used_in")
    m = r.select("design_key", "assembly_id", F.explode(F.concat(F.array_distinct("in_keys"), F.array_distinct("out_keys"))).alias("molecule_key"))
    return m.groupBy("molecule_key").agg(used), dag


def extra_producers(dag: DataFrame) -> DataFrame:
    """(molecule_key, reaction_key, nth) of molecules that more than one reaction makes."""
    made = dag.select("reaction_key", F.explode(F.array_distinct("out_keys")).alias("molecule_key"))  # a key has one row
    w = Window.partitionBy("molecule_key").orderBy("reaction_key")
    all_of = Window.partitionBy("molecule_key")
    return made.withColumn("nth", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(all_of)).filter("n > 1").drop("n")


def drop_extra(dag: DataFrame) -> DataFrame:
    """Without the second and later producers of a molecule."""
    return dag.join(extra_producers(dag).filter("nth > 1").select("reaction_key").distinct(), "reaction_key", "left_anti")


def filter_designs(reactions: DataFrame, design_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The molecules and reactions of plan_dag that the designs of design_keys(design_key) use, each with all designs that use it.

    Those designs' own reactions tell which they are, so only these are grouped by content. What uses them besides is looked up among all
    reactions by left joins, which fall away if used_in is not read.
    """
    keyed = lambda df: df if "reaction_key" in df.columns else with_keys(df)
    r, mine = keyed(reactions), keyed(reactions.join(design_keys, "design_key", "left_semi"))  # keys are made of what is left
    used = F.sort_array(F.collect_set(F.struct("design_key", "assembly_id"))).alias("used_in")
    kept = mine.groupBy(F.unhex("reaction_key").alias("_key")).agg(*[F.first(x).alias(x) for x in ("name", "in_keys", "out_keys")])
    dag = kept.join(r.groupBy(F.unhex("reaction_key").alias("_key")).agg(used), "_key", "left")
    there = mine.select(F.explode(F.concat("in_keys", "out_keys")).alias("molecule_key")).distinct()
    return there.join(plan_dag(r)[0], "molecule_key", "left"), dag.select(F.lower(F.hex("_key")).alias("reaction_key"), "name", "in_keys", "out_keys", "used_in")


def status(edges: DataFrame, complexity: str | None = None) -> DataFrame:
    """Per assembly: material, efficiency, cost, edges and the largest complexity, if any."""
    t = paths.total_cost(edges, ["query_key", "rank"])
    if complexity:
        t = t.join(edges.groupBy("query_key", "rank").agg(F.max(complexity).alias("max_complexity")), ["query_key", "rank"])
    return t


def output_json(summary: DataFrame) -> DataFrame:
    """One JSON document per goal: its assemblies by rank, their edges in order."""
    cols = [c for c in summary.columns if c not in ("query_key", "rank")]
    one = summary.groupBy("query_key", "rank").agg(F.sort_array(F.collect_list(F.struct("pos", *[c for c in cols if c != "pos"]))).alias("edges"), F.sum("material").alias("material"))
    doc = one.groupBy("query_key").agg(F.sort_array(F.collect_list(F.struct("rank", "material", "edges"))).alias("assemblies"))
    return doc.select("query_key", F.to_json(F.struct(F.col("query_key").alias("design_key"), "assemblies")).alias("json"))


def sequence_json(sequences: DataFrame) -> DataFrame:
    """Records as JSON: bases, name, isCircular, annotations."""
    return sequences.select("key", F.to_json(F.struct("bases", "name", F.col("is_circular").alias("isCircular"), F.col("features").alias("annotations"))).alias("json"))


def junctions(edges: DataFrame, table: DataFrame) -> DataFrame:
    """Assembly edges with ext_before and ext_after, the bases that the neighbouring junctions add to the piece's ends, and
    size and lshift of the gene that a junction is filled with, if any.

    A junction's left primer extends the piece before it and its right primer the piece after. One that is filled by a gene
    meets it in two junctions, whose primers are looked up at their own spans.
    """
    c = F.col
    t = table.select(c("l").alias("_l"), c("r").alias("_r"), c("span").alias("_at"), "left_ext", "right_ext", "size", "lshift")
    yes = lambda x: c(x).cast("int")

    def ext(df: DataFrame, left, right, span, take: dict[str, str]) -> DataFrame:
        side = F.broadcast(t.select("_l", "_r", "_at", *[c(k).alias(v) for k, v in take.items()]))
        return df.join(side, (left == c("_l")) & (right == c("_r")) & (span == c("_at")), "left").drop("_l", "_r", "_at")

    outer = c("kind") == "external"
    e = ext(edges, F.when(outer, yes("src.expandable")), yes("dst.expandable"), c("span"), {"left_ext": "left_ext", "right_ext": "right_ext", "size": "size", "lshift": "lshift"})
    e = ext(e, F.when(outer, yes("src.expandable")), F.lit(0), c("lshift"), {"left_ext": "gene_left"})
    e = ext(e, F.when(outer, F.lit(0)), yes("dst.expandable"), c("span") - c("size") - c("lshift"), {"right_ext": "gene_right"})
    left, right = F.coalesce("left_ext", "gene_left", F.lit(0)).cast("int"), F.coalesce("right_ext", "gene_right", F.lit(0)).cast("int")
    e = e.withColumns({"_left": left, "_right": right})
    w = Window.partitionBy("query_key", "rank").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.coalesce(F.lag("_right").over(w), F.last("_right").over(whole)), F.coalesce(F.lead("_left").over(w), F.first("_left").over(whole))
    return e.withColumns({"ext_before": before, "ext_after": after}).drop("left_ext", "right_ext", "gene_left", "gene_right", "_left", "_right")


def molecule(mtype, seq, key=None, a=None, b=None, length=None):
    """A molecule of a reaction: its type and bases, the record it comes from, and its region on the goal."""
    none, where = F.lit(None).cast("string"), F.lit(None).cast("struct<a:int,b:int,context_length:int>")
    if a is not None:
        where = F.struct(F.pmod(a, length).cast("int").alias("a"), (F.pmod(b - 1, length) + 1).cast("int").alias("b"), length.cast("int").alias("context_length"))
    return F.struct((F.lit(mtype) if isinstance(mtype, str) else mtype).alias("mtype"), seq.alias("seq"), (none if key is None else key).alias("key"), where.alias("region"))


_NO_INPUTS = "array<struct<mtype:string,seq:string,key:string,region:struct<a:int,b:int,context_length:int>>>"


def reactions_of(edges: DataFrame, goals: DataFrame, table: DataFrame, alignments: DataFrame, stock: DataFrame, primed: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
    """Reactions of assembly edges: PCR or direct use of internal pieces, synthesis of genes, and the assembly itself.

    A PCR product reaches over both junctions by their extensions; a new primer is that overhang and the bases that anneal
    to the product's end, chosen with its partner (functions.thermo; by the GC rule where bases are unknown), a primer of the inventory is taken as it is, without
    overhang. Its template is the record of alignments(query_key, atype, a, n, subject_key) that covers the product, the
    least key of several, unless best(query_key, mtype, a, b, template) names the one that the product was priced with; bases come from stock(key, bases); two overlapping primers that extend each other have none. primed: alignments of inventory primers with their `bases`.
    A junction that its primers close alone has no reaction.
    """
    c = F.col
    types = F.broadcast(edges.sparkSession.createDataFrame(K.MOLECULE_TYPES, K.MOLECULE_SCHEMA).select(c("name").alias("mtype"), c("l").alias("new_left"), c("r").alias("new_right")))
    e = junctions(edges, table).join(goals.select(c("key").alias("query_key"), F.upper("bases").alias("_s")), "query_key").join(types, "mtype", "left")
    is_extension, is_fragment = c("mtype").startswith("PRIMER_EXTENSION"), c("mtype") == K.FRAGMENT
    is_pcr = c("mtype").startswith("PCR_PRODUCT") | is_extension
    gene = (c("kind") == "external") & c("size").isNotNull()
    e = e.filter(((c("kind") == "internal") & (c("span") > 0)) | gene)
    start = F.pmod(c("src.index"), c("length"))
    e = e.withColumns({"_a": F.when(gene, F.pmod(start + c("lshift"), c("length"))).otherwise(start).cast("int"), "_n": F.when(gene, c("size")).otherwise(c("span")).cast("int")})
    e = e.withColumns({"_lo": F.when(is_pcr & c("new_left"), c("ext_before")).otherwise(0), "_hi": F.when(is_pcr & c("new_right"), c("ext_after")).otherwise(0)})
    piece = lambda at, n: S.slice_region(c("_s"), F.pmod(at, c("length")), n)
    e = e.withColumns({"_core": piece(c("_a"), c("_n")), "_product": piece(c("_a") - c("_lo"), c("_n") + c("_lo") + c("_hi")), "_left": piece(c("_a") - c("_lo"), c("_lo")), "_right": S.reverse_complement(piece(c("_a") + c("_n"), c("_hi")))})
    at = ["query_key", "rank", "pos"]
    kind = F.when(c("atype") == K.FRAGMENT, F.lit(K.FRAGMENT)).otherwise(F.lit(K.PCR))
    here = alignments.select(c("query_key").alias("_q"), kind.alias("_t"), c("a").alias("_b"), c("n").alias("_m"), "subject_key").distinct()
    covers = (c("query_key") == c("_q")) & (c("_t") == F.when(is_fragment, F.lit(K.FRAGMENT)).otherwise(F.lit(K.PCR))) & (F.pmod(c("_a") - c("_b"), c("length")) + c("_n") <= c("_m"))
    source = e.filter(is_pcr | is_fragment).filter(~is_extension).join(here, covers).groupBy(*at).agg(F.min("subject_key").alias("_key"))
    if best is not None:
        wanted = e.filter(is_pcr).select(*at, "mtype", c("_a").cast("int").alias("a"), (F.pmod(c("_a") + c("_n") - 1, c("length")) + 1).cast("int").alias("b"))
        wanted = wanted.join(best.select("query_key", "mtype", "a", "b", "template"), ["query_key", "mtype", "a", "b"]).select(*at, "template")
        source = source.join(wanted, at, "full").select(*at, F.coalesce("template", "_key").alias("_key"))
    source = source.join(stock.select(c("key").alias("_key"), F.upper("bases").alias("_stock")), "_key")
    e = e.join(source, at, "left")
    if primed is not None:
        p = primed.select(c("query_key").alias("_q"), c("a").alias("_b"), (c("a") + c("n")).alias("_e"), F.struct(c("subject_key").alias("key"), F.upper("bases").alias("seq")).alias("_p"))
        ends = {"_fwd": (~c("new_left")) & (c("_b") == c("_a")), "_rev": (~c("new_right")) & (F.pmod(c("_e") - c("_a") - c("_n"), c("length")) == 0)}
        for name, same in ends.items():
            own = e.filter(is_pcr).join(p, (c("query_key") == c("_q")) & same).groupBy(*at).agg(F.min("_p").alias(name))
            e = e.join(own, at, "left")
    else:
        e = e.withColumns({x: F.lit(None).cast("struct<key:string,seq:string>") for x in ("_fwd", "_rev")})
    e = e.withColumn("_pair", thermo.primer_pair(F.when(is_pcr, c("_core")), c("_fwd.seq"), c("_rev.seq")))
    left = molecule(K.PRIMER, F.coalesce("_fwd.seq", F.concat("_left", F.coalesce("_pair.left", S.design_primer(c("_core"))))), c("_fwd.key"))
    right = molecule(K.PRIMER, F.coalesce("_rev.seq", F.concat("_right", F.coalesce("_pair.right", S.design_primer(S.reverse_complement(c("_core")))))), c("_rev.key"))
    inputs = F.when(is_extension, F.array(left, right)).when(is_pcr, F.array(left, right, molecule(K.TEMPLATE, c("_stock"), c("_key")))).otherwise(F.array().cast(_NO_INPUTS))
    made = F.when(is_fragment, F.coalesce("_stock", "_product")).otherwise(c("_product"))
    out = molecule(c("mtype"), made, F.when(is_fragment, c("_key")), c("_a") - c("_lo"), c("_a") + c("_n") + c("_hi"), c("length"))
    name = F.when(is_extension, "Primer Extension").when(is_pcr, "PCR").when(is_fragment, "Retrieve Fragment").otherwise("Synthesize")
    prices = ["material", "efficiency", *[x for x in ("complexity",) if x in e.columns]]
    parts = e.select(c("query_key").alias("design_key"), c("rank").alias("assembly_id"), c("pos").alias("reaction_id"), name.alias("name"), inputs.alias("inputs"), F.array(out).alias("outputs"), *prices, "_s", "length")
    whole = molecule("PLASMID", F.first("_s"), None, F.lit(0), F.first("length"), F.first("length"))
    final = parts.groupBy("design_key", "assembly_id").agg((F.max("reaction_id") + 1).alias("reaction_id"), F.lit("Assembly").alias("name"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("reaction_id", "outputs"))), lambda x: x["outputs"])).alias("inputs"), F.array(whole).alias("outputs"), F.sum("material").alias("material"), F.product("efficiency").alias("efficiency"), *[F.max(x).alias(x) for x in prices[2:]])
    return parts.drop("_s", "length").unionByName(final)


def reaction_table(reactions: DataFrame, goals: DataFrame, rank: int | None = None) -> DataFrame:
    """The full table of molecules over all designs: 13 columns, the designs numbered from 0 by key; rank: one assembly's rank."""
    c = F.col
    ids = goals.groupBy(c("key").alias("design_key")).agg(F.min("name").alias("name") if "name" in goals.columns else F.min("key").alias("name"))
    ids = frame.numbered(ids, ["design_key"], "design_id")
    chosen = reactions if rank is None else reactions.filter(c("assembly_id") == rank)
    sides = F.array(*[F.struct(F.lit(x).alias("role"), c(y).alias("m")) for x, y in (("INPUT", "inputs"), ("OUTPUT", "outputs"))])
    d = chosen.select("design_key", "assembly_id", "reaction_id", c("name").alias("reaction_name"), F.explode(sides).alias("s")).select("*", F.explode("s.m").alias("x")).join(ids, "design_key")
    return d.select(c("design_id").alias("DESIGN_ID"), c("design_key").alias("DESIGN_KEY"), c("assembly_id").alias("ASSEMBLY_ID"), c("reaction_id").alias("REACTION_ID"), c("reaction_name").alias("REACTION_NAME"), c("name").alias("NAME"), c("x.mtype").alias("TYPE"), F.coalesce("x.key", molecule_key(c("x.mtype"), c("x.seq"))).alias("KEY"), c("s.role").alias("ROLE"), c("x.region").alias("REGION"), c("x.seq").alias("SEQUENCE"), F.length("x.seq").alias("LENGTH"), F.create_map(F.lit("content_key"), S.content_key(c("x.seq"))).alias("META"))
