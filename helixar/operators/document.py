"""The output document of a run: designs, molecules and reactions, numbered, linked by number, and validated.

Molecules and reactions are those of the plan's graph, one for each content, and numbered from 0 in the order of their keys.
A reaction names its molecules by number, a molecule the reactions that use and make it, and a design, for each of its
assemblies, its reactions. The document of many designs does not fit in one text, so it is frames; `lines` gives them as
JSON, a line per entry. `filtered` keeps some designs, `problems` finds what does not hold together, by joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixar.functions import shared
from helixar.operators import frame, output

ASSEMBLY, PLASMID = "Assembly", "PLASMID"


class BrokenDocument(ValueError):
    """The parts of a document do not hold together."""


@dataclass
class Document:
    """
    molecules: index, molecule_key, name, sequence, used_in_assemblies, used_as_input_to_reactions, used_as_output_to_reactions
    reactions: index, reaction_key, name, used_in_assemblies, n_inputs, n_outputs, inputs, outputs, metadata
    designs: design_key, sequence, success, assemblies of (assembly, cost, summary, final_assembly_reaction)
    """

    molecules: DataFrame
    reactions: DataFrame
    designs: DataFrame
    program: str = "helixar"
    version: str = "0.1"

    def lines(self) -> DataFrame:
        """(section, key, json): the metadata, then every design, molecule and reaction."""
        c = F.col
        spark = self.designs.sparkSession
        entry = lambda df, kind: df.select(F.lit(f"{kind}s").alias("section"), c("index").cast("string").alias("key"), *df.columns, F.lit(kind).alias("_type"))
        m, r = entry(self.molecules, "molecule"), entry(self.reactions, "reaction")
        head = [c("name").alias("__name__"), c("index").alias("__index__"), c("_type").alias("__type__"), "used_in_assemblies"]
        about = F.struct(c("molecule_key").alias("key")).alias("__meta__")
        m = m.select("section", "key", F.to_json(F.struct(*head, about, "sequence", "used_as_input_to_reactions", "used_as_output_to_reactions")).alias("json"))
        r = r.select("section", "key", F.to_json(F.struct(*head, "inputs", "outputs", "metadata")).alias("json"))
        d = self.designs.select(F.lit("designs").alias("section"), c("design_key").alias("key"), F.to_json(F.struct("design_key", F.lit(True).alias("compiled"), F.lit(True).alias("run"), "success", "sequence", "assemblies")).alias("json"))
        meta = spark.createDataFrame([(self.program, self.version)], "program string, version string")
        meta = meta.select(F.lit("metadata").alias("section"), F.lit("").alias("key"), F.to_json(F.struct("program", "version")).alias("json"))
        return meta.unionByName(d).unionByName(m).unionByName(r)

    def filtered(self, keys: DataFrame) -> Document:
        """The part that the designs of keys(design_key) need; numbers stay."""
        designs = self.designs.join(keys, "design_key", "left_semi")
        a = designs.select(F.explode("assemblies").alias("a"))
        used = a.select(F.explode(F.concat(F.transform("a.summary", lambda x: x["reaction_index"]), "a.final_assembly_reaction")).alias("index")).distinct()
        reactions = self.reactions.join(used, "index", "left_semi")
        there = reactions.select(F.explode(F.concat("inputs", "outputs")).alias("index")).distinct()
        return Document(self.molecules.join(there, "index", "left_semi"), reactions, designs, self.program, self.version)

    def problems(self) -> DataFrame:
        """(rule, key) of everything that does not hold; no rows if the document is whole."""
        c = F.col
        named = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))
        unclean = lambda cols: sum((F.when(c(x).isNull() | F.isnan(c(x).cast("double")), 1).otherwise(0) for x in cols), F.lit(0)) > 0
        # each rule reads a few columns of the sections, which are made once
        r = shared.held(self.reactions.select("index", "name", "n_inputs", "n_outputs", "inputs", "outputs", unclean(["metadata.material_cost", "metadata.efficiency"]).alias("unclean")), "reactions")
        m = shared.held(self.molecules.select("index", "name", (c("sequence.bases").isNull() | (c("sequence.bases") == "")).alias("empty"), "used_as_input_to_reactions", "used_as_output_to_reactions"), "molecules")
        a = self.designs.select("design_key", "success", F.explode_outer("assemblies").alias("a"))
        a = shared.held(a.select("design_key", "success", F.transform("a.summary", lambda x: x["reaction_index"]).alias("summary"), c("a.final_assembly_reaction").alias("final")), "designs")
        links = r.select("index", F.explode(F.concat("inputs", "outputs")).alias("molecule"))
        missing = links.select("molecule").distinct().join(m.select(c("index").alias("molecule")), "molecule", "left_anti")
        gone = links.join(missing, "molecule")  # each molecule is looked up once, however many reactions name it
        twice = lambda df: df.groupBy("index").count().filter("count > 1")
        makers = m.filter(c("name") != PLASMID).filter(F.size("used_as_output_to_reactions") > 1)
        steps = a.select("design_key", F.explode("summary").alias("index"))
        ends = a.select("design_key", F.explode("final").alias("index")).join(r.select("index", "name"), "index", "left")
        back = m.select(c("index").alias("molecule"), F.explode(F.concat("used_as_input_to_reactions", "used_as_output_to_reactions")).alias("index"))
        found = [
            named(gone, "reaction names a molecule that is not there", c("index")),
            named(back.join(r.select("index"), "index", "left_anti"), "molecule names a reaction that is not there", c("molecule")),
            named(steps.join(r.select("index"), "index", "left_anti"), "design names a reaction that is not there", c("design_key")),
            named(ends.filter((c("name") != ASSEMBLY) | c("name").isNull()), "design does not end in an assembly", c("design_key")),
            named(a.filter(c("success") & (F.size("final") != 1)), "design has no or several final assemblies", c("design_key")),
            named(twice(m), "molecule number given twice", c("index")),
            named(twice(r), "reaction number given twice", c("index")),
            named(makers, "molecule made by several reactions", c("index")),
            named(r.filter(c("n_inputs") != F.size(F.array_distinct("inputs"))), "inputs given twice or lost", c("index")),
            named(r.filter(c("n_outputs") != F.size(F.array_distinct("outputs"))), "outputs given twice or lost", c("index")),
            named(r.filter("unclean"), "no number as a price", c("index")),
            named(m.filter("empty"), "molecule without bases", c("index")),
        ]
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    def validated(self) -> Document:
        """Itself, or BrokenDocument with the first problems."""
        bad = self.problems().limit(10).collect()
        if bad:
            raise BrokenDocument("; ".join(f"{x.rule}: {x.key}" for x in bad))
        return self


def _molecules(reactions: DataFrame) -> DataFrame:
    c = F.col
    kinds = [reactions.schema[s].dataType.simpleString() for s in ("inputs", "outputs")]
    slim = [F.transform(s, lambda x: F.struct(x["mtype"].alias("mtype"), x["seq"].alias("seq"))) for s in ("inputs", "outputs")]
    m = reactions.select(F.explode(F.concat("inputs", "outputs") if kinds[0] == kinds[1] else F.concat(*slim)).alias("m"))
    m = m.select(c("m.mtype").alias("name"), "m.seq").distinct()  # keys are made of what is left
    m = m.select(output.molecule_key(c("name"), c("seq")).alias("molecule_key"), "name", "seq")
    return m.groupBy("molecule_key").agg(F.min("name").alias("name"), F.min("seq").alias("bases"))


def _sequence(bases: Column, name: Column, circular: Column, features: Column | None = None) -> Column:
    notes = [] if features is None else [features.alias("annotations")]
    return F.struct(bases.alias("bases"), F.length(bases).alias("length"), name.alias("name"), circular.alias("isCircular"), *notes)


def _packed(key: Column) -> Column:
    """A content key in 20 bytes."""
    return F.unhex(F.sha1(key.cast("binary")))


def _with_numbers(dag: DataFrame, keys: list[bytes]) -> DataFrame:
    """dag with the places in `keys` of the molecules' keys in _in and _out."""
    known, names = pa.array(keys, pa.binary()), dag.columns

    def run(batches):
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=True))
            for x in ("_in", "_out"):
                ends = pc.list_value_length(columns[x]).to_numpy(zero_copy_only=False).cumsum()
                places = pc.index_in(columns[x].flatten(), value_set=known).cast(pa.int64())
                columns[x] = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), places)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    kinds = {k: "array<bigint>" if k in ("_in", "_out") else v for k, v in dag.dtypes}
    return dag.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()))


def document(reactions: DataFrame, goals: DataFrame | None = None, elim_extra: bool = False, hold: bool = True, few: int = 200_000) -> Document:
    """The document of reactions(design_key, assembly_id, reaction_id, name, inputs, outputs[, material, efficiency, complexity]), whose
    inputs and outputs are arrays of (mtype, seq[, region]); goals(key, bases, is_circular) gives designs without assembly, too.

    elim_extra: a molecule's second and later makers are left out. hold: the reactions are written once, as each section reads them;
    not needed if they are cheap to make, such as a projection of a table. Content keys are made once and written in 20 bytes each, the molecules'
    bases and the numbers besides; sections are made of them when they are read, without the columns that nobody reads.
    """
    c = F.col
    shared.folder(reactions.sparkSession)
    for x in ("material", "efficiency", "complexity"):
        if x not in reactions.columns:
            reactions = reactions.withColumn(x, F.lit(None).cast("double"))
    reactions = shared.held(reactions, "reactions") if hold else reactions
    molecules = frame.numbered(_molecules(reactions), ["molecule_key"], "index")
    pack = lambda side: F.transform(side, _packed)
    sizes = [F.size(x).alias(f"n_{x}") for x in ("inputs", "outputs")]
    prices = ["material", "efficiency", "complexity"]
    keyed = output.with_keys(reactions).select("design_key", "assembly_id", "reaction_id", "name", F.unhex("reaction_key").alias("_key"), pack(c("in_keys")).alias("_in"), pack(c("out_keys")).alias("_out"), *sizes, *prices, _made(reactions).alias("_made"))
    keyed = shared.held(keyed, "keys")
    best = [F.min("material").alias("material_cost"), F.min("efficiency").alias("efficiency"), F.max("complexity").alias("complexity"), F.max("n_inputs").alias("n_inputs"), F.max("n_outputs").alias("n_outputs")]
    used_in = F.sort_array(F.collect_set(F.struct("design_key", c("assembly_id").alias("assembly")))).alias("used_in_assemblies")
    dag = keyed.groupBy("_key").agg(*[F.first(x).alias(x) for x in ("name", "_in", "_out")], *best)
    if elim_extra:
        _, whole = output.plan_dag(reactions)
        dag = dag.join(output.drop_extra(whole).select(F.unhex("reaction_key").alias("_key")), "_key", "left_semi")
    ids = shared.held(molecules.select(_packed(c("molecule_key")).alias("_molecule"), c("index").alias("molecule")), "molecule-numbers")
    small = ids.count() <= few  # some 4 MB; more go to their keys by a shuffle
    if small:
        dag = _with_numbers(dag, [bytes(x[0]) for x in ids.orderBy("molecule").select("_molecule").collect()])
    dag = frame.numbered(dag, ["_key"], "index")
    numbers = dag.select("_key", "index")
    of = lambda role: F.transform(F.sort_array(F.collect_list(F.when(c("role") == role, F.struct("pos", "molecule")))), lambda x: x["molecule"])
    tagged = lambda role, col: F.transform(col, lambda k, i: F.struct(F.lit(role).alias("role"), i.alias("pos"), k.alias("molecule" if small else "_molecule")))

    def links(of_keys):
        named = dag.select("index", F.explode(F.concat(tagged("in", of_keys(c("_in"))), tagged("out", of_keys(c("_out"))))).alias("m")).select("index", "m.*")
        return named if small else named.join(ids, "_molecule")

    rest = ["_key", "name", "n_inputs", "n_outputs", "material_cost", "efficiency", "complexity"]
    uses = keyed.groupBy("_key").agg(used_in)
    if small:
        linked = dag.select("index", *rest, c("_in").alias("inputs"), c("_out").alias("outputs"))
    else:
        linked = dag.select("index", *rest).join(links(lambda x: x).groupBy("index").agg(of("in").alias("inputs"), of("out").alias("outputs")), "index")
    reactions_out = linked.join(uses, "_key", "left").select("index", F.lower(F.hex("_key")).alias("reaction_key"), "name", "used_in_assemblies", "n_inputs", "n_outputs", "inputs", "outputs", F.struct("material_cost", "efficiency", "complexity").alias("metadata"))
    used = links(F.array_distinct).groupBy(c("molecule").alias("index")).agg(*[F.sort_array(F.collect_list(F.when(c("role") == k, c("index")))).alias(v) for k, v in (("in", "used_as_input_to_reactions"), ("out", "used_as_output_to_reactions"))])
    places = keyed.select("design_key", "assembly_id", F.explode(F.concat(F.array_distinct("_in"), F.array_distinct("_out"))).alias("_molecule")).groupBy("_molecule").agg(used_in)
    sequence = _sequence(c("bases"), c("molecule_key"), c("name") == PLASMID)
    molecules_out = molecules.withColumn("_molecule", _packed(c("molecule_key"))).join(places, "_molecule", "left").join(used, "index", "left").select("index", "molecule_key", "name", sequence.alias("sequence"), "used_in_assemblies", *[F.coalesce(x, F.array().cast("array<bigint>")).alias(x) for x in ("used_as_input_to_reactions", "used_as_output_to_reactions")])
    return Document(molecules_out, reactions_out, _designs(keyed, numbers, goals))


def _made(reactions: DataFrame) -> Column:
    """Type and region, if known, of what a reaction makes."""
    region = "region" in reactions.schema["outputs"].dataType.elementType.names
    place = lambda m, f: m["region"][f] if region else F.lit(None).cast("int")
    return F.transform("outputs", lambda m: F.struct(place(m, "a").alias("start"), place(m, "b").alias("end"), m["mtype"].alias("type")))


def _designs(keyed: DataFrame, numbers: DataFrame, goals: DataFrame | None) -> DataFrame:
    c = F.col
    steps = keyed.join(numbers, "_key")
    prices = F.struct(c("material").alias("material_cost"), "efficiency", "complexity").alias("metadata")
    is_last = c("name") == ASSEMBLY
    step = F.when(~is_last, F.struct("reaction_id", c("index").alias("reaction_index"), prices, c("_made").alias("outputs")))
    summary = F.transform(F.sort_array(F.collect_list(step)), lambda x: F.struct(*[x[f].alias(f) for f in ("reaction_index", "metadata", "outputs")]))
    totals = F.struct(F.sum(F.when(~is_last, c("material"))).alias("material_cost"), F.product(F.when(~is_last, c("efficiency"))).alias("assembly_efficiency"), F.coalesce(F.max(F.when(~is_last, c("complexity"))), F.lit(0.0)).alias("max_complexity"))
    a = steps.groupBy("design_key", "assembly_id").agg(totals.alias("cost"), summary.alias("summary"), F.sort_array(F.collect_set(F.when(is_last, c("index")))).alias("final_assembly_reaction"))
    d = a.groupBy("design_key").agg(F.sort_array(F.collect_list(F.struct(c("assembly_id").alias("assembly"), "cost", "summary", "final_assembly_reaction"))).alias("assemblies"))
    if goals is None:
        return d.select("design_key", F.lit(None).cast("struct<bases:string,length:int,name:string,isCircular:boolean>").alias("sequence"), F.lit(True).alias("success"), "assemblies")
    name = c("name") if "name" in goals.columns else c("key")
    g = goals.select(c("key").alias("design_key"), _sequence(c("bases"), name, c("is_circular"), c("features") if "features" in goals.columns else None).alias("sequence"))
    out = g.join(d, "design_key", "left").withColumn("success", c("assemblies").isNotNull())
    return out.withColumn("assemblies", F.coalesce("assemblies", F.array().cast(d.schema["assemblies"].dataType))).select("design_key", "sequence", "success", "assemblies")
