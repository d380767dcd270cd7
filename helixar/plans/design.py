"""From materials to ranked assemblies, for all goals at once; the goal's key is the partition key throughout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixar import constants as K
from helixar.functions import shared
from helixar.operators import cost, document, expand, features, graph, library as lib, match, output, paths, score
from helixar.plans.runlog import RunLog


@dataclass
class Design:
    """Frames of one run; alignments and edges are checkpointed, the rest is lazy."""

    goals: DataFrame
    alignments: DataFrame
    groups: DataFrame
    edges: DataFrame
    assemblies: DataFrame
    table: DataFrame
    stock: DataFrame
    primed: DataFrame | None = None
    log: RunLog | None = None
    misprimed: bool = False

    def steps(self) -> DataFrame:
        return paths.assembly_edges(self.assemblies, self.edges)

    def summary(self) -> DataFrame:
        return output.summary_rows(self.steps(), self.alignments)

    def reactions(self) -> DataFrame:
        return output.reactions_of(self.steps(), self.goals, self.table, self.alignments, self.stock, self.primed, self.priced_templates() if self.misprimed else None)

    def priced_templates(self) -> DataFrame:
        """The template that each PCR product of the assemblies was priced with, and its misprimings."""
        c = F.col
        e = self.steps().filter(c("mtype").isin(graph.PCR_TYPES) & (c("span") > 0))
        made = e.select("query_key", "mtype", F.pmod(c("src.index"), c("length")).alias("a"), (F.pmod(c("dst.index") - 1, c("length")) + 1).alias("b"), c("span").alias("n"), "length")
        return score.template_misprimings(made, self.alignments, self.stock)

    def reaction_table(self, rank: int | None = None) -> DataFrame:
        return output.reaction_table(self.reactions(), self.goals, rank)

    def document(self, elim_extra: bool = False) -> document.Document:
        """The numbered output document; `.validated()` refuses a broken one."""
        return document.document(self.reactions(), self.goals, elim_extra)

    def records(self, rank: int = 0) -> DataFrame:
        """The molecules of the assemblies of a rank as sequences: (key, name, bases, length, is_circular, features), with
        the features of their goals and of the inventory that lie in them."""
        return features.of_molecules(self.reactions().filter(F.col("assembly_id") == rank), self.goals)

    def json(self) -> DataFrame:
        return output.output_json(self.summary())

    def status(self) -> DataFrame:
        return output.status(self.steps())


def _sub(products: DataFrame, groups: DataFrame) -> DataFrame:
    return products.join(groups.select("gid", "cyclic"), "gid").select("query_key", "atype", "a", "b", "n", "length", "cyclic")


def design(goals: DataFrame, templates: DataFrame, fragments: DataFrame | None = None, primers: DataFrame | None = None, table: DataFrame | None = None, least: int = 30, n_paths: int = 3, postprocess: bool = True, partition: bool = True, misprime: bool = True, dimers: bool = False, library: bool = False, keep: list[str] | None = None, log: RunLog | None = None) -> Design:
    """All inputs are (key, bases, is_circular). Only circular goals can be assembled; `keep` limits to these keys.

    With `library`, fragments that several goals share may be synthesized once, at a discount. log: takes a row for each step.
    """
    c = F.col
    log = log or RunLog()
    spark = goals.sparkSession
    if keep is not None:
        goals = goals.filter(c("key").isin(keep))
    table = table if table is not None else cost.span_cost(spark)
    stock = templates.select("key", "bases", "is_circular")
    if fragments is not None:  # a fragment may be copied, too
        stock = stock.unionByName(fragments.select("key", "bases", "is_circular"))
    stock = stock.dropDuplicates(["key"])
    hits = match.exact_matches(goals, stock, least)
    aligned = match.to_regions(hits, K.PCR)
    if fragments is not None:
        aligned = aligned.unionByName(match.to_regions(match.whole_matches(goals, fragments.filter(~c("is_circular"))), K.FRAGMENT))
    shared.folder(spark)
    aligned = log.checkpoint(expand.dedup_alignments(aligned), "alignments")  # read by every later step
    regions = aligned.groupBy("query_key", "atype", "a", "b", "n", "length", "cyclic").agg(F.min("subject_key").alias("subject_key"))
    groups = regions.filter(expand.size_ok(c("n"), c("atype"))).withColumn("gid", F.concat_ws("|", "query_key", "atype", "a", "b"))
    every = groups.select("query_key", "atype", "a", "b", "n", "length", "cyclic")
    every = every.unionByName(_sub(expand.overlap_products(groups), groups))
    if primers is not None:
        p = match.to_regions(match.whole_matches(goals, primers, K.MIN_BIND), K.PRIMER).withColumn("pid", c("subject_key"))
        every = every.unionByName(_sub(expand.primer_pairs(groups, p), groups))
        if dimers:
            every = every.unionByName(expand.extension_products(p).select("query_key", "atype", "a", "b", "n", "length", F.lit(True).alias("cyclic")))
    primed = None
    if primers is not None:
        primed = p.join(primers.select(c("key").alias("subject_key"), "bases"), "subject_key").select("query_key", "subject_key", "a", "n", "bases")
    together = None
    if library:
        together = log.checkpoint(lib.shared_groups(goals), "shared groups")
        every = every.unionByName(together.drop("n_clusters"))
    every = log.checkpoint(every.distinct(), "groups", "alignments", "shared groups")
    edges = graph.assembly_graph(every, table)
    if postprocess:
        edges = graph.score_long_products(edges)
        if misprime:
            edges = score.score_misprimings(edges, aligned, stock.select("key", "bases"))
        edges = graph.score_complexity(edges, goals)
        if partition:
            edges = log.checkpoint(edges, "scored edges", "groups")  # read for the cuts and again with them
            cuts = score.partition_points(goals)
            more = score.partition_edges(edges, cuts)
            priced = graph.priced(more, table).select(*[x for x in edges.columns if x != "complexity"])
            edges = edges.drop("complexity").unionByName(priced)
            edges = graph.score_complexity(edges, goals)
        edges = edges.filter(c("cost") < float("inf"))
    if together is not None:
        edges = lib.discount_shared(edges, together)
    edges = log.checkpoint(edges, "edges", "scored edges" if postprocess and partition else "groups")  # read by the search and again by the steps
    found = log.checkpoint(paths.assemblies(edges, n_paths), "assemblies", "edges")
    return Design(goals, aligned, every, edges, found, table, stock.select("key", "bases"), primed, log, postprocess and misprime)
