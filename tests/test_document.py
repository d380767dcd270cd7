"""The output document: numbers, links, sections, and what is refused."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from helixar.operators import document, frame
from helixar.plans import cli
from helixar.plans.design import design
from helixar.sources import sequences as files


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.fixture(scope="module")
def plan(spark):
    goal = dna(3000, 12)
    fs = [(100, 160, 1, "early", "gene", [(100, 160, 1)]), (2990, 20, -1, "over", "gene", [(2990, 3000, -1), (0, 20, -1)])]
    goals = spark.createDataFrame([("g1", "goal 1", goal, 3000, True, fs), ("g2", "goal 2", dna(2500, 13), 2500, True, [])], files.RECORDS)
    templates = spark.createDataFrame([("t1", "GATTACA" + goal[:960], False), ("t2", goal[1000:2000], False), ("t3", goal[2010:3000], False)], "key string, bases string, is_circular boolean")
    return design(goals, templates, postprocess=False, n_paths=2)


@pytest.fixture(scope="module")
def doc(plan):
    return plan.document()


def rows(df, key="index"):
    return {r[key]: r for r in df.collect()}


def test_numbers_and_links(doc):
    m, r = rows(doc.molecules), rows(doc.reactions)
    assert sorted(m) == list(range(len(m))) and sorted(r) == list(range(len(r))) and len(r) > 3
    assert [m[i].molecule_key for i in range(len(m))] == sorted(x.molecule_key for x in m.values())
    for i, x in r.items():
        assert all(i in m[k].used_as_input_to_reactions for k in x.inputs) and all(i in m[k].used_as_output_to_reactions for k in x.outputs)
        assert x.metadata.material_cost is not None
    for i, x in m.items():
        assert all(i in r[k].inputs for k in x.used_as_input_to_reactions) and all(i in r[k].outputs for k in x.used_as_output_to_reactions)


def test_designs(doc, plan):
    d, r = rows(doc.designs, "design_key"), rows(doc.reactions)
    assert (d["g1"].success, d["g2"].success) == (True, False) and d["g2"].assemblies == [] and d["g1"].sequence.isCircular
    for a in d["g1"].assemblies:
        assert [r[k].name for k in a.final_assembly_reaction] == ["Assembly"]
        assert all(r[s.reaction_index].name != "Assembly" and s.outputs[0].end for s in a.summary) and a.cost.material_cost > 0
        assert set(r[a.final_assembly_reaction[0]].inputs) == {k for s in a.summary for k in r[s.reaction_index].outputs}
    assert doc.problems().count() == 0 and doc.validated() is doc


def test_lines_are_json(doc):
    found = {}
    for x in doc.lines().collect():
        found.setdefault(x.section, {})[x.key] = json.loads(x.json)
    assert set(found) == {"metadata", "designs", "molecules", "reactions"} and found["metadata"][""]["program"] == "helixar"
    for section, kind in (("molecules", "molecule"), ("reactions", "reaction")):
        for k, x in found[section].items():
            assert x["__type__"] == kind and x["__index__"] == int(k) and x["__name__"] and x["used_in_assemblies"][0]["design_key"] == "g1"
    assert all(x["sequence"]["bases"] and "isCircular" in x["sequence"] for x in found["molecules"].values())
    assert {(x["design_key"], x["success"]) for x in found["designs"].values()} == {("g1", True), ("g2", False)}


def test_filtered(spark, doc):
    none = doc.filtered(spark.createDataFrame([("g2",)], "design_key string"))
    assert none.reactions.count() == none.molecules.count() == 0 and none.designs.count() == 1
    some = doc.filtered(spark.createDataFrame([("g1",)], "design_key string"))
    assert (some.reactions.count(), some.molecules.count()) == (doc.reactions.count(), doc.molecules.count())
    some.validated()


@pytest.mark.parametrize(
    ("part", "change", "rule"),
    [
        ("molecules", lambda d: d.filter("index > 0"), "molecule that is not there"),
        ("reactions", lambda d: d.filter("name = 'Assembly'"), "reaction that is not there"),
        ("reactions", lambda d: d.withColumn("name", F.lit("PCR")), "does not end in an assembly"),
        ("reactions", lambda d: d.withColumn("n_inputs", F.col("n_inputs") + 1), "inputs given twice"),
        ("reactions", lambda d: d.unionByName(d.limit(1)), "reaction number given twice"),
        ("reactions", lambda d: d.withColumn("metadata", F.col("metadata").withField("efficiency", F.lit(float("nan")))), "no number as a price"),
        ("molecules", lambda d: d.withColumn("sequence", F.col("sequence").withField("bases", F.lit(""))), "without bases"),
        ("molecules", lambda d: d.withColumn("used_as_output_to_reactions", F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))), "made by several"),
        ("designs", lambda d: d.withColumn("assemblies", F.transform("assemblies", lambda a: a.withField("final_assembly_reaction", F.array().cast("array<bigint>")))), "no or several final"),
    ],
)
def test_broken_documents_are_refused(doc, part, change, rule):
    broken = document.Document(**{x: change(getattr(doc, x)) if x == part else getattr(doc, x) for x in ("molecules", "reactions", "designs")})
    with pytest.raises(document.BrokenDocument, match=rule):
        broken.validated()


def test_extra_makers_are_left_out(spark):
    mol = lambda t, s: (t, s)
    r = [("d", 0, i, "PCR", [mol("PRIMER", x), mol("TEMPLATE", "ACGT")], [mol("PCR_PRODUCT", "CCC")], 1.0, 0.9) for i, x in enumerate(["AA", "GG"])]
    r.append(("d", 0, 2, "Assembly", [mol("PCR_PRODUCT", "CCC")], [mol("PLASMID", "CCC")], 2.0, 0.81))
    side = "array<struct<mtype:string,seq:string>>"
    df = spark.createDataFrame(r, f"design_key string, assembly_id int, reaction_id int, name string, inputs {side}, outputs {side}, material double, efficiency double")
    with pytest.raises(document.BrokenDocument, match="made by several"):
        document.document(df).validated()
    assert document.document(df, elim_extra=True).reactions.count() == 2


def test_dense_numbers(spark):
    rng = random.Random(0)
    values = rng.sample(range(10_000), 500)
    got = frame.numbered(spark.createDataFrame([(v,) for v in [*values, None]], "v int").repartition(7), ["v"], "i").collect()
    assert {r.v: r.i for r in got} == {v: i for i, v in enumerate([None, *sorted(values)])}
    assert frame.numbered(spark.createDataFrame([], "v int"), ["v"], "i").count() == 0


def test_records_carry_features(plan):
    got = plan.records().collect()
    plasmid = next(r for r in got if r.is_circular)
    assert {f.name for f in plasmid.features} == {"early", "over"}
    goal = plasmid.bases
    seen = set()
    for r in got:
        for f in r.features:
            seen.add((r.name, f.name))
            where = "".join(r.bases[p.start : p.end] for p in f.parts)
            assert where == (goal[100:160] if f.name == "early" else goal[2990:] + goal[:20])
    assert any(k != "PLASMID" and n == "early" for k, n in seen)


def test_command_line_writes_all(spark, tmp_path):
    goal = dna(2400, 5)
    (tmp_path / "goals.fa").write_text(f">g1 a>b\n{goal}\n")
    (tmp_path / "templates.fa").write_text(f">t1\n{goal[:1200]}\n>t2\n{goal[1150:2400] + goal[:50]}\n")
    out = f"file://{tmp_path}/out"
    cli.run(spark, f"file://{tmp_path}/goals.fa", f"file://{tmp_path}/templates.fa", out, n_paths=1)
    table = spark.read.option("header", True).option("escape", '"').csv(f"{out}/sequence_design.csv")
    assert len(table.columns) == 13 and {"INPUT", "OUTPUT"} == {r.ROLE for r in table.collect()}
    region = [json.loads(r.REGION) for r in table.collect() if r.REGION]
    assert region and all(x["context_length"] == 2400 for x in region)
    records = files.read_genbank(spark, f"{out}/sequences.gb/part*").collect()
    assert goal in {r.bases.upper() for r in records if r.is_circular} and len(records) > 3
    assert {json.loads(r.value).get("__type__") for r in spark.read.text(f"{out}/output.json").collect()} == {None, "molecule", "reaction"}
    assert os.path.isdir(tmp_path / "out" / "summary.csv")


def test_run_log(spark, plan):
    log = plan.log.frame(spark).collect()
    by = {r.step: r for r in log}
    assert list(by) == ["alignments", "groups", "edges", "assemblies"]
    assert by["alignments"].rows_out == plan.alignments.count() and by["edges"].rows_out == plan.edges.count() == by["assemblies"].rows_in
    assert all(r.seconds > 0 for r in log) and by["groups"].rows_in == by["alignments"].rows_out


def test_reactions_name_the_priced_template(spark):
    """Of two templates that hold a product, the one with fewer misprimings is priced, and it is the one that the reaction takes."""
    goal = dna(2400, 31)
    bad = goal[:1300] + goal[:29] * 3  # sorts first, but its start primes elsewhere, too
    rows = [("a-bad", bad, False), ("b-good", goal[:1300], False), ("c", goal[1250:] + goal[:40], False)]
    goals = spark.createDataFrame([("g", goal, True)], "key string, bases string, is_circular boolean")
    d = design(goals, spark.createDataFrame(rows, goals.schema), n_paths=1, partition=False)
    best = {(r.a, r.b): r.template for r in d.priced_templates().collect()}
    used = [m for r in d.reactions().collect() if r.name == "PCR" for m in r.inputs if m.mtype == "TEMPLATE"]
    assert best and {m.key for m in used} == set(best.values()) and "a-bad" not in {m.key for m in used}


def test_rows_that_are_cheap_to_make_are_not_written(spark, monkeypatch):
    """F1 to F4: only numbers are written, and the sections are the same as with written reactions."""
    from pyspark.sql import functions as F

    from helixar.functions import shared

    m = lambda kind, k: F.struct(F.lit(kind).alias("mtype"), F.translate(F.col(k).cast("string"), "0123456789", "ACGTACGTAC").alias("seq"))
    r = spark.range(60).selectExpr("cast(id % 9 as string) design_key", "int(id % 4) assembly_id", "id reaction_id", "if(id % 3 = 0, 'Assembly', 'PCR') name", "id % 7 x", "id % 11 y")
    r = r.select("design_key", "assembly_id", "reaction_id", "name", F.array(m("PRIMER", "x"), m("PRIMER", "x"), m("TEMPLATE", "y")).alias("inputs"), F.array(m("PCR_PRODUCT", "y")).alias("outputs"))
    written, held = [], shared.held
    monkeypatch.setattr(shared, "held", lambda df, label: written.append(df.columns) or held(df, label))
    got, want = document.document(r, hold=False), None
    assert not any({"inputs", "outputs", "in_keys", "used_in"} & set(x) for x in written)
    want = document.document(r)
    for x in ("molecules", "reactions", "designs"):
        assert sorted(map(str, getattr(got, x).collect())) == sorted(map(str, getattr(want, x).collect()))


def test_what_is_not_read_of_the_graph_is_not_shuffled(spark):
    """F8, F16, F25: reactions are grouped by their key alone, and keys are sorted by the built-in order."""
    from pyspark.sql import functions as F

    from helixar.operators import output

    m = lambda kind, k: F.struct(F.lit(kind).alias("mtype"), F.col(k).cast("string").alias("seq"))
    r = spark.range(40).selectExpr("cast(id % 9 as string) design_key", "int(id % 4) assembly_id", "id reaction_id", "if(id % 3 = 0, 'Assembly', 'PCR') name", "id % 7 x", "id % 5 y")
    r = r.select("design_key", "assembly_id", "reaction_id", "name", F.array(m("PRIMER", "x"), m("TEMPLATE", "y")).alias("inputs"), F.array(m("PCR_PRODUCT", "y")).alias("outputs"))
    _, dag = output.plan_dag(r)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    group = next(x for x in plan(output.extra_producers(dag)).split("\n") if "Aggregate" in x)
    assert "in_keys" not in group and "used_in" not in group and "comparator" not in plan(dag).lower() and "array_sort" not in plan(dag).lower()
    want = {(x.reaction_key, x.name, tuple(x.in_keys), tuple(x.out_keys)) for x in output.with_keys(r).collect()}
    assert {(x.reaction_key, x.name, tuple(x.in_keys), tuple(x.out_keys)) for x in dag.collect()} == want and dag.count() == len(want)
    assert all(list(k) == sorted(k) for _, _, k, _ in want)


def test_filter_takes_reactions_of_wanted_designs_alone(spark, tmp_path):
    """kept molecules and reactions are those of the whole graph, with all designs that use them; reading keys alone groups no reactions and hashes no others."""
    from helixar.operators import output
    from helixar.plans import queries

    rows = [(f"d{i % 7}", i % 3, i, "Assembly" if i % 4 == 0 else "PCR", [("PRIMER", "AC" * (i % 5 + 1)), ("TEMPLATE", "G" * (i % 2 + 1))], [("PCR_PRODUCT", "T" * (i % 6 + 1))]) for i in range(60)]
    side = "array<struct<mtype:string,seq:string>>"
    r = spark.createDataFrame(rows, f"design_key string, assembly_id int, reaction_id long, name string, inputs {side}, outputs {side}")
    keys = spark.createDataFrame([("d2",), ("d5",), ("d5",), ("none",), (None,)], "design_key string")
    molecules, dag = output.plan_dag(r)
    got_molecules, got_dag = output.filter_designs(r, keys)
    mine = [x for x in dag.collect() if {u.design_key for u in x.used_in} & {"d2", "d5"}]
    there = {k for x in mine for k in [*x.in_keys, *x.out_keys]}
    assert 0 < len(mine) < dag.count()
    assert sorted(map(tuple, got_dag.select(dag.columns).collect())) == sorted(map(tuple, mine))
    assert sorted(map(tuple, got_molecules.select(molecules.columns).collect())) == sorted(tuple(x) for x in molecules.collect() if x.molecule_key in there)

    spark.createDataFrame([(i, "1-URGENT" if i % 3 else "5-LOW") for i in range(9)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 9, i, i, i % 4, "A") for i in range(30)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = queries.filter_by_key(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.count("Join") == 1
    assert "sha1" not in plan[plan.index("Join") :]


def test_document_makes_its_keys_once(spark, monkeypatch):
    """reactions get their keys once, and molecules' numbers are the same looked up in a task and by a shuffle."""
    from helixar.operators import output

    rows = [(f"d{i % 7}", i % 3, i, "Assembly" if i % 4 == 0 else "PCR", [("PRIMER", "AC" * (i % 5 + 1)), ("PRIMER", "ac" * (i % 5 + 1)), ("TEMPLATE", "G" * (i % 2 + 1))], [("PCR_PRODUCT", "T" * (i % 6 + 1))]) for i in range(60)]
    side = "array<struct<mtype:string,seq:string>>"
    r = spark.createDataFrame(rows, f"design_key string, assembly_id int, reaction_id long, name string, inputs {side}, outputs {side}")
    keys, made = output.with_keys, []
    monkeypatch.setattr(output, "with_keys", lambda df: made.append(1) or keys(df))
    looked, joined = document.document(r, hold=False), document.document(r, hold=False, few=0)
    assert len(made) == 2
    for d in (looked, joined):  # sections read numbers and packed keys alone
        assert all("sha1" not in x._jdf.queryExecution().optimizedPlan().toString().split("molecule-numbers")[0] for x in (d.reactions, d.designs))
    for x in ("molecules", "reactions", "designs"):
        assert sorted(map(str, getattr(looked, x).collect())) == sorted(map(str, getattr(joined, x).collect()))
    by_number = {m["index"]: m.molecule_key for m in looked.molecules.collect()}
    got = {x.reaction_key: ([by_number[i] for i in x.inputs], [by_number[i] for i in x.outputs]) for x in looked.reactions.collect()}
    assert got == {x.reaction_key: (x.in_keys, x.out_keys) for x in keys(r).collect()}
    assert any(len(i) > len(set(i)) for i, _ in got.values())
