"""Sequence files: FASTA and GenBank globs to the `sequences` table, and writers. Parsing runs on executors, file by file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "array<struct<start:int,end:int,strand:int,name:string,type:string>>"
#: Features with all parts of their location, in the order of the top strand: a part over the origin of a circle comes before
#: the one behind it. Features of both strands have strand 0 and their parts as written. start and end are the first part's start and the last one's end.
LOCATED = "array<struct<start:int,end:int,strand:int,name:string,type:string,parts:array<struct<start:int,end:int,strand:int>>>>"
SEQUENCES = f"key string, name string, bases string, length int, is_circular boolean, features {FEATURES}"
RECORDS = SEQUENCES.replace(FEATURES, LOCATED)


def read_fasta(spark: SparkSession, glob: str, is_circular: bool = False) -> DataFrame:
    """One row per record; the key is the header's first word. Files are cut where a line begins with '>', so a large one is
    read by several tasks, and a '>' inside a header belongs to it."""
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")  # only a file's first record has kept its mark
    records = spark.read.option("lineSep", "\n>").text(glob).select(text.alias("value")).filter(F.trim("value") != "")
    header = F.trim(F.substring_index("value", "\n", 1))
    bases = F.regexp_replace(F.expr("substr(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s+", "")
    return records.select(F.split(header, " ")[0].alias("key"), header.alias("name"), bases.alias("bases"), F.length(bases).alias("length"), F.lit(is_circular).alias("is_circular"), F.lit(None).cast(FEATURES).alias("features"))


def _operands(text: str) -> list[str]:
    """Split at the commas outside of brackets."""
    out, depth = [""], 0
    for x in text:
        depth += (x == "(") - (x == ")")
        if x == "," and not depth:
            out.append("")
        else:
            out[-1] += x
    return out


def parse_location(text: str) -> list[tuple[int, int, int]]:
    """(start, end, strand) of a location's parts in reading order, 0-based and half-open; parts in other records are left out.

    `<` and `>` are dropped, a place between two bases is an empty part, and of a choice of places the outermost are taken.
    """
    whole = re.fullmatch(r"(complement|join|order|bond|one-of)\((.*)\)", text, re.S)
    if whole:
        parts = [p for x in _operands(whole[2]) for p in parse_location(x)]
        return [(a, b, -s) for a, b, s in reversed(parts)] if whole[1] == "complement" else parts
    places = [] if ":" in text else [int(x) for x in re.findall(r"\d+", text)]
    if not places:
        return []
    return [(places[0], places[0], 1) if "^" in text else (places[0] - 1, places[-1], 1)]


def located(name: str, kind: str, parts: list[tuple[int, int, int]]) -> dict:
    """A feature of LOCATED from parts in reading order."""
    strands = {s for _, _, s in parts}
    strand = strands.pop() if len(strands) == 1 else 0
    parts = parts[::-1] if strand == -1 else parts
    return {"start": parts[0][0], "end": parts[-1][1], "strand": strand, "name": name, "type": kind, "parts": [dict(zip(("start", "end", "strand"), p, strict=True)) for p in parts]}


def parse_record(record: str) -> dict | None:
    """A GenBank record; None if it has no locus."""
    locus = re.search(r"^LOCUS\s+(\S+)(.*)$", record, re.M)
    if not locus:
        return None
    origin = re.search(r"^ORIGIN.*?$(.*)", record, re.M | re.S)
    bases = re.sub(r"[^A-Za-z]", "", origin[1]) if origin else ""
    name = re.search(r"^DEFINITION\s+(.*)$", record, re.M)
    features = []
    table = re.search(r"^FEATURES.*?$(.*?)(?=^ORIGIN|\Z)", record, re.M | re.S)
    for m in re.finditer(r"^ {5}(\S+)\s+([^\s/].*(?:\n {21}[^/\s].*)*)((?:\n {21}.*)*)", table[1] if table else "", re.M):
        parts = parse_location(re.sub(r"\s+", "", m[2]))
        if parts:
            label = re.search(r'/(?:label|gene|note)="?([^"\n]*)', m[3])
            features.append(located(label[1] if label else "", m[1], parts))
    return {"key": locus[1], "name": name[1].strip(" .") if name else locus[1], "bases": bases, "length": len(bases), "is_circular": "circular" in locus[2], "features": features}


def parse_genbank(text: str) -> Iterator[dict]:
    """Records of a GenBank file."""
    yield from filter(None, (parse_record(x) for x in re.split(r"^//\s*$", text, flags=re.M)))


def read_genbank(spark: SparkSession, glob: str, is_circular: bool | None = None, parts: bool = False) -> DataFrame:
    """One row per record; is_circular overrides the files' topology; parts: features as LOCATED.

    Files are cut at the lines that end a record, by the text source, so a large file is read by several tasks, from any
    store that Spark reads.
    """

    df = spark.read.option("lineSep", "\n//").text(glob).mapInArrow(_records, RECORDS)
    if not parts:
        df = df.withColumn("features", F.transform("features", lambda f: F.struct(*[f[x].alias(x) for x in ("start", "end", "strand", "name", "type")])))
    return df if is_circular is None else df.withColumn("is_circular", F.lit(is_circular))


_PLACE = [("start", pa.int32()), ("end", pa.int32()), ("strand", pa.int32())]
_LOCATED = pa.list_(pa.struct([*_PLACE, ("name", pa.string()), ("type", pa.string()), ("parts", pa.list_(pa.struct(_PLACE)))]))
_RECORDS = pa.schema([("key", pa.string()), ("name", pa.string()), ("bases", pa.string()), ("length", pa.int32()), ("is_circular", pa.bool_()), ("features", _LOCATED)])
_HELD = 1 << 20  # characters made before they are handed on, so what a worker holds does not grow with the rows of a batch


def _records(batches):
    """Batches of RECORDS from batches of GenBank texts, which are parsed one at a time."""
    rows, held = [], 0
    for batch in batches:
        for text in batch.column(0):
            row = parse_record(text.as_py().replace("\r", ""))
            if row:
                rows.append(row)
                held += row["length"]
            if held > _HELD:
                yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, _RECORDS)


def _texts(batches):
    """Batches of GenBank texts from batches of records, which are written one at a time."""
    made, held = [], 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            made.append(genbank_text(SimpleNamespace(**{k: v.as_py() for k, v in zip(batch.schema.names, row, strict=True)})))
            held += len(made[-1])
            if held > _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])
                made, held = [], 0
    yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])


def location_text(feature) -> str:
    """A feature's location in GenBank format, from its parts if it has any."""
    own = feature["parts"] if "parts" in feature and feature["parts"] is not None else [feature]
    place = lambda p: f"{p['start'] + 1}..{p['end']}" if p["end"] > p["start"] else f"{p['start']}^{p['start'] + 1}"
    mixed = len({p["strand"] for p in own}) > 1
    texts = [f"complement({place(p)})" if mixed and p["strand"] == -1 else place(p) for p in own]
    text = texts[0] if len(texts) == 1 else f"join({','.join(texts)})"
    return f"complement({text})" if not mixed and own[0]["strand"] == -1 else text


def genbank_text(r) -> str:
    """A record in GenBank format."""
    topology = "circular" if r.is_circular else "linear"
    lines = [f"LOCUS       {r.key} {len(r.bases)} bp DNA {topology}", f"DEFINITION  {r.name}", "FEATURES             Location/Qualifiers"]
    for f in r.features if r.features is not None else []:
        f = f.asDict() if hasattr(f, "asDict") else f
        label = (f["name"] or "").replace('"', "'")
        lines += [f"     {f['type']:<16}" + location_text(f), f'                     /label="{label}"']
    lines.append("ORIGIN")
    for i in range(0, len(r.bases), 60):
        part = r.bases[i : i + 60].lower()
        lines.append(f"{i + 1:>9} " + " ".join(part[j : j + 10] for j in range(0, len(part), 10)))
    return "\n".join([*lines, "//"])


def write_genbank(sequences: DataFrame, path: str, mode: str = "error") -> None:
    """Text files of GenBank records, a file per partition."""
    sequences.mapInArrow(_texts, "value string").write.mode(mode).text(path)


def write_fasta(sequences: DataFrame, path: str) -> None:
    sequences.select(F.concat(F.lit(">"), F.coalesce("name", "key"), F.lit("\n"), "bases").alias("value")).write.text(path)


def with_topology(sequences: DataFrame, is_circular: bool) -> DataFrame:
    return sequences.withColumn("is_circular", F.lit(is_circular))


def materials(primers: DataFrame, templates: DataFrame, goals: DataFrame, fragments: DataFrame | None = None) -> DataFrame:
    """The inventory by role. Only linear fragments are used as they are; all fragments are templates too."""
    tag = lambda df, role: df.withColumn("role", F.lit(role))
    out = tag(primers, "primer").unionByName(tag(templates, "template")).unionByName(tag(goals, "query"))
    if fragments is not None:
        out = out.unionByName(tag(fragments.filter(~F.col("is_circular")), "fragment")).unionByName(tag(fragments, "template"))
    return out


def random_designs(spark: SparkSession, n: int, size: int = 3000, parts: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(goals, templates): n random circular goals and, for each, templates that cover it in equal parts. For tests."""
    letters = F.array(*[F.lit(x) for x in "ACGT"])
    ids = spark.range(n)
    pick = lambda i: F.get(letters, F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(4)).cast("int"))
    goals = ids.select(F.concat(F.lit("goal"), "id").alias("key"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size)), pick), "").alias("bases"), F.lit(True).alias("is_circular"))
    step = size // parts
    cut = goals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    templates = cut.select(F.concat("key", F.lit("_t"), "i").alias("key"), F.expr(f"substring(bases, i * {step} + 1, IF(i = {parts - 1}, {size}, {step}))").alias("bases"), F.lit(False).alias("is_circular"))
    return goals, templates
