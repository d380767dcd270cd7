"""Secrets in texts by an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text; equal texts are one blob, however many paths and
versions have it. The ledger, a folder of Parquet tables, tells which blobs were scanned under which version of which rule, and
what was found. A run scans only pairs of blob and rule version that the ledger lacks: new texts under all rules, old ones
under changed or new rules. Findings are then joined to all paths that have the blob, copies of one text being dealt over tasks.

A rule is a regular expression whose matches, from the left and without overlap, count if the named group is long enough.
Places come from the pieces between the matches: their lengths and those of the matches are summed, a row a match.

Findings are written before the note that a blob was scanned, so a run that dies is repeated and a finding is read once,
however often it was written.

Cases: null or empty text is the empty blob; repeated rows get their findings each; several rules may find overlapping spans,
and all are kept; equal starts are ordered as the rules are, then by end; an empty table gives no rows and leaves the ledger as it was; carried
columns named like a result, in any case, give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixar.llm import common

MADE = ("blob", "spans")
SPANS = "array<struct<start:bigint,nth:int,end:bigint,kind:string>>"
FINDINGS = "blob binary, rule string, start bigint, end bigint"


@dataclass(frozen=True)
class Rule:
    """pattern: without look-around or back-references; at least `least` characters in its group (0: the match)."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules as they are given (a run of 16 or 32 in the pattern is the same as the length asked
# of the match, as their matches take all that follows), then public formats of keys.
RULES = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 32),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("json_web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("code_host_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_password", 1, r"://[^/@:\x20\x09-\x0D]{1,64}:[^/@\x20\x09-\x0D]{3,64}@"),
)
_FOUND = "array<struct<rule:string,i:int,upto:bigint,size:bigint,counts:boolean>>"


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _address(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def matches(text: Column, rule: Rule) -> Column:
    """Array of a rule's matches: number, characters from the end of the one before to its own end, size, and whether it counts."""
    p, n = F.lit(rule.pattern), lambda x: F.length(x).cast("long")
    both = F.zip_with(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), lambda gap, m: F.struct((n(gap) + n(m)).alias("upto"), n(m).alias("size")))
    if rule.group:
        both = F.zip_with(both, F.regexp_extract_all(text, p, F.lit(rule.group)), lambda x, g: F.struct(x["upto"].alias("upto"), x["size"].alias("size"), (n(g) >= rule.least).alias("counts")))
    else:
        both = F.transform(both, lambda x: F.struct(x["upto"].alias("upto"), x["size"].alias("size"), (x["size"] >= rule.least).alias("counts")))
    return F.transform(F.filter(both, lambda x: x["size"].isNotNull()), lambda x, i: F.struct(F.lit(rule.key).alias("rule"), i.alias("i"), x["upto"].alias("upto"), x["size"].alias("size"), x["counts"].alias("counts")))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """FINDINGS of blobs(blob, text, rules: keys of those to look for)."""
    none = F.array().cast(_FOUND)
    found = [F.when(F.array_contains("rules", r.key) & F.rlike("text", F.lit(r.pattern)), matches(F.col("text"), r)).otherwise(none) for r in rules]
    rows = blobs.select("blob", F.explode(F.flatten(F.array(*found))).alias("m")).select("blob", "m.*")
    end = F.sum("upto").over(Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", end).filter("counts").select("blob", "rule", (F.col("end") - F.col("size")).alias("start"), "end")


def update(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", few: int = 1_000_000) -> int:
    """Scan what the ledger lacks of the versions' texts and write it there; how many blobs were scanned.

    Up to `few` blobs to scan (40 MB) are sent to the versions, so that texts seen before are not moved; of more, each
    text is moved once to where its blob is.
    """
    spark = versions.sparkSession
    texts = versions.select(_text(text_col).alias("text")).withColumn("blob", _address(F.col("text")))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    todo = texts.select("blob").distinct()
    first = not common.exists(spark, f"{ledger}/scanned")
    if first:
        todo = todo.withColumn("rules", wanted)
    else:
        seen = spark.read.parquet(f"{ledger}/scanned").select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).filter(F.size("rules") > 0)
    todo = common.materialize(todo, "unseen")
    n = todo.count()
    if not n:
        return 0
    if not first and n <= few:
        texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
    blobs = texts.groupBy("blob").agg(F.any_value("text").alias("text"))  # copies end in the task that read them
    blobs = blobs.withColumn("rules", wanted) if first else blobs.join(todo, "blob")
    scan(blobs, rules).write.mode("append").parquet(f"{ledger}/findings")
    todo.write.mode("append").parquet(f"{ledger}/scanned")
    return n


def find(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`carry` columns (default: the id) of every version of every path, its blob (hex) and spans (see SPANS), after an update of the ledger."""
    spark = versions.sparkSession
    carry = [c for c in (carry or [id_col]) if c.lower() not in MADE]
    own = [f"c{i}" for i in range(len(carry))]
    update(versions, ledger, rules, text_col)
    paths = common.materialize(versions.select(_address(_text(text_col)).alias("blob"), *[F.col(f"`{c}`").alias(x) for c, x in zip(carry, own, strict=True)]), "paths")
    if common.exists(spark, f"{ledger}/findings"):
        found = spark.read.schema(FINDINGS).parquet(f"{ledger}/findings")
    else:
        found = spark.createDataFrame([], FINDINGS)
    kind = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)]), F.col("rule"))
    nth = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)]), F.col("rule"))
    found = found.filter(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", nth.alias("nth"), "end", kind.alias("kind")))).alias("spans"))
    rows = common.join_spread(paths, common.materialize(found, "found"), "blob")
    return rows.select(*[F.col(x).alias(c) for c, x in zip(carry, own, strict=True)], F.lower(F.hex("blob")).alias("blob"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
