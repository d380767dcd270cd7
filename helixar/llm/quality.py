"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule is a ratio of counts of a text; larger is worse. Labelled documents are the holdout: nothing is fitted to
them. The rules share a path of levels, from lenient to strict: level i has the i-th cutoff of every rule's fixed grid, and a
document goes at level i if any rule is over its cutoff there. What a level rejects is rejected at each stricter one, so a
stratum's levels are tested from lenient to strict and the last one before the first failure is taken; such a sequence of
tests needs no correction, only the strata do (Bonferroni). A level that rejects x of a stratum's n good documents passes if
P(Binomial(n, alpha) <= x) <= delta / strata, so with probability 1 - delta no stratum loses more than alpha of its
good documents to the rules. A stratum of too few labels (under 86 of four strata) gets no cutoff, and its documents are kept.

Base rules (given, not learnt) come first: fewer than 50 words, or more than half of them in repeated windows.

Cases: null or empty text has no words and fails the base rules; a null stratum is a stratum of its own; documents
without label do not enter the holdout; a document labelled twice is good if any label says so; repeated documents get a
row each; without labels every document that passes the base rules is kept; other columns are carried as they are.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixar.llm import common

#: name: (numerator, denominator, cutoffs from strict to lenient)
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.05, 0.1, 0.15, 0.2, 0.3)),
    "marks": ("n_marks", "n_words", (0.3, 0.5, 0.75, 1.0, 1.5)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.3, 0.4, 0.5, 0.6, 0.7)),
    "repeats": ("n_repeat_words", "n_words", (0.2, 0.25, 0.3, 0.35, 0.4)),
    "capitals": ("n_capitals", "word_chars", (0.2, 0.3, 0.4, 0.5, 0.6)),
}
ALPHA, DELTA = 0.05, 0.05
MADE = ("counts", "base_failed", "kept")
_WS = r"[ \\t-\\r]+"


def add_counts(docs: DataFrame, text_col: str = "text", into: str = "counts") -> DataFrame:
    """All columns, and a struct of the counts of the whole text.

    Repeated windows are found by sorting (hash of window, position) packed in one long each, whose neighbours with
    equal hash are candidates; candidates are then compared as strings.
    """
    names = docs.columns
    keep = [F.col(f"`{c}`") for c in names]

    def new(x: str) -> str:
        return common.free_name([*names, *made], x)

    made: list[str] = []
    for x in ("_t", "_w", "_n", "_bits", "_packed", "_at", "_rep"):
        made.append(new(x))
    t, w, n, bits, packed, at, rep = made
    q = {k: f"`{v}`" for k, v in zip(("t", "w", "n", "bits", "packed", "at", "rep"), made, strict=True)}
    e = lambda sql: F.expr(sql.format(**q, ws=_WS))
    d = docs.select(*keep, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(t))
    d = d.select("*", e("array_remove(split({t}, '{ws}'), '')").alias(w))
    d = d.select("*", e("size({w})").alias(n), e("length(bin(size({w})))").alias(bits))
    d = d.select("*", e("CASE WHEN {n} < 4 THEN array(0L) ELSE sort_array(transform(sequence(0, {n} - 3), i -> shiftleft(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), {bits}) | CAST(i AS BIGINT))) END").alias(packed))
    d = d.select("*", e("filter({packed}, (x, i) -> (i > 0 AND shiftright(x, {bits}) = shiftright(get({packed}, i - 1), {bits})) OR (i < size({packed}) - 1 AND shiftright(x, {bits}) = shiftright(get({packed}, i + 1), {bits})))").alias(at))
    windows = "array_sort(transform({at}, x -> named_struct('s', concat_ws(' ', {w}[CAST(x & (shiftleft(1L, {bits}) - 1) AS INT)], {w}[CAST(x & (shiftleft(1L, {bits}) - 1) AS INT) + 1], {w}[CAST(x & (shiftleft(1L, {bits}) - 1) AS INT) + 2]), 'p', CAST(x & (shiftleft(1L, {bits}) - 1) AS INT))))"
    d = d.select("*", e(f"CASE WHEN size({{at}}) = 0 THEN NULL ELSE {windows} END").alias(rep)).drop(at, packed)
    d = d.select("*", e("CASE WHEN {rep} IS NULL THEN NULL ELSE sort_array(transform(filter({rep}, (x, i) -> get({rep}, i - 1).s = x.s OR get({rep}, i + 1).s = x.s), x -> x.p)) END").alias(at)).drop(rep)
    d = d.select("*", e("split({t}, '\\n')").alias(packed))
    lines = d.select("*", F.expr(f"filter(`{packed}`, l -> l rlike '[^ \\\\t-\\\\r]')").alias(rep)).drop(packed)
    fields = {
        "n_words": "CAST({n} AS BIGINT)",
        "word_chars": "CAST(length(regexp_replace({t}, '{ws}', '')) AS BIGINT)",
        "n_symbols": "CAST(length({t}) - length(regexp_replace({t}, '[#*$%&|<>]+', '')) AS BIGINT)",
        "n_dup_lines": "CAST(size({rep}) - size(array_distinct({rep})) AS BIGINT)",
        "n_repeat_words": "CASE WHEN {at} IS NULL THEN 0L ELSE aggregate(transform({at}, (p, i) -> CASE WHEN i = 0 THEN 3 ELSE least(3, p - get({at}, i - 1)) END), 0L, (a, x) -> a + x) END",
        "n_lines": "CAST(size({rep}) AS BIGINT)",
        "n_marks": "CAST(length({t}) - length(regexp_replace({t}, '[!?]+', '')) AS BIGINT)",
        "n_capitals": "CAST(length({t}) - length(regexp_replace({t}, '[A-Z]+', '')) AS BIGINT)",
    }
    return lines.select(*keep, F.struct(*[e(sql).alias(k) for k, sql in fields.items()]).alias(into))


def base_failed(c: str = "counts"):
    n, r = F.col(f"`{c}`.n_words"), F.col(f"`{c}`.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def _ratio(rule: str, c: str):
    a, b, _ = RULES[rule]
    return F.coalesce(F.try_divide(F.col(f"`{c}`.{a}").cast("double"), F.col(f"`{c}`.{b}").cast("double")), F.lit(0.0))


def allowed(n, rate: float, bound):
    """Column: the largest x with P(Binomial(n, rate) <= x) <= bound, -1 if none. Terms by recurrence of logs."""
    step = log(rate / (1 - rate))
    state = F.struct((n * F.lit(log(1 - rate))).alias("lp"), F.exp(n * F.lit(log(1 - rate))).alias("cdf"), F.when(F.exp(n * F.lit(log(1 - rate))) <= bound, F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("x"))

    def more(s, i):
        lp = s["lp"] + F.log((n - i + 1) / i) + F.lit(step)
        cdf = s["cdf"] + F.exp(lp)
        return F.struct(lp.alias("lp"), cdf.alias("cdf"), F.when(cdf <= bound, i).otherwise(s["x"]).cast("long").alias("x"))

    most = F.greatest(F.lit(1), F.ceil(n * rate).cast("long"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), most), state, more)["x"]


def strictness(counts: str = "counts"):
    """Column: how many levels, from the strictest, reject a text: the most cutoffs of one rule that it is over."""
    return F.greatest(*[sum((F.when(_ratio(r, counts) > F.lit(g), 1).otherwise(0) for g in grid), F.lit(0)) for r, (_, _, grid) in RULES.items()])


def calibrate(counted: DataFrame, labels: DataFrame, stratum: str = "lang", counts: str = "counts", id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row per stratum with labels: stratum and, for each rule, its cutoff (null: no level passes)."""
    levels = min(len(grid) for _, _, grid in RULES.values())
    good = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("_good")).filter("_good = 1").select("_id")
    held = counted.filter(~base_failed(counts)).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{stratum}`").cast("string").alias("stratum"), strictness(counts).alias("over")).join(good, "_id")
    lost = [F.sum((F.col("over") > i).cast("long")).alias(f"x{i}") for i in range(levels)]
    per = common.materialize(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *lost), "holdout")
    per = per.withColumn("most", allowed(F.col("n"), alpha, F.lit(delta / max(1, per.count()))))
    # x0 >= x1 >= ..., so the strictest level that passes is the end of the sequence
    return per.select("stratum", *[F.coalesce(*[F.when(F.col(f"x{i}") <= F.col("most"), F.lit(grid[i])) for i in range(levels)]).alias(r) for r, (_, _, grid) in RULES.items()])


def decide(counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang", counts: str = "counts", most_strata: int = 10_000, salts: int = 64) -> DataFrame:
    """`counted` with base_failed and kept. Cutoffs go along by broadcast up to most_strata strata, else by a salted join."""
    key, salt, own = (common.free_name(counted.columns, x) for x in ("_stratum", "_salt", "_own_salt"))
    names = {r: common.free_name(counted.columns, f"_cut_{r}") for r in RULES}
    cut = cutoffs.select(F.col("stratum").alias(key), *[F.col(r).alias(x) for r, x in names.items()])
    same = F.col(f"`{stratum}`").cast("string").eqNullSafe(F.col(key))
    if cut.limit(most_strata + 1).count() <= most_strata:
        joined = counted.join(F.broadcast(cut), same, "left")
    else:
        dealt = counted.withColumn(own, F.pmod(F.xxhash64(*[F.col(f"`{counts}`.{c}") for c in ("n_words", "word_chars")]), F.lit(salts)).cast("int"))
        joined = dealt.join(cut.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), same & (F.col(own) == F.col(salt)), "left").drop(own, salt)
    bad = F.lit(False)
    for r, x in names.items():
        bad = bad | F.coalesce(_ratio(r, counts) > F.col(x), F.lit(False))
    failed = base_failed(counts)
    return joined.withColumns({"base_failed": failed, "kept": ~failed & ~bad}).drop(key, *names.values())


def assess(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_col: str = "text", carry: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """`carry` columns (default all) with struct `counts`, base_failed and kept; the counts are written once and used twice.

    Columns of the input named counts, base_failed or kept, in any case, give way to the results.
    """
    counted = add_counts(docs.drop(*MADE), text_col)
    carry = [c for c in (carry or docs.columns) if c.lower() not in MADE]
    counted = common.materialize(counted.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, stratum, id_col])], "counts"), "quality")
    cutoffs = common.materialize(calibrate(counted, labels, stratum, id_col=id_col), "cutoffs")
    return decide(counted, cutoffs, stratum).select(*[F.col(f"`{c}`") for c in carry], "counts", "base_failed", "kept")
