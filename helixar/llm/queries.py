"""The queries of this package and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixar.llm import chat, common, decontam, fim, lbl, line_dedup, merkle, packing, quality, secrets, simhash, tokenfiles, unigram_count, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), with_ids=False)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.new_path(spark, "tokens")
    tokenfiles.write_token_files(_read(spark, sf_dir, "documents"), root)
    return tokenfiles.read_token_files(spark, root)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = quality.assess(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), carry=["doc_id"])
    return a.select("doc_id", *[F.col(f"counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(_read(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = chat.rotate(_read(spark, sf_dir, "conversations"))
    marks = F.array_join(F.transform("mask", lambda x: F.when(x, "1").otherwise("0")), "")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return r.select("conv_id", "perspective", "chunk", "start", "n_messages", "text", marks.alias("mask"), spans.alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.count_tokens(_read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.drop_boilerplate(_read(spark, sf_dir, "documents"))
    return d.select("doc_id", "source", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses_of_pages(_read(spark, sf_dir, "pages")), carry=["page_id"], with_blocks=False)
    return made.select("page_id", "kind", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    one_more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    changed = F.when(tampered, merkle.leaf_of(*[one_more if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]))
    rows = merkle.manifest(_read(spark, sf_dir, "documents"), carry={"doc_id": F.col("doc_id"), "changed": changed})
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(_read(spark, sf_dir, "documents"), with_text=False).drop("output")


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_read(spark, sf_dir, "documents"), common.new_path(spark, "ledger"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = secrets.listed(F.filter("spans", lambda x: x["nth"] < 3))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (op1_packing, op2_decontamination, op3_token_files, op4_quality_rules, op5_lm_scoring, op6_simhash_dedup, op7_chat_rotation, op8_token_counts, op9_line_dedup, op10_warc_derivatives, op11_merkle_manifest, op12_fill_in_middle, op13_secret_scans)
    return {f.__name__: f for f in fs}


_RULE_SQL = {r: f"coalesce(try_cast({a} as double) / nullif({b}, 0), 0.0)" for r, (a, b, _) in quality.RULES.items()}
_LEVELS = range(min(len(g) for _, _, g in quality.RULES.values()))
_OVER = ", ".join(" + ".join(f"cast(r_{r} > {g} as int)" for g in grid) for r, (_, _, grid) in quality.RULES.items())
_OP4 = rf"""
with d as (select doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
k as (select row_number() over () rid, *, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls from d),
win as (select rid, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: {{'p': i, 's': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) x from k where len(w) >= 4),
rep as (select rid, x.p p from win qualify count(*) over (partition by rid, x.s) > 1),
cov as (select rid, count(distinct p + o) n from rep, (values (0), (1), (2)) v(o) group by rid),
c as (select rid, doc_id, lang, cast(len(w) as bigint) n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines,
  cast(coalesce(n, 0) as bigint) n_repeat_words, len(ls) n_lines, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) n_marks, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) n_capitals
  from k left join cov using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, {", ".join(f"{sql} r_{r}" for r, sql in _RULE_SQL.items())} from c),
good as (select doc_id from labels group by doc_id having max(quality) = 1),
per as (select lang, cast(count(*) as bigint) n, {", ".join(f"cast(sum(cast(o > {i} as int)) as bigint) x{i}" for i in _LEVELS)} from (select lang, greatest({_OVER}) o from f join good using (doc_id) where not base_failed) group by lang),
pmf as (select lang, n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.ALPHA}) + (n - i) * ln(1 - {quality.ALPHA})) p from (select lang, n, unnest(range(0, cast(greatest(1, ceil(n * {quality.ALPHA})) as bigint) + 1)) i from per)),
cdf as (select lang, i, sum(p) over (partition by lang order by i) p from pmf),
most as (select lang, coalesce(max(i) filter (where p <= {quality.DELTA} / (select count(*) from per)), -1) x from cdf group by lang),
cut as (select per.lang, {", ".join("coalesce(" + ", ".join(f"case when x{i} <= x then {grid[i]} end" for i in _LEVELS) + f") c_{r}" for r, (_, _, grid) in quality.RULES.items())} from per join most on per.lang is not distinct from most.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({" or ".join(f"coalesce(r_{r} > c_{r}, false)" for r in quality.RULES)}) kept
from f left join cut on f.lang is not distinct from cut.lang
"""
_OP7 = r"""
with m as (select conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\r\n]', ' ', 'g') as role, replace(coalesce(text, ''), '<|', '< |') t from conversations),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(t)) - 1 pos from m),
who as (select distinct conv_id, role perspective from m where role <> 'system'),
x as (select o.*, perspective, case when role = 'system' then '<|im_start|>system' when role = perspective then '<|im_start|>assistant' else '<|im_start|>user name=' || role end || chr(10) head from o join who on o.conv_id is not distinct from who.conv_id),
y as (select *, cast(coalesce(sum(length(head) + length(t) + 11) over (partition by conv_id, perspective order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) a from x)
select conv_id, perspective, pos // 1024 as chunk, min(a) as start, count(*) n_messages,
  string_agg(head || t || '<|im_end|>' || chr(10), '' order by pos) as text,
  string_agg(case when role = perspective then '1' else '0' end, '' order by pos) mask,
  coalesce(string_agg((a + length(head)) || '-' || (a + length(head) + length(t)), ',' order by pos) filter (where role = perspective), '') spans
from y group by 1, 2, 3
"""
_BLANK = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
_OP9 = rf"""
with d as (select doc_id, source, text, string_split(text, chr(10)) ls from documents),
p as (select distinct source, text from documents),
tot as (select source, count(*) total from p group by 1 having count(*) >= {line_dedup.MIN_PAGES}),
n as (select source, l, count(*) n from (select distinct source, text, trim(l, {_BLANK}) l from (select source, text, unnest(string_split(text, chr(10))) l from p)) where l <> '' group by 1, 2),
bad as (select n.source, list(l) bad from n join tot on n.source is not distinct from tot.source where n > cast({line_dedup.RATIO} as double) * total and n >= {line_dedup.LEAST} group by 1)
select doc_id, d.source, cast(coalesce(len(ls), 0) as bigint) n_lines,
  cast(coalesce(len(list_filter(ls, lambda l: list_contains(coalesce(bad, []), trim(l, {_BLANK})))), 0) as bigint) n_dropped,
  case when text is not null then md5(array_to_string(list_filter(ls, lambda l: not list_contains(coalesce(bad, []), trim(l, {_BLANK}))), chr(10))) end text_md5
from d left join bad on d.source is not distinct from bad.source
"""


_FIELD = "case when {0} is null then '-' else octet_length(encode({1}::varchar)) || ':' || {1}::varchar end"
_LEAF, _CHANGED = (" || ".join(_FIELD.format(c, f"({c}::hugeint + 1)" if c == more else c) for c in merkle.COLUMNS) for more in ("", "n_chars"))
#: CRC-32 of a decimal number, bit by bit
_CRC = "xor(4294967295, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda s, b: list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(s, b)), 4294967295::bigint))"
_OP11 = rf"""
with recursive d as (select row_number() over () rid, doc_id, lang, sha256({_LEAF}) leaf, case when {_CRC} % 7 = 0 then sha256({_CHANGED}) end changed from documents),
l as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf, rid) - 1 pos, count(*) over (partition by lang) n from d),
node(lang, lvl, pos, n, h) as (select lang, 0, pos, n, leaf from l union all select lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from node where n > 1 group by lang, lvl, pos // 2, n),
sub as (select lang, h subroot, lvl height, row_number() over (order by lang nulls first) - 1 place, count(*) over () langs from node where n = 1),
upper_node(lvl, pos, n, h) as (select 0, place, langs, subroot from sub union all select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from upper_node where n > 1 group by lvl, pos // 2, n),
top as (select h root, lvl more from upper_node where n = 1),
p as (select l.*, subroot, root, height, more, place from l join sub on l.lang is not distinct from sub.lang cross join top),
step as (
  select rid, v.lvl, (p.pos >> v.lvl) & 1 side, h other from p, unnest(range(height)) v(lvl) left join node s on s.lang is not distinct from p.lang and s.lvl = v.lvl and s.pos = xor(p.pos >> v.lvl, 1)
  union all
  select rid, height + v.lvl, (place >> v.lvl) & 1, h from p, unnest(range(more)) v(lvl) left join upper_node s on s.lvl = v.lvl and s.pos = xor(place >> v.lvl, 1)),
way as (select rid, list({{'side': side, 'other': coalesce(other, '')}} order by lvl) steps from step group by rid),
up(rid, steps, i, h) as (select p.rid, steps, 1, coalesce(changed, leaf) from p left join way using (rid) union all select rid, steps, i + 1, sha256(case when steps[i].side = 1 then steps[i].other || h else h || steps[i].other end) from up where i <= coalesce(len(steps), 0))
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s.other), ''), '')) proof_sha256, h folded_root, h = root verified
from p join up using (rid) where i > coalesce(len(steps), 0)
"""
_DRAW = "('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), {}, 8))::ubigint"
_JOINED = "coalesce(list_aggregate(list_filter(ls, lambda x, i: i > {} and i <= {}), 'string_agg', ''), '')"
_OP12 = rf"""
with d as (select doc_id, coalesce(text, '') t, string_split(t, chr(10)) parts, {", ".join(f"{_DRAW.format(8 * i + 1)} h{i + 1}" for i in range(4))} from documents),
u as (select *, list_filter(list_transform(parts, lambda x, i: case when i < len(parts) then x || chr(10) else x end), lambda x: x <> '') ls from d),
c as (select *, least(h1 % (len(ls) + 1)::ubigint, h2 % (len(ls) + 1)::ubigint) a, greatest(h1 % (len(ls) + 1)::ubigint, h2 % (len(ls) + 1)::ubigint) b,
  case when t = '' or strpos(t, '<P>') > 0 or strpos(t, '<S>') > 0 or strpos(t, '<M>') > 0 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end form from u),
x as (select *, {_JOINED.format(0, "a")} pre, {_JOINED.format("a", "b")} mid, {_JOINED.format("b", "len(ls)")} suf from c)
select doc_id, len(ls)::bigint n, form, case when form <> 'plain' then length(pre) end prefix_chars, case when form <> 'plain' then length(mid) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(t) restored_sha256
from x
"""


def _secret_sql() -> str:
    """Matches by rule, their places by running sums over the pieces between them."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = " union all ".join(
        f"select rid, {i} nth, {q(r.kind)} kind, unnest(list_zip(regexp_extract_all(t, {q(r.pattern)}), string_split_regex(t, {q(r.pattern)})[:-2], regexp_extract_all(t, {q(r.pattern)}, {r.group}), range(len(regexp_extract_all(t, {q(r.pattern)}))))) x, {r.least} least from d"
        for i, r in enumerate(secrets.RULES)
    )
    return f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
m as (select rid, nth, kind, x[1] s, x[2] gap, x[3] g, x[4] i, least from ({kinds})),
e as (select *, sum(length(gap) + length(s)) over (partition by rid, nth order by i) stop from m),
f as (select rid, nth, stop - length(s) start, kind || ':' || (stop - length(s))::bigint || ':' || stop::bigint span from e where length(g) >= least),
a as (select rid, {", ".join(f"count(*) filter (nth = {i}) n_{secrets.RULES[i].kind}" for i in range(3))}, string_agg(span, ',' order by start, nth) filter (nth < 3) base, string_agg(span, ',' order by start, nth) spans from f group by rid)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) n_{r.kind}" for r in secrets.RULES[:3])}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join a using (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": _OP4, "op7_chat_rotation": _OP7, "op9_line_dedup": _OP9, "op11_merkle_manifest": _OP11, "op12_fill_in_middle": _OP12, "op13_secret_scans": _secret_sql()}
