"""Fill-in-the-middle: texts cut in lines and put together anew, by DuckDB over the Arrow batches of each task.

Every batch, in slices of a bounded number of bytes, is registered in an in-memory DuckDB of the task, and one SQL statement
cuts, draws, assembles and hashes; no row is looked at in Python. The draws are the digits of a SHA-256 of the id, so every
run and every retry gives the same rows.

A text of n lines is cut before two of its n + 1 line borders, drawn apart, into prefix, middle and suffix, any of which may
be empty. `psm` gives prefix, suffix, middle with a mark before each; `spm` suffix, prefix, middle. A text that holds a mark
itself, is empty, or is not drawn stays `plain`, so from form and output the exact text follows (`restored`).

Cases: a null text is empty; a null id draws like the empty one; repeated rows are transformed each, and alike; a last line
without line break is a line; \\r and other separators belong to their line; an empty table gives no rows; all wanted
columns are carried, and those named like a result, in any case, give way to it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixar.llm import common, wordtok

#: before prefix, suffix and middle
MARKS = ("<P>", "<S>", "<M>")
MADE = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")
_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def statement(seed: int, rate: int, spm: int, marks: tuple[str, str, str], with_text: bool) -> str:
    """SQL over batch(nth, id, text). rate: percent of texts transformed; spm: percent of these in that order."""
    p, s, m = (f"'{x.replace(chr(39), 2 * chr(39))}'" for x in marks)
    draw = lambda i: f"('0x' || h[{8 * i + 1}:{8 * i + 8}])::UBIGINT"
    between = lambda a, b: f"split_part(split_part(output, {a}, 2), {b}, 1)"
    return f"""
    WITH lines AS (SELECT nth, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS unit, sha256('{seed}:' || id) AS h FROM batch),
    drawn AS (SELECT *, len(unit)::BIGINT AS n, ({draw(0)} % (len(unit) + 1)::UBIGINT)::BIGINT AS c1, ({draw(1)} % (len(unit) + 1)::UBIGINT)::BIGINT AS c2,
      CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {draw(2)} % 100 >= {rate} THEN 'plain' WHEN {draw(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM lines),
    cut AS (SELECT nth, text, n, form, array_to_string(list_slice(unit, 1, least(c1, c2)), '') AS prefix,
      array_to_string(list_slice(unit, least(c1, c2) + 1, greatest(c1, c2)), '') AS middle, array_to_string(list_slice(unit, greatest(c1, c2) + 1, n), '') AS suffix FROM drawn),
    made AS (SELECT nth, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
      CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output FROM cut)
    SELECT nth, n, form, prefix_chars, middle_chars, {"output" if with_text else "NULL::VARCHAR"} AS output, sha256(output) AS output_sha256,
      sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {between(p, s)} || split_part(output, {m}, 2) || {between(s, m)} ELSE {between(p, m)} || split_part(output, {m}, 2) || {between(s, p)} END) AS restored_sha256
    FROM made ORDER BY nth"""


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS, with_text: bool = True) -> DataFrame:
    """`carry` columns (default: the id) with the columns MADE; `output` is null unless with_text."""
    carry = [c for c in (carry or [id_col]) if c.lower() not in MADE]
    sql = statement(seed, rate, spm, marks, with_text)
    names: list[str] = []
    for x in ("_id", "_text"):
        names.append(common.free_name([*carry, *names], x))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias(names[0]), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(names[1]), *[F.col(f"`{c}`") for c in carry])
    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in carry]).schema.fields, *StructType.fromDDL(_SCHEMA).fields])

    def run(batches):
        import duckdb

        with duckdb.connect(config={"threads": 1}) as db:
            for batch in (part for whole in batches for part in wordtok.slices(whole, 1)):
                nth = pa.array(range(batch.num_rows), pa.int64())
                db.register("batch", pa.table([nth, batch.column(0), batch.column(1)], ["nth", "id", "text"]))
                made = db.sql(sql).to_arrow_table().drop_columns("nth").combine_chunks()
                db.unregister("batch")
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], *[made.column(c).combine_chunks() for c in MADE]], schema.names)

    return rows.mapInArrow(common.tidy(run), schema)


def restored(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that was transformed."""
    p, s, m = marks
    if form == "plain":
        return output
    head, middle = output.split(m)
    if form == "psm":
        prefix, suffix = head.removeprefix(p).split(s)
    else:
        suffix, prefix = head.removeprefix(s).split(p)
    return prefix + middle + suffix
