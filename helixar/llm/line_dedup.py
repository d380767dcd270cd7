"""Site-relative line frequency: lines on more than a share of a site's pages are boilerplate and are dropped.

Site: the host of the page's URL where `url_col` is given and holds one, else the site column. Different pages of a site
count once (by two 64-bit hashes of the text), so that copies of a page do not make its lines boilerplate. Of every
different page the hashes of its trimmed lines go to the count, pre-aggregated before each shuffle; pages containing a line
are divided by the site's page total. Lines over the ratio go to the pages by a broadcast if all together they are few, else by a
join on (site, line) salted by the page, so that a line on many pages is spread. Then every page is filtered in one pass
over its lines, with a set of the lines to drop.

A page has few lines next to its site: at most (mean lines a page) / ratio lines of a site can exceed the ratio.

Cases: null text stays null and is a page of its site; blank lines stay; the null site is a site of its own; repeated pages
are all filtered; a line on fewer than `least` pages stays, and sites with fewer than min_pages pages lose nothing; a page may
become empty and is kept; an empty table gives no rows; all columns are carried, and working columns take free names.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixar.llm import common, wordtok

MADE = ("n_lines", "n_dropped")
#: A line on over one in 12.5 different pages of its site is not what the page is about; `least` and `min_pages` keep small sites from chance.
RATIO, LEAST, MIN_PAGES = 0.08, 5, 10
_BLANK = " \t\r\x0b\x0c"
_SECOND = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)  # the seed of the second hash, as xxhash64(7, x) has it


def site_of(site_col: str, url_col: str | None = None) -> Column:
    """The host of a URL, in lower case and without `www.`; where there is none, the site column."""
    site = F.col(f"`{site_col}`").cast("string")
    if url_col is None:
        return site
    host = F.regexp_replace(F.lower(F.try_parse_url(F.col(f"`{url_col}`").cast("string"), F.lit("HOST"))), r"^www\.", "")
    return F.coalesce(F.when(host != "", host), site)


def _line(x: Column) -> Column:
    x = F.trim(x, F.lit(_BLANK))
    return F.when(x != "", F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2")))


def _lines(text: Column) -> Column:
    """The different lines of a text that are not blank, as pairs of hashes."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), _line), lambda x: x.isNotNull()))


def _page(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", url_col: str | None = None, ratio: float = RATIO, min_pages: int = MIN_PAGES, least: int = LEAST) -> DataFrame:
    """(site, line hashes h1, h2, n different pages with it, total different pages of the site) for lines over the ratio."""
    text = F.col(f"`{text_col}`").cast("string")
    pages = docs.select(site_of(site_col, url_col).alias("site"), *_page(text), F.coalesce(_lines(text), F.array()).alias("lines"))
    pages = common.materialize(pages.groupBy("site", "t1", "t2").agg(F.first("lines").alias("lines")).select("site", "lines"), "pages")
    totals = pages.groupBy(F.col("site").alias("_site")).agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= min_pages)
    counts = pages.select("site", F.explode("lines").alias("x")).groupBy("site", F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n"))
    over = counts.filter((F.col("n") > F.lit(ratio * min_pages)) & (F.col("n") >= least)).join(totals, F.col("site").eqNullSafe(F.col("_site")))
    return over.filter(F.col("n") > F.lit(ratio) * F.col("total")).drop("_site")


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", url_col: str | None = None, ratio: float = RATIO, min_pages: int = MIN_PAGES, least: int = LEAST, few: int = 100_000, salts: int = 64) -> DataFrame:
    """docs with those lines removed from the text, and n_lines, n_dropped (input columns of these names give way)."""
    docs = docs.drop(*MADE)
    names, spark = docs.columns, docs.sparkSession
    bad = common.materialize(boilerplate(docs, site_col, text_col, url_col, ratio, min_pages, least).select("site", "h1", "h2"), "boilerplate")
    made: list[str] = []
    for x in ("_site", "_bad", "_t1", "_t2"):
        made.append(common.free_name([*names, *made], x))
    site, drop, t1, t2 = (f"`{x}`" for x in made)
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.withColumn(made[0], site_of(site_col, url_col))
    held = None
    if bad.limit(few + 1).count() <= few:
        by_site: dict = {}
        for r in bad.collect():  # at most `few` rows
            by_site.setdefault(r[0], set()).add((r[1], r[2]))
        held = spark.sparkContext.broadcast(by_site)
        keyed = keyed.withColumn(made[1], F.lit(None).cast("array<struct<h1:bigint,h2:bigint>>"))
    else:
        salt = F.pmod(F.col("t1"), F.lit(salts)).cast("int").alias("salt")
        lines = docs.select(site_of(site_col, url_col).alias("site"), *_page(text), F.explode(_lines(text)).alias("x")).select("site", "t1", "t2", salt, "x.h1", "x.h2")
        wide = bad.select(F.col("site").alias("_s"), F.col("h1").alias("_a"), F.col("h2").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
        found = lines.join(wide, F.col("site").eqNullSafe(F.col("_s")) & (F.col("h1") == F.col("_a")) & (F.col("h2") == F.col("_b")) & (F.col("salt") == F.col("_salt")), "left_semi")
        page = found.groupBy("site", "t1", "t2").agg(F.collect_set(F.struct("h1", "h2")).alias(made[1])).withColumnsRenamed({"site": "_s", "t1": made[2], "t2": made[3]})
        a, b = _page(text)
        keyed = keyed.join(page, F.col(site).eqNullSafe(F.col("_s")) & (a == F.col(t1)) & (b == F.col(t2)), "left").select(*[F.col(f"`{c}`") for c in names], F.col(site), F.col(drop))
    at = [c.lower() for c in names].index(text_col.lower())
    own_columns = [F.col(f"`{c}`").cast("string").alias(c) if i == at else F.col(f"`{c}`") for i, c in enumerate(names)]
    keyed, schema = keyed.select(*own_columns, F.col(site), F.col(drop)), docs.select(*own_columns).schema

    def run(batches):
        hash_of = xxhash.xxh64_intdigest
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in (part for whole in batches for part in wordtok.slices(whole, at)):
            texts, sites, own = (batch.column(c) for c in (at, len(names), len(names) + 1))
            out, n_lines, n_dropped = [], [], []
            for i, x in enumerate(texts):
                text = x.as_py()
                lines = [] if text is None else text.split("\n")
                bad = held.value.get(sites[i].as_py()) if held else own[i].as_py() and {(y["h1"], y["h2"]) for y in own[i].as_py()}
                kept = lines
                if bad and lines:
                    kept = []
                    for line in lines:
                        raw = line.strip(_BLANK).encode()
                        if not raw or (signed(hash_of(raw, 42)), signed(hash_of(raw, _SECOND))) not in bad:
                            kept.append(line)
                out.append(text if len(kept) == len(lines) else "\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            cols = [batch.column(c) for c in range(len(names))]
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, *MADE])

    return keyed.mapInArrow(common.tidy(run), schema.add("n_lines", "long").add("n_dropped", "long"))
