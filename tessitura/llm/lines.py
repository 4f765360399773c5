"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate, if it also stands in as many different texts: a page
that is copied to many sites does not vote its own lines out. HyperLogLog sketches of the sites and of
the texts of each line's hash are merged by aggregation, map side first; lines whose estimates are
both clear of the threshold are decided by them, lines near it by exact counts of distinct sites
and texts. Boilerplate lines are then taken out wherever they stand.

Everything is built-in column functions. The lines' keys, two 64-bit hashes each, are written
once and read by all passes; texts are shuffled once, to meet the numbers of the lines they lose, by
hashes of the text and a salt, so that the copies of one text are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import Scratch, at, fresh, require

MIN_SITES = 8
#: Estimates this far from the threshold, as a share of it, are decided by the sketch: 15
#: standard errors of a sketch with 4,096 registers.
MARGIN = 0.25
LG_REGISTERS = 12
SALTS = 1024
BLANKS = " \t\r\x0b\x0c"
KEYS = ["line_1", "line_2"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(line: Column) -> dict[str, Column]:
    return {"line_1": F.xxhash64(line), "line_2": F.xxhash64(F.lit("line"), line)}


def _exploded(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """A row for each line that is not blank: keys of the text and the line, number and site."""
    text, site = at(docs, text_col), at(docs, site_col).cast("string")
    rows = docs.select(*(c.alias(n) for n, c in _text_keys(docs, id_col, site_col, text_col).items()), F.coalesce(F.concat(F.lit("="), site), F.lit("")).alias("site"), F.posexplode(_lines(text)).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")
    return rows.select("t1", "t2", "salt", "site", "pos", *(c.alias(n) for n, c in _keys(F.col("line")).items()))


def _text_keys(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> dict[str, Column]:
    text = at(docs, text_col)
    salt = F.pmod(F.xxhash64(at(docs, id_col).cast("string"), at(docs, site_col).cast("string")), F.lit(SALTS)).cast("int")
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("text"), text), "salt": salt}


def boilerplate(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """The keys of lines that stand on ``min_sites`` sites and in as many different texts, at least. A
    null site is a site of its own."""
    # each site and text of a line once, so that neither a common line nor a group of copies meets in one task
    once = lines.select(*KEYS, "t1", "t2", "site").distinct()
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, LG_REGISTERS))
    least, clear = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    spread = once.groupBy(*KEYS).agg(sketch("site").alias("sites"), sketch("t1").alias("texts"))
    spread = scratch.save(spread.where((F.col("sites") >= least) & (F.col("texts") >= least)), "spread")
    sure = (F.col("sites") >= clear) & (F.col("texts") >= clear)
    near = once.join(spread.where(~sure).select(*KEYS), KEYS, "left_semi")
    exact = near.groupBy(*KEYS).agg(F.count_distinct("site").alias("sites"), F.count_distinct("t1", "t2").alias("texts")).where((F.col("sites") >= min_sites) & (F.col("texts") >= min_sites))
    return scratch.save(spread.where(sure).select(*KEYS).unionAll(exact.select(*KEYS)), "boilerplate")


def strip_boilerplate(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """Returns ``docs`` with boilerplate lines taken out of the text, and ``n_lines`` (not blank)
    and ``n_removed``; a row for each row.

    Blank lines are no lines and stay. A null text stays null, an empty one empty, with no
    lines; a text all of whose lines go is left with its blank ones. Repeated rows and null ids are
    treated alike, each row by its own text. Where ``docs`` has a column of one of the new names,
    the new one gets underscores before it. An empty table gives an empty table.
    """
    require(docs, id_col, site_col, text_col)
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(_exploded(docs, id_col, site_col, text_col), "lines")
    marks = boilerplate(lines, scratch, min_sites)
    names = {n: fresh(docs, n) for n in ("n_lines", "n_removed", "t1", "t2", "salt", "gone")}
    # copies of a text bring the same numbers, which a set holds once
    by = ["t1", "t2", "salt"]
    gone = lines.join(marks, KEYS, "left_semi").groupBy(*by).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = scratch.save(gone, "gone").withColumnsRenamed({n: names[n] for n in (*by, "gone")})
    scratch.drop("lines", "spread", "boilerplate")
    out = docs.withColumns({names[n]: c for n, c in _text_keys(docs, id_col, site_col, text_col).items()}).join(gone, [names[n] for n in by], "left")
    text, removed = at(docs, text_col), F.col(names["gone"])
    split = _lines(text)
    bounds = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(split)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), lambda i: F.slice(split, F.element_at(bounds, i + 1) + 2, F.element_at(bounds, i + 2) - F.element_at(bounds, i + 1) - 1)))
    n_lines = F.size(F.filter(split, lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    strips = removed.isNotNull()
    out = out.withColumns({names["n_lines"]: F.when(text.isNull(), 0).otherwise(n_lines).cast("long"), names["n_removed"]: F.when(strips, F.size(removed)).otherwise(0).cast("long"), text_col: F.when(strips, F.array_join(kept, "\n")).otherwise(text)})
    return out.select(*(out["`" + c.replace("`", "``") + "`"] for c in [*docs.columns, names["n_lines"], names["n_removed"]]))
