"""Outlines: titles, levels, paths, tables of contents, chunks by title and the two chunk merges, as window plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import TITLE_RULES, clean, normalize_title, title_rule
from . import dictionary


def titles(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, title, norm, rule: lines (doc_id, line_no, text) that a title rule matches."""
    t = lines.withColumn("title", clean(F.col("text"))).where("title <> ''").withColumn("rule", title_rule(F.col("title")))
    return t.where("rule is not null").select("doc_id", "line_no", "title", normalize_title(F.col("title")).alias("norm"), "rule")


def levels(found: DataFrame) -> DataFrame:
    """found plus level: a rule's place in the order of first appearance."""
    firsts = found.groupBy("doc_id", "rule").agg(F.min("line_no").alias("first"))
    firsts = firsts.select("doc_id", "rule", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).cast("long").alias("level"))
    return found.join(firsts, ["doc_id", "rule"])


def paths(leveled: DataFrame) -> DataFrame:
    """leveled plus path: the titles a title stands under, itself last.

    A title of a lower level is on the path if it is the last of its level before this one and no title of a yet lower level
    came after it.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__{k}" for k in range(1, len(TITLE_RULES) + 1)]
    last = {n: F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(w) for k, n in enumerate(names, 1)}
    df = leveled.withColumns(last)
    parts: list[Column] = []
    for k, n in enumerate(names, 1):
        on = F.col("level") > k
        for m in names[: k - 1]:
            on = on & (F.col(f"{n}.line_no") > F.coalesce(F.col(f"{m}.line_no"), F.lit(-1)))
        parts.append(F.when(on & F.col(n).isNotNull(), F.col(f"{n}.title")))
    path = F.filter(F.array(*parts, F.col("title")), lambda x: x.isNotNull())
    return df.withColumn("path", path).drop(*names)


def tree_lines(pathed: DataFrame) -> DataFrame:
    """doc_id, line_no, shown: each of paths()' titles as a line of an indented tree, with its place, level and rule."""
    shown = F.concat(F.repeat(F.lit("  "), F.size("path") - 1), F.format_string("%s [line=%d, level=%d, rule=%s]", "title", "line_no", "level", "rule"))
    return pathed.select("doc_id", "line_no", shown.alias("shown"))


def toc_start(lines: DataFrame) -> DataFrame:
    """doc_id, toc_start: first of at least two title lines in a row that end in a number and whose title part comes again below."""
    flat = lines.select("doc_id", "line_no", F.trim("text").alias("t"))
    rule = title_rule(F.col("t"))
    core = F.lit(None).cast("string")
    for p in reversed(TITLE_RULES.values()):
        core = F.when(F.col("t").rlike(p), F.regexp_extract("t", p, 0)).otherwise(core)
    entries = flat.where(F.col("t").rlike("[0-9]+$") & rule.isNotNull()).withColumn("core", F.trim(core))
    # one pass over the lines finds all title parts in them; a part found counts in its own document, below its entry
    later = dictionary.find(entries.select(F.col("core").alias("part")), flat, "t", ["doc_id", "line_no"])
    met = entries.join(later.select("doc_id", F.col("line_no").alias("l2"), F.col("part").alias("core")), ["doc_id", "core"])
    again = met.where(F.col("l2") > F.col("line_no")).select("doc_id", "line_no").distinct()
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    runs = again.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("line_no").alias("start"), F.count("*").alias("n")).where("n >= 2")
    return runs.groupBy("doc_id").agg(F.min("start").alias("toc_start"))


def toc_range(lines: DataFrame) -> DataFrame:
    """doc_id, toc_start, toc_end: from the start (or a line 目录 before it) to the line before the first entry's title part comes again, else the last line."""
    starts = toc_start(lines)
    flat = lines.select("doc_id", "line_no", F.trim("text").alias("t"))
    above = flat.where(F.col("t").rlike(r"^目\s*录$")).select("doc_id", (F.col("line_no") + 1).alias("toc_start"), F.lit(1).alias("named"))
    entry = flat.join(starts, "doc_id").where((F.col("line_no") >= F.col("toc_start")) & title_rule(F.col("t")).isNotNull())
    core = F.lit(None).cast("string")
    for p in reversed(TITLE_RULES.values()):
        core = F.when(F.col("t").rlike(p), F.regexp_extract("t", p, 0)).otherwise(core)
    entry = entry.groupBy("doc_id", "toc_start").agg(F.min("line_no").alias("first"), F.min_by(F.trim(core), "line_no").alias("core"))
    again = flat.join(entry.select("doc_id", "first", "core"), "doc_id").where((F.col("line_no") > F.col("first")) & normalize_title(F.col("t")).contains(F.col("core")))
    again = again.groupBy("doc_id").agg(F.min("line_no").alias("again"))
    last = flat.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    df = entry.join(above, ["doc_id", "toc_start"], "left").join(again, "doc_id", "left").join(last, "doc_id")
    return df.select("doc_id", (F.col("toc_start") - F.coalesce("named", F.lit(0))).alias("toc_start"), F.coalesce(F.col("again") - 1, F.col("last")).alias("toc_end"))


def after_toc(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Titles below their document's table of contents; all where there is none."""
    df = found.join(ranges.select("doc_id", "toc_end"), "doc_id", "left")
    return df.where(F.col("toc_end").isNull() | (F.col("line_no") > F.col("toc_end"))).drop("toc_end")


def chunks_by_title(lines: DataFrame, pathed: DataFrame, keep_preamble: bool = True, joined: bool = True) -> DataFrame:
    """doc_id, ord, text, path, first_line: lines from one group of consecutive titles to the next, with the path of the group's last title.

    The path is one string, or the array of its titles (joined=False).
    """
    t = pathed.select("doc_id", "line_no", (F.array_join("path", " > ") if joined else F.col("path")).alias("path"), F.lit(True).alias("is_title"))
    df = lines.join(t, ["doc_id", "line_no"], "left")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    starts = F.col("is_title").isNotNull() & F.lag("is_title").over(w).isNull()
    df = df.withColumn("group", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    if not keep_preamble:
        df = df.where("group > 0")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    # the path of the group's title run: that of the last title before the first body line
    body = F.sum(F.when(F.col("is_title").isNull(), 1).otherwise(0)).over(Window.partitionBy("doc_id", "group").orderBy("line_no"))
    df = df.withColumn("body", body)
    out = df.groupBy("doc_id", "group").agg(ordered.alias("text"), F.max_by("path", F.when(F.col("is_title") & (F.col("body") == 0), F.col("line_no"))).alias("path"), F.min("line_no").alias("first_line"))
    return out.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("group")).cast("long").alias("ord"), "text", "path", "first_line")


def _pairs(df: DataFrame, flag: Column, fold_last: bool) -> DataFrame:
    """df (doc_id, ord) plus group: greedy pairs of a flagged row with its next; by parity in runs of flagged rows.

    fold_last: a flagged last row that no pair holds joins the group before it.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    df = df.withColumn("__s", F.coalesce(flag, F.lit(False))).withColumn("__run", F.sum(F.when(F.col("__s"), 0).otherwise(1)).over(w))
    place = F.row_number().over(Window.partitionBy("doc_id", "__run", "__s").orderBy("ord"))
    df = df.withColumn("__p", F.when(F.col("__s"), place).otherwise(0))
    consumed = F.coalesce(F.lag("__s").over(w) & (F.lag("__p").over(w) % 2 == 1), F.lit(False))
    df = df.withColumn("__lead", ~consumed)
    if fold_last:
        last = F.lead("ord").over(w).isNull() & F.lag("ord").over(w).isNotNull() & F.col("__s") & F.col("__lead")
        df = df.withColumn("__lead", F.col("__lead") & ~last)
    return df.withColumn("group", F.sum(F.when(F.col("__lead"), 1).otherwise(0)).over(w)).drop("__s", "__run", "__p", "__lead")


def merge_short(chunks: DataFrame, short: Column) -> DataFrame:
    """doc_id, ord, text, first_ord, last_ord: each short chunk joined with the next one; a short last one joins the chunk before it."""
    df = _pairs(chunks, short, fold_last=True)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return df.groupBy("doc_id", F.col("group").alias("g")).agg(text.alias("text"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")).select("doc_id", F.col("g").cast("long").alias("ord"), "text", "first_ord", "last_ord")


#: Characters of text in a partition of documents that are taken together.
PART_CHARS = 8 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) dealt by doc_id once, in so many partitions that those of each can be sorted in memory."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(min(10_000, max(least, -(-chars // PART_CHARS))), "doc_id")


def _stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\f\v"))


def merge_title_only(chunks: DataFrame, joined: bool = True) -> DataFrame:
    """doc_id, ord, text, path: a chunk whose text is its last title, outer white space aside, joined with the next.

    Joined paths name a title once. chunks has path (array, empty where there is none). A page column gives the last page known
    in a group; a type column stays with chunks that stand alone.
    """
    df = _pairs(dealt(chunks), _stripped(F.col("text")) == _stripped(F.try_element_at("path", F.lit(-1))), fold_last=False)
    kept = [c for c in ("page", "type") if c in chunks.columns]
    out = df.groupBy("doc_id", "group").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "path", *kept))).alias("r"))
    alone = F.size("r") == 1
    path = F.flatten(F.transform("r", lambda x: x["path"]))
    titles = F.transform(path, _stripped)
    path = F.when(alone, path).otherwise(F.filter(path, lambda x, i: F.array_position(titles, _stripped(x)) == i + 1))
    text = F.array_join(F.transform("r", lambda x, i: F.when(alone | (i > 0), x["text"]).otherwise(_stripped(x["text"]))), "\n")
    more = []
    if "page" in kept:
        more.append(F.try_element_at(F.filter(F.transform("r", lambda x: x["page"]), lambda x: x.isNotNull()), F.lit(-1)).alias("page"))
    if "type" in kept:
        more.append(F.when(alone, F.col("r")[0]["type"]).alias("type"))
    return out.select("doc_id", F.col("group").cast("long").alias("ord"), text.alias("text"), (F.array_join(path, " > ") if joined else path).alias("path"), *more)
