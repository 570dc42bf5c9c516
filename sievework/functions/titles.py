"""Title formats, line features and title structure as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .text import strip

# fixed values: the mark of a chapter
CHAPTER = "^第[一二三四五六七八九十百]+[章节篇]"
# fixed values: title formats in the order they are tried
FORMATS = {
    "rule_001": r"^第[一二三四五六七八九十百]+章\b\s*(.+)",
    "rule_002": r"^第[一二三四五六七八九十百]+节\b\s*(.+)",
    "rule_003": r"^第[一二三四五六七八九十百]+篇\b\s*(.+)",
    "rule_004": r"^第[一二三四五六七八九十百]+条\b\s*(.+)",
    "rule_005": r"^第\d+章\b\s*(.+)",
    "rule_006": r"^第\d+节\b\s*(.+)",
    "rule_007": r"^第\d+篇\b\s*(.+)",
    "rule_008": r"^第\d+条\b\s*(.+)",
    "rule_009": r"^[一二三四五六七八九十百]+[　\s]+(.+)",
    "rule_010": r"^[一二三四五六七八九十百]+[、,]\s*(.+)",
    "rule_011": r"^\d+[　\s]+(.+)",
    "rule_012": r"^\d+[、,]\s*(.+)",
    "rule_013": r"^\d+(?:\.\d+)+[　\s]+(.+)",
    "rule_014": r"^\d+(?:\.\d+)+[、,]\s*(.+)",
}
# how the patterns of formats begin
FIRST = ["^第", "^[一二三四五六七八九十百]", r"^\d"]


def title_format(title: Column) -> Column:
    """The first format that a title has, else null; word ends and white space are those of Unicode."""
    none = F.lit(None).cast("string")
    out = none
    for first in FIRST:  # a title's first character leaves a few formats to try
        own = none
        for name, pattern in reversed(FORMATS.items()):
            if pattern.startswith(first):
                own = F.when(title.rlike(f"(?U){pattern}"), F.lit(name)).otherwise(own)
        out = F.when(title.rlike(f"(?U){first}"), own).otherwise(out)
    return out


def without_same_format(path: Column, text: Column) -> Column:
    """A title path without titles of a format that a later one has too, unless the text has more than them and names them."""
    formats = F.transform(path, title_format)
    later = lambda f, i: F.array_contains(F.slice(f, i + 2, F.size(f)), F.get(f, i))
    named = lambda t: F.coalesce(text, F.lit("")).contains(F.trim(t)) & (F.trim(text) != F.trim(t))
    # an array of the formats alone, so that they are told once a path and not at each use
    kept = lambda f: F.filter(path, lambda t, i: F.get(f, i).isNull() | ~F.coalesce(later(f, i), F.lit(False)) | F.coalesce(named(t), F.lit(False)))
    return F.transform(F.array(formats), kept)[0]


def breaks_structure(path: Column, patterns: list[str]) -> Column:
    """Whether a title of a path doesn't match the pattern of its level, or has no level; never without patterns."""
    if not patterns:
        return F.lit(False)
    out = F.size(path) > len(patterns)
    for i, p in enumerate(patterns):
        out = out | F.coalesce(~F.get(path, F.lit(i)).rlike(p), F.lit(False))
    return out


def line_features(lines: DataFrame) -> DataFrame:
    """The non-blank lines (doc_id, line_no, text) with title and what a title is told by.

    Those are index, length, word_count, prev_empty, next_empty, starts_with_digit, starts_with_chinese_num,
    starts_with_bracket, starts_with_chapter_keyword, has_dot_separated_numbers, has_punctuation_after_num and
    prefix_pattern (the chapter mark, else empty).
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    t = F.col("title")
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    df = lines.withColumn("title", F.coalesce(strip(F.col("text")), F.lit("")))
    df = df.withColumns({"index": (F.row_number().over(w) - 1).cast("long"), "prev_empty": blank(F.lag("title").over(w)), "next_empty": blank(F.lead("title").over(w))})
    chapter = F.regexp_extract(t, CHAPTER, 0)
    return df.where("title <> ''").withColumns({
        "length": F.length(t).cast("long"), "word_count": F.size(F.split(t, r"(?U)\s+")).cast("long"), "starts_with_digit": t.rlike(r"(?U)^\d"),
        "starts_with_chinese_num": t.rlike("^[一二三四五六七八九十百千零]"), "starts_with_bracket": t.rlike(r"^[(\[（]"), "starts_with_chapter_keyword": chapter != "",
        "has_dot_separated_numbers": t.rlike(r"(?U)^\d+\.\d+"), "has_punctuation_after_num": t.rlike(r"(?U)^\d+[.\s、,]"), "prefix_pattern": chapter,
    })


def title_candidates(featured: DataFrame) -> DataFrame:
    """doc_id, line_no, title, confidence, pattern of line_features() rows that may be titles: numbered or marked ones, or those that stand alone and are short.

    A line without a known prefix (null pattern) needs a confidence of 5. A document's line counts as apart from others also
    where its index is that of the last of its non-blank lines.
    """
    of_document = F.count("*").over(Window.partitionBy("doc_id"))
    apart = F.col("prev_empty") | F.col("next_empty") | (F.col("index") == 0) | (F.col("index") == of_document - 1)
    # the marks of a title with their weights; a Chinese number has no punctuation mark of its own
    marks = [(F.col("starts_with_chapter_keyword"), 5), (F.col("has_dot_separated_numbers"), 4), (F.col("starts_with_bracket"), 3), (F.col("starts_with_digit") & F.col("has_punctuation_after_num"), 3)]
    point = lambda c, v: F.when(c, v).otherwise(0)
    score = point(apart, 2) + point(F.col("length") < 80, 1) + point(F.col("length") < 50, 1)
    marked = F.lit(False)
    for c, v in marks:
        score, marked = score + point(c, v), marked | c
    df = featured.withColumns({"confidence": score.cast("long"), "marked": marked, "pattern": prefix_pattern(F.col("prefix_pattern"))})
    return df.where(((F.col("confidence") >= 3) | F.col("marked")) & (F.col("pattern").isNotNull() | (F.col("confidence") >= 5))).select("doc_id", "line_no", "title", "confidence", "pattern")


def pattern_groups(candidates: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, type, regex, level_info, n, first_line, examples: the prefix types of title_candidates() found at least so often, chapters once; the last line's regex counts."""
    df = candidates.where("pattern is not null").withColumn("type", F.col("pattern.type"))
    examples = F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.substring("title", 1, 30).alias("t")))), lambda x: x["t"])
    last = F.max_by("pattern", "line_no")
    n = df.groupBy("doc_id", "type").agg(last["regex"].alias("regex"), last["level"].alias("level_info"), F.count("*").alias("n"), F.min("line_no").alias("first_line"), examples.alias("examples"))
    return n.where((F.col("n") >= least) | (F.col("type") == "chinese_chapter"))


def pattern_hierarchy(groups: DataFrame, lines: DataFrame, longest: int = 50) -> DataFrame:
    """doc_id, level (level1, level2, ...), type, regex: pattern_groups() in order of the first of lines (doc_id, line_no, text), shorter than longest, that has the pattern."""
    own = groups.select("doc_id", "type", "regex", "first_line")
    hit = lines.where(F.length("text") < longest).join(own, "doc_id").where(F.regexp_like("text", F.concat(F.lit("(?U)"), F.col("regex"))))
    first = hit.groupBy("doc_id", "type").agg(F.min("line_no").alias("first"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("first"), "first_line"))
    return own.join(first, ["doc_id", "type"], "left").select("doc_id", F.concat(F.lit("level"), place.cast("string")).alias("level"), "type", "regex")


def format_counts(titles: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, format, n, level, example: formats that titles (doc_id, line_no, title) have at least so often, levels by first line."""
    df = titles.withColumn("format", title_format(F.col("title"))).where("format is not null")
    n = df.groupBy("doc_id", "format").agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.min_by("title", "line_no").alias("example")).where(F.col("n") >= least)
    return n.select("doc_id", "format", "n", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).cast("long").alias("level"), "example")


# fixed values: what numbers a title by its prefix, in the order tried: type, prefix, longest prefix, (pattern of such titles, level)
PREFIXES = [
    ("chinese_chapter", r"^第([一二三四五六七八九十百]+)([章节篇])\s*", None, (r"^第[一二三四五六七八九十百]+[章节篇]\s+.+", "high")),
    ("chinese_num_dot", r"^([一二三四五六七八九十百]+)[、\s]+", 9, (r"^[一二三四五六七八九十百]+[、\s].+", "medium")),
    ("bracket_chinese_num", r"^[（(]([一二三四五六七八九十百]+)[）)]\s*", None, (r"^[（(][一二三四五六七八九十百]+[）)]\s*.+", "low")),
    ("numbered_dotted", r"^(\d+(\.\d+){2,})[\.\s、,]", None, (r"^\d+(\.\d+){2,}[\.\s、,]?\s*.+", "low")),
    ("numbered_dotted", r"^(\d+\.\d+)[\.\s、,]", None, (r"^\d+\.\d+[\.\s、,]?\s*.+", "medium")),
    ("numbered_dotted", r"^(\d+)[\.\s、,]", None, (r"^\d+[\.\s、,]\s*.+", "high")),
    ("bracket_number", r"^[（(](\d+)[）)]\s*", None, (r"^[（(]\d+[）)]\s*.+", "low")),
    ("number_space", r"^(\d+)\s+", None, (r"^\d+\s+.+", "medium")),
]


def prefix_pattern(prefix: Column) -> Column:
    """(type, regex, level) of a title's prefix, white space at its ends aside; null if it has none of the known forms."""
    t = F.trim(prefix)
    out = F.lit(None).cast("struct<type:string,regex:string,level:string>")
    for kind, pattern, longest, (regex, level) in reversed(PREFIXES):
        fits = t.rlike(f"(?U){pattern}") if longest is None else t.rlike(f"(?U){pattern}") & (F.length(t) <= longest)
        out = F.when(fits, F.struct(F.lit(kind).alias("type"), F.lit(regex).alias("regex"), F.lit(level).alias("level"))).otherwise(out)
    return out
