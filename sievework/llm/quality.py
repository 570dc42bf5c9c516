"""Quality rules with thresholds from mergeable quantile sketches (native DataFrame functions only).

Each document gets integer metrics. A log-linear histogram per (lang, source, metric) is the sketch: a value keeps its
leading bits, so a bucket is at most 1/64 wide relative to its value, two sketches merge by adding counts, and the result
is the same for any partitioning. Tail quantiles of the sketch give the limits of each group; no limit is a constant:

    upper = tail + spread * (tail - q50)      lower = head - spread * (q50 - head)

where tail and head are the metric's upper and lower tail quantile. Values are compared by their bucket, so a limit holds to
the sketch's resolution. Symbols have a quartile as their tail, as up to a quarter of a source may be junk; repetition has the
99th percentile alone, so at most one document in a hundred of a source goes by it; lengths have fences around their tails.
A group's quantiles are weighed with its language's, merged from its sources, as n rows against ``PRIOR_ROWS``, and a language's
with those of all documents in the same way: every source has limits of its own, and they change smoothly with its size.

Null text counts as no words; null lang and null source are groups of their own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import bind, bounded_broadcast, materialize, table, words

#: metric -> (percent of the tail quantile, spread, has a lower limit). Shares are in thousandths, mean word length in thousandths
#: of a character, length in eighths of an octave of the number of words.
METRICS = {"symbols": (75, 4, False), "dup_lines": (99, 0, False), "repeats": (99, 0, False), "word_len": (99, 1, True), "length": (99, 2, True)}
#: Rows that the coarser level counts for when quantiles are weighed: as many as a 99th percentile asks for.
PRIOR_ROWS = 100
WINDOW = 5
#: Quantiles that limits are made of: the tails and the median.
PLACES = ("high", "mid", "low")


def _repeated(hashes: Column, n: int) -> Column:
    """Words inside n-word windows that occur twice or more, from the words' hashes."""

    def spread_over(h: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return bind(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k)))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))
        twice = bind(placed, lambda s: F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["k"] == x["k"]) | (F.get(s, i + 1)["k"] == x["k"]), x["p"])), lambda p: p.isNotNull()))
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-n).alias("last"))
        return F.aggregate(F.sort_array(twice), start, lambda a, p: F.struct((a["sum"] + F.least(F.lit(n), p - a["last"])).alias("sum"), p.alias("last")), lambda a: a["sum"])

    return F.when(F.size(hashes) >= n, bind(hashes, spread_over)).otherwise(F.lit(0).cast("long"))


def with_metrics(docs: DataFrame) -> DataFrame:
    """docs plus __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_lines, __n_repeat and __base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    df = docs.withColumns({"__w": words(F.col("text")), "__lines": lines})
    df = df.withColumns({
        "__n_words": F.size("__w").cast("long"),
        "__word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
        "__n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "__n_lines": F.size("__lines").cast("long"),
        "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__n_repeat": _repeated(F.transform("__w", lambda w: F.xxhash64(w)), WINDOW),
    })
    failed = (F.col("__n_words") < 10) | (100 * F.col("__n_repeat") > 20 * F.col("__n_words"))
    return df.drop("__w", "__lines").withColumn("__base_failed", failed)


def _values() -> dict[str, Column]:
    """The integer value of each metric."""
    share = lambda a, b: F.floor(1_000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    bits = F.length(F.bin("__n_words"))
    octaves = 8 * bits + F.call_function("shiftright", F.col("__n_words"), F.greatest(bits - 4, F.lit(0))).bitwiseAND(F.lit(7))
    values = [share("__n_symbols", "__word_chars"), share("__n_dup_lines", "__n_lines"), share("__n_repeat", "__n_words"), share("__word_chars", "__n_words"), octaves.cast("long")]
    return dict(zip(METRICS, values, strict=True))


def bucket(value: Column) -> Column:
    """The lower end of a value's bucket: its seven leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of the documents that pass the base rules: the mergeable sketches."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in _values().items()])
    # no filter, as that would be evaluated below the metrics and measure each text twice
    rows = measured.select("lang", "source", F.explode(F.when(~F.col("__base_failed"), values)).alias("v"))
    return rows.groupBy("lang", "source", F.col("v.metric").alias("metric"), bucket(F.col("v.value")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *by: str) -> DataFrame:
    """Merges sketches of finer groups into those of ``by``."""
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, prior: int = PRIOR_ROWS) -> DataFrame:
    """One row per (lang, source) with lo_/hi_ limits of each metric, from quantiles weighed with those of the coarser levels."""

    def quantiles(s: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by, "metric")
        tail = F.coalesce(*[F.when(F.col("metric") == m, F.lit(p[0])) for m, p in METRICS.items()])
        s = s.withColumns({"cum": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w), "tail": tail})
        at = lambda q: F.min(F.when(100 * F.col("cum") >= q * F.col("total"), F.col("bucket")))
        s = s.groupBy(*by, "metric").agg(F.max("total").alias("total"), at(F.col("tail")).alias("high"), at(F.lit(50)).alias("mid"), at(100 - F.col("tail")).alias("low"))
        return s.groupBy(*by).agg(F.max("total").alias("total"), *[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}") for m in METRICS for c in PLACES])

    cols = [f"{c}_{m}" for m in METRICS for c in PLACES]
    own, lang = quantiles(sketch, "lang", "source"), quantiles(merge(sketch, "lang"), "lang")
    every = quantiles(merge(sketch)).first()  # one row, of nulls for an empty sketch
    lang = lang.select(F.col("lang").alias("lang_l"), F.struct("total", *cols).alias("l"))
    joined = own.select("lang", "source", F.struct("total", *cols).alias("s")).join(lang, F.col("lang").eqNullSafe(F.col("lang_l")), "left")
    weighed = lambda level, c, rest: F.expr(f"({level}.total * {level}.{c} + {prior}L * ({rest})) div ({level}.total + {prior}L)")
    of = {c: weighed("s", c, f"(l.total * l.{c} + {prior}L * {every[c] or 0}L) div (l.total + {prior}L)") for c in cols}
    ends = {}
    for m, (_, spread, _) in METRICS.items():
        high, mid, low = (F.col(f"{c}_{m}") for c in PLACES)
        ends |= {f"__hi_{m}": high + spread * (high - mid), f"__lo_{m}": low - spread * (mid - low)}
    return joined.select("lang", "source", *[c.alias(name) for name, c in of.items()]).select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[c.alias(name) for name, c in ends.items()])


def judged(measured: DataFrame, found: DataFrame) -> DataFrame:
    """measured plus __kept: passes the base rules and lies within its group's limits."""
    inside = F.lit(True)
    for m, v in _values().items():
        inside = inside & (bucket(v) <= F.col(f"__hi_{m}"))
        if METRICS[m][2]:
            inside = inside & (bucket(v) >= F.col(f"__lo_{m}"))
    joined = measured.join(found, measured["lang"].eqNullSafe(found["__lang"]) & measured["source"].eqNullSafe(found["__source"]), "left")
    # one expression that no part of can be pushed below the metrics
    kept = F.when(F.col("__base_failed"), False).otherwise(F.coalesce(inside, F.lit(True)))
    return joined.withColumn("__kept", kept).drop(*found.columns)


def limits_of(measured: DataFrame) -> DataFrame:
    """limits() of measured rows, from sketches written once; broadcast while there are few groups."""
    sketch = materialize(sketches(measured), "quality-sketches")
    return bounded_broadcast(materialize(limits(sketch), "quality-limits"))


def keep_clean(docs: DataFrame) -> DataFrame:
    """Rows of docs that the rules keep, with docs' own columns.

    Texts are read twice, once for the sketches and once to filter, and never shuffled while the limits can be broadcast.
    """
    found = limits_of(with_metrics(docs))
    return judged(with_metrics(docs), found).where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    slim = with_metrics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    measured = materialize(slim, "quality-metrics")
    found = limits_of(measured)
    return judged(measured, found).select("doc_id", F.col("__n_words").alias("n_words"), F.col("__word_chars").alias("word_chars"), F.col("__n_symbols").alias("n_symbols"), F.col("__n_dup_lines").alias("n_dup_lines"), F.col("__n_repeat").alias("n_repeat_words"), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql_metrics() -> str:
    return r"""
w AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
ws AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS a,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
win AS (SELECT rid, i, a[i:i+4] AS g FROM ws, unnest(range(1, len(a) - 3)) AS u(i) WHERE len(a) >= 5),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(5, i - coalesce(prev, -100))) AS r FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM dup) GROUP BY rid),
m AS (SELECT ws.rid, doc_id, lang, source, len(a)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words
      FROM ws LEFT JOIN rep ON rep.rid = ws.rid),
mb AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (1000 * n_symbols) // greatest(word_chars, 1) AS symbols,
        (1000 * n_dup_lines) // greatest(n_lines, 1) AS dup_lines, (1000 * n_repeat_words) // greatest(n_words, 1) AS repeats, (1000 * word_chars) // greatest(n_words, 1) AS word_len,
        8 * length(ltrim(bin(n_words), '0')) + ((n_words >> greatest(length(ltrim(bin(n_words), '0')) - 4, 0)) & 7) AS length FROM m)"""


def oracle() -> str:
    of = lambda i: "CASE metric " + " ".join(f"WHEN '{m}' THEN {p[i]}" for m, p in METRICS.items()) + " END"
    group = lambda level, by: f"""
c_{level} AS (SELECT {by}metric, bucket, sum(n) AS n FROM sk GROUP BY {by}metric, bucket),
q_{level} AS (SELECT {by}metric, max(total) AS total, [min(CASE WHEN 100 * cum >= {of(0)} * total THEN bucket END), min(CASE WHEN 100 * cum >= 50 * total THEN bucket END),
    min(CASE WHEN 100 * cum >= (100 - {of(0)}) * total THEN bucket END)] AS q
  FROM (SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {by}metric) AS total FROM c_{level}) GROUP BY {by}metric)"""  # noqa: E731
    bucket = lambda v: f"(({v}) >> greatest(length(ltrim(bin({v}), '0')) - 7, 0)) << greatest(length(ltrim(bin({v}), '0')) - 7, 0)"
    inside = " AND ".join(f"coalesce({bucket(m)} <= l_{m}.hi, true)" + (f" AND coalesce({bucket(m)} >= l_{m}.lo, true)" if two else "") for m, (_, _, two) in METRICS.items())
    joins = "\n".join(f"LEFT JOIN lim l_{m} ON l_{m}.metric = '{m}' AND l_{m}.lang IS NOT DISTINCT FROM mb.lang AND l_{m}.source IS NOT DISTINCT FROM mb.source" for m in METRICS)
    rest = lambda i: f"(l.total * l.q[{i}] + {PRIOR_ROWS} * a.q[{i}]) // (l.total + {PRIOR_ROWS})"
    weighed = [f"((s.total * s.q[{i}] + {PRIOR_ROWS} * ({rest(i)})) // (s.total + {PRIOR_ROWS}))::BIGINT" for i in (1, 2, 3)]
    return f"""WITH {_sql_metrics()},
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM mb WHERE NOT base_failed" for m in METRICS)}),
sk AS (SELECT lang, source, metric, {bucket("v")} AS bucket, count(*) AS n FROM v GROUP BY 1, 2, 3, 4),
{group("s", "lang, source, ")}, {group("l", "lang, ")}, {group("a", "")},
best AS (SELECT s.lang, s.source, s.metric, [{", ".join(weighed)}] AS q
  FROM q_s s LEFT JOIN q_l l ON l.lang IS NOT DISTINCT FROM s.lang AND l.metric = s.metric JOIN q_a a ON a.metric = s.metric),
lim AS (SELECT lang, source, metric, q[1] + {of(1)} * (q[1] - q[2]) AS hi, q[3] - {of(1)} * (q[2] - q[3]) AS lo FROM best)
SELECT mb.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM mb {joins}"""
