"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base counts come from each whole text.  Then every normalised line is hashed,
its distinct documents are counted per host, and lines that too many of a
host's documents share are removed; a document that loses too large a share of
its words is depleted and rejected.

Limits: a line is frequent on a host from ``MIN_DOCS`` documents on, where
those are also more than ``MAX_SHARE`` of the host's documents; a document is
depleted when frequent lines hold more than ``MAX_LOST`` of its words.

Edge cases: null text has no words and fails the base rules; null host is a
host of its own; lines without a word are neither counted nor removed; repeated
rows are documents of their own; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import materialize, unused

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_DOCS = 20
MAX_SHARE = 0.01
MAX_LOST = 0.5

_SPACE = r"[\\x20\\x09-\\x0D]"
_LINE_KEY = rf"trim(regexp_replace(lower({{0}}), '[\\x20\\x09-\\x0D0-9]+', ' '))"


def _words(text: str) -> str:
    return f"array_remove(split({text}, '{_SPACE}+'), '')"


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host``, the base counts, and ``lines``: hash and number of
    words of each line with a word."""
    read = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    split = read.select("*", F.expr(_words("text")).alias("words"), F.expr(rf"filter(split(text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("worded"))
    hashed = split.select(
        "doc_id",
        "host",
        "worded",
        F.size("words").cast("long").alias("n_words"),
        F.expr("char_length(array_join(words, ''))").cast("long").alias("word_chars"),
        F.expr("regexp_count(text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        # One hash for each window of three words, in order.
        F.expr("if(size(words) < 3, array(), transform(sequence(0, greatest(size(words) - 3, 0)), i -> xxhash64(words[i], words[i + 1], words[i + 2])))").alias("w3"),
    )
    # Only where some window repeats are positions sorted by hash; equal
    # neighbours mark their windows, and marked windows cover up to three words.
    repeated = """if(size(array_distinct(w3)) = size(w3), 0L, aggregate(
        transform(array(array_sort(transform(w3, (h, i) -> struct(h, i)))), s ->
          aggregate(transform(array(sort_array(array_distinct(flatten(filter(zip_with(s, slice(s, 2, size(s)), (a, b) -> if(a.h = b.h, array(a.i, b.i), null)), x -> x is not null))))), p ->
            aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (t, x) -> t + x)), 0L, (t, x) -> t + x)),
        0L, (t, x) -> t + x))"""
    return hashed.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        F.expr("size(worded) - size(array_distinct(worded))").cast("long").alias("n_dup_lines"),
        F.expr(repeated).alias("n_repeat_words"),
        F.expr(f"transform(worded, l -> struct(xxhash64({_LINE_KEY.format('l')}) as h, size({_words('l')}) as n))").alias("lines"),
    )


def frequent_lines(counted: DataFrame) -> DataFrame:
    """``host, h, docs`` of the lines above the limits."""
    hosts = counted.groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = counted.select("host", F.explode(F.expr("array_distinct(transform(lines, l -> l.h))")).alias("h")).groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") >= MIN_DOCS)
    return lines.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(F.col("docs") > MAX_SHARE * F.col("host_docs")).select("host", "h", "docs")


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: ``row``, ``doc_id``, base counts, ``base_failed``,
    what frequent lines take (``lost_lines, lost_words, frequent`` hashes),
    and ``kept``."""
    counted = materialize(base_counts(docs, host).withColumn("row", F.monotonically_increasing_id()), "line-counts")
    frequent = frequent_lines(counted).select(F.col("host").alias("of"), F.col("h").alias("key"))
    lines = counted.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.h", "l.n")
    lost = lines.join(frequent, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("key"))).groupBy("row").agg(F.count("*").alias("lost_lines"), F.sum("n").alias("lost_words"), F.collect_set("h").alias("frequent"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = counted.drop("lines").join(lost, "row", "left")
    return joined.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), none("lost_lines"), none("lost_words"), "frequent").withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= MAX_LOST * F.col("n_words")))


def clean(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, without their frequent lines: the columns
    of ``docs``; a doc_id that stands for different texts is judged by the
    strictest of them."""
    kept, frequent, of = unused(docs, "_kept", "_frequent", "_id")
    verdict = judge(docs, host).groupBy("doc_id").agg(F.min("kept").alias(kept), F.array_distinct(F.flatten(F.collect_list("frequent"))).alias(frequent))
    joined = docs.join(verdict.withColumnRenamed("doc_id", of), F.col("doc_id").cast("long").eqNullSafe(F.col(of))).where(F.col(kept))
    rest = rf"array_join(filter(split(text, '\\n'), l -> not (l rlike '[^\\x20\\x09-\\x0D]') or not array_contains({frequent}, xxhash64({_LINE_KEY.format('l')}))), '\n')"
    return joined.withColumn("text", F.expr(rest)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_line_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row", "frequent")


ORACLE_SQL = rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as tri from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
m as (select r, i from g qualify count(*) over (partition by r, tri) > 1),
rep as (select r, count(distinct k)::bigint as n from (select r, unnest([i, i + 1, i + 2]) as k from m) group by r),
l as (select r, source, trim(regexp_replace(lower(x), '[\x20\x09-\x0D0-9]+', ' ', 'g')) as k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n from (select r, source, unnest(ls) as x from w)),
h as (select source, count(*) as hd from d group by source),
f as (select l.source, k from (select source, k, count(distinct r) as c from l group by source, k) l join h on l.source is not distinct from h.source where c >= {MIN_DOCS} and c > {MAX_SHARE} * hd),
lost as (select r, count(*)::bigint as ln, sum(n)::bigint as lw from l join f on l.k = f.k and l.source is not distinct from f.source group by r)
select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
 (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
 (len(ws) < {MIN_WORDS} or 100 * coalesce(rep.n, 0) > {MAX_REPEATED_PERCENT} * len(ws)) as base_failed,
 coalesce(ln, 0)::bigint as lost_lines, coalesce(lw, 0)::bigint as lost_words,
 (not (len(ws) < {MIN_WORDS} or 100 * coalesce(rep.n, 0) > {MAX_REPEATED_PERCENT} * len(ws)) and coalesce(lw, 0) <= {MAX_LOST} * len(ws)) as kept
from w left join rep using (r) left join lost using (r)
"""
