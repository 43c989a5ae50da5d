"""Quality rules by cross-document line frequency, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.text import SPACE, SPACE_CHARS, filled, kept_rows, lookup, words
from staytide.sources.tables import checkpointed

_SYMBOLS = "[#*$%&|<>]"
_KEY = ["doc_id", "source", "digest"]


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(_bare(line)))


def _with_signals(rows: DataFrame) -> DataFrame:
    """Counts of one text, row by row.

    Three-word windows are compared by 64-bit hash inside one document only.
    Sorting (hash, position) puts equal windows side by side; documents whose
    windows all differ skip the sort. ``lines`` has the hash, length and words of
    each normalised line: lower case, without blanks at its ends.
    """
    rows = rows.withColumns({"w": words(F.col("text")),
                             "full_lines": F.filter(F.split("text", "\n"), lambda x: _bare(x) != "")})
    rows = rows.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    windows = F.transform(F.slice("hashes", 1, F.greatest(F.size("hashes") - 2, F.lit(0))),
                          lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2)))
    rows = rows.withColumn("windows", windows)
    rows = rows.withColumn("ordered", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("ordered", lambda x, k: F.coalesce(F.get("ordered", k + 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get("ordered", k - 1)["h"] == x["h"], F.lit(False)))
    places = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return rows.select(
        "doc_id", "source", F.md5("text").alias("digest"), F.length("text").alias("n_chars"),
        F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("ordered").isNull(), 0).otherwise(F.size(F.array_distinct(places))).cast("bigint")
        .alias("n_repeat_words"),
        F.transform("full_lines", lambda x: F.struct(_line_hash(x).alias("line"), F.length(F.lower(_bare(x))).alias("n"),
                                                    F.size(F.split(_bare(x), SPACE)).alias("w"))).alias("lines"))


def line_quality(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_line_docs: int = 10,
                 max_removed_share: float = 0.5, salts: int = 8) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``, ``source``) with its counts and verdict.

    Base rule: a document fails with fewer than ``min_words`` words or with more
    than ``max_repeat_percent`` % of its words in repeated three-word windows.

    Line rule: lines are normalised and hashed; for every host (``source``) the
    distinct documents with a line are counted, copies of one text counting
    once. Lines in at least ``min_line_docs`` documents are removed, whatever the
    size of the host. A document is depleted, and rejected, if it loses more than
    ``max_removed_share`` of its characters or keeps fewer than ``min_words`` words.

    Null or empty texts have no words and fail the base rule. A null host is a
    host of its own. Repeated rows get the same verdict each. Other columns of
    ``docs`` are not read. ``hot_lines`` are the hashes of a row's frequent
    lines, null without any, for :func:`without_lines`.

    The texts are read once; later steps read a written table of hashes. Counts
    are aggregated before the shuffle, and the look-up of frequent lines is
    salted, so that neither a hot host nor a hot line meets one task.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), filled(F.col("text")).alias("text"))
    signals = checkpointed(_with_signals(rows))
    placed = signals.select(*_KEY, F.posexplode("lines").alias("pos", "l")).select(
        *_KEY, "pos", F.col("l")["line"].alias("line"), F.col("l")["n"].alias("n"), F.col("l")["w"].alias("w"))
    frequent = checkpointed(
        placed.select("source", "line", "digest").distinct()
        .groupBy(F.col("source").alias("host"), F.col("line").alias("hot_line")).agg(F.count("*").alias("docs"))
        .filter(F.col("docs") >= min_line_docs)
        .select("host", "hot_line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    hits = placed.join(frequent, (F.col("line") == F.col("hot_line")) & F.col("source").eqNullSafe(F.col("host"))
                       & (F.pmod(F.xxhash64("doc_id", "digest", "pos"), F.lit(salts)) == F.col("salt")))
    removed = (hits.select(*_KEY, "pos", "line", "n", "w").dropDuplicates([*_KEY, "pos"])
               .groupBy(*[F.col(c).alias(f"r_{c}") for c in _KEY])
               .agg(F.sum("n").alias("removed_chars"), F.sum("w").alias("removed_words"), F.count("*").alias("removed_lines"),
                    F.array_sort(F.collect_set("line")).alias("hot_lines")))
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in _KEY]
    n = F.col("n_words")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)
    cut, gone = (F.coalesce(F.col(c), F.lit(0)) for c in ("removed_chars", "removed_words"))
    whole = (cut <= F.lit(max_removed_share) * F.col("n_chars")) & (n - gone >= min_words)
    return (signals.drop("lines").join(removed, same[0] & same[1] & same[2], "left")
            .select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), cut.cast("bigint").alias("removed_chars"),
                    F.coalesce("removed_lines", F.lit(0)).cast("bigint").alias("removed_lines"),
                    (~failed & whole).alias("kept"), "digest", "hot_lines"))


def without_lines(text: Column, hot_lines: Column) -> Column:
    """The text without the lines whose normalised form has one of the hashes; blank lines and order stay."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(hot_lines, _line_hash(x))), "\n")


def keep_good(docs: DataFrame, **settings: object) -> DataFrame:
    """The rows of ``docs`` that :func:`line_quality` keeps, with all their
    columns; ``text`` comes without the frequent lines of its host. Other
    columns, a length among them, stay as delivered."""
    verdicts = checkpointed(line_quality(docs, **settings).filter(~F.col("kept") | F.col("hot_lines").isNotNull())
                            .select(*[F.col(c).alias(f"r_{c}") for c in _KEY], "kept", "hot_lines").distinct())
    rejected = verdicts.filter(~F.col("kept")).select(*[f"r_{c}" for c in _KEY])
    cut = verdicts.filter("kept").select(*[f"r_{c}" for c in _KEY], "hot_lines")
    rows = kept_rows(docs).withColumn("digest", F.md5(filled(F.col("doc.text"))))
    same = (F.col("doc.doc_id").eqNullSafe(F.col("r_doc_id")) & F.col("doc.source").eqNullSafe(F.col("r_source"))
            & (F.col("digest") == F.col("r_digest")))
    rows = rows.join(lookup(rejected), same, "left_anti")
    # A broadcast holds the hashes too, so they count as rows of their own.
    hashes = cut.agg(F.coalesce(F.sum(F.size("hot_lines")), F.lit(0))).first()[0]
    rows = rows.join(lookup(cut) if hashes <= 200_000 else cut, same, "left")
    text = F.when(F.col("hot_lines").isNull(), F.col("doc.text")).otherwise(
        without_lines(filled(F.col("doc.text")), F.col("hot_lines")))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


#: DuckDB: the same counts and verdict by plain grouping of the line texts.
SQL = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (select rid, list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> '') as w from d),
tok as (select rid, unnest(w) as word, generate_subscripts(w, 1) as pos from w),
win as (select rid, pos, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o as three
        from tok window o as (partition by rid order by pos)),
rep as (select rid, pos from win where three is not null
        qualify count(*) over (partition by rid, three) > 1),
cover as (select rid, count(distinct pos + k) as n_repeat_words from rep, (values (0), (1), (2)) as v(k) group by rid),
raw as (select rid, unnest(string_split(text, chr(10))) as line from d),
lines as (select rid, line, lower(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) as tidy
          from raw where regexp_matches(line, '[^ 	-
]')),
dups as (select rid, count(*) - count(distinct line) as n_dup_lines from lines group by rid),
freq as (select source, tidy, count(distinct text) as docs from lines join d using (rid) group by source, tidy),
hot as (select source, tidy from freq where docs >= 10),
gone as (select l.rid, sum(length(l.tidy)) as removed_chars, count(*) as removed_lines,
                sum(len(regexp_split_to_array(l.tidy, '[\x20\x09-\x0D]+'))) as removed_words
         from lines l join d using (rid) join hot h on h.tidy = l.tidy and h.source is not distinct from d.source group by l.rid),
n as (select d.doc_id, length(text) as n_chars, len(w.w) as n_words, length(regexp_replace(text, '[ 	-
]+', '', 'g')) as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
        coalesce(removed_chars, 0)::bigint as removed_chars, coalesce(removed_lines, 0) as removed_lines,
        coalesce(removed_words, 0) as removed_words
      from d join w using (rid) left join dups using (rid) left join cover using (rid) left join gone using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and removed_chars <= 0.5 * n_chars and n_words - removed_words >= 50 as kept,
       removed_chars, removed_lines
from n
"""
