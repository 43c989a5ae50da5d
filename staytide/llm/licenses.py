"""License scan: exact containment join of text blocks with templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.text import SPACE_CHARS, filled, lower_ascii, spread_lookup
from staytide.sources.tables import checkpointed

#: Phrases whose places are counted, with their labels: the parameters of the registered query.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Texts whose words a block must contain, with their labels.
TEMPLATES = {
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "gpl-3": ["licensed under the gnu general public license version 3"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
    "proprietary": ["all rights reserved"],
}
#: Everything that is no word: ASCII but for digits and letters.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def _wrapped(text: Column, reach: int) -> Column:
    """Word windows over line ends: of every paragraph (lines up to a blank one)
    of several lines, 2 * ``reach`` words from every ``reach``-th on, so that
    any run of ``reach`` words lies in one window."""
    paragraphs = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.contains(F.btrim(p, F.lit(SPACE_CHARS)), F.lit("\n")))
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - reach - 1, F.lit(0)), F.lit(reach))
    return F.flatten(F.transform(F.transform(paragraphs, _split),
                                 lambda w: F.transform(starts(w), lambda i: F.slice(w, i + 1, 2 * reach))))


def _places(phrase: str) -> Column:
    """Starts of a phrase's words in ``words``, counted from 0. Only texts that hold the phrase's words side by side look."""
    parts = phrase.split()
    steps = F.sequence(F.lit(0), F.greatest(F.size("words") - len(parts), F.lit(0)))
    same = lambda i: F.slice("words", i + 1, len(parts)) == F.array(*map(F.lit, parts))
    held = F.contains("joined", F.lit(f" {phrase} ")) & (F.size("words") >= len(parts))
    return F.when(held, F.filter(steps, same)).otherwise(F.array().cast("array<int>"))


def _sets(templates: Mapping[str, Sequence[str]], threshold: float) -> list[tuple[str, list[str], int]]:
    """Label, distinct tokens and tokens needed of every template."""
    sets = [(label, sorted(set(text.split()))) for label, texts in sorted(templates.items()) for text in texts]
    return [(label, tokens, max(1, ceil(threshold * len(tokens) - 1e-9))) for label, tokens in sets]


def template_matches(blocks: DataFrame, counts: Mapping[str, int], templates: Mapping[str, Sequence[str]],
                     threshold: float) -> DataFrame:
    """All pairs of a block (``row``, ``block``, distinct ``tokens``) and a template with containment
    |block and template| / |template| of at least ``threshold``: ``row``, ``block``, ``label``, ``containment``.

    Tokens are put in one order for all: rare first by ``counts``, the documents
    that hold a token. Of a template with n tokens, k = ceil(threshold * n) must
    occur, so one of its n - k + 1 first tokens must, and the block needs k
    tokens (length filter). Where the first shared token is token i of the
    template and token j of the block, the pair is dropped unless
    1 + min(n - 1 - i, m - 1 - j) reaches k (positional filter). Survivors are intersected.
    """
    spark = blocks.sparkSession
    order = sorted({t for _, tokens, _ in _sets(templates, threshold) for t in tokens}, key=lambda t: (counts.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    rows = []
    for number, (label, tokens, need) in enumerate(_sets(templates, threshold)):
        tokens = sorted(tokens, key=rank.__getitem__)
        rows += [(number, label, tokens, len(tokens), need, t, i) for i, t in enumerate(tokens[:len(tokens) - need + 1])]
    prefixes = spark.createDataFrame(rows, "number int, label string, wanted array<string>, n int, need int, token string, i int")
    # Only template tokens can match; a block's are put in the common order.
    ordered = blocks.select("row", "block", F.size("tokens").alias("m"),
                            F.array_intersect(F.array(*map(F.lit, order)), F.col("tokens")).alias("shared"))
    met = ordered.filter(F.size("shared") > 0).select("row", "block", "m", "shared", F.posexplode("shared").alias("j", "token"))
    pairs = (met.join(F.broadcast(prefixes), "token")
             .filter((F.col("m") >= F.col("need"))
                     & (1 + F.least(F.col("n") - 1 - F.col("i"), F.size("shared") - 1 - F.col("j")) >= F.col("need"))))
    overlap = F.size(F.array_intersect("shared", "wanted"))
    first = F.get(F.array_intersect("wanted", F.col("shared")), F.lit(0)) == F.col("token")
    return (pairs.filter(first & (overlap >= F.col("need")))
            .select("row", "block", "label", (overlap / F.col("n")).alias("containment")))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, Sequence[str]] = TEMPLATES,
         threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``).

    ``n_base`` counts the places where a phrase's words stand consecutively,
    ``first_word`` and ``last_word`` are their smallest and largest start,
    ``base_labels`` the phrases' labels; ``labels`` adds those of the templates
    that a block contains to ``threshold`` at least; ``score`` is the greatest
    containment found, 1 with a phrase, else 0. Blocks are the lines and, for
    texts wrapped over several lines, windows of a paragraph's words of twice
    the longest template's length. Null texts count as
    empty: no words, null starts, no labels. Repeated rows are judged each;
    other columns are not read.
    """
    rows = docs.select("doc_id", F.md5(filled(F.col("text"))).alias("row"), lower_ascii(filled(F.col("text"))).alias("text"))
    sets = _sets(templates, threshold)
    wanted = F.array(*map(F.lit, sorted({t for _, tokens, _ in sets for t in tokens})))
    words = rows.withColumn("words", _split(F.col("text"))).withColumn(
        "joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    # A text holds a block's tokens, so one without enough tokens of any template has no block with enough.
    words = words.withColumn("held", F.array_intersect(wanted, F.col("words")))
    enough = F.lit(False)
    for _, tokens, need in sets:
        enough = enough | (F.size(F.array_intersect("held", F.array(*map(F.lit, tokens)))) >= need)
    found = {label: _places(phrase) for phrase, label in phrases.items()}
    places = words.select("doc_id", "row", F.size("words").cast("bigint").alias("n_words"), "held", F.when(enough, F.col("text")).alias("text"),
                          *[p.alias(f"p{i}") for i, p in enumerate(found.values())])
    names = [F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(found)]
    places = places.select("doc_id", "row", "n_words", "held", "text",
                           F.flatten(F.array(*[f"p{i}" for i in range(len(found))])).alias("places"),
                           F.array_compact(F.array(*names)).alias("base"))
    places = checkpointed(places)
    # As many counts as the templates have tokens.
    counts = {r[0]: r[1] for r in places.select(F.explode("held").alias("t")).groupBy("t").count().collect()}
    reach = max((len(t.split()) for texts in templates.values() for t in texts), default=1)
    parts = F.concat(F.transform(F.split("text", "\n"), _split), _wrapped(F.col("text"), reach))
    blocks = places.filter("text is not null").select("row", F.posexplode(parts).alias("block", "part"))
    blocks = blocks.select("row", "block", F.array_distinct("part").alias("tokens"))
    matches = template_matches(blocks.filter(F.size("tokens") >= min((need for *_, need in sets), default=1)), counts, templates, threshold)
    best = checkpointed(matches.groupBy(F.col("row").alias("r"))
                        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment")))
    base = F.array_join(F.array_sort(F.array_distinct("base")), ",")
    labels = F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",")
    return (spread_lookup(places, best, "row", "r", "doc_id")
            .select("doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
                    F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
                    base.alias("base_labels"), labels.alias("labels"),
                    F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score")))
