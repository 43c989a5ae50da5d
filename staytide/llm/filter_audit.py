"""Filter interaction audit: count-weighted decision diagrams of failure masks, read in every order of the filters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.llm.text import filled, words

#: What a leaf of a diagram counts: all documents, those of good quality, toxic ones.
Weight = tuple[int, int, int]


def conditions(text: Column) -> dict[str, Column]:
    """The registered query's failure conditions that one text decides: few words, few distinct words, many capitals,
    a sign. ``text`` has no nulls."""
    w = words(text)
    return {"A": F.size(w) < 50, "B": 100 * F.size(F.array_distinct(w)) < 65 * F.size(w),
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}


#: The filter that looks at the whole table: a smaller id has the same text.
REPEATED = "E"


class Diagram:
    """A reduced decision diagram over failure bits whose leaves hold counts.

    A node is (filter, passed, failed); equal nodes are one. Leaves are count
    vectors; a subgraph without documents is the empty leaf, whatever filters
    are left. The weight of a node is the sum of the leaves below it.
    """

    EMPTY: Weight = (0, 0, 0)

    def __init__(self, order: str, counts: Mapping[int, Weight]):
        """``counts``: weight per failure mask, bit i for the i-th filter of ``order``."""
        self.order = list(order)
        self._nodes: dict[tuple, tuple] = {}
        self._weights: dict[tuple, Weight] = {}
        self.root = self._built(0, 0, counts)

    def _built(self, level: int, mask: int, counts: Mapping[int, Weight]) -> tuple:
        if level == len(self.order):
            return counts.get(mask, self.EMPTY)
        return self._node(self.order[level], self._built(level + 1, mask, counts),
                          self._built(level + 1, mask | 1 << level, counts))

    def _node(self, name: str, passed: tuple, failed: tuple) -> tuple:
        if passed == failed == self.EMPTY:
            return self.EMPTY
        key = (name, id(passed), id(failed)) if isinstance(passed[0], str) or isinstance(failed[0], str) else (name, passed, failed)
        return self._nodes.setdefault(key, (name, passed, failed))

    def weight(self, node: tuple) -> Weight:
        """Documents below a node, summed once per node."""
        if not isinstance(node[0], str):
            return node
        key = id(node)
        if key not in self._weights:
            self._weights[key] = tuple(map(sum, zip(self.weight(node[1]), self.weight(node[2]))))
        return self._weights[key]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next; nodes above are rebuilt on the way, those below stay."""
        x, y = self.order[level], self.order[level + 1]

        def branches(node: tuple, name: str) -> tuple[tuple, tuple]:
            return (node[1], node[2]) if node[0] == name else (self.EMPTY, self.EMPTY)

        def exchanged(node: tuple, depth: int) -> tuple:
            if node == self.EMPTY:
                return node
            if depth < level:
                return self._node(node[0], exchanged(node[1], depth + 1), exchanged(node[2], depth + 1))
            (pp, pf), (fp, ff) = (branches(child, y) for child in branches(node, x))
            return self._node(y, self._node(x, pp, fp), self._node(x, pf, ff))

        self.root = exchanged(self.root, 0)
        self.order[level], self.order[level + 1] = y, x

    def path(self) -> Iterator[tuple[str, Weight, Weight]]:
        """Along the path on which every filter passes: filter, weight kept, weight removed."""
        node = self.root
        for name in self.order:
            passed, failed = (node[1], node[2]) if node != self.EMPTY else (self.EMPTY, self.EMPTY)
            yield name, self.weight(passed), self.weight(failed)
            node = passed


def adjacent_orders(n: int) -> Iterator[int]:
    """Places (left of the pair) of adjacent swaps that visit every order of ``n`` things once, the last of them
    walking back and forth through the orders of the others."""
    if n < 2:
        return
    inner, down = adjacent_orders(n - 1), True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


def audit_steps(filters: str, counts: Mapping[int, Weight]) -> list[tuple]:
    """For every order of ``filters`` and step: order, step, filter, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. ``counts``: weight per failure mask, bit i for the i-th filter."""
    diagram = Diagram(filters, counts)
    rows, shapley, failing, alone = [], dict.fromkeys(filters, 0), {}, {}
    moves = adjacent_orders(len(filters))
    while True:
        steps = list(diagram.path())
        failing.setdefault(steps[0][0], steps[0][2][0])  # the first filter meets all that fail it
        alone.setdefault(steps[-1][0], steps[-1][2][0])  # the last one only those that pass all others
        for k, (name, kept, removed) in enumerate(steps):
            rows.append(("".join(diagram.order), k + 1, name, kept[0], *removed))
            shapley[name] += removed[0]
        place = next(moves, None)
        if place is None:
            break
        diagram.swap(place)
    return [(order, step, name, kept, n, failing[name] - n, alone[name], good, toxic, shapley[name])
            for order, step, name, kept, n, good, toxic in rows]


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part``, ``mask`` (bit i: fails the i-th of :func:`conditions`, the last bit: a smaller id has the same text)
    and the documents ``n``, ``good``, ``toxic`` of each.

    Texts are read once; what is shuffled is a digest, an id and a mask. Rows
    are first summed per (digest, part, id), then per (digest, part) with the
    smallest id's own sums beside the totals, so that neither a hot part nor a
    text with very many copies meets one task.
    """
    text = filled(F.col("text"))
    found = conditions(text)
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(found.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    marks = (labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("l_id"))
             .agg(F.max((F.col("quality") == 1).cast("long")).alias("q"), F.max((F.col("toxic") == 1).cast("long")).alias("t")))
    own = (rows.groupBy("digest", "part", "doc_id").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
           .join(marks, F.col("doc_id") == F.col("l_id"), "left")
           .select("digest", "part", "doc_id", "mask", "n", (F.col("n") * F.coalesce("q", F.lit(0))).alias("good"),
                   (F.col("n") * F.coalesce("t", F.lit(0))).alias("toxic")))
    counted, least = ["n", "good", "toxic"], F.struct("doc_id", "n", "good", "toxic")
    has_id = F.col("doc_id").isNotNull()
    texts = own.groupBy("digest", "part").agg(
        F.first("mask").alias("mask"), F.min(F.when(has_id, least)).alias("first"),
        *[F.sum(c).alias(c) for c in counted], *[F.sum(F.when(~has_id, F.col(c)).otherwise(0)).alias(f"no_id_{c}") for c in counted])
    smallest = texts.groupBy(F.col("digest").alias("d")).agg(F.min("first.doc_id").alias("smallest"))
    holds = F.coalesce(F.col("first.doc_id") == F.col("smallest"), F.lit(False))
    passed = {c: F.col(f"no_id_{c}") + F.when(holds, F.col(f"first.{c}")).otherwise(0) for c in counted}
    split = texts.join(smallest, F.col("digest") == F.col("d")).select("part", F.explode(F.array(
        F.struct("mask", *[passed[c].alias(c) for c in counted]),
        F.struct((F.col("mask") + (1 << len(found))).alias("mask"), *[(F.col(c) - passed[c]).alias(c) for c in counted]))).alias("x"))
    return (split.groupBy("part", F.col("x.mask").alias("mask")).agg(*[F.sum(f"x.{c}").alias(c) for c in counted]))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: ``part``, ``filter_order``, ``step``, ``filter`` and the
    counts of :func:`audit_steps`.

    Reads ``doc_id``, ``text`` and ``part`` of ``docs`` and ``doc_id``, ``quality``, ``toxic`` of ``labels``; other
    columns are not read. A null text counts as empty, a null part as the empty string. A null id is neither smaller
    nor greater than any: such a row never fails the last filter and has no label. Repeated rows count each; equal ids
    with equal texts do not fail one another. Of a repeated label any 1 counts. An empty table has no parts, so no rows.

    A part's counts are at most one row per mask; its diagram is built where its counts meet.
    """
    filters = "".join(conditions(F.lit(""))) + REPEATED
    names = ["filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def diagrams(rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples()}
        out = pd.DataFrame(audit_steps(filters, counts), columns=names)
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    kinds = ", ".join(f"{n} {'string' if n.startswith('filter') else 'int' if n == 'step' else 'long'}" for n in names)
    return failure_counts(docs, labels, part).groupBy("part").applyInPandas(diagrams, f"part string, {kinds}")


def _sql() -> str:
    """DuckDB: every order applied to the masks by plain sums; the orders are the one thing written out."""
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))
    return rf"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as part from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
least as (select text, min(doc_id) as smallest from d group by text),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
f as (select w.part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
        (len(w.w) < 50)::int as a, (100 * len(list_distinct(w.w)) < 65 * len(w.w))::int as b,
        (100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 5 * length(w.text))::int as c,
        regexp_matches(w.text, '[#$%&*|]')::int as d, coalesce(w.doc_id > least.smallest, false)::int as e
      from w join least on least.text = w.text left join l on l.doc_id = w.doc_id),
m as (select part, a + 2 * b + 4 * c + 8 * d + 16 * e as mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
o as (select col0 as filter_order from (values {orders}) v),
s as (select filter_order, step, 1 << (ascii(filter_order[step]) - 65) as bit,
        list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) as earlier
      from o, (values (1), (2), (3), (4), (5)) v(step)),
c as (select part, filter_order, step, any_value(bit) as bit,
        sum(n) filter (where mask & (bit | coalesce(earlier, 0)) = 0) as kept,
        sum(n) filter (where mask & bit > 0 and mask & coalesce(earlier, 0) = 0) as removed,
        sum(n) filter (where mask & bit > 0 and mask & coalesce(earlier, 0) > 0) as redundant,
        sum(n) filter (where mask = bit) as unique_fails,
        sum(good) filter (where mask & bit > 0 and mask & coalesce(earlier, 0) = 0) as good_lost,
        sum(toxic) filter (where mask & bit > 0 and mask & coalesce(earlier, 0) = 0) as toxic_lost
      from m, s group by part, filter_order, step)
select part, filter_order, step::int as step, filter_order[step] as filter, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
       coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
       coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       (sum(coalesce(removed, 0)) over (partition by part, bit))::bigint as shapley
from c"""


SQL = _sql()
