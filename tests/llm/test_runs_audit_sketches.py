"""Periodic runs, filter audit and HyperMinHash against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
import xxhash

from staytide.llm import filter_audit, hyperminhash, periodic_runs, queries
from test_operators import DOCS, ROWS, body, components, docs, edited, empty  # noqa: F401  the fixtures are used by name

LABELS = "doc_id bigint, quality int, toxic int"


def split(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# --- periodic runs -----------------------------------------------------------------

def all_runs(w: list) -> list[tuple[int, int, int]]:
    """Maximal stretches of equal words q apart, for every q; of one interval the smallest period."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), (i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("kind", range(4))
def test_runs_equal_brute_force(kind):
    draw = np.random.default_rng(kind)
    for _ in range(400):
        w = draw.integers(0, draw.integers(1, 5), draw.integers(0, 70))
        if kind == 1 and len(w):
            a = int(draw.integers(0, len(w)))
            p = 1 + int(draw.integers(0, (len(w) - a) // 4 + 1))
            w[a:] = w[a + np.arange(len(w) - a) % p]
        if kind == 2:
            u = draw.integers(0, 3, draw.integers(1, 6))
            w = np.concatenate([w, np.tile(u, 6), w, np.tile(u, 5), draw.integers(0, 3, 4)])
        if kind == 3:
            v = np.append(np.tile(draw.integers(0, 2, draw.integers(1, 4)), draw.integers(3, 6)), 5)
            w = np.concatenate([np.tile(v, 5), w, np.tile(v, 4)])
        assert periodic_runs.runs_of(w) == all_runs(w.tolist())


def test_grammar_derives_its_text_and_leaves_no_pair_twice():
    draw = np.random.default_rng(9)
    for _ in range(200):
        ids = draw.integers(0, 4, draw.integers(1, 80)).tolist()
        if len(ids) > 9:
            ids[5] = -1
        g = periodic_runs.Grammar(ids)
        spell = lambda s: [s] if s < g.base else spell(g.rules[s - g.base][0]) + spell(g.rules[s - g.base][1])
        assert [x for _, s in g.start for x in spell(s)] == [x for x in ids if x >= 0]
        assert all(ids[i:i + g.lengths[s]] == spell(s) for s, at in g.occurrences().items() for i in at)
        seen, last = Counter(), None
        for (i, a), (j, b) in zip(g.start, g.start[1:]):
            pair = (a, b) if i + g.lengths[a] == j else None
            overlapping = pair is not None and a == b and last == pair
            if pair is not None and not overlapping:
                seen[pair] += 1
            last = None if overlapping else pair
        assert max(seen.values(), default=0) < 2


def test_long_runs_of_one_word_and_of_one_phrase():
    assert periodic_runs.runs_of(np.zeros(30_000, dtype=np.int64)) == [(0, 30_000, 1)]
    assert periodic_runs.runs_of(np.tile(np.arange(500), 20)) == [(0, 10_000, 500)]


def test_periodic_runs_of_documents(table, docs, empty):  # noqa: F811
    got = [r for r in periodic_runs.periodic_runs(docs).collect()]
    assert len(got) == len(ROWS) and periodic_runs.periodic_runs(empty).count() == 0
    assert Counter((r.doc_id, r.n_words, r.collapsed) for r in got)[5, 80, body(5, 80)] == 2
    blank = [r for r in got if r.doc_id in (2, 3, 4)]
    assert all((r.n_words, r.runs, r.collapsed) == (0, [], "") for r in blank)
    text = "x " + "a b c " * 5 + "y\n" + "z\t" * 7 + "end"
    r = periodic_runs.periodic_runs(table("doc_id bigint, text string, runs string", (1, text, "r"))).first()
    assert [tuple(x) for x in r.runs] == [(1, 15, 3), (17, 7, 1)] and r.collapsed == "x a b c y z end"


def test_registered_runs_equal_brute_force(spark, tmp_path):
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(list("abcdefgh"), draw.integers(0, 60))) for _ in range(150)] + [None, "", " \n", body(1, 300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "p q " * 12), (3, texts[3])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    want, periodic = [], 0
    for i, t in rows:
        w = split(t)
        n, h = len(w), zlib.crc32(("" if i is None else str(i)).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, periodic = g % n, periodic + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = all_runs(w)
        dropped = {k for s, size, q in runs for k in range(s + q, s + size)}
        top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
                     digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in dropped))))
    assert periodic > 5 and Counter(map(tuple, got)) == Counter(want)


# --- filter audit --------------------------------------------------------------------

def test_adjacent_swaps_visit_every_order_once():
    for n in range(1, 6):
        order = list(range(n))
        seen = {tuple(order)}
        for place in filter_audit.adjacent_orders(n):
            order[place:place + 2] = order[place + 1], order[place]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_swaps_keep_the_counts_and_share_nodes():
    draw = np.random.default_rng(0)
    counts = {int(m): tuple(map(int, draw.integers(0, 4, 3))) for m in draw.choice(16, 11, replace=False)}
    diagram = filter_audit.Diagram("ABCD", counts)
    for place in filter_audit.adjacent_orders(4):
        diagram.swap(place)

        def leaf(node, mask, depth=0):
            while depth < 4 and node != diagram.EMPTY:
                node = node[2 if mask >> "ABCD".index(diagram.order[depth]) & 1 else 1]
                depth += 1
            return node
        assert all(leaf(diagram.root, m) == counts.get(m, diagram.EMPTY) for m in range(16))
    equal = filter_audit.Diagram("ABC", {m: (1, 0, 0) for m in range(8)})
    assert equal.root[1] is equal.root[2] and equal.weight(equal.root) == (8, 0, 0)


def test_audit_equals_applying_the_filters(table, docs, empty):  # noqa: F811
    marks = [(2, 1, 0), (5, 1, 1), (6, 0, 1), (7, 1, None), (7, 0, 0), (20, 1, 0), (None, 1, 1), (99, 1, 1), (40, 1, 1)]
    labels = table(LABELS, *marks)
    assert filter_audit.filter_audit(empty, labels).count() == 0
    rows = [*ROWS, (50, "Some CAPITALS # " + body(1, 60), "en", None, 1), (51, body(5, 80), "en", "g", 1)]
    extra = table(f"{DOCS}, part string, filter string, mask int", *[(*r, "p", "f", 9) for r in rows]).repartition(4)
    good = {i: max(q == 1 for j, q, _ in marks if j == i) for i, *_ in marks if i is not None}
    toxic = {i: max(t == 1 for j, _, t in marks if j == i) for i, *_ in marks if i is not None}
    failing = []
    for i, text, _, source, _ in rows:
        t, w = text or "", split(text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)}
        failing.append((source or "", {k for k, v in fails.items() if v}, good.get(i, 0), toxic.get(i, 0)))
    want, total = {}, Counter()
    for part in {p for p, *_ in failing}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in failing if f[0] == part]
            for step, name in enumerate(order):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                total[part, name] += len(gone)
                want[part, order, step + 1] = (name, len(left), len(gone), sum(f[0] == part and name in f[1] for f in failing) - len(gone),
                                               sum(f[0] == part and f[1] == {name} for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone))
    got = filter_audit.filter_audit(extra, labels).collect()
    assert {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for r in got} == want
    assert len(got) == len(want) and all(r.shapley == total[r.part, r.filter] for r in got)


# --- HyperMinHash ----------------------------------------------------------------------

def test_registers_hold_zeros_and_mantissa_of_the_smallest_hash():
    draw = np.random.default_rng(1)
    for n in (1, 7, 300, 5000):
        hashes = np.unique(np.append(draw.integers(0, 1 << 64, n, dtype=np.uint64), [np.uint64(0), np.uint64((1 << 64) - 1)]))
        least: dict[int, int] = {}
        for h in map(int, hashes):
            value = h & ((1 << 56) - 1)
            least[h >> 56] = min(value, least.get(h >> 56, value))
        want = [0] * 256
        for r, value in least.items():
            bits = f"{value:056b}".lstrip("0")
            want[r] = 1 + (min(56 - len(bits), 62) << 10) + int((bits[1:] + "0" * 10)[:10], 2)
        assert hyperminhash.registers(hashes).tolist() == want


def test_estimates_are_near_and_corrected():
    draw = np.random.default_rng(2)
    for n, shared in ((40, 36), (600, 540), (5000, 4500), (20_000, 17_000)):
        x = draw.integers(0, 1 << 64, 2 * n - shared, dtype=np.uint64)
        one, two = (hyperminhash.registers(np.unique(s)) for s in (x[:n], x[n - shared:]))
        at, e = hyperminhash.estimate(one, two[None, :], np.asarray([n]), np.asarray([n]), 80)
        true = shared / (2 * n - shared)
        assert len(at) == 1 and abs(e[0] - true) < 5 * (true * (1 - true) / min(256, n)) ** 0.5
    # Sets without a common hash agree by chance about as often as the correction says.
    agree = expected = 0.0
    for _ in range(300):
        one, two = (hyperminhash.registers(np.unique(draw.integers(0, 1 << 64, 4000, dtype=np.uint64))) for _ in range(2))
        agree += ((one == two) & (one > 0)).sum()
        expected += hyperminhash.collisions(np.asarray([4000.0]), np.asarray([4000.0]))[0]
    assert abs(agree - expected) < 5 * expected ** 0.5


def jaccard_classes(texts, size, percent=80):
    sets = []
    for t in texts:
        w = [x.lower() for x in split(t)]
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)
             if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, pairs, components(pairs)


@pytest.mark.parametrize("chunk", [2048, 8])
def test_near_duplicates_equal_brute_force_jaccard(spark, monkeypatch, chunk):
    whole = hyperminhash.bucket_pairs
    monkeypatch.setattr(hyperminhash, "bucket_pairs", lambda members, percent: whole(members, percent, chunk, 50 * chunk))
    texts = [edited(seed, words, edits) for seed, words in ((s, (12, 30, 80, 200, 600)[s % 5]) for s in range(20)) for edits in (0, 1, 2, 3, 5, 8)]
    texts += [edited(77, 120, e) + f" v{k}" for k in range(40) for e in (2, 4)]
    texts += [body(900 + i, 30) + " a line that many texts share " * 2 for i in range(40)]
    texts += [edited(3, 200, 0).upper(), "a b", "A  b", "a b c d", None, "", " \n"]
    sets, pairs, root = jaccard_classes(texts, 4)
    frame = spark.createDataFrame([(i, t, -1, True) for i, t in enumerate(texts)], "doc_id bigint, text string, n int, kept boolean").repartition(5)
    got = {r.doc_id: r for r in hyperminhash.near_duplicates(frame, size=4).collect()}
    assert len(pairs) > 100 and len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), root.get(i, i), root.get(i, i) == i)


def test_near_duplicates_with_null_and_repeated_ids(docs, empty):  # noqa: F811
    rows = hyperminhash.near_duplicates(docs).collect()
    assert hyperminhash.near_duplicates(empty).count() == 0 and len(rows) == len(ROWS)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[None] == [(62, None, True)] and got[5] == [(76, 5, True)] * 2 and got[6] == [(76, 5, False)]
    assert [got[i] for i in (2, 3, 4)] == [[(0, i, True)] for i in (2, 3, 4)]
    assert got[8] == [(1, 8, True)] and got[9] == [(1, 8, False)]


def test_set_names_are_hashes_of_the_whole_set(table):
    one, two = hyperminhash.sketches(table("doc_id bigint, text string", (1, "A b c d e f"), (2, "a B c d\te f")), 5).orderBy("doc_id").collect()
    grams = sorted(xxhash.xxh64_intdigest(g.encode(), 42) for g in ("a b c d e", "b c d e f"))
    name = xxhash.xxh64_intdigest(np.asarray(grams, dtype=np.uint64).tobytes(), 42)
    assert one.s == two.s == (name - (1 << 64) if name >> 63 else name) and one.n == 2


def test_whole_sets_meet_only_in_the_first_bucket_that_a_pair_shares(spark, monkeypatch):
    """Sketches and sets join the members of buckets whose components differ; near copies share many buckets and meet in few."""
    called, whole = [], hyperminhash.bucket_pairs
    monkeypatch.setattr(hyperminhash, "bucket_pairs", lambda members, percent: called.append(members) or whole(members, percent))
    texts = [edited(seed, 200, edits) for seed in range(12) for edits in (0, 3, 6, 9, 12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    _, pairs, root = jaccard_classes(texts, 4)
    got = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(frame, size=4).collect()}
    assert pairs and got == {i: root.get(i, i) for i in range(len(texts))}
    first, second = called
    assert all("sketch" not in m.buckets.columns and "shingles" not in m.buckets.columns for m in called)
    again = second.buckets.select("s", "key").distinct().collect()
    near = {r.s for r in again}
    before = [r for r in first.buckets.select("s", "key").distinct().collect() if r.s in near]
    assert near and 2 * len(again) < len(before)
