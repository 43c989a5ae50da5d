"""Operators on small tables against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import json
import re
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from staytide.llm import licenses, line_quality, mixing, packing, rule_quality, simhash, topk, toxicity, trie_tokens, url_filter
from staytide.llm.components import connected_components, joined_components
from staytide.llm.queries import vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LINE = "every page of this host ends with the same long closing line about cookies and consent"


def body(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in draw.integers(0, 26, draw.integers(3, 9))) for _ in range(n))


ROWS = [
    (None, "a text whose id is missing " + body(1, 60), "en", "h", 1),
    (2, None, None, None, None), (3, "", "en", "h", 0), (4, " \n\t", "en", "h", 3),
    (5, body(5, 80), "en", "h", 1), (5, body(5, 80), "en", "h", 1), (6, body(5, 80), "de", None, 1),
    (7, body(7, 30_000), "fr", "h", 1), (8, "One two", "xx", "g", 7), (9, "ONE two", None, "g", 7),
    *[(20 + i, body(20 + i, 60) + "\n" + LINE, "en", "h", 1) for i in range(12)],
    (40, body(40, 8) + "\n" + "\n".join([LINE] * 4), "en", "h", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    # The extra columns clash with names that the operators use.
    return spark.createDataFrame([(*r, "w", True, -1.0) for r in ROWS], f"{DOCS}, w string, kept boolean, digest double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_line_quality(docs, empty):
    rows = line_quality.line_quality(docs).collect()
    assert len(rows) == len(ROWS) and line_quality.line_quality(empty).count() == 0
    got = {r.doc_id: r for r in rows}
    for i, text in {r[0]: r[1] or "" for r in ROWS}.items():
        words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.strip()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (
            len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert got[20].kept and got[20].removed_lines == 1 and not got[40].kept and got[40].removed_lines == 4
    assert sorted(r[0] for r in line_quality.keep_good(docs).collect() if r[0]) == [5, 5, 6, 7, *range(20, 32)]
    assert line_quality.keep_good(docs).columns == docs.columns


def test_kept_texts_come_without_frequent_lines(table, docs):
    texts = {i: f"{body(i, 30)}\n\n  {LINE.upper()}\t\n{body(100 + i, 30)}\n{LINE}" for i in range(12)}
    rows = [(i, t, "en", "h", 1) for i, t in texts.items()] + [(20, body(20, 60) + "\n" + LINE, "en", "other", 1), (0, texts[0], "en", None, 1)]
    for frame in (table(DOCS, *rows), table(DOCS, *rows).repartition(5)):
        got = {(r.doc_id, r.source): r.text for r in line_quality.keep_good(frame).collect()}
        assert got == {(r[0], r[3]): f"{body(r[0], 30)}\n\n{body(100 + r[0], 30)}" if r[3] == "h" else r[1] for r in rows}
    kept = {r.doc_id: r.text for r in line_quality.keep_good(docs).collect()}
    assert kept[20] == body(20, 60) and kept[7] == body(7, 30_000)


def test_line_limit_does_not_grow_with_the_host(table):
    rows = [(i, body(i, 60), "en", "h", 1) for i in range(700)]
    rows += [(1000 + i, body(1000 + i, 55) + "\n" + LINE, "en", "h", 1) for i in range(10)]
    rows += [(2000 + i, body(2000 + i, 10) + f"\n{LINE} twice\n{LINE} thrice\n{LINE} and again", "en", "h", 1) for i in range(12)]
    got = {r.doc_id: r.text for r in line_quality.keep_good(table(DOCS, *rows)).collect()}
    assert sorted(got) == [*range(700), *range(1000, 1010)] and got[1000] == body(1000, 55)


def test_copies_of_a_text_are_one_document_for_line_counts(table):
    copies = table(DOCS, *[(i, body(3, 70), "en", "h", 1) for i in range(40)])
    assert line_quality.line_quality(copies).filter("kept").count() == 40


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_chains_stars_and_random_graphs(spark):
    draw = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(100, 200)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7)]
    pairs += [tuple(map(int, p)) for p in draw.integers(1000, 1400, (250, 2))]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == components([p for p in pairs if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("cut", [(0, 0), (40, 40), (40, 70), (60, 90), (120, 120)])
def test_components_after_later_links(spark, cut):
    """Links in three lots, empty ones too, join what all at once would."""
    rng = random.Random(sum(cut))
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(120)]
    lots = [spark.createDataFrame(some, "a long, b long") for some in (pairs[:cut[0]], pairs[cut[0]:cut[1]], pairs[cut[1]:])]
    classes = connected_components(lots[0])
    for lot in lots[1:]:
        classes = joined_components(classes, lot)
    rows, groups = classes.collect(), {}
    assert len(rows) == len({r.node for r in rows})
    for r in rows:
        groups.setdefault(r.component, set()).add(r.node)
    want = {}
    for node, root in components([p for p in pairs if p[0] != p[1]]).items():
        want.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert all(name in members for name, members in groups.items())


def test_simhash(docs, empty, spark):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS) and simhash.near_duplicates(empty).count() == 0
    got = {r.doc_id: r for r in rows}
    assert got[2].fingerprint == "0" * 16 and {got[i].component_id for i in (2, 3, 4)} == {2}
    assert got[6].component_id == 5 and got[9].component_id == 8 and got[None].component_id is None
    kept = simhash.keep_one(docs)
    assert sorted(map(str, (r[0] for r in kept.collect()))) == sorted(map(str, [None, 2, 5, 7, 8, *range(20, 32), 40]))
    assert kept.columns == docs.columns


def edited(seed, words, edits):
    """A text of ``words`` words with ``edits`` of them replaced."""
    out, draw = body(seed, words).split(), np.random.default_rng(1000 + 100 * seed + edits)
    for i in draw.choice(words, edits, replace=False):
        out[i] = f"edit{draw.integers(1 << 30)}"
    return " ".join(out)


def test_one_of_each_equals_brute_force_bits(spark):
    texts = [edited(seed, 400, edits) for seed in range(12) for edits in (0, 1, 2, 3)] + [edited(3, 400, 0).upper(), "a b", "A  b", None, ""]
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = components(pairs)
    assert len(pairs) > 10
    frame = spark.createDataFrame([(i, t, "en", "h", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    assert sorted(r[0] for r in simhash.keep_one(frame).collect()) == sorted({root.get(i, i) for i in range(len(texts))})


def test_fingerprint_equals_plain_counting():
    for text in (body(1, 40), "A b\x0bC d\te " + body(2, 9), "one Two", "x " * 500):
        w = [x for x in text.lower().replace("\x0b", " ").replace("\t", " ").split(" ") if x]
        grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
        hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text.encode()) == want


def test_links_equal_brute_force_with_split_buckets(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set(map(int, base))
    for b in base:
        for _ in range(150):
            x = int(b)
            for bit in draw.integers(0, 64, draw.integers(1, 9)):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    want = components(pairs)
    for chunk in (4096, 16):
        edges = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), chunk=chunk)
        assert {r.node: r.component for r in connected_components(edges).collect()} == want


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    assert packing.pack(empty, path).count() == 0
    rows = packing.pack(docs, path).collect()
    tokenizer, want = Tokenizer.from_file(path), []
    for doc_id, text, *_ in ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(doc_id, k, at, len(ids[at:at + 2048]), zlib.crc32(np.asarray(ids[at:at + 2048], "<u4").tobytes()))
                 for k, at in enumerate(range(0, len(ids), 2048))]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_encoder_on_odd_words():
    from tokenizers import Tokenizer
    path = vocabulary("word_bpe_49k.json")
    texts = ["İstanbul 'tis x's a'. ''s ΌΔΟΣ", "<|endoftext|> a <|ENDOFTEXT|>", "é! é́! …. a….. x²!", "a\x1cb \x85 c", "한국어, 각 ﬁ. कि. ŉ!", "",
             "GELDİ. TEŞEKKÜRLERİ!", "\u095f. x\u095f!", "W\u030a. w\u030a!"]
    letters = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x180), *range(0x300, 0x330), *range(0x900, 0x970), *range(0x1E00, 0x1F00),
                                0x130, 0x1F0, 0x3B0, 0xFB01, 0xAC00, 0x5D0, 0x5B0, 0x627, 0x654, 0x212B]]
    draw = random.Random(7)
    for _ in range(20_000):
        texts.append(" ".join("".join(draw.choices(letters, k=draw.randint(1, 5))) + "".join(draw.choices(".,!?;:()", k=draw.randint(0, 2)))
                              for _ in range(draw.randint(1, 4))))
    coded = packing.Encoder(path)([t.encode() for t in texts])
    plain = Tokenizer.from_file(path)
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once_and_is_near_the_bound(seed):
    draw = np.random.default_rng(seed)
    top = (2048, 2048, 600, 40, 2048, 1100)[seed]
    lengths = draw.integers(1, top + 1, 3000).tolist() + [2048] * 5
    plan = packing.Plan(dict(Counter(lengths)), 2048)
    placed = Counter()
    used = defaultdict(int)
    runs = sorted(plan.runs)
    for k, (length, first, sequence, each, _) in enumerate(runs):
        after = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else Counter(lengths)[length]
        for i in range(after - first):
            used[sequence + i // each] += length
        placed[length] += after - first
    assert placed == Counter(lengths) and max(used.values()) <= 2048 and len(used) == plan.sequences
    assert plan.sequences <= 1.03 * -(-sum(lengths) // 2048) + 2 or top == 1100


def test_reduction_is_optimal_where_every_piece_is_fixed():
    plan = packing.Plan({6: 3, 4: 2, 7: 1, 3: 1, 9: 2}, 10)
    assert plan.sequences == 6 and plan.fixed == 6  # 6+4, 6+4, 7+3, 6, 9, 9


def test_top_k(table):
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(draw.integers(-3, 4, (90, 5)) / 64)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")]), (120, [float("inf")]), (None, [9.0]), (140, [2.0]), (140, [2.0]), (160, [])]
    frame = table("vec_id bigint, embedding array<float>, rank string", *[(*r, "x") for r in rows])
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, 4).orderBy("query_id", "rank").collect()]
    vec = {i: (np.floor(64 * np.asarray(v)).astype(int).tolist() + [0] * 5)[:5] for i, v in rows[:90]} | {140: [128, 0, 0, 0, 0], 160: [0] * 5}
    want = []
    for q in sorted(v for v in vec if v % 20 == 0):
        scored = sorted((-int(np.dot(vec[q], vec[c])), c) for c in vec if c != q)[:4]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert got == want
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_looks_at_every_shard_and_every_vector_of_an_id(table, monkeypatch):
    draw = np.random.default_rng(5)
    vec = [(int(i), v.tolist()) for i, v in zip(draw.integers(0, 300, 700), draw.integers(-9, 10, (700, 4)))] + [(20, [9, 9, 9, 9])] * 3
    frame = table("vec_id bigint, embedding array<float>", *[(i, [x / 64 for x in v]) for i, v in vec])
    want = []
    for q in sorted({i for i, _ in vec if i % 20 == 0}):
        best = {}
        for i, v in vec:
            if i != q:
                best[i] = max([best.get(i, -10**9)] + [int(np.dot(v, u)) for j, u in vec if j == q])
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:5])]
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "GROUP", 6)
    plain = type(frame).repartitionByRange
    for shard, raised in ((40, 0), (100_000, 37)):
        monkeypatch.setattr(topk, "SHARD", shard)
        # A session may deal rows to more partitions than asked for.
        monkeypatch.setattr(type(frame), "repartitionByRange", lambda self, n, *c, more=raised: plain(self, max(n, more), *c))
        assert [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect()] == want


def test_pruned_blocks_equal_a_full_search():
    draw = np.random.default_rng(3)
    rows = draw.integers(-20, 20, (600, 8))
    ids = draw.permutation(600)
    blocks = [(ids[i:i + 25], rows[i:i + 25], rows[i:i + 25].max(0), rows[i:i + 25].min(0)) for i in range(0, 600, 25)]
    for b, f in zip(topk.search_blocks(ids[:30], rows[:30], blocks, np.full(30, -np.inf), 7), range(30)):
        want = sorted((-int(s), int(c)) for s, c in zip(rows @ rows[f], ids) if c != ids[f])[:7]
        assert list(zip((-b.scores).tolist(), b.ids.tolist())) == want


def test_token_counts(docs, empty):
    path = vocabulary("piece_bpe_32k.model")
    scores = trie_tokens.unigram_scores(path)
    trie = trie_tokens.SegmentTrie(scores, max_nodes=50)

    def brute(word):
        best = [(0.0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            options = [(best[end - 1][0] + size * trie.byte_score, best[end - 1][1] + size)]
            options += [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in scores]
            best[end] = max(options, key=lambda o: (o[0], -o[1]))
        return best[-1][1]
    for word in ["▁", "▁hello", "▁help", "▁helping", "▁日本語", "▁x𝄞y", "▁" + "ab" * 40]:
        assert trie.count(word) == brute(word)
    got = {r.doc_id: r for r in trie_tokens.token_counts(docs, path).collect()}
    assert len(got) == len({r[0] for r in ROWS}) and (got[2].n_tokens, got[3].n_pretokens, got[4].n_chars) == (0, 0, 3)
    assert got[8].n_tokens == brute("▁One") + brute("▁two") and got[7].n_pretokens == 30_000
    assert trie_tokens.token_counts(empty, path).count() == 0


def test_licenses(table, empty):
    text = "Released under the MIT license.\nCC-BY cc by!\nAll rights, reserved; all RIGHTS reserved"
    frame = table("doc_id bigint, text string, labels string", (1, text, ""), (2, None, ""), (3, "", ""), (None, "released under an old MIT license", ""),
                  (4, "the mit license was released under it", ""), (4, "the mit license was released under it", ""), (5, "cc\ncc by", ""))
    got = defaultdict(list)
    for r in licenses.scan(frame).collect():
        got[r.doc_id].append(r)
    r = got[1][0]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (15, 4, 5, 12, "cc-by,reserved")
    assert r.labels == "cc-by,mit,proprietary,reserved" and r.score == 1.0
    assert tuple(got[2][0])[1:] == (0, 0, None, None, "", "", 0.0) == tuple(got[3][0])[1:]
    assert [x.labels for x in got[4]] == ["mit", "mit"] and got[4][0].score == 1.0
    assert got[None][0].labels == "mit" and got[None][0].score == pytest.approx(0.8)
    assert (got[5][0].n_base, got[5][0].first_word) == (1, 1) and licenses.scan(empty).count() == 0


def test_licenses_wrapped_over_lines(table):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy"
    mit = "Permission is hereby\ngranted, free of charge,\nto any person\nobtaining a copy\nof this software"
    apart = "subject to the terms of the Mozilla Public\n\nLicense, v. 2.0"
    frame = table("doc_id bigint, text string", (1, bsd), (2, mpl), (3, mit), (4, apart), (5, body(1, 95) + "\n" + body(2, 40) + "\n" + bsd + body(3, 50)),
                  (6, "released\n" + body(4, 80) + "\nunder the mit\n" + body(5, 80) + "\nlicense"))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame).collect()}
    assert [got[i] for i in range(1, 7)] == [("bsd", 1.0), ("mpl-2.0", 1.0), ("mit", 1.0), ("", 0.0), ("bsd", 1.0), ("", 0.0)]


def test_template_join_equals_all_pairs(spark):
    draw = np.random.default_rng(4)
    pool = [f"t{i}" for i in range(14)]
    templates = {f"l{k}": [" ".join(draw.choice(pool, draw.integers(2, 9)))] for k in range(6)}
    blocks = [(str(i), 0, sorted(set(draw.choice(pool + ["x", "y"], draw.integers(1, 14)).tolist()))) for i in range(200)]
    frame = spark.createDataFrame(blocks, "row string, block int, tokens array<string>")
    counts = Counter(t for *_, tokens in blocks for t in tokens)
    got = {(r.row, r.label, round(r.containment, 9)) for r in licenses.template_matches(frame, counts, templates, 0.7).collect()}
    want = {(row, label, round(len(set(t) & set(x.split())) / len(set(x.split())), 9)) for row, _, t in blocks
            for label, (x,) in templates.items() if len(set(t) & set(x.split())) >= 0.7 * len(set(x.split())) - 1e-9}
    assert got == want


def test_url_filter(table):
    rules = url_filter.RULES
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "HTTP://A.Example.COM/en/x?q#f", None), (2, "https://www.example.com/en/", ""), (3, None, None), (4, "no scheme", ""),
            (5, "http://x.net", ""), (6, "http://x.net/es/1", ""), (7, "http://notexample.org/a", link.format("http://x.net/es/1")),
            (8, "http://b.org/1", '<meta http-equiv=refresh content="0; url=/2">'), (9, "https://m.b.org/2/?utm_source=q", link.format("http://k.com/ok")),
            (10, "http://c.org/1", link.format("http://x.net/fr/2")), (10, "http://c.org/1", link.format("http://x.net/fr/2")), (11, "http://d.org", "")]
    frame = table("page_id bigint, url string, html string, verdict string", *[(*r, "?") for r in rows])
    got = {r.page_id: r for r in url_filter.filter_urls(frame, rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2].rule == "www.example.com/en/" and got[2].verdict == "allow"
    assert [tuple(got[i])[1:] for i in (3, 4)] == [("", "", None, "allow")] * 2
    assert (got[5].host, got[5].path, got[5].rule) == ("x.net", "", None) and got[6].verdict == "block"
    # 7 is an alias of the blocked 6; 8 leads to 9, which names an allowed page; 10 names a blocked one without a page.
    assert [got[i].verdict for i in (7, 8, 9, 10, 11)] == ["block", "allow", "allow", "block", "allow"]
    assert url_filter.filter_urls(frame, rules).count() == len(rows) and url_filter.filter_urls(frame.limit(0), rules).count() == 0


def test_raking_meets_targets_and_sampling_follows_them(spark, docs, empty):
    draw = np.random.default_rng(5)
    tokens = draw.integers(50, 4000, (4, 3, 2))
    cells = [(f"s{i}" if i else None, f"l{j}", f"t{k}", int(tokens[i, j, k])) for i in range(4) for j in range(3) for k in range(2)]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(frame, {"lang": {"l0": 2, "l1": 1, "l2": 1}}, tolerance=1e-9).collect()}
    w = tokens.astype(float)
    goals = [tokens.sum((1, 2)) ** 0.7, np.asarray([2.0, 1, 1]), tokens.sum((0, 1)) ** 0.7]
    for _ in range(200):
        for axis, goal in enumerate(goals):
            shape = [-1 if a == axis else 1 for a in range(3)]
            w *= (goal / goal.sum() / w.sum(tuple(a for a in range(3) if a != axis))).reshape(shape)
    assert all(got[c[:3]] == pytest.approx(w[divmod(i, 6)[0], i % 6 // 2, i % 2], rel=1e-6) for i, c in enumerate(cells))
    chosen = mixing.inclusion(spark.createDataFrame([(*k, t, got[k]) for *k, t in [(*c[:3], c[3]) for c in cells] for k in [tuple(k)]],
                                                    "source string, lang string, topic string, tokens long, weight double"), 0.4).collect()
    assert sum(r.probability * r.tokens for r in chosen) == pytest.approx(0.4 * tokens.sum()) and max(r.probability for r in chosen) <= 1
    rows = mixing.mix(docs, rate=0.5).collect()
    assert len(rows) == len(ROWS) and not any(r.sampled for r in rows if r.n_tokens == 0)
    assert sorted(str(r.doc_id) for r in rows if r.sampled) == sorted(str(r[0]) for r in mixing.sample(docs, rate=0.5).collect())
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).count() == 0


def labelled(n):
    draw = np.random.default_rng(6)
    bad = ["worthless", "scumbag", "dreadful"]
    docs, labels = [], []
    for i in range(n):
        toxic, good = bool(draw.random() < 0.3), bool(draw.random() < 0.8)
        words = body(i, int(draw.integers(30, 90))).split()
        for _ in range(3 * toxic):
            words.insert(int(draw.integers(0, len(words))), bad[draw.integers(0, 3)])
        text = " ".join(words) if good else "!! ".join(words).upper()
        docs.append((i, text, ("en", "de")[i % 2], "s", 1))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_learnt_scores(spark, docs, empty):
    rows, marks = labelled(500)
    texts = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([*marks, (None, 1, 1), (77, None, None), (-5, 1, 0)], "doc_id bigint, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in marks}
    for score, fold, column in ((rule_quality.rule_quality, (5, 0), 0), (toxicity.toxicity, (3, 1), 1)):
        got = score(texts, labels).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in got)
        held = [r for r in got if r.held_out]
        assert np.mean([r.predicted == truth[r.doc_id][column] for r in held]) > 0.95
        odd = score(docs.drop("digest"), labels).collect()
        assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
        assert score(empty, labels).count() == 0 and score(docs, labels.limit(0)).count() == len(ROWS)
    assert toxicity.keep_civil(texts, labels).columns == texts.columns


def test_rules_compile_to_the_scores_of_their_conditions(spark):
    draw = np.random.default_rng(7)
    x = draw.random((400, len(rule_quality.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    model = rule_quality.fit_rules(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], list(rule_quality.FEATURES))
    got = np.asarray([r[0] for r in frame.select(model.column()).collect()])
    logit = model.intercept + sum(w * rule_quality._support(x, r) for r, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-logit))) and ((got >= 0.5) == (y == 1)).mean() > 0.98


def test_scores_of_long_texts_do_not_depend_on_the_parts(monkeypatch):
    rows, marks = labelled(120)
    model = toxicity.fit([r[1] for r in rows], np.asarray([m[2] for m in marks], dtype=float), epochs=2, steps=20)
    texts = [" ".join(r[1] for r in rows), "", rows[0][1]]
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity, "_CHUNK", 37)
    assert np.allclose(whole, model.scores(texts))
    assert json.dumps([round(float(s), 6) for s in whole])


def test_long_words_are_scored_without_nodes(monkeypatch):
    draw = np.random.default_rng(5)
    scores = {p: -float(draw.random() * 9) - 1 for p in ["a", "b", "ab", "aab", "ba", "bbbb", "abababab", "\u00e9"]}
    words = ["".join(draw.choice(list("ab\u00e9c"), draw.integers(300, 900))) for _ in range(20)] + ["ab" * 700, "b" * 1001]
    rolling = trie_tokens.SegmentTrie(scores)
    got = [rolling.count(w) for w in words]
    assert rolling.nodes < 1000
    monkeypatch.setattr(trie_tokens, "LONG_WORD", 10_000)
    assert got == [trie_tokens.SegmentTrie(scores).count(w) for w in words]


def test_scores_equal_plain_loops_over_the_words():
    rows = [(body(i, 12) + " " + (" ".join(["vile rot", "rot vile"][i % 2] for _ in range(2)) if i % 3 == 0 else body(99, 3)), i % 3 == 0) for i in range(60)]
    texts, y = [r[0] for r in rows], np.asarray([float(r[1]) for r in rows])
    model = toxicity.fit(texts, y, epochs=3, steps=30)

    def plain(text):
        found = re.findall(r"[^\W\d_]+", text.lower())
        vectors = [sum((model.table[r] for h in toxicity._buckets(w) if (r := model.rows.get(h))), np.zeros(8)) for w in found]
        vectors += [np.zeros(8)] * 4
        z = model.intercept
        for w in toxicity.WIDTHS:
            places = range(max(len(found) + 2, 1))
            values = [sum(vectors[i + j] @ model.filters[w][j] for j in range(w)) for i in places if i + w <= len(vectors)]
            z += np.maximum(np.max(values, axis=0) + model.bias[w], 0) @ model.out[w]
        return 1 / (1 + np.exp(-z))

    assert np.allclose(model.scores(texts), [plain(t) for t in texts], atol=1e-4)
    marks = model.scores(texts)
    assert ((marks > 0.5) == (y == 1)).all()


def test_long_labelled_texts_are_fitted_and_calibrated(spark):
    """Toxic texts are the long ones here: a cut by length would leave nothing to learn from."""
    rows = [(i, body(i, 1300) + (" vile rot scum " + body(i + 500, 40) if i % 2 else ""), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    assert min(len(r[1]) for r in rows) > 6000
    got = toxicity.toxicity(docs, labels, fit_toxic=25, fit_clean=25).filter("held_out").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.9
    kept = toxicity.keep_civil(docs.drop("lang"), labels)
    assert kept.columns == ["doc_id", "text"] and kept.count() < 45


def test_all_labelled_texts_are_fitted_on_and_calibrate(spark, monkeypatch):
    """Every label counts, whatever their number, and in several parts the network learns as well as in one."""
    rows, marks = labelled(900)
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    inside = {i for i, *_ in marks if zlib.crc32(str(i).encode()) % 3 != 1}
    back = {i for i in inside if zlib.crc32(f"fold {i}".encode()) % 5 == 0}
    seen, tallied, truth = [], [], {i: t for i, _, t in marks}
    averaged, calibrate = toxicity._averaged, toxicity.calibrate
    monkeypatch.setattr(toxicity, "PART_ROWS", 150)
    monkeypatch.setattr(toxicity, "_averaged", lambda sample, *rest: seen.append(sample) or averaged(sample, *rest))
    monkeypatch.setattr(toxicity, "calibrate", lambda counts: tallied.extend(counts) or calibrate(counts))
    got = toxicity.toxicity(docs, labels).filter("held_out").collect()
    assert seen[0].select("part").distinct().count() > 1
    assert {r.doc_id for r in seen[0].collect()} == inside - back and sum(r["n"] for r in tallied) == len(back)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.95


def test_scores_do_not_depend_on_the_texts_beside():
    """A filter that begins in the gap after a text must not reach the words of the next."""
    rows, marks = labelled(120)
    model = toxicity.fit([r[1] for r in rows], np.asarray([m[2] for m in marks], dtype=float), epochs=2, steps=20)
    texts = [r[1] for r in rows] + ["", "vile"]
    assert np.allclose(model.scores(texts), [float(model.scores([t])[0]) for t in texts], atol=1e-6)


def test_averages_read_numbers_of_words_and_no_texts(spark, monkeypatch):
    """Texts are cut into words once, not again in every average."""
    rows, marks = labelled(400)
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    averaged, seen = toxicity._averaged, []
    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    monkeypatch.setattr(toxicity, "_averaged", lambda sample, *rest: seen.append(sample) or averaged(sample, *rest))
    model, _ = toxicity.train(docs, labels)
    assert len(seen) > 1 and all("text" not in s.columns for s in seen)
    texts = {r[0]: r[1] for r in rows}
    for r in seen[0].collect():
        found = re.findall(r"[^\W\d_]+", texts[r.doc_id].lower())
        want = [[model.rows.get(h, 0) for h in toxicity._buckets(w)] for w in found]
        assert toxicity._rows_of(np.frombuffer(r.words, dtype=np.int64)).tolist() == want


def test_whole_rows_are_scored_with_their_texts_sent_once(spark, monkeypatch):
    """The pipeline's rows hold their texts; a second copy beside would double what tasks hold."""
    rows, marks = labelled(80)
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit([r[1] for r in rows], np.asarray([m[2] for m in marks], dtype=float), epochs=2, steps=20)
    monkeypatch.setattr(toxicity, "train", lambda *_: (model, {None: 0.5}))
    scored, sent = toxicity.score_texts, []
    monkeypatch.setattr(toxicity, "score_texts", lambda frame, *rest: sent.append(frame) or scored(frame, *rest))
    got = {tuple(r) for r in toxicity.keep_civil(docs, labels).collect()}
    assert sent[0].columns == ["doc"]
    want = {tuple(r) for r in docs.collect() if model.scores([r.text or ""])[0] < 0.5}
    assert got == want and 0 < len(got) < len(rows)
    other = {r.doc_id for r in toxicity.keep_civil(docs.withColumn("text", F.col("text").cast("binary")), labels).collect()}
    assert other == {r[0] for r in got}
