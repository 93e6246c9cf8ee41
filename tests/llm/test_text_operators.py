"""Operators over texts, against brute force."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from mnemolith.llm import leakage, packing, spans, tokens
from mnemolith.llm.words import words
from tests.helpers import SF, oracle, rows

DOCS = "doc_id long, text string, start int, anchor string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 0, "clash") for i, t in texts], DOCS)


# Shared spans


def brute_spans(texts, least):
    held = defaultdict(set)
    for i, t in texts:
        for k in range(len(t or "") - least + 1):
            held[t[k : k + least]].add(i)
    out = {}
    for i, t in texts:
        shared = {c for k in range(len(t or "") - least + 1) if len(held[t[k : k + least]]) > 1 for c in range(k, k + least)}
        if shared:
            out[i] = len(shared)
    return sorted(out.items(), key=repr)


def random_texts(rng, n=25):
    def noise(k):
        return "".join(rng.choice("abcdefgh é日\U0001f600") for _ in range(k))

    pieces = [noise(rng.randrange(60, 400)) for _ in range(8)]
    footer = noise(150)
    texts = []
    for i in range(n):
        body = "".join(rng.choice([noise(rng.randrange(5, 80)), rng.choice(pieces), rng.choice(pieces)[rng.randrange(40) :]]) for _ in range(rng.randrange(1, 7)))
        texts.append((i, body + (footer if rng.random() < 0.4 else "")))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_shared_spans_against_brute_force(spark, seed):
    texts = random_texts(random.Random(seed))
    for least in (128, 200):
        assert rows(spans.shared_chars(spans.shared_spans(documents(spark, texts), least=least))) == brute_spans(texts, least)


def test_shared_spans_edge_cases(spark, monkeypatch):
    run = lambda texts, least=128: rows(spans.shared_chars(spans.shared_spans(documents(spark, texts), least=least)))
    base = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    assert run([]) == [] and run([(1, None), (2, ""), (3, "short"), (None, base), (4, base)]) == []
    # Repetition inside one document isn't sharing; repeated rows are one document.
    assert run([(1, base + "|" + base), (2, "x" * 200)]) == [] and run([(1, base), (1, base)]) == []
    assert run([(1, base[:127]), (2, base[:127])]) == [] and run([(1, base[:128]), (2, "~" + base[:128])]) == [(1, 128), (2, 128)]
    # Text that repeats one character or one line has ties everywhere.
    flat = [(1, "a" * 700), (2, "b" + "a" * 130 + "c"), (3, "ab" * 90)]
    assert run(flat) == brute_spans(flat, 128)
    monkeypatch.setattr(spans, "_SLICE", 150)
    monkeypatch.setattr(spans, "BROADCAST_CHUNKS", 0)
    texts = random_texts(random.Random(9), 12)
    assert run(texts) == brute_spans(texts, 128)
    with pytest.raises(ValueError):
        spans.shared_spans(documents(spark, []), least=100)


def test_anchors_depend_on_content_alone():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, 600).astype(np.uint32)
    h, moved = spans.gear_hashes(text), spans.gear_hashes(np.concatenate([rng.integers(97, 123, 77).astype(np.uint32), text]))
    assert (moved[77:] == h).all()
    assert (spans.window_anchors(moved, 65)[77:] - 77 == spans.window_anchors(h, 65)).all()
    naive = [int(np.argmin(h[i : i + 65])) + i for i in range(len(h) - 64)]
    assert spans.window_anchors(h, 65).tolist() == naive


# Leakage


def item_words(n, tag):
    return [f"{tag}word{i}" for i in range(n)]


def found(spark, items, texts, **options):
    it = spark.createDataFrame(items, "item_id long, text string, doc_id long")
    out = leakage.leaks(it, documents(spark, texts), **options)
    return rows(out.where("passage_words >= 15").select("item_id", "doc_id").distinct())


def test_leaks_whatever_the_spelling(spark):
    w = item_words(30, "Ä")
    items = [(1, " ".join(w), 0), (2, " ".join(item_words(40, "b")), 0)]
    changed = list(w)
    changed[4], changed[13], changed[22] = "other", "x y", ""
    texts = [
        (1, "before " + " ".join(w[3:18]) + " after"),
        (2, " ".join(w[3:17]) + " end"),
        (3, "\r\n| ".join(x.upper() for x in w[:20])),
        (4, " ".join(f"**{x}**" if i % 3 else f"<em>{x}</em>" for i, x in enumerate(w))),
        (5, " ".join(x.replace("Ä", "a") for x in w)),
        (6, " ".join(changed)),
        (7, " ".join(w[10:20] + ["no"] * 3 + w[:10])),
        (8, " ".join(x for p in zip(w, itertools.repeat("filler")) for x in p)),
        (9, None),
        (10, ""),
        (11, "pad " * 40_000 + " ".join(w[5:25])),
    ]
    assert found(spark, items, texts) == [(1, 1), (1, 11), (1, 3), (1, 4), (1, 5), (1, 6)]
    assert found(spark, items, texts, block_words=1) == [(1, 1), (1, 11), (1, 3), (1, 4), (1, 5), (1, 6)]


def test_leaks_own_wording_only(spark):
    header = " ".join(item_words(20, "common"))
    items = [(i, header + " " + " ".join(item_words(16, f"own{i}x")), 0) for i in range(8)]
    texts = [(1, header), (2, header + " " + " ".join(item_words(9, "own3x"))), (3, " ".join(item_words(16, "own3x")))]
    assert found(spark, items, texts) == [(3, 3)]
    assert found(spark, [], texts) == [] and found(spark, items, []) == []
    assert found(spark, [(1, None, 0), (None, header, 0), (2, "too short", 0)], texts) == []


def test_one_quote_does_not_use_up_the_words_of_another(spark):
    w = item_words(30, "q")
    edited = w[:24]
    edited[6], edited[15] = "other", "words"
    texts = [(1, " ".join(w[7:18] + ["and"] * 3 + edited)), (2, " ".join(edited + ["and"] * 3 + w[7:18])), (3, " ".join(w[7:18] + ["and"] * 3 + w[7:18]))]
    assert found(spark, [(1, " ".join(w), 0)], texts) == [(1, 1), (1, 2)]


def test_edits_that_cluster_are_found_as_well(spark):
    w = item_words(24, "c")
    swap = lambda n, *at: " ".join("other" if i + 1 in at else x for i, x in enumerate(w[:n]))
    texts = [(1, swap(15, 3, 6)), (2, swap(24, 9, 11, 13)), (3, swap(15, 3, 6, 9)), (4, swap(14, 3, 6))]
    # One edit for every eight words begun: two in 15, three in 24.
    assert found(spark, [(1, swap(24), 0)], texts) == [(1, 1), (1, 2)]


def longest_passage(a, b, least):
    """By full edit distances of every stretch of a to every stretch of b that begin and end alike."""
    best = (0, 0)
    for s, t in itertools.product(range(len(a)), range(len(b))):
        if a[s] == b[t]:
            row = [None] * (t + 1) + list(range(len(b) - t))
            for i in range(s + 1, len(a)):
                new = [None] * (t + 1) + [i - s]
                for j in range(t + 2, len(b) + 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a[i] != b[j - 1])))
                    n = i - s + 1
                    if a[i] == b[j - 1] and n >= least and row[j - 1] <= -(-n // 8):
                        best = max(best, (n, row[j - 1]), key=lambda x: (x[0], -x[1]))
                row = new
    return best


@pytest.mark.parametrize("seed", range(30))
def test_closest_passage_against_brute_force(seed):
    rng = random.Random(seed)
    a = [rng.randrange(1, rng.choice([6, 200])) for _ in range(rng.randrange(15, 30))]
    b = [0] * rng.randrange(4)
    for _ in range(2):
        part = a[rng.randrange(6) :][: rng.randrange(8, 30)]
        for _ in range(rng.randrange(5)):
            at, kind = rng.randrange(1, len(part)), rng.randrange(3)
            part[at : at + (kind != 1)] = [] if kind == 0 else [0]
        b += part + [0] * rng.randrange(3)
    seeds = {j - i for i in range(len(a) - 3) for j in range(len(b) - 3) if a[i : i + 4] == b[j : j + 4]}
    assert leakage.closest(a, [True] * len(a), b, seeds, 15) == longest_passage(a, b, 15)


def test_coverage_ignores_order(spark):
    w = item_words(24, "k")
    it = spark.createDataFrame([(1, " ".join(w), 0)], "item_id long, text string, doc_id long")
    texts = [(1, " ".join(w[16:] + ["-"] + ["z"] + w[8:16] + ["z"] + w[:8]))]
    got = leakage.leaks(it, documents(spark, texts)).first()
    assert got.coverage == 1.0 and got.passage_words < 15


@pytest.mark.parametrize("seed", range(40))
def test_passages_with_one_edit_in_eight_are_found(seed):
    rng = random.Random(seed)
    a = list(range(1, 41))
    at, n = rng.randrange(0, 20), rng.randrange(16, 21)
    part = a[at : at + n]
    for place in sorted(rng.sample(range(1, n - 1), n // 8), reverse=True):
        kind = rng.choice(["change", "drop", "add"])
        part[place : place + (kind != "add")] = [] if kind == "drop" else [0]
    b = [0] * 9 + part + [0] * 9
    got, edits = leakage.passage(a, b, leakage.tiles(a, b, 3), [True] * 40, 15)
    assert got >= 15 and edits <= 3


def test_tiles_are_longest_first_and_disjoint():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randrange(1, 5) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        out = leakage.tiles(a, b, 3)
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in out)
        for side in (0, 1):
            taken = [k for t in out for k in range(t[side], t[side] + t[2])]
            assert len(taken) == len(set(taken))
        longest = max((n for n in range(3, 25) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]), default=0)
        assert max((n for _, _, n in out), default=0) == longest


def test_runs_agree_whatever_way_they_are_found():
    rng = random.Random(6)
    for _ in range(60):
        a, b = (np.array([rng.randrange(1, rng.choice([3, 9])) for _ in range(rng.randrange(3, 30))], np.int64) for _ in range(2))
        key = leakage._rolling(a, 3)
        order = np.argsort(key, kind="stable")
        low = np.searchsorted(key[order], leakage._rolling(b, 3), "left")
        many = np.searchsorted(key[order], leakage._rolling(b, 3), "right") - low
        by_hash = set(zip(*(c.tolist() for c in leakage._runs_by_hash(a, b, 3, order, low, many)), strict=True))
        assert by_hash == set(zip(*(c.tolist() for c in leakage._runs_by_diagonal(a, b, 3)), strict=True))


def test_words_that_repeat_take_no_longer(spark):
    began = time.perf_counter()
    out = leakage.tiles([1] * 300, [1] * 4000, 3)
    assert out == [(0, 0, 300)] and time.perf_counter() - began < 1
    items = [(1, "same " * 300, 0), (2, " ".join(item_words(20, "n")), 0)]
    texts = [(1, "same " * 20_000), (2, "same " * 10 + " ".join(item_words(20, "n")) + " same" * 10)]
    assert found(spark, items, texts) == [(1, 1), (2, 2)]


def test_words():
    assert words("<p>Caf&eacute; **bo**ld [link text](http://x.y/z) snake_case ﬁn­al&amp;</p>") == ["cafe", "bold", "link", "text", "snake", "case", "final"]
    assert words(None) == words("") == words("— … _ *") == []


# Packing


def check_packs(spark, sizes, capacities, **options):
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, tokens long")
    out = packing.packs(items, capacities, **options).collect()
    for name, capacity in capacities.items():
        mine = [r for r in out if r.container == name]
        fill = Counter()
        for r in mine:
            fill[r.pack] += r.tokens
        assert all(v <= capacity for v in fill.values())
        for i, n in enumerate(sizes):
            pieces = sorted((r.piece, r.first_token, r.tokens) for r in mine if r.item == i)
            n = n or 0
            want = max(1, -(-n // capacity))
            assert [p[0] for p in pieces] == list(range(want)) and sum(p[2] for p in pieces) == n
            assert all(p[1] == p[0] * capacity for p in pieces) and all(p[2] == capacity for p in pieces[:-1])
        packs = {r.pack for r in mine if r.tokens}
        assert packs == set(range(len(packs)))
        least = -(-sum(n or 0 for n in sizes) // capacity)
        yield len(packs), least


def test_packs_hold_everything_and_are_tight(spark):
    rng = random.Random(2)
    sizes = [rng.choice([rng.randrange(1, 60), 17, rng.randrange(1, 300)]) for _ in range(900)] + [0, None, 0]
    for packs, least in check_packs(spark, sizes, {"small": 100, "wide": 1000}, buckets=7):
        assert packs <= least * 1.03 + 1
    # One length, as when a third of all texts are copies.
    assert [p for p, _ in check_packs(spark, [25] * 403, {"c": 100})] == [101]
    assert [p for p, _ in check_packs(spark, [1000, 100, 100], {"c": 100})] == [12]
    assert [p for p, _ in check_packs(spark, [0, None], {"c": 100})] == [0]
    assert list(check_packs(spark, [], {"c": 100})) == [(0, 0)]
    assert packing.packs(spark.createDataFrame([(1, 5)], "item long, tokens long"), {"none": 0, "null": None}).count() == 0


def test_patterns_match_the_histogram():
    rng = random.Random(8)
    for _ in range(30):
        capacity = rng.randrange(5, 60)
        histogram = {rng.randrange(1, capacity + 1): rng.randrange(1, 500) for _ in range(rng.randrange(0, 20))}
        used = Counter()
        made = packing.patterns(histogram, capacity)
        for packed, packs in made:
            assert packs > 0 and sum(n * k for n, k in packed.items()) <= capacity
            for n, k in packed.items():
                used[n] += k * packs
        assert used == Counter(histogram) and len(made) <= 3 * len(histogram) + 1


def test_token_counts(spark):
    texts = ["", None, "Hello world, it's 42 tokens?", "日本語 \U0001f600", "a" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(rows(tokens.token_counts(df, item="doc_id", text="text")))
    encode = tokens.encoding(tokens.DEFAULT_VOCABULARY)
    assert got[0] == got[1] == 0 and all(got[i] == len(encode.encode_ordinary(t)) for i, t in enumerate(texts) if t)
    assert all(encode.decode(encode.encode_ordinary(t)) == t for t in texts if t)


def test_queries_run(spark):
    from mnemolith.llm.queries import QUERIES, SQL

    for name, sql in SQL.items():
        df = QUERIES[name](spark, SF)
        assert Counter(repr(tuple(r)) for r in df.collect()) == oracle(sql, df.columns)

    for name, query in QUERIES.items():
        df = query(spark, SF)
        assert df.columns and df.count() >= 0, name
