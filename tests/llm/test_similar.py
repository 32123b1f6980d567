"""SimHash, components, substring dedup."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortline.llm import common, graph, simhash, substrings
from tests.llm.odd import lower, odd_docs, odd_rows, rank, same_rows


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    cut = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in cut], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(cut))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute_groups(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    ids = {i for i, _ in prints if i is not None}
    known = [(i, f) for i, f in prints if i is not None]
    root = brute_components(ids, [(a, b) for k, (a, x) in enumerate(known) for b, y in known[:k] if (x ^ y).bit_count() <= 4])
    by_print = {f: root[i] for i, f in known}
    return [(i, f"{f:016x}", by_print.get(f)) for i, f in prints]


def test_near_groups_of_odd_rows(spark):
    same_rows([tuple(r) for r in simhash.near_groups(odd_docs(spark)).collect()], brute_groups(odd_rows()))
    assert simhash.near_groups(odd_docs(spark, [])).count() == 0
    kept = simhash.drop_near_copies(odd_docs(spark))
    roots = {c for i, _, c in brute_groups(odd_rows()) if i is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == roots and kept.columns == odd_docs(spark).columns


def test_near_stage_keeps_one_row_of_each_group(spark):
    rows = [(None, "only rows without id hold this text"), (None, "only rows without id hold this text"), (None, "this text has ids too"), (4, "this text has ids too"), (4, "this text has ids too"), (9, "this text has ids too")]
    kept = simhash.drop_near_copies(odd_docs(spark, rows))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [rows[0], rows[3]]))


def test_every_link_up_to_four_bits_and_none_beyond(spark):
    rng = random.Random(4)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        prints += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 4, 4, 4, 5, 6)]
    prints = list(dict.fromkeys(prints))
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    got = simhash.links(spark.createDataFrame(list(zip(signed, range(len(signed)), strict=True)), "fp long, id long")).collect()
    want = {(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4}
    assert len(got) == len(want) and {(max(r.a, r.b), min(r.a, r.b)) for r in got} == want


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(6)
    linked = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7)]
    nodes = {n for e in linked for n in e if e[0] != e[1]}
    want = brute_components(nodes, [e for e in linked if e[0] != e[1]])
    found = {r.id: r.root for r in graph.components(spark.createDataFrame(linked, "a long, b long")).collect()}
    assert {n: found.get(n, n) for n in nodes} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_strings(rows):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - 49):
            s = data[k : k + 50]
            first[s] = min(first.get(s, 1 << 63), rank(i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < rank(i):
                gone[k : k + 50] = b"\x01" * 50
        starts = [k for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])]
        out.append((i, bytes(x for x, y in zip(data, gone, strict=True) if not y), len(data), sum(gone), starts))
    return out


def strings(docs, **options):
    got = substrings.drop_repeated_strings(docs, **options).collect()
    return [(r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, list(r.starts)) for r in got]


def test_substrings_of_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] not in (7, 8)]
    same_rows(strings(odd_docs(spark, rows)), brute_strings(rows))
    assert strings(odd_docs(spark, [])) == []


@pytest.mark.parametrize("symbols", [2 << 20, 3000])
def test_substrings_of_few_letters(spark, monkeypatch, symbols):
    monkeypatch.setattr(substrings, "SYMBOLS", symbols)
    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(6)] + ["a" * 200, "ab" * 90, "\x00" * 70, "é" * 60]
    text = lambda: "".join(rng.choice(base)[rng.randint(0, 30) : rng.randint(40, 200)] for _ in range(rng.randint(0, 5)))
    rows = [(rng.randint(0, 200), text()) for _ in range(200)]
    same_rows(strings(odd_docs(spark, rows), part_bytes=2000), brute_strings(rows))


def test_interval_edges_are_common_prefixes():
    rng = np.random.default_rng(2)
    symbols = np.append(rng.integers(1, 3, 400), 0).astype(np.uint16)
    symbols[200:300] = symbols[50:150]
    order = substrings.suffix_order(symbols)
    edge = substrings.interval_edges(symbols[order - 1])
    text = symbols.tolist()
    for r in range(1, len(order)):
        a, b = text[order[r - 1] :][:50], text[order[r] :][:50]
        assert edge[r] == (a != b)


def test_anchors_are_dealt_evenly_to_parts():
    data = np.random.default_rng(7).integers(97, 123, 100_000).astype(np.uint8)
    pieces = substrings.Pieces(data, np.array([0, len(data)]), 16)
    counts = np.bincount(pieces.part, minlength=16)
    assert counts.min() > 0.8 * counts.mean() and counts.max() < 1.2 * counts.mean()


def test_variants_are_never_broadcast(spark):
    def plan(df):
        return df._jdf.queryExecution().sparkPlan().toString()

    prints = spark.range(100).select(F.xxhash64("id").alias("fp"), "id")
    # 64 rows of each fingerprint, which Spark takes for one
    assert "SortMergeJoin [key" in plan(simhash.links(common.stored(prints, "test")))
    # counted as too many, however small the file
    joined = [plan(prints.join(common.sized(prints, n), "id")) for n in (99, 100)]
    assert "SortMergeJoin" in joined[0] and "BroadcastHashJoin" in joined[1]
