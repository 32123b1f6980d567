"""Exact and line dedup, sharding."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from cohortline.llm import exact, lines, sharding
from tests.llm.odd import SPACES, lower, odd_docs, odd_rows, rank, same_rows

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
plain = lambda t: "".join(c for c in t or "" if c not in SPACES)


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_groups(spark, broadcast_rows, digest_all):
    rows, groups = [*odd_rows(), (None, "no id, two rows"), (None, "no id, two rows"), (7, "seven's copy"), (7, "seven's copy"), (5, "seven's copy ")], defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[plain(t)].append((-len(t or ""), i is None, rank(i), at, i))
    again = defaultdict(int)
    for i, t in rows:
        again[len(plain(t)), plain(t)[:64]] += 1
    want = []
    for at, (i, t) in enumerate(rows):
        group = groups[plain(t)]
        digest = sha(plain(t)) if digest_all or again[len(plain(t)), plain(t)[:64]] > 1 else None
        want.append((i, min(group)[4], len(group), at == min(group)[3], digest))
    got = exact.exact_groups(odd_docs(spark, rows), digest_all, broadcast_rows=broadcast_rows)
    same_rows([tuple(r) for r in got.collect()], want)


def test_exact_dedup_keeps_columns_and_empty_tables(spark):
    docs = odd_docs(spark)
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(plain(r.text) for r in kept.collect()) == sorted({plain(t) for _, t in odd_rows()})
    twice = odd_docs(spark, [(None, "a copy"), (None, "a copy"), (3, "an other"), (3, "another"), (3, None)])
    assert sorted(map(str, ((r.doc_id, plain(r.text)) for r in exact.drop_exact_copies(twice).collect()))) == ["(3, '')", "(3, 'another')", "(None, 'acopy')"]
    assert exact.exact_groups(odd_docs(spark, [])).count() == 0


def brute_lines(rows):
    key = lambda x: lower(x.strip(SPACES))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(rank(i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or min(held[key(x)]) == rank(i)]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return out


@pytest.mark.parametrize("index_keys", [10**6, 0])
def test_line_dedup(spark, index_keys):
    got = lines.drop_repeated_lines(odd_docs(spark), index_keys, probes=3)
    same_rows([tuple(r) for r in got.select("doc_id", "kept", "n_lines", "n_dropped").collect()], brute_lines(odd_rows()))
    assert lines.drop_repeated_lines(odd_docs(spark, []), index_keys).count() == 0


def test_lines_of_many_documents_are_probed_together(spark):
    docs = spark.createDataFrame([(i, f"a\nline of document {i}\n") for i in range(40)], "doc_id long, text string").coalesce(1)
    together = lambda: lambda doc_id, h, g, of, extra: np.full(len(h), len(np.unique(of)) == 40)
    got = {r.doc_id: (r.kept, r.n_lines, r.n_dropped) for r in lines._rewrite(docs, together).collect()}
    assert got == {i: ("a\n", 3, 1) for i in range(40)}


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    h, g = (rng.integers(0, 1 << 64, 5000, dtype=np.uint64) for _ in range(2))
    shard = lines.Shard.unpack(lines.Shard.build(h, g, np.arange(5000), np.arange(5000) * 3).pack())
    assert sorted(shard.find(h).tolist()) == list(range(5000))
    known, first = shard.first_of(h, g)
    assert known.all() and (first == np.arange(5000) * 3).all()
    others = rng.integers(0, 1 << 64, (2, 5000), dtype=np.uint64)
    assert not shard.first_of(*others)[0].any()


def test_line_hashes_agree_between_engines(spark):
    docs = odd_docs(spark).where("text IS NOT NULL").select("doc_id", "text")
    here = set()
    for r in docs.collect():
        _, counts, h, g = lines.hashed_lines(r.text.encode())
        here |= set(zip(h[counts].view(np.int64).tolist(), g[counts].view(np.int64).tolist(), strict=True))
    assert here == {(r.h, r.g) for r in lines.lines_of(docs).collect()}


def test_lookup_table_is_balanced_and_stable():
    table = sharding.lookup_table()
    counts = np.bincount(table)
    assert len(table) == sharding.SLOTS and len(counts) == 64 and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True))
    assert moved < 0.06 * len(table)  # a 64th had to move
    with pytest.raises(ValueError):
        sharding.lookup_table(slots=6554)


def test_lookup_table_by_turns():
    names, slots = ["a", "b", "c"], 11
    seeds = [hashlib.md5(n.encode()).hexdigest() for n in names]
    orders = [[(int(s[:15], 16) + j * (int(s[15:30], 16) % (slots - 1) + 1)) % slots for j in range(slots)] for s in seeds]
    table = {}
    while len(table) < slots:
        for k, order in enumerate(orders):
            if len(table) < slots:
                table[next(x for x in order if x not in table)] = k
    assert sharding.lookup_table(names, slots) == [table[k] for k in range(slots)]


def test_placement_of_odd_rows(spark):
    got = sharding.place(odd_docs(spark)).collect()
    table = sharding.lookup_table()
    want = []
    for i, _ in odd_rows():
        slot = int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        want.append((i, slot, sharding.SHARDS[table[slot]]))
    same_rows([tuple(r) for r in got], want)
    assert sharding.place(odd_docs(spark, [])).count() == 0
