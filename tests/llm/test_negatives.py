"""Hard negatives against a plain search over all pairs."""

import math

import duckdb
import numpy as np
import pytest

from cohortline.llm import negatives
from cohortline.llm.common import table
from tests.helpers import SF
from tests.llm.odd import same_rows

SCHEMA = "vec_id long, embedding array<double>, label int, row string, j int, q string"


def plain(rows):
    """The contract over all pairs; ids must differ."""
    kept = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(256 * x) for x in v]))
    rank = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for k, (anchor, label, q) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(i, sum(a * b for a, b in zip(q, r)), y) for n, (i, y, r) in enumerate(kept) if n != k]
        for positive, best, _ in sorted((s for s in scored if s[2] == label), key=rank)[:5]:
            fits = [s for s in scored if s[2] != label and 30 * best <= 100 * s[1] <= 90 * best]
            out += [(anchor, positive, n, i, best, s) for n, (i, s, _) in enumerate(sorted(fits, key=rank)[:10], 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0, "y") for r in rows], SCHEMA)


def random_rows(n, dims=13, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, dims))
    label = rng.integers(0, 3, n)
    return [(k - 40, (0.2 * centre[y] + 0.15 * rng.normal(size=dims)).round(3).tolist(), int(y)) for k, y in enumerate(label.tolist())]


@pytest.mark.parametrize("sent", [negatives.SENT_BLOCKS, 0])
def test_random_and_odd_rows(spark, sent, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "LANES", 16)
    rows = random_rows(700)
    rows += [(1000 + k, rows[50][1], 1 + k % 2) for k in range(60)]  # one vector many times: ties by id
    rows += [(2000, None, 1), (2001, rows[3][1], None), (2002, [None] * 13, 1), (2003, [math.nan] * 13, 1), (2004, [math.inf] * 13, 2), (2100, [0.0] * 13, 0)]
    rows += [(None, rows[50][1], 1), (None, rows[9][1], 2), (2200, [], 1), (2201, [0.5], 1), (2300, [7.5, -9.25, 1000.0], 2), (2301, [-1000.0] * 13, 0)]
    got = [tuple(r) for r in negatives.hard_negatives(frame(spark, rows).repartition(5), sent_blocks=sent).collect()]
    same_rows(got, plain(rows))


def test_the_whole_table_and_its_sql(spark):
    rows = table(spark, SF, "embeddings")
    got = [tuple(r) for r in negatives.hard_negatives(rows).collect()]
    same_rows(got, plain([(r.vec_id, r.embedding, r.label) for r in rows.collect()]))
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    same_rows(got, duckdb.sql(negatives.SQL).fetchall())


def test_tables_give_the_product():
    rng = np.random.default_rng(3)
    for reach in (1, 200, 70_000):
        a, b = rng.integers(-reach, reach + 1, (9, 21)), rng.integers(-reach, reach + 1, (40, 21))
        planes, bits = negatives.bit_planes(b)
        assert bits.shape == (planes, 3, 40)
        assert (negatives.scores(negatives.subset_sums(a, np.int64), bits) == b @ a.T).all()


def test_hot_label_repeated_rows_and_single_class(spark):
    rows = [(k, [1.0, 0.5], 4) for k in range(300)] + [(1000 + k, [0.5, 0.25], 5) for k in range(3)]
    got = [tuple(r) for r in negatives.hard_negatives(frame(spark, rows)).collect()]
    same_rows(got, plain(rows))
    assert negatives.hard_negatives(frame(spark, rows[:300])).count() == 0  # no other label


def test_equal_ids_are_rows_of_their_own(spark):
    rows = [(100, [1.0], 1), (100, [1.0], 1), (3, [0.5], 2)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(frame(spark, rows)).collect())
    assert got == [(100, 100, 1, 3, 65536, 32768)] * 2


def test_empty_table_and_oversized_components(spark):
    assert negatives.hard_negatives(frame(spark, [])).collect() == []
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(frame(spark, [(0, [1e15], 1), (1, [1e15], 1)])).collect()
