import math
import random

import numpy as np
import pytest

from riskloom.llm.hardneg import hard_negatives, scores
from riskloom.llm.pigeonhole import Blocks, near_duplicates, tile_links, unit

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(4)


def linked_brute(rows, t=0.95):
    n, out = len(rows), [0] * len(rows)
    width = max((len(v) for _, v, _ in rows if v), default=0)
    vs = []
    for _, v, _ in rows:
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vs.append(np.array([*np.float32(v).astype(float), *[0.0] * (width - len(v))]) if ok else None)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(n):
            if i != j and vs[i] is not None and vs[j] is not None and vs[i] @ vs[j] / math.sqrt((vs[i] @ vs[i]) * (vs[j] @ vs[j])) >= t:
                out[i] += 1
                a, b = find(i), find(j)
                root[a] = b
    least = {}
    for i in range(n):
        least.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], out[i], (c := min(least[find(i)])), rows[i][0] == c) for i in range(n))


def clouds(seed, n, d, copies=0):
    """Vectors in chains and clouds about 0.95 apart, copies, and others."""
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.normal(size=(max(2, n // 12), d))
    for i in range(n):
        c = centre[rng.integers(len(centre))]
        rows.append((i, (c + rng.normal(size=d) * rng.choice([0.02, 0.15, 0.24, 1.0])).tolist(), int(rng.integers(4))))
    rows += [(n + i, rows[0][1], 1) for i in range(copies)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("d, n, copies", [(64, 300, 60), (7, 150, 0), (3, 80, 5), (1, 12, 0)])
def test_links_against_brute_force(spark, d, n, copies):
    rows = clouds(d, n, d, copies)
    got = sorted(map(tuple, near_duplicates(frame(spark, rows)).collect()))
    assert got == linked_brute(rows)
    assert d < 3 or any(r[1] for r in got) and any(not r[1] for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [None, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 0.0], 0), (8, [2.0], 0), (9, [1e-30, 0.0], 0), (10, [3e38, 3e37], 0), (11, [-0.0, 1.0], 0), (12, [0.0, 1.0], 0), (-3, [0.0, 5.0], 0), (13, [-1.0, 0.0], 0)]
    got = sorted(map(tuple, near_duplicates(frame(spark, rows)).collect()))
    assert got == linked_brute(rows)
    assert near_duplicates(frame(spark, [])).collect() == []
    same = near_duplicates(frame(spark, [(5, [1.0, 2.0], 0)] * 3 + [(None, [1.0, 2.0], 0), (None, None, 0)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in same if r.component_id) == [(0, 3, 5, False), (5, 3, 5, True), (5, 3, 5, True), (5, 3, 5, True)]
    assert [(r.vec_id, r.n_links, r.kept) for r in same if r.component_id is None] == [(None, 0, False)]


def test_each_pair_counts_in_one_block_and_one_cell():
    v = unit(np.array([r[1] for r in clouds(3, 400, 32)]))
    blocks = Blocks(v, 10**6, 0.95)
    found = [p for j in range(blocks.m) for p in zip(*tile_links(blocks, j, 0.95, v, v), strict=True)]
    want = {(i, j) for i, j in zip(*np.nonzero(v @ v.T >= 0.95), strict=True)}
    assert len(found) == len(set(found)) and set(found) == want
    row, block, cell, home = blocks.cells(blocks.rotated(v))
    assert home.sum() == len(v) * blocks.m
    homes = {(r, b): c for r, b, c, h in zip(row, block, cell, home, strict=True) if h}
    inside = set(zip(row, block, cell, strict=True))
    rotated = blocks.rotated(v)
    for i, j in want:  # of two within a block's budget one is in the other's cell, both if they live in it
        for b in range(blocks.m):
            if i != j and ((rotated[i, b] - rotated[j, b]) ** 2).sum() <= blocks.budget[b]:
                assert ((j, b, homes[i, b]) in inside) + ((i, b, homes[j, b]) in inside) == (2 if homes[i, b] == homes[j, b] else 1)


def negatives_brute(rows):
    ok = [(i, v, label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in ok]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, (a, _, label) in enumerate(ok):
        if a % 100:
            continue
        s = sorted((-dot(q[i], q[j]), ok[j][0], ok[j][2]) for j in range(len(ok)) if j != i)
        for ps, p, _ in [x for x in s if x[2] == label][:5]:
            band = [x for x in s if x[2] != label and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:10]
            out += [(a, p, r + 1, x[1], -ps, -x[0]) for r, x in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize("d, n", [(16, 700), (2, 400)])
def test_negatives_against_brute_force(spark, d, n):
    rows = [(i * 10, v, label) for i, v, label in clouds(d, n, d, 40)]
    rows += [(20_001, None, 1), (20_100, [1.0] * d, None), (None, [1.0] * d, 1), (20_200, [float("nan")] * d, 1), (20_300, [0.0] * d, 2), (20_400, [], 1), (20_500, [9.5], 3), (20_501, [None] * d, 3)]
    got = sorted(map(tuple, hard_negatives(frame(spark, rows)).collect()))
    assert got == negatives_brute(rows)
    assert len(got) > 100


def test_negatives_of_small_tables(spark):
    assert hard_negatives(frame(spark, [])).collect() == []
    assert hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).collect() == []
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (3, [0.5, 0.5], 2), (4, [0.5, 0.5], 2), (100, [-1.0, 0.0], 2)]
    assert sorted(map(tuple, hard_negatives(frame(spark, rows)).collect())) == negatives_brute(rows)


def test_scores_beyond_doubles():
    a = np.array([[2.0**40, 3.0], [1.0, 1.0]])
    assert scores(a, np.array([[2.0**20, 5.0]])).tolist() == [[2**60 + 15], [2**20 + 5]]
    with pytest.raises(OverflowError):
        scores(a, np.array([[2.0**40, 5.0]]))


def test_queries_equal_their_sql_where_there_are_links(spark, tmp_path):
    import duckdb

    from riskloom.llm import hardneg, pigeonhole, registered

    rows = clouds(8, 300, 24, 10)
    frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for query, sql in ((registered.op11_embedding_dedup, pigeonhole.ORACLE_SQL), (registered.op13_hard_negatives, hardneg.ORACLE_SQL)):
        got = query(spark, str(tmp_path))
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        assert names == got.columns
        assert sorted(result.fetchall()) == sorted(map(tuple, got.collect())) != []
