import numpy as np
import pytest

from tidewave.llm import nndescent
from tidewave.llm.nndescent import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = [(i, np.array(e, np.float32).astype(float)) for i, e, _ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = [(i, e / np.sqrt(e @ e)) for i, e in ok]
    parent = list(range(len(unit)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(unit)
    for a in range(len(unit)):
        for b in range(a):
            if len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.9:
                n[a] += 1
                n[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(unit):
        least[root(k)] = min(i, least.get(root(k), i))
    used = {id(r): None for r in rows}
    out, k = [], 0
    for i, e, _ in rows:
        valid = i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
        if valid:
            out.append((i, n[k], least[root(k)], i == least[root(k)]))
            k += 1
        else:
            out.append((i, 0, i, True))
    assert used
    return out


def rows_of(seed=5):
    rng = np.random.default_rng(seed)
    far = rng.standard_normal((260, 16))
    rows = [(k, x.tolist(), 0) for k, x in enumerate(far)]
    for c, size, spread in ((3, 60, 0.02), (9, 25, 0.1), (11, 1, 0.05), (12, 2, 0.12)):
        rows += [(1000 * c + k, (far[c] + spread * rng.standard_normal(16)).tolist(), 1) for k in range(size)]
    rows += [(90000 + k, far[20].tolist(), 2) for k in range(40)]
    return rows


def test_against_all_pairs(spark):
    rows = rows_of()
    got = {r["vec_id"]: tuple(r)[:4] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {r[0]: r for r in brute(rows)}
    wrong = [i for i in want if want[i] != got[i]]
    assert len(got) == len(want) and len(wrong) <= 3, [(want[i], got[i]) for i in wrong]
    found, true = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert 0.98 * true <= found <= true


def test_tiles_and_audit_rounds(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "TILE", 16)
    rows = rows_of(8)
    got = {r["vec_id"]: tuple(r)[:4] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {r[0]: r for r in brute(rows)}
    found, true = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert 0.9 * true <= found <= true


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [1.0, None], 0)]
    rows += [(7, [], 0), (None, [1.0, 0.0], 0), (8, [1.0], 0), (9, [float("inf"), 0.0], 0), (10, [3e38, 0.0], 0)]
    got = sorted((tuple(r)[:4] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == sorted(brute(rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("tile", [512, 16])
def test_dense_groups_joined_by_cross_links(spark, monkeypatch, tile):
    """Either group fills the lists of its members; the links between the groups lie below all of them."""
    monkeypatch.setattr(nndescent, "TILE", tile)
    monkeypatch.setattr(nndescent, "audit", lambda *_: (1.0, 1))  # no further rounds with longer lists
    rng = np.random.default_rng(6)
    rows = [(k, x.tolist(), 0) for k, x in enumerate(rng.standard_normal((100, 32)))]
    for c in range(3):
        a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        for g, centre in enumerate((a, 0.92 * a + (1 - 0.92**2) ** 0.5 * b)):
            rows += [(1000 * (2 * c + g + 1) + k, (centre + 0.006 * rng.standard_normal(32)).tolist(), 1) for k in range(40)]
    want = {r[0]: r for r in brute(rows)}
    for parts in (1, 7):  # whatever order rows arrive in
        rng.shuffle(rows)
        got = {r["vec_id"]: tuple(r)[:4] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}
        assert got == want


def test_audit_sees_lost_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(9)
    far = rng.standard_normal((201, 32))
    rows = [(k, (far[200] + 0.01 * rng.standard_normal(32)).tolist()) for k in range(200)]
    rows += [(1000 + k, (far[k // 2] + 0.05 * rng.standard_normal(32)).tolist()) for k in range(400)]  # 200 pairs
    reps = spark.createDataFrame(rows, "v long, e array<double>")
    large = [(k, 0) for k in range(200)]
    pairs = [(1000 + k, 1000 + k // 2 * 2) for k in range(400)]
    unit = np.array([e for _, e in rows])
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    ids = np.array([v for v, _ in rows])
    edges = [(int(ids[i]), int(ids[j])) for i, j in np.argwhere(unit @ unit.T >= 0.9) if i > j]

    def measured(edges, roots, dense):
        frame = spark.createDataFrame([(v, r, dense) for v, r in roots], "v long, root long, dense boolean")
        return nndescent.audit(reps, spark.createDataFrame(edges, "a long, b long"), frame)

    inside = [e for e in edges if e[0] < 200]
    assert measured(inside, large, True)[0] < 0.5
    assert measured(edges, large + pairs, False)[0] == 1.0
    assert measured(edges[::2], large + pairs, False)[0] < 0.8  # links count, not being connected
    recall, seen = measured(edges, large + pairs, True)
    assert recall == 1.0 and seen > 10_000
    lonely = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.standard_normal((300, 32)))], "v long, e array<double>")
    none = spark.createDataFrame([], "v long, root long, dense boolean")
    assert nndescent.audit(lonely, spark.createDataFrame([], "a long, b long"), none) == (None, 0)


def test_tables_grow_and_a_failed_audit_compares_all(spark, monkeypatch):
    assert all(1 - (1 - (1 - np.arccos(0.9) / np.pi) ** b) ** nndescent._tables(b, 0.9) >= 0.99 for b in range(1, 25))
    monkeypatch.setattr(nndescent, "TILE", 64)
    monkeypatch.setattr(nndescent, "MOST_ROUNDS", 2)
    monkeypatch.setattr(nndescent, "audit", lambda *_: (0.0, 1))

    def apart(*_):
        return lambda parts: (part[["v"]].assign(g=part["v"])[["g", "v"]] for part in parts)

    monkeypatch.setattr(nndescent, "_signatures", apart)
    rows = rows_of()[:360]
    got = {r["vec_id"]: tuple(r)[:4] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: r for r in brute(rows)}


def test_saturated_lists_grow(spark, monkeypatch):
    """Groups of 30 fill lists of 8; no component is compared in full before lists of 64 are full."""
    monkeypatch.setattr(nndescent, "count_dense", None)
    rng = np.random.default_rng(3)
    rows = []
    for g, centre in enumerate(rng.standard_normal((12, 32))):
        rows += [(1000 * g + k, (centre + 0.15 * rng.standard_normal(32)).tolist(), 1) for k in range(30)]
    result = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"]: tuple(r)[:4] for r in result} == {r[0]: r for r in brute(rows)}
    assert result[0]["audit_recall"] >= 0.95 and result[0]["audit_links"] > 100


@pytest.mark.parametrize("tile", [512, 16])
def test_dense_groups_are_counted_exactly(spark, monkeypatch, tile):
    monkeypatch.setattr(nndescent, "TILE", tile)
    rng = np.random.default_rng(4)
    parts = []
    for c, spread in ((0, 0.01), (1, 0.03), (2, 0.06), (3, 0.3)):
        centre = rng.standard_normal(24)
        x = centre / np.sqrt(centre @ centre) + spread * rng.standard_normal((150, 24)) * rng.random((150, 1))
        parts += [(1000 * c + k, c, e.tolist(), int(rng.integers(1, 4))) for k, e in enumerate(x)]
    got = {r["v"]: r["n"] for r in nndescent.count_dense(spark.createDataFrame(parts, "v long, c long, e array<double>, m long")).collect()}
    for c in range(4):
        own = [p for p in parts if p[1] == c]
        x = np.array([p[2] for p in own])
        x /= np.sqrt((x**2).sum(1))[:, None]
        linked = x @ x.T >= 0.9
        np.fill_diagonal(linked, False)
        want = linked @ np.array([p[3] for p in own])
        assert [got.get(p[0], 0) for p in own] == want.tolist()


def test_a_dense_group_of_twenty_thousand(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    x = centre / np.sqrt(centre @ centre) + 0.01 * rng.standard_normal((20_000, 16))
    rows = [(k, e.tolist(), 1) for k, e in enumerate(x)] + [(50_000 + k, e.tolist(), 0) for k, e in enumerate(rng.standard_normal((50, 16)))]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).where("vec_id < 20000").groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(19_999, 0, 20_000)]
