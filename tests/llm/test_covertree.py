import numpy as np
import pytest

from folio.llm import covertree


def brute(rows, cosine=0.95):
    ok = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = {i: [j for j in ok if j != i and len(ok[j]) == len(ok[i]) and ok[i] @ ok[j] >= cosine] for i, _ in rows if i in ok}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, [])), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("block, leaf", [(8192, 512), (60, 16)])
def test_equals_brute_force(spark, sf, monkeypatch, block, leaf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    r = np.random.default_rng(1)
    for k, s in enumerate((0.02, 0.03, 0.04, 0.045, 0.05)):
        rows += [(10_000 * (k + 1) + i, (np.array(rows[k][1]) + r.normal(0, s, 64)).tolist()) for i in range(25)]
    rows += [(90_001, None), (90_002, []), (90_003, [0.0] * 64), (90_004, [float("nan")] * 64), (90_005, [None] * 64), (90_006, [1.0, 2.0]), (90_007, [1.0, 2.0]), (90_008, rows[3][1])]
    vectors = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, v double")
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "LEAF", leaf)
    out = covertree.near_vectors(vectors).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == brute(rows) and len(out) == len(rows)


def test_empty_and_null_ids(spark):
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert covertree.near_vectors(vectors.limit(0)).count() == 0
    assert sorted((r.vec_id or 0, r.n_links) for r in covertree.near_vectors(vectors).collect()) == [(0, 0), (1, 0)]


@pytest.mark.parametrize("kind", ["spread", "clusters", "line"])
def test_tree_keeps_its_rules_and_prunes(monkeypatch, kind):
    monkeypatch.setattr(covertree, "LEAF", 32)
    r = np.random.default_rng(2)
    v = {"spread": r.normal(size=(900, 64)), "clusters": np.repeat(r.normal(size=(30, 16)), 30, 0) + r.normal(0, 0.02, (900, 16)), "line": np.c_[np.ones(900), np.linspace(-3, 3, 900)]}[kind]
    x = covertree.unit(v)
    parent, level = covertree.CoverTree.separated(x, 0.04)
    last = level.max()
    for k in range(1, last):
        centres = np.flatnonzero(level <= k)
        d = covertree.chords(x[centres], x[centres]) + 9 * np.eye(len(centres))
        assert d.min() > 2 * 0.5**k - 1e-9  # separation over the whole level
        assert covertree.chords(x, x[centres]).min(1).max() <= 2 * 0.5**k + 1e-9  # covering
    assert (level[parent[1:]] < level[1:]).all()
    p = covertree.Points(np.arange(900), np.ones(900, np.int64), v, 0.04)
    t, y = p.tree, covertree.unit(p.v)
    for i in range(len(t.start)):
        assert covertree.chords(y[t.start[i] : t.end[i]], p.centres[i][None]).max() <= t.radius[i]
    done = sum((t.end[i] - t.start[i]) * (t.end[j] - t.start[j]) for i, j in covertree.tiles(p, p, 0.3163))
    assert sorted(p.reps.tolist()) == list(range(900)) and (done < 250_000 or kind == "spread") and done <= 420_000
    u, _, n = covertree.compared(p, p, 0.95)
    c = y @ y.T >= 0.95
    assert dict(zip(u.tolist(), n.tolist())) == {int(p.reps[i]): int(c[i].sum()) - 1 for i in range(900) if c[i].sum() > 1}
