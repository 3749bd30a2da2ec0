import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from callweave.llm import op08_embeddings as e
from callweave.llm import op09_minhash as m
from tests.conftest import SF001
from tests.llm.texts import documents, odd_texts


def components(n, links):
    f = m.Forest(n)
    for a, b in links:
        f.join(a, b)
    return [f.root(i) for i in range(n)]


# ------------------------------------------------------------------ operator 8
def link_matrix(vectors, cosine=0.9):
    n = len(vectors)
    out = np.zeros((n, n), bool)
    for i, j in combinations(range(n), 2):
        a, b = vectors[i], vectors[j]
        fine = all(v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in (a, b))
        if fine and len(a) == len(b):
            a, b = (np.array(v, float) / np.abs(v).max() for v in (a, b))
            out[i, j] = out[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine
    return out


def vectors(n=160, dim=24):
    r = np.random.default_rng(4)
    out = []
    for _ in range(n // 8):
        v = r.normal(size=dim)
        out += [(v + s * r.normal(size=dim)).tolist() for s in (0.05, 0.2, 0.25, 0.3, 0.35, 0.4)] + [v.tolist(), (3 * v).tolist()]
    return out + [None, [], [0.0] * dim, [1.0] * (dim - 1) + [None], [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0] * dim, [1.0] * dim,
                  [1.0] * 3, [1.0, 1.0, 1.1], [1e200] * 3, [1e-200] * 3, [-1.0] * 3, [0.5], [2.0], [-2.0]]


@pytest.mark.parametrize("tile, parts", [(4_096, 4), (7, 4), (16, 1), (50, 8)])
def test_links_of_vectors(spark, tile, parts):
    vs = vectors()
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vs)], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS key", "2 AS n", "3 AS cell")
    got = {r.vec_id: r for r in e.near_duplicates(rows.repartition(5), tile=tile, parts=parts).collect()}
    links = link_matrix(vs)
    top = components(len(vs), zip(*np.nonzero(links)))
    assert len(got) == len(vs)
    for i in range(len(vs)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i].sum(), top[i], top[i] == i), i


def test_repeated_and_empty_vectors(spark):
    rows = spark.createDataFrame([(5, [1.0, 0.0])] * 3 + [(2, [1.0, 0.01]), (9, None)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in e.near_duplicates(rows).collect())
    assert got == [(2, 3, 2, True), (5, 3, 2, False), (5, 3, 2, False), (5, 3, 2, False), (9, 0, 9, True)]
    assert e.near_duplicates(rows.limit(0)).count() == 0


def test_pigeonhole_shares_add_up():
    for dim, parts in ((64, 4), (10, 3), (2, 4), (1, 4)):
        edges = e.part_edges(dim, parts)
        assert edges[0] == 0 and edges[-1] == dim and all(a < b for a, b in zip(edges, edges[1:]))
        assert np.allclose(e.rotation(dim) @ e.rotation(dim).T, np.eye(dim))


def test_embedding_query(spark):
    from callweave.llm.queries import QUERIES
    rows = spark.read.parquet(f"{SF001}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = (v @ v.T >= 0.9) & ~np.eye(len(v), dtype=bool)
    got = {r.vec_id: r.n_links for r in QUERIES["op8_embedding_dedup"](spark, SF001).collect()}
    assert got == {r.vec_id: links[i].sum() for i, r in enumerate(rows)}


# ------------------------------------------------------------------ operator 9
def shingles(text):
    ws = m.words_of(text)
    n = min(len(ws), 5)
    return Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)) if ws else Counter()


def classes(texts, similarity=0.8):
    """Brute force: equal texts, and all pairs that share a shingle."""
    sets, by, same, links = [shingles(t) for t in texts], defaultdict(list), {}, []
    for i, (t, s) in enumerate(zip(texts, sets)):
        links.append((same.setdefault(t, i), i))
        for k in s:
            by[k].append(i)
    for i, j in {p for v in by.values() for p in combinations(v, 2)}:
        low, high = (sum((f(sets[i], sets[j])).values()) for f in (lambda a, b: a & b, lambda a, b: a | b))
        if low >= similarity * high - 1e-9:
            links.append((i, j))
    return components(len(texts), links)


def near_copies(groups=12, seed=8):
    """Families of texts around the limit, chains of copies of copies, shared passages, junk."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    passage = [word() for _ in range(40)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([4, 5, 6, 30, 120]))] + (passage if g % 3 == 0 else [])
        for k in range(10):
            if k % 5 == 4:
                base = out[-1].split()  # go on from a copy
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                t[r.randrange(len(t))] = word()
            out.append(" ".join(t + base[:3] * (k % 2)))
        out += [out[-1]] * 3
    out += ["x y " * 60, "x y " * 61, "x y " * 40, "same line here\n" * 30, "same line here\n" * 33]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("tile", [1_024, 5])
def test_classes_of_texts(spark, tile):
    texts = near_copies() + odd_texts()
    docs = documents(spark, texts).selectExpr("*", "1 AS print", "2 AS class", "3 AS kept")
    got = {r.doc_id: r for r in m.near_duplicates(docs.repartition(6), tile=tile).collect()}
    want = classes(texts)
    assert len(got) == len(texts) > len(set(want))
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(want))
    assert {i for i, r in got.items() if r.kept} == set(want)
    assert all(r.class_size == want.count(r.class_id) for r in got.values())


def test_one_of_each_class_stays(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, None), (4, ""), (5, ""), (6, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _id", "2 AS _row", "3 AS _print")
    out = m.deduplicate(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect())
    assert got == [(False, 3, "a b c d e f"), (False, 4, ""), (False, 6, " "), (True, 0, None)]
    assert m.deduplicate(docs.limit(0)).count() == 0 == m.near_duplicates(docs.limit(0)).count()


def test_registers_estimate_the_probability_jaccard():
    a, b = {i: 1.0 + i % 3 for i in range(60)}, {i: 1.0 + i % 2 for i in range(20, 80)}
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in {*a, *b}) for i in a if i in b)
    hashes = lambda s: m.mixed(np.array(sorted(s), np.uint64) + np.uint64(99))
    doc = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    got = m.probminhash(doc, np.r_[hashes(a), hashes(b)], np.array([a[k] for k in sorted(a)] + [b[k] for k in sorted(b)]), 2, 4_096)
    assert (got[0] == got[1]).mean() == pytest.approx(want, abs=0.04)


def test_early_termination_changes_nothing():
    """A document's registers do not depend on the documents beside it."""
    doc, el, w = np.array([0, 0, 1, 2, 2, 2]), m.mixed(np.arange(6, dtype=np.uint64)), np.array([1.0, 3.0, 2.0, 1.0, 1.0, 9.0])
    together = m.probminhash(doc, el, w, 3, 64)
    for d in range(3):
        own = doc == d
        assert (m.probminhash(np.zeros(own.sum(), int), el[own], w[own], 1, 64)[0] == together[d]).all()


def test_exact_links_are_a_spanning_forest():
    texts = near_copies(6, 3)
    left, right = m.exact_links(texts, [2] * len(texts), 0.8)
    unequal = classes(texts)
    top = components(len(texts), zip(left, right))
    assert len(left) < len(texts) and [top[i] for i in range(len(texts))] == unequal


def test_minhash_query(spark):
    from callweave.llm.queries import QUERIES
    sf = SF001.replace("0.001", "0.01")
    docs = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = classes([t for _, t in docs])
    got = {r.doc_id: r.class_id for r in QUERIES["op9_minhash_dedup"](spark, sf).collect()}
    assert got == {d: docs[c][0] for (d, _), c in zip(docs, want)}


def test_links_at_the_edge_of_a_block(spark):
    """Pairs a share and a little apart, nearly all of it along the first coordinate of a block."""
    from callweave.llm import op08_embeddings as op08
    rng, rows, want, base = np.random.default_rng(11), [], {}, 0
    for dim in (4, 8, 64):
        turn, made = op08.rotation(dim), []
        share = 0.2 * op08.part_edges(dim, op08.PARTS)[1] / dim
        for _ in range(150):
            a = rng.normal(size=dim)
            a /= np.linalg.norm(a)
            first = a[0] + np.sqrt(share + rng.uniform(-1, 1) * op08.SLACK)
            if abs(first) < 1:
                b = np.r_[first, a[1:] * np.sqrt((1 - first ** 2) / (1 - a[0] ** 2))]
                made += [a @ turn.T, b @ turn.T]
        v = np.array(made)
        links = (v @ v.T >= 0.9).sum(axis=1) - 1
        assert (links > 0).sum() > 60
        rows += [(base + i, x.tolist()) for i, x in enumerate(v)]
        want.update({base + i: int(n) for i, n in enumerate(links)})
        base += 1_000
    got = op08.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.vec_id: r.n_links for r in got.collect()} == want


def test_large_tiles_are_compared_in_strips(monkeypatch):
    """A group's distances are not held at once, and the strips lose no link."""
    import tracemalloc

    import pandas as pd

    from callweave.llm import op08_embeddings as op8
    rng = np.random.default_rng(8)
    base = rng.normal(size=(600, 4))
    v = np.concatenate([base + rng.normal(scale=.01, size=base.shape) for _ in range(5)])
    group = lambda side: pd.DataFrame({"key": np.arange(len(v)), "side": side, "two": False, "part": 0, "v": list(v), "n": 1})
    whole = op8._group_links(group(0), 0.999, 1)
    monkeypatch.setattr(op8, "STRIP", 100 * len(v))
    tracemalloc.start()
    strips = op8._group_links(group(0), 0.999, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < len(v) ** 2 * 4 and len(whole[whole.other < 0]) > 2000
    assert strips.reset_index(drop=True).equals(whole.reset_index(drop=True))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.999
    assert strips[strips.other < 0].groupby("key")["links"].sum().to_dict() == {i: k - 1 for i, k in enumerate(near.sum(axis=1)) if k > 1}
