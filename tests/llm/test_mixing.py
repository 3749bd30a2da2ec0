from collections import Counter, defaultdict

import pytest

from callweave.llm import op07_mixing as m
from tests.conftest import SF001
from tests.llm.texts import documents, odd_texts


def want_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, t = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        each = left / sum(w[s] for s in open_)
        over = {s for s in open_ if each * w[s] > most * sizes[s]}
        for s in over or open_:
            t[s] = most * sizes[s] if over else each * w[s]
        left -= sum(most * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    return t


def want_seats(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max((k for k in weights if weights[k] > 0), key=lambda k: (weights[k] / (2 * got[k] + 1), [-ord(c) for c in k]), default=None)
        if best is None:
            break
        got[best] += 1
    return got


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 50, "d": 3, None: 70}, {"x": 5}, {"a": 0, "b": 7}, {"z": 400, "é": 9, "Z": 9, "~": 800}])
def test_targets(spark, sizes):
    rows = m.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in rows} == pytest.approx(want_targets(sizes))


@pytest.mark.parametrize("weights, seats", [({"a": 53, "b": 24, "c": 23}, 7), ({"a": 1, "b": 1, "c": 1}, 2), ({"a": 1000, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}, 3),
                                            ({f"k{i:02}": (i * 37) % 11 + 0.5 for i in range(30)}, 17), ({"a": 0.0, "b": 5.0}, 9), ({"a": 7.0, "b": 7.0}, 0)])
def test_highest_quotients(spark, weights, seats):
    p = spark.createDataFrame([(k, float(w), seats) for k, w in weights.items()], "k string, w double, seats long")
    got = {r.k: r.q for r in m.apportion(p, [], ["k"], "w", "seats", "q").collect()}
    assert got == want_seats(weights, seats)


def check(rows, texts_of, block):
    sizes, taken, targets = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        targets[r.source] = r.target
    want = want_targets(dict(sizes))
    assert targets == pytest.approx({s: want[s] for s in targets})
    for r in rows:
        assert r.source_size == sizes[r.source]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 3 * block + 0.01 * t, s


def test_mix(spark):
    texts = [t for t in odd_texts(9, 200)] + [f"w{i} " * (i % 90) for i in range(300)]
    docs = documents(spark, texts, lambda i: None if i % 7 == 0 else f"s{i % 5}" if i % 3 else "hot").selectExpr("*", "1 AS size", "2 AS taken", "3 AS block")
    rows = m.mix(docs, block=16).collect()
    assert len(rows) == len(texts)
    check(rows, texts, 16)
    again = m.mix(docs.repartition(7), block=16).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))  # reruns agree, however the rows are dealt
    many = m.mix(docs, block=16, shard_words=200).collect()  # quotas of many shards
    assert sum(r.taken for r in many) == pytest.approx(sum(r.taken for r in rows), rel=0.2) and all(r.taken <= 2 * r["size"] for r in many)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 4 + [(None, None, None), (2, "d e", None)], "doc_id long, text string, source string")
    rows = m.mix(docs, block=1).collect()
    assert Counter(r.doc_id for r in rows) == {1: 4, None: 1, 2: 1}
    assert m.mix(docs.limit(0)).count() == 0
    assert m.mixed_documents(docs.limit(0)).count() == 0


def test_whole_documents(spark):
    docs = documents(spark, [f"w{i} " * 30 for i in range(200)], lambda i: f"s{i % 4}").selectExpr("*", "5 AS _times")
    out = m.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    rows, by = out.collect(), defaultdict(int)
    for r in rows:
        by[r.source] += len(r.text.split())
    want = want_targets({f"s{i}": 1500 for i in range(4)})
    assert dict(by) == pytest.approx(want, rel=0.15)
    assert max(Counter(r.doc_id for r in rows).values()) <= 2


def test_sources_of_long_documents(spark):
    """Documents of many blocks: each is taken near its source's ratio, and the words still meet the targets."""
    import random
    r, names = random.Random(5), "abcdef"
    texts = [f"w{i} " * int(300 * 2 ** r.uniform(-2, 2)) for i in range(900)]
    docs = documents(spark, texts, lambda i: names[i % 6])
    for options in ({"block": 16}, {"block": 16, "shard_words": 8_000}):
        rows, words, most = m.mix(docs, **options).collect(), Counter(), Counter()
        taken = Counter()
        for x in rows:
            taken[x.source] += x.taken
            most[x.source] = max(most[x.source], x["size"])
        for x in m.mixed_documents(docs.repartition(5), **options).collect():
            words[x.source] += len(x.text.split())
        for s in names:
            assert abs(words[s] - taken[s]) <= most[s], (s, words[s], taken[s])
        times = Counter(x.doc_id for x in m.mixed_documents(docs, **options).collect())
        assert times == Counter(x.doc_id for x in m.mixed_documents(docs.repartition(3), **options).collect()) and max(times.values()) <= 2


def test_equal_rows_share_the_copies(spark):
    docs = spark.createDataFrame([(7, "a b c d " * 5, "x", i) for i in range(9)] + [(8, "e f g h " * 5, "y", 9 + i) for i in range(9)], "doc_id long, text string, source string, n int")
    taken, got = Counter(), Counter()
    for x in m.mix(docs, block=4).collect():
        taken[x.doc_id] += x.taken
    rows = m.mixed_documents(docs, block=4).collect()
    for x in rows:
        got[x.doc_id] += 1
    assert all(abs(20 * got[i] - taken[i]) <= 10 for i in (7, 8)), (got, taken)
    assert max(Counter(x.n for x in rows).values()) <= 2


def test_query(spark):
    from callweave.llm.queries import QUERIES
    rows = QUERIES["op7_source_mix"](spark, SF001).collect()
    assert len(rows) == spark.read.parquet(f"{SF001}/documents.parquet").count()
    check(rows, None, m.BLOCK)
