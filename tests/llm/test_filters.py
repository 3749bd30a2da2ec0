import random
import re
from bisect import bisect_left
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from callweave.llm import op01_url_filters as u
from callweave.llm import op03_quality as q
from callweave.llm import op05_toxicity as x
from callweave.llm.lexicon import FuzzyLexicon, errors_allowed
from tests.conftest import SF001
from tests.llm.texts import documents, odd_texts

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


# ------------------------------------------------------------------ operator 1
def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def given(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "HTTPS://A.Example.ORG/es/1?x=1", "http://example.org/en/12#t", "http://xexample.org/es/",
        "http://a.com/fr/", "http://a.com/FR/", "http://com/de/x", "http://É.Com/de/", "x://y://z.org/q", "http://a.org?q=/es/", "http://a.net/de/a/b?k=1&j&=2"]


def test_hosts_paths_and_given_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS tokens")
    none = spark.createDataFrame([], "url string, label string")
    for r in u.filter_urls(pages, none, RULES).collect():
        host, path = parts(URLS[r.page_id])
        rule, verdict = given(host, path)
        assert (r.host, r.path, r.rule, r.verdict, r.mined_rule) == (host, path, rule, verdict or "allow", None), URLS[r.page_id]
    assert u.filter_urls(pages.limit(0), none, RULES).count() == 0


def test_mined_rules(spark):
    """Only a combination (host and path) tells bad pages; neither token alone does."""
    rows = []
    for i in range(40):
        rows += [(f"http://spam.net/win/{i}", "block"), (f"http://spam.net/news/{i}", "allow"), (f"http://good{i % 3}.net/win/{i}", "allow"), (f"http://x{i}.net/a", "allow")]
    rows += [(None, "block"), ("http://y.net/z", None), ("http://y.net/z", "odd")]
    labelled = spark.createDataFrame(rows, "url string, label string")
    rules = {tuple(r.tokens): r for r in u.mine_rules(labelled).collect()}
    assert ("host:spam", "path:win") in rules and ("host:spam",) not in rules and ("path:win",) not in rules
    assert rules["host:spam", "path:win"].confidence == 1.0 and abs(rules["host:spam", "path:win"].support - 0.25) < 0.01
    pages = spark.createDataFrame([(1, "https://www.spam.net/win/9/8"), (1, "https://www.spam.net/win/9/8"), (2, "http://spam.net/news/win2"), (3, "http://a.org/win/spam")], "page_id long, url string")
    got = Counter((r.page_id, r.verdict) for r in u.filter_urls(pages, labelled, RULES).collect())
    assert got == {(1, "block"): 2, (2, "allow"): 1, (3, "allow"): 1}


def brute_rules(rows, tokens_of):
    """The mined confidence by token set: items are tokens of the same labelled rows, every combination is counted."""
    rows = [(tokens_of[url], label) for url, label in rows if label in ("allow", "block") and tokens_of[url]]
    where = {}
    for i, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(i)
    items = {}
    for t, at in where.items():
        items.setdefault(frozenset(at), []).append(t)
    bad = {i for i, (_, label) in enumerate(rows) if label == "block"}
    rules = []
    for size in range(1, 6):
        for some in combinations(items, size):
            at = frozenset.intersection(*some)
            if len(at & bad) >= 5 and len(at & bad) / len(at) >= 0.6:
                rules.append((frozenset(t for k in some for t in items[k]), len(at & bad) / len(at)))
    return lambda tokens: max((c for r, c in rules if r <= tokens), default=None)


def test_verdicts_equal_a_brute_force_miner(spark):
    r = random.Random(4)
    rows = [(f"http://{r.choice('ab')}.{r.choice(['net', 'fr'])}/{r.choice('pq')}/{r.choice('pst')}?{r.choice('uv')}=1", r.choice(["allow", "block", None])) for _ in range(150)]
    rows += [(f"https://long.net/{'/'.join('xyz')}", "block")] * 5
    urls = sorted({url for url, _ in rows} | {"http://other.net/x", "http://a.net/y/x/z", "x://q"}) * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    tokens_of = {p.url: frozenset(p.t) for p in pages.select("url", u.url_tokens(F.col("url")).alias("t")).collect()}
    best = brute_rules(rows, tokens_of)
    got = u.filter_urls(pages, spark.createDataFrame(rows, "url string, label string")).collect()
    assert len(got) == len(urls)
    for g in got:
        c = best(tokens_of[urls[g.page_id]])
        assert (g.verdict, g.confidence) == ("block" if c else "allow", c), urls[g.page_id]
    assert 0 < sum(g.verdict == "block" for g in got) < len(got)


def test_mining_is_bounded_on_long_repeated_urls(spark):
    """40 equal segments five times over are one item and one rule; 30 that differ by one segment each end too."""
    same = "http://deep.net/" + "/".join(f"a{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    names = [f"b{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30)]
    rows = [(same, "block")] * 5 + [(f"http://g{'abcde'[i]}.net/x", "allow") for i in range(5)]
    labelled = spark.createDataFrame(rows, "url string, label string")
    rules = u.mine_rules(labelled).collect()
    assert len(rules) == 1 and len(rules[0].tokens) == 41 and rules[0].confidence == 1.0 and rules[0].support == 0.5
    near = [("http://deep.net/" + "/".join(n for n in names if n != out), "block") for out in names]
    rules = {tuple(x.tokens) for x in u.mine_rules(spark.createDataFrame(near + rows[5:], "url string, label string")).collect()}
    assert rules == {(f"path:{n}",) for n in names} | {("host:deep",), ("host:net", "scheme:http")}  # 30 of 30, and 30 of 35


def test_support_is_a_number_at_every_size(spark):
    """Five block rows of a host make a rule among ten rows and among ten thousand."""
    labelled = spark.range(10_000).selectExpr("concat('http://h', translate(cast(id AS string), '0123456789', 'abcdefghij'), '.net/') AS url", "'allow' AS label").unionByName(
        spark.range(5).selectExpr("'http://spam.net/' AS url", "'block' AS label"))
    assert [tuple(r.tokens) for r in u.mine_rules(labelled).collect()] == [("host:spam",)]


def test_common_token_sets_are_judged_by_broadcast(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN 'http://spam.net/a' WHEN id % 3 = 1 THEN null ELSE concat('http://h', translate(cast(id AS string), '0123456789', 'abcdefghij'), '.net/a') END AS url")
    labelled = spark.createDataFrame([("http://spam.net/a", "block")] * 5 + [("http://x.net/a", "allow")] * 9, "url string, label string")
    rows = u.filter_urls(pages, labelled).collect()
    assert sorted(r.page_id for r in rows) == list(range(3000))
    assert all((r.verdict == "block") == (r.page_id % 3 == 0) for r in rows)


def test_matching_is_a_subset_test(spark):
    rules = [["a", "b"], ["b", "c", "d"], ["e"]]
    sets = [["a"], ["a", "b"], ["b", "c"], ["b", "c", "d", "e"], []]
    r = spark.createDataFrame([(x, 0.1, 0.5 + i / 10) for i, x in enumerate(rules)], "tokens array<string>, support double, confidence double")
    got = {tuple(m.tokens): m.mined_rule for m in u.match_rules(spark.createDataFrame([(s,) for s in sets], "tokens array<string>"), r).collect()}
    assert got == {("a", "b"): "a b", ("b", "c", "d", "e"): "e"}


def test_url_query(spark):
    from callweave.llm.queries import QUERIES, URL_RULES
    assert URL_RULES == RULES
    urls = {p.page_id: p.url for p in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    rows = QUERIES["op1_url_filter"](spark, SF001).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        rule, verdict = given(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined_rule else "allow"))


# ------------------------------------------------------------------ operator 3
def base(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", t)
    windows = list(zip(w, w[1:], w[2:]))
    n, covered = Counter(windows), set()
    for i, g in enumerate(windows):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [y for y in t.split("\n") if re.search("[^\x20\x09-\x0D]", y)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


QUALITY_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
REPEATS = ["a b c", "a b c d", "a a a", "a a a a", "a a a a a a", "a b c x a b c", "a b c a b c a b c", "x\ny\nx\n \n \nx", "a b c\u00a0d a b c", "p q r s t " * 30, " ".join(f"u{i % 60}" for i in range(150))]


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_base_rules(spark):
    texts = odd_texts() + REPEATS
    docs = documents(spark, texts).selectExpr("*", "1 AS kept", "2 AS n_words", "3 AS llr_score")
    rows = q.judge(docs, no_labels(spark)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in QUALITY_COLUMNS) == base(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed)  # without labels
    assert q.judge(docs.limit(0), no_labels(spark)).count() == 0


def quality_corpus():
    good = [f"{'plain words of one kind go on here ' * 2}{i} " + " ".join(f"talk{(i * 7 + j) % 90}ing" for j in range(60)) for i in range(40)]
    bad = [" ".join(f"zq{(i * 5 + j) % 80}%%%" for j in range(70)) + f" {i}" for i in range(40)]
    return good + bad


def test_scores_split_the_classes(spark):
    texts = quality_corpus()
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80) if i % 2] + [(None, 1, 0), (999, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts)
    rows = q.judge(docs, labels).collect()
    assert all(r.kept == (r.doc_id < 40) for r in rows if not r.base_failed)
    assert sum(not r.base_failed for r in rows) == 80
    kept = q.kept_documents(docs.unionByName(docs), labels)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == {i: 2 for i in range(40)}


def test_score_is_the_mean_log_ratio(spark):
    import math
    texts, n = quality_corpus()[::8], 64
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 5), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    sample = q.labelled_sample(labels)
    got = {r.doc_id: r.llr_score for r in q.with_score(q.with_words(docs), q.llr_model(docs, sample, n), n).collect()}
    grams = docs.selectExpr("doc_id", "explode(split(text, ' ')) AS w").where("w != ''").selectExpr(
        "doc_id", f"explode(array(pmod(xxhash64(w), {n}), pmod(xxhash64(right(w, 3), 3), {n}))) AS b").collect()
    raw, good = Counter(g.b for g in grams), Counter(g.b for g in grams if g.doc_id < 5)
    ratio = {b: math.log((good[b] + .5) / (sum(good.values()) + .5 * n)) - math.log((raw[b] + .5) / (sum(raw.values()) + .5 * n)) for b in range(n)}
    for i in range(len(texts)):
        own = [ratio[g.b] for g in grams if g.doc_id == i]
        assert got[i] == pytest.approx(sum(own) / len(own))


def test_model_is_whole(spark):
    """65,536 buckets, no number of the model is rounded, and no plan holds the model."""
    texts = quality_corpus()
    docs, n = documents(spark, texts), 1 << 16
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    sample = q.labelled_sample(labels)
    model = q.llr_model(docs, sample)
    llr = model.first().llr
    assert len(llr) == n
    scored = q.with_score(q.with_words(docs), model)
    grams = docs.selectExpr("doc_id", "explode(split(text, ' ')) AS w").where("w != ''").selectExpr(
        "doc_id", f"explode(array(pmod(xxhash64(w), {n}), pmod(xxhash64(right(w, 3), 3), {n}))) AS b").collect()
    own = {i: [llr[g.b] for g in grams if g.doc_id == i] for i in range(len(texts))}
    for r in scored.collect():
        assert r.llr_score == pytest.approx(sum(own[r.doc_id]) / len(own[r.doc_id]), rel=1e-12, abs=1e-13)
    assert len(q.judge(docs, labels)._jdf.queryExecution().toString()) < 200_000


def test_quality_query(spark):
    from callweave.llm.queries import QUERIES
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op3_quality"](spark, SF001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in QUALITY_COLUMNS) == base(texts[r.doc_id])


def test_quality_is_native(spark):
    for name in ("op1_url_filter", "op3_quality", "op7_source_mix"):
        from callweave.llm.queries import QUERIES
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|InArrow", plan)


# ------------------------------------------------------------------ operator 5
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x_ in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x_ != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_lexicon_against_distances():
    import random
    r = random.Random(3)
    terms = ["idiot", "moron", "scum", "worthless", "pathetic", "mor", "disgusting"]
    lexicon = FuzzyLexicon(terms, ["vequ"])
    words = [*terms, "vequa", "veq", "vequ", "", "xvequ"] + ["".join(r.choice(t + "xyz") if r.random() < 0.2 else c for c in t if r.random() > 0.1) for t in terms * 60]
    for w in words:
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= errors_allowed(t)]
        want = (0, "vequ") if w.startswith("vequ") else min(near, default=None)
        assert lexicon.find(w) == want, w


def test_misspelled_stems_against_distances():
    """A stem is met by every word of which a beginning is near it."""
    import random
    r = random.Random(4)
    terms, stems = ["idiot", "achtung"], ["bomente", "achlich", "réeuxa", "boco", "schrecklich"]
    lexicon = FuzzyLexicon(terms, stems)
    words = [*stems, "achlichb", "achl1chkeit", "b0mentera", "rêeuxament", "boc0os", "bocoos", "", "achlic", "achtumg"]
    words += ["".join(r.choice(t + "xyz1") if r.random() < 0.12 else c for c in t if r.random() > 0.06) + r.choice(["", "x", "ung", "mente"]) for t in (terms + stems) * 40]
    for w in words:
        exact = [(0, s) for s in stems if w.startswith(s)]
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= errors_allowed(t)]
        near += [(e, s) for s in stems if (e := min(distance(w[:k], s) for k in range(len(w) + 1))) <= errors_allowed(s)]
        assert lexicon.find(w) == (min(exact) if exact and len({len(s) for _, s in exact}) == 1 else min(near, default=None)), w


def test_misspelled_stems_and_digits_count_as_misspelled():
    """A stem with a typing error, or with a digit for a letter, in each language; letters beside a digit still count."""
    s = x.Scorer(["idiot", "scum"], ["achlich", "bomente", "réeux"], set(), x.PRIOR)
    exact, fuzzy = s.features("idiot"), s.features("idiat")
    assert exact[1] > 0 and fuzzy[3] > 0
    for w in ("idi0t", "achlochkeit", "achl1chkeit", "bomemtera", "b0mentera", "réeoxment", "r3euxment", "réeu_xment"):
        assert s.features(f"ab {w} cd")[1:5] == fuzzy[1:5], w
    for w in ("scum2you", "you_idiot", "idiot_9", "achlichkeit", "7scum"):
        assert s.features(f"ab {w} cd")[1:5] == exact[1:5], w
    assert s.near("ab idi0t you_idiat scum cd") == {"idi0t", "idiat"}


def test_quotations():
    assert x.is_quoted('he said "you ', ' are" bad') and x.is_quoted("« tu ", " es »") and not x.is_quoted("you ", " are")
    assert not x.is_quoted('"a" and you ', ' are') and not x.is_quoted('he said "you', " are")


def test_quotations_are_carried_along_a_line():
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice('ab""“”„«»\n') for _ in range(r.randrange(30)))
        marks, quoted = x.quotations(text)
        for i, c in enumerate(text):
            if c in "ab":
                line = text.rfind("\n", 0, i) + 1
                assert quoted[bisect_left(marks, i)] == x.is_quoted(text[line:i], text[i + 1:].split("\n")[0]), (text, i)
    s = x.Scorer(["blockhead"], [], set(), x.PRIOR)
    kind = lambda text: [i for i, v in enumerate(s.features(text)[1:5]) if v]
    far = "w " * 100
    assert kind(f'he said "{far} blockhead {far}" then') == [1]  # a long quotation
    assert kind(f'he said "{far}", blockhead, and "then"') == [0]  # closed before, however near
    assert kind(f'an open " mark\nyou blockhead\nand " one') == [0]


def test_hits_never_speak_against():
    assert x.never_against([-5.0, 4.0, -0.1, -2.0, 1.0, 0.0]) == [-5.0, 4.0, 0.0, 0.0, 1.0, 0.0]


def toxic_corpus(n=160):
    import random
    r, texts, toxic = random.Random(7), [], []
    for i in range(n):
        ws = [f"wor{r.choice('abcdefgh')}{r.choice('klmnop')}" for j in range(40)]
        bad = i % 4 == 0
        if bad:
            ws[7] = ("blockhead", "numbskull")[i // 4 % 2]
            ws[20] = "zorg" + "abcd"[i // 4 % 4]
        texts.append(" ".join(ws))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity(spark):
    texts, toxic = toxic_corpus()
    n = len(texts)
    more = ["you are a blockheed ok", "you are a numbskull", "zorgnew thing", None, "", " ", "wora worb", "a " * 20_000 + "blockhead"]
    docs = documents(spark, texts + more)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (10_000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in x.score_documents(docs.selectExpr("*", "1 AS score", "2 AS held_out"), labels).collect()}
    import zlib
    assert len(rows) == n + len(more)
    for i, t in enumerate(toxic):
        assert rows[i].predicted == t and rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= rows[i].score <= 1
    assert [rows[n + k].predicted for k in range(8)] == [1, 1, 1, 0, 0, 0, 0, 1]
    quoted = x.Scorer(["blockhead"], [], set(), x.PRIOR)
    assert quoted.score('they said "you blockhead" then') < quoted.score("they said you blockhead then")


def test_learning_ignores_held_out_rows(spark):
    texts, toxic = toxic_corpus()
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    import zlib
    flipped = spark.createDataFrame([(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    assert x.learn(docs, labels).value == x.learn(docs, flipped).value


def test_weights_are_the_optimum():
    """Also from where a plain Newton step would leave the convex bowl."""
    import numpy as np
    r = np.random.default_rng(2)
    n = 3_000
    y = (r.random(n) < 0.35).astype(float)
    exact, fuzzy = np.log1p(r.poisson(6 * y)), np.log1p(r.poisson(np.where(y > 0, 2.0, 1.6) * 3))
    zero = np.zeros(n)
    features = np.column_stack([np.ones(n), exact, zero, fuzzy, zero, (exact + fuzzy) / 6])
    w = np.array(x.fit_weights(features, y))
    p = 1 / (1 + np.exp(-features @ w))
    assert np.abs(features.T @ (p - y) + (w - np.array(x.PRIOR))).max() < 1e-3  # no slope left
    assert ((p >= 0.3) == (y > 0)).mean() > 0.97
    assert x.fit_weights(np.zeros((0, 6)), np.zeros(0)) == x.PRIOR


def test_near_copies_count_once(spark):
    """Many copies of one toxic text, each with a change, do not make its words terms."""
    texts, toxic = toxic_corpus()
    copies = ["strangeword " + " ".join(texts[0].split()[1:30] + [f"end{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}"]) for i in range(60)]
    docs = documents(spark, texts + copies)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic + [1] * 60)], "doc_id long, quality int, toxic int")
    words, stems, _, _ = x.learn(docs, labels).value
    assert {"blockhead", "numbskull"} <= set(words) and "zorg" in stems
    assert not any(w.startswith("stran") for w in words + stems)


def test_nothing_to_learn(spark):
    docs = documents(spark, odd_texts())
    assert {r.predicted for r in x.score_documents(docs, no_labels(spark)).collect()} == {0}
    assert x.score_documents(docs.limit(0), no_labels(spark)).count() == 0


def test_held_out_accuracy(spark):
    from callweave.llm.queries import QUERIES
    sf = SF001.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    hit = Counter((labels[r.doc_id], r.predicted) for r in rows)
    assert hit[1, 1] >= 0.9 * (hit[1, 0] + hit[1, 1]) and hit[0, 1] <= 0.02 * (hit[0, 0] + hit[0, 1])


def test_no_combination_of_a_long_url_is_left_out(spark):
    """only two far apart segments of fourteen items, together, tell bad pages."""
    names = [chr(97 + i) * 2 for i in range(13)]
    a, z = names[3], names[12]
    others = [n for n in names if n not in (a, z)]
    url = lambda out: "http://long.net/" + "/".join(n for n in names if n not in out)
    rows = [(url([o]), "block") for o in others] + [(url([o, x]), "allow") for o in others for x in (a, z)]
    rules = u.mine_rules(spark.createDataFrame(rows, "url string, label string"), min_count=9).collect()
    assert [(r.tokens, r.confidence) for r in rules] == [([f"path:{a}", f"path:{z}"], 1.0)]


def test_every_label_counts(spark):
    """no class of labels is cut."""
    labels = spark.range(30_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic")
    got = q.labelled_documents(labels.unionByName(labels)).groupBy("quality").count().collect()
    assert sorted(map(tuple, got)) == [(0, 15_000), (1, 15_000)]


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    """The verdicts do not depend on how the labelled ids are joined."""
    docs = documents(spark, quality_corpus())
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    rows = lambda: sorted((r.doc_id, r.kept) for r in q.judge(docs, labels).collect())
    want = rows()
    monkeypatch.setattr(q, "FEW", 0)
    assert rows() == want
