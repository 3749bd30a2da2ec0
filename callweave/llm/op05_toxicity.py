"""Toxicity (operator 5).

A lexicon is learned from labelled documents: words and word beginnings (stems) that
toxic documents use far more often than clean ones. Every distinct word of a text is
run through Levenshtein automata intersected with the lexicon's trie, so misspelled
terms are met too; misspellings that clean documents use are not counted. Each hit is
scored by its window, the line around it: a hit where a quotation is open that the same
line closes is a quotation, any other abuse. The state of the marks is carried along the
text in one pass, so a quotation may be of any length.
A logistic model over the counts (exact or misspelled, quoted or not, by length),
fitted on the same sample with a prior that hits count for toxicity, gives the score.

Learning uses at most ``sample`` documents a class (ids of the labelled rows in a
seeded order; those with crc32(doc_id) mod 4 = 2 are held out), and gives at most
``terms`` terms: both are what is broadcast. Scoring is a map over all documents,
whole texts, without a shuffle.

Defined results: null and empty texts get the score of a text without hits; repeated
rows are scored each; without toxic labels nothing is predicted toxic; an empty table
gives no rows; of the other columns of a table none is read, whatever its name; a text
of any length is read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callweave.llm.common import only_for, prepare_python, words, written
from callweave.llm.lexicon import FuzzyLexicon

SAMPLE, TERMS, THRESHOLD = 10_000, 4_000, 0.3
#: a term's odds in toxic documents, and the evidence (log-likelihood ratio) against chance among all words tried
MIN_LOG_ODDS, MIN_EVIDENCE = 2.0, 14.0
SHORTEST, STEMS = 4, (4, 5, 6, 7, 8)
#: words remembered by a task: a full memory is emptied (bounded memory, same results)
MEMORY = 500_000
#: words may hold digits and underscores between letters (a letter swapped for a digit); the runs of letters in them are read too
_WORD, _LETTERS = re.compile(r"[^\W\d_](?:\w*[^\W\d_])?"), re.compile(r"[^\W\d_]+")


def is_quoted(before: str, after: str) -> bool:
    """Whether a quotation is open at the end of ``before`` and closed in ``after``."""
    straight = before.count('"') % 2 == 1
    curly = max(before.rfind(c) for c in "“„«") > max(before.rfind(c) for c in "”»")
    return straight and '"' in after or curly and any(c in after for c in "”“»")


_MARKS = re.compile('["“„«”»\n]')


def quotations(text: str) -> tuple[list[int], list[bool]]:
    """Places of the quotation marks and line ends of a text, and for the stretch before each of
    them, and after the last, whether ``is_quoted`` holds there for its line."""
    marks = [(m.start(), m[0]) for m in _MARKS.finditer(text)]
    opened, straight, curly = [], False, False
    for _, c in marks:
        opened.append((straight, curly))
        straight, curly = (False, False) if c == "\n" else (not straight, curly) if c == '"' else (straight, c in "“„«")
    opened.append((straight, curly))
    closes, straight, curly = [(False, False)], False, False
    for _, c in reversed(marks):
        straight, curly = (False, False) if c == "\n" else (straight or c == '"', curly or c in "”“»")
        closes.append((straight, curly))
    return [at for at, _ in marks], [o[0] and c[0] or o[1] and c[1] for o, c in zip(opened, reversed(closes))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def runs_of(word: str) -> list[tuple[int, int]]:
    """Places of the runs of letters in a word that holds other signs too."""
    return [] if word.isalpha() else [r.span() for r in _LETTERS.finditer(word) if r.span() != (0, len(word))]


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(toxic, text) of at most ``sample`` labelled documents a class that are not held out."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).where(~held_out(F.col("_id")) & F.col("_id").isNotNull()).distinct()
    each = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    each = each.groupBy("_id").agg(F.max("toxic").alias("toxic")).join(ids, "_id", "left_semi")
    some = lambda t: each.where(F.col("toxic") == t).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = written(some(0).unionByName(some(1)), "toxic-ids")  # at most 2 * sample rows
    found = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string")).join(F.broadcast(chosen), "_id").where("text IS NOT NULL")
    # near copies would vouch for each other's words: of texts with the same smallest hash of three
    # words (copies have it as often as they agree) one is read
    at = lambda i: F.get("_w", i)
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    found = found.withColumn("_w", words(F.col("text"))).select(
        "toxic", "text", F.when(F.size("_w") > 3, F.array_min(windows)).otherwise(F.xxhash64("text")).alias("group"))
    return written(found.groupBy("toxic", "group").agg(F.min("text").alias("text")).select("toxic", "text"), "toxic-sample")


def _counted(sample: DataFrame, keys_of) -> DataFrame:
    """(key, clean, toxic): documents of either class with a key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(c: Counter, kind: int) -> pa.RecordBatch:
            n, zero = list(c.values()), [0] * len(c)
            both = [zero, n] if kind else [n, zero]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *(pa.array(x, pa.int64()) for x in both)], ["key", "clean", "toxic"])

        for b in batches:
            found = (Counter(), Counter())
            for t, x in zip(b.column(0).to_pylist(), b.column(1)):
                found[t].update(keys_of(x.as_py()))
            for kind in (0, 1):
                yield rows(found[kind], kind)

    return sample.mapInArrow(count, "key string, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _terms_of(text: str | None) -> set[str]:
    """Distinct words, and stems with a star."""
    ws = set(words_of(text))
    ws = {x for w in ws for x in (w, *(w[a:b] for a, b in runs_of(w))) if len(x) >= SHORTEST}
    return ws | {w[:n] + "*" for w in ws for n in STEMS if len(w) > n}


def choose_terms(candidates: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """Words and stems of (term, documents): a stem stays if no single longer term of it has
    nearly all its documents (else that term says it better), and then stands for all of these."""
    docs, words, stems = dict(candidates), [], []
    below: dict[str, list[str]] = {}
    for t in docs:
        plain = t.rstrip("*")
        for n in range(1, len(plain) + (not t.endswith("*"))):
            if plain[:n] + "*" in docs:
                below.setdefault(plain[:n] + "*", []).append(t)
    covered: set[str] = set()
    for t in sorted(docs, key=lambda t: (len(t.rstrip("*")), t)):
        if t in covered:
            continue
        if not t.endswith("*"):
            words.append(t)
        elif all(docs[x] < 0.9 * docs[t] for x in below.get(t, ())):
            stems.append(t[:-1])
            covered.update(below.get(t, ()))
    return words, stems


def learn_lexicon(sample: DataFrame, terms: int = TERMS) -> tuple[list[str], list[str]]:
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}  # two rows
    odds = F.log((F.col("toxic") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    base = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    evidence = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    best = (_counted(sample, _terms_of).where((F.col("toxic") > 0) & (odds >= MIN_LOG_ODDS) & (evidence >= MIN_EVIDENCE))
            .orderBy(F.desc("toxic"), "key").limit(terms).select("key", "toxic").collect())  # at most `terms` rows
    return choose_terms([(r[0], r[1]) for r in best])


class Scorer:
    """Features and score of a text; one for all tasks of a worker."""

    def __init__(self, words: list[str], stems: list[str], harmless: set[str], weights: list[float] | None = None):
        self.lexicon, self.harmless, self.weights = FuzzyLexicon(words, stems), harmless, weights
        self.plain: set[str] = set()  # words that are no hit, and below, those that are
        self.hits: dict[str, list[tuple[int, int, int]]] = {}  # from, to and errors of what is met in the word

    def _met_in(self, word: str) -> list[tuple[int, int, int]]:
        """What is met: the word, or the runs of letters in it if only these are exact or met."""

        def errors(w: str) -> int | None:
            hit = self.lexicon.find(w) if len(w) >= SHORTEST - 1 and w not in self.harmless else None
            return hit and hit[0]

        whole = errors(word)
        if whole == 0:
            return [(0, len(word), 0)]
        runs = [(a, b, e) for a, b in runs_of(word) if (e := errors(word[a:b])) is not None]
        if whole is not None and all(e for _, _, e in runs):
            return [(0, len(word), whole)]
        return runs

    def met(self, words: set[str]) -> set[str]:
        """Those of the words that are near a term, or hold letters that are."""
        new = words - self.plain
        found = {w for w in new if w in self.hits}
        for w in new - found:
            hit = self._met_in(w)
            if hit:
                self.hits[w] = hit
                found.add(w)
            else:
                self.plain.add(w)
        if len(self.plain) + len(self.hits) >= MEMORY:
            self.plain.clear()
            self.hits = {w: self.hits[w] for w in found}
        return found

    def near(self, text: str | None) -> set[str]:
        """Words of a text that are a misspelling of a term."""
        return {w[a:b] for w in self.met(set(words_of(text))) for a, b, e in self.hits[w] if e > 0}

    def features(self, text: str | None) -> list[float]:
        """1, and the numbers of hits (log): exact, misspelled, each as abuse and as quotation;
        and the share of all of them."""
        n = [0, 0, 0, 0]
        low = text.lower() if text else ""
        ws = _WORD.findall(low)
        met = self.met(set(ws))
        if met:
            marks, quoted = quotations(low)
            for m in _WORD.finditer(low):
                for a, _, e in self.hits[m[0]] if m[0] in met else ():
                    n[2 * (e > 0) + quoted[bisect_left(marks, m.start() + a)]] += 1
        return [1.0, *(math.log1p(x) for x in n), math.log1p(sum(n)) / math.log(2 + len(ws))]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: prior of the weights: rare without a hit, an abusive hit tells most
PRIOR = [-3.0, 4.0, 1.5, 4.0, 1.5, 0.0]


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> list[float]:
    """Logistic regression with a normal prior around PRIOR: Newton's method, each step halved
    until the loss goes down (it is convex, so this ends at the optimum)."""
    prior, sign = np.array(PRIOR), 2 * y - 1

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -sign * (x @ w)).sum() + strength / 2 * ((w - prior) ** 2).sum())

    w, now = prior.copy(), loss(prior)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (p - y) + strength * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-8 and not loss(w - size * step) <= now - 1e-4 * size * float(g @ step):
            size /= 2
        if size <= 1e-8 or np.abs(step).max() < 1e-9:
            break
        w = w - size * step
        now = loss(w)
    return [float(v) for v in w]


def never_against(weights: list[float]) -> list[float]:
    """A hit, or a share of hits, never speaks for a clean text: weights below zero are zero."""
    return [weights[0], *(max(0.0, w) for w in weights[1:])]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS):
    """Broadcast of what a Scorer needs (words, stems, harmless words, weights): bounded by
    ``terms`` and by the sample."""
    spark = docs.sparkSession
    prepare_python(spark)
    some = labelled_sample(docs, labels, sample)
    whole, stems = learn_lexicon(some, terms)
    first = spark.sparkContext.broadcast((whole, stems, set(), None))
    made: list[Scorer] = []  # one a task

    def near(text: str | None) -> set[str]:
        if not made:
            made.append(Scorer(*first.value))
        return made[0].near(text)

    def misspellings(rows: DataFrame) -> set[str]:
        """Words near a term that clean documents use too, so words of the language: the most used."""
        found = _counted(rows, near).where((F.col("clean") > 0) & (F.col("toxic") < 3 * F.col("clean"))).orderBy(F.desc("clean"), "key")
        return {r["key"] for r in found.limit(5 * terms).collect()}  # at most 5 * terms words

    # the weights are fitted on one half, with the misspellings of the other half known: so a
    # misspelling that was never seen counts as much as it tells
    half = F.xxhash64("text") % 2 == 0
    second = spark.sparkContext.broadcast((whole, stems, misspellings(some.where(half)), None))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*second.value)
        for b in batches:
            f = [s.features(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))], ["toxic", "f"])

    rows = some.where(~half).mapInArrow(features, "toxic int, f array<double>").groupBy("toxic", "f").count().collect()  # of at most 2 * sample rows
    x = np.array([r["f"] for r in rows for _ in range(r["count"])], float).reshape(-1, len(PRIOR))
    y = np.array([r["toxic"] for r in rows for _ in range(r["count"])], float)
    return spark.sparkContext.broadcast((whole, stems, misspellings(some), never_against(fit_weights(x, y))))


def with_scores(docs: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and the score of each text."""
    kept = docs.drop(score_col)
    at = kept.columns.index(text_col)
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_for("toxicity")
        s = Scorer(*model.value)
        for b in batches:
            out = pa.array([s.score(x.as_py()) for x in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, score_col])

    return kept.mapInArrow(score, StructType([*kept.schema.fields]).add(score_col, "double"))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    d = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    scored = with_scores(d, learn(d, labels, sample, terms))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
