"""Quality rules (operator 3).

Hashed n-grams of a document (its words, and the last three letters of its words)
are scored by log(p_trusted / p_raw): two multinomials over ``buckets`` hash
buckets, the raw one counted over all documents, the trusted one over all documents
that are labelled good. The sum is divided by the number
of n-grams. A document is kept if its score is at least the threshold, half way
between the mean scores of all labelled good and bad documents, and if
no base rule fails (too few words; too many words in repeated three-word windows).

The counting pass sums buckets on the map side, the model
is one array of ``buckets`` numbers, and the verdict is an expression on the row.
The labelled ids are counted: up to ``FEW`` are broadcast, so that texts are not shuffled; more are
joined as the planner finds best, by a shuffle of the texts if need be.

Native: DataFrame functions only. Defined results: a null text has no words and
fails the base rules; repeated rows are judged each; without good or bad labels the
threshold is minus infinity and only the base rules reject. Repeated windows are
compared by 64-bit hashes of their three words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import WORD_PATTERN, words, written

BUCKETS = 1 << 16
#: labelled ids that are broadcast (some 64 MB)
FEW = 2_000_000
MIN_WORDS, MAX_REPEAT = 50, 50
#: fixed value: the signs that count as symbols
SYMBOLS = "#*$%&|<>"


def _buckets_of(word: Column, n: int) -> tuple[Column, Column]:
    """Buckets of a word and of its last three letters."""
    return F.pmod(F.xxhash64(word), F.lit(n)).cast("int"), F.pmod(F.xxhash64(F.substring(word, -3, 3), F.lit(3)), F.lit(n)).cast("int")


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("_words", words(F.col(text_col).cast("string")))


def base_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (with ``_words``) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_PATTERN)))
    at = lambda i: F.get("_words", i)
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    d = d.withColumn("_windows", F.when(F.size("_words") >= 4, windows))
    # the windows that come again, for rows that have any (most have none, and are not sorted)
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    d = d.withColumn("_sorted", F.when(again, F.sort_array("_windows")))
    d = d.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda h, i: h == F.get("_sorted", i + 1))))
    few = F.filter(F.transform("_windows", lambda h, i: F.when(F.array_contains("_twice", h), i)), lambda i: i.isNotNull())
    # many windows that come again: by sorting the places, as looking each up would be quadratic
    d = d.withColumn("_places", F.when(F.size("_twice") > 32, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda k: F.get("_places", k)["h"]
    twice = F.filter("_places", lambda x, k: F.coalesce(near(k - 1) == x["h"], F.lit(False)) | F.coalesce(near(k + 1) == x["h"], F.lit(False)))
    many = F.sort_array(F.transform(twice, lambda x: x["i"]))
    d = d.withColumn("_starts", F.when(F.size("_twice") > 32, many).when(F.size("_twice") > 0, few))
    covered = F.aggregate("_starts", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    d = (d.withColumn("n_words", F.size("_words").cast("long"))
         .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
         .withColumn("n_symbols", F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"))
         .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
         .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("_lines", "_windows", "_sorted", "_twice", "_places", "_starts")


def labelled_documents(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of every labelled id, once (of several labels the lowest)."""
    each = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    return written(each.groupBy("doc_id").agg(F.min("quality").alias("quality")), "quality-labels")


#: the name of the time when labels were sampled
labelled_sample = labelled_documents


def _sent(labelled: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` of ``labelled``, broadcast only under a counted bound."""
    return F.broadcast(ids) if labelled.count() <= FEW else ids


def llr_model(docs: DataFrame, labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``llr``, the log ratio of every bucket (counts plus one half)."""
    good = labelled.where("quality = 1").select(F.col("doc_id").alias("_good"))
    d = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text")).join(_sent(labelled, good), F.col("_id") == F.col("_good"), "left")
    d = with_words(d).select(F.col("_good").isNotNull().cast("int").alias("good"), F.explode(F.concat(
        F.transform("_words", lambda w: _buckets_of(w, buckets)[0]), F.transform("_words", lambda w: _buckets_of(w, buckets)[1]))).alias("bucket"))
    counts = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "good"])
    every = every.groupBy().agg(F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"),
                                F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("all"))  # `buckets` entries
    ratio = lambda b: F.log((b["good"] + 0.5) / (F.col("n_good") + 0.5 * buckets)) - F.log((b["raw"] + 0.5) / (F.col("n_raw") + 0.5 * buckets))
    # without a trusted document there is nothing to prefer
    llr = F.when(F.col("n_good") > 0, F.transform("all", ratio)).otherwise(F.transform("all", lambda b: F.lit(0.0)))
    return written(every.select(llr.alias("llr")), "quality-model")


def with_score(docs: DataFrame, model: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` (with ``_words``) and ``llr_score``: the mean log ratio of its n-grams (no words: 0)."""

    def total_of(llr: Column) -> Column:
        def add(total: Column, word: Column) -> Column:
            a, b = _buckets_of(word, buckets)
            return total + F.get(llr, a) + F.get(llr, b)

        return F.aggregate("_words", F.lit(0.0), add)

    # `buckets` numbers, whatever the input, read by a subquery: plans do not hold them. It is named
    # once, as the only element of an array, so that the optimiser puts it where it is used and
    # no row carries it (a subquery cannot be written into a lambda)
    d = docs.withColumn("_llr", model.select("llr").scalar())
    total = F.get(F.transform(F.array("_llr"), total_of), F.lit(0))
    return d.withColumn("llr_score", F.when(F.size("_words") > 0, total / (2 * F.size("_words"))).otherwise(0.0)).drop("_llr")


def threshold(docs: DataFrame, labelled: DataFrame, model: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: half way between the mean scores of the two labelled classes."""
    ids = labelled.select(F.col("doc_id").alias("_id"), "quality")
    d = docs.select(F.col("doc_id").cast("long"), F.col("text")).join(_sent(labelled, ids), F.col("doc_id") == F.col("_id"))
    s = with_score(with_words(d), model, buckets).where(F.size("_words") > 0)
    mean = lambda q: F.avg(F.when(F.col("quality") == q, F.col("llr_score")))
    return written(s.agg(F.coalesce((mean(0) + mean(1)) / 2, F.lit(float("-inf"))).alias("threshold")), "quality-threshold")


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` and the base columns, llr_score and kept."""
    labelled = labelled_documents(labels)
    model = llr_model(docs, labelled, buckets)
    limit = threshold(docs, labelled, model, buckets).select("threshold").scalar()
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr_score", "kept")
    d = with_score(base_columns(with_words(docs.drop(*own))), model, buckets)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr_score") >= limit)).drop("_words")


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept. The row number keeps the optimiser from moving the
    filter below the columns it is made of, which would make these again in the filter."""
    d = judge(docs, labels, **options).withColumn("_row", F.monotonically_increasing_id())
    return d.where("kept AND _row >= 0").select(*docs.columns)
