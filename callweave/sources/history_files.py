"""A11 for large history documents: one JSON document is read by many tasks.

``sinks.read_history_files`` reads a document in one task. Here a document is read as pieces that
end at ``}``, which Spark splits by bytes. Quotes that are not escaped tell by a running count
whether a piece begins inside a string, and brackets outside strings by another how deep it
begins; both are sums within a split plus the totals of the splits before. An object at depth 2
is a record: its pieces are put together and parsed alone, so an analysis is the most that a task
holds of it. What is left of the document, with a mark for each run of records, is its header,
which shows whether the document is whole and which runs are the ``analyses``.

Defined results, as those of ``sinks.read_history_files``: a document that is not JSON, or of which an analysis is
not, gives no rows and the problem ``not JSON``; one without the key gives ``no analyses key``;
an empty list gives neither; null entries are rows of nulls; unknown fields are left out; empty
files and folders give nothing.

Many small documents need not be a file each: with ``mark`` a file holds several, each begun by it (as the
record separator of RFC 7464, which JSON never holds unescaped). A running count of marks names the
document of a piece; a document may lie in several splits, and one of white space alone is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.session import cut_lineage
from callweave.sources.sinks import ANALYSIS_SCHEMA

BAD = "_corrupt_record"
ELEMENT = T.StructType([*ANALYSIS_SCHEMA.fields, T.StructField(BAD, T.StringType())])
HEADER = T.StructType([T.StructField("analyses", T.ArrayType(T.StructType([T.StructField("#", T.LongType())]))), T.StructField(BAD, T.StringType())])
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
RECORD_DEPTH = 2  # root object, list
MARK = "\x1e"


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _with_before(pieces: DataFrame, **columns: Column) -> DataFrame:
    """Adds for each named column its sum over the pieces before, in the order of the document.
    Sums run within a split; a split's offset is summed from one row a split."""
    return _running(pieces, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), columns)


def _running(pieces: DataFrame, total, both_of, columns: dict[str, Column]) -> DataFrame:
    df = pieces.select("*", *(c.cast("long").alias(f"_{name}") for name, c in columns.items()))
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("file", "block").agg(*(total(f"_{n}").alias(n) for n in columns))
    offsets = totals.select("file", "block", *(total(n).over(splits).alias(f"_{n}_off") for n in columns))
    both = df.select("*", *(total(f"_{n}").over(inside).alias(f"_{n}_in") for n in columns)).join(offsets, ["file", "block"])
    return both.select(*pieces.columns, *(both_of(F.col(f"_{n}_in"), F.col(f"_{n}_off")).alias(n) for n in columns))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, text): what lies up to and with each ``}``; ``at`` orders the pieces of a split."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    raw = cut_lineage(raw)  # ``at`` must not change
    ends = raw.groupBy("file").agg(F.sum(F.octet_length("text") + 1).alias("_bytes"), F.max(F.struct("block", "at")).alias("_last"))
    # only what follows the last bracket of a file has none itself
    bare = (F.struct("block", "at") == F.col("_last")) & (F.col("_bytes") > F.col("_size"))
    return raw.join(ends, "file").select("file", "block", "at", F.when(bare, F.col("text")).otherwise(F.concat("text", F.lit("}"))).alias("text"))


def _documents(pieces: DataFrame, mark: str) -> DataFrame:
    """Pieces of files of several documents, cut at the marks; ``file`` tells the document."""
    parts = _with_before(pieces, doc=_count(F.col("text"), mark)).select("file", "block", "at", "doc", F.posexplode(F.split("text", f"[{mark}]")).alias("k", "text"))
    parts = parts.where(F.col("text").rlike(r"[^ \t\r\n]"))
    return cut_lineage(parts.select(F.concat("file", F.lit("#"), (F.col("doc") + F.col("k")).cast("string")).alias("file"), "block", "at", "text"))


def _start(tokens: Column, depth: Column, inside: Column) -> Column:
    """The number of the token that opens a record (0: none does)."""
    first = F.struct(F.lit(0).alias("i"), depth.cast("int").alias("depth"), inside.cast("int").alias("inside"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        out = s["inside"] == 0
        deeper = F.when(out & x.isin("{", "["), 1).when(out & x.isin("}", "]"), -1).otherwise(0)
        here = out & (x == "{") & (s["depth"] == RECORD_DEPTH) & (s["at"] == 0)
        return F.struct((s["i"] + 1).alias("i"), (s["depth"] + deeper).alias("depth"),
                        F.when(x == '"', 1 - s["inside"]).otherwise(s["inside"]).alias("inside"), F.when(here, s["i"] + 1).otherwise(s["at"]).alias("at"))
    return F.aggregate(tokens, first, step, lambda s: s["at"])


def _joined(order: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["text"]), "")


def read_history_split(spark: SparkSession, path: str, mark: str | None = None) -> tuple[DataFrame, DataFrame]:
    """History JSON documents -> (analyses, problems), each document read by as many tasks as it has splits.
    ``mark``: the character that begins each document of a file (none: a file is a document)."""
    plain = F.regexp_replace("text", r"(?s)\\.", "")  # without escapes
    p = _pieces(spark, path)
    p = _with_before(p if mark is None else _documents(p, mark), quotes=_count(plain, '"')).withColumn("quotes", F.col("quotes") % 2)
    outside = F.regexp_replace(F.concat(F.when(F.col("quotes") == 1, '"').otherwise(""), plain), '"[^"]*("|$)', "")
    p = p.withColumn("outside", outside).withColumn("deeper", _count(F.col("outside"), "{[") - _count(F.col("outside"), "}]"))
    # a record opens at depth 2; a piece that begins deeper must come up to it by a list's end first
    p = p.withColumn("listed", F.col("outside").rlike(r"(?s)\].*\{")).drop("outside")
    p = cut_lineage(_with_before(p, depth=F.col("deeper"), number=F.lit(1)))  # each sum reads its input twice

    tokens = F.when((F.col("depth") <= RECORD_DEPTH) | F.col("listed"), F.regexp_extract_all("text", F.lit(r'(?s)\\.|["\[\]{}]|[^"\\\[\]{}]+|\\'), F.lit(0)))
    p = p.withColumn("tokens", tokens)
    p = p.withColumn("start", F.coalesce(_start(F.col("tokens"), F.col("depth"), F.col("quotes")), F.lit(0)))
    opens = F.col("start") > 0
    # whether a piece begins in a record: the last piece before that opened one or came up to depth 2 tells
    told = F.when(F.col("depth") + F.col("deeper") <= RECORD_DEPTH, 2 * F.col("number")).when(opens, 2 * F.col("number") + 1)
    p = _running(p, F.max, F.greatest, {"told": told}).withColumn("within", F.coalesce(F.col("told") % 2 == 1, F.lit(False)))
    p = p.withColumn("head", F.when(opens, F.array_join(F.slice("tokens", F.lit(1), F.greatest(F.col("start") - 1, F.lit(0))), "")))
    # a record that only a comma parts from the one before belongs to its run
    first = opens & ~((F.col("depth") == RECORD_DEPTH) & F.col("head").rlike(r"^\s*,\s*$"))
    p = p.withColumn("first", first)
    p = _with_before(p, record=opens.cast("int"), run=F.col("first").cast("int"))
    p = p.withColumn("record", F.col("record") + opens.cast("int")).withColumn("run", F.col("run") + F.col("first").cast("int"))

    own = F.when(opens, F.array_join(F.slice("tokens", F.greatest(F.col("start"), F.lit(1)), F.size("tokens") + 1), "")).when(F.col("within"), F.col("text"))
    mark = F.concat("head", F.lit('{"#":'), F.col("run").cast("string"), F.lit("}"))
    left = F.when(F.col("first"), mark).when(~opens & ~F.col("within"), F.col("text"))
    p = cut_lineage(p.select("file", "block", "at", "record", "run", own.alias("own"), left.alias("left")))

    records = (p.where("own IS NOT NULL").groupBy("file", "record")
               .agg(F.max("run").alias("run"), _joined(F.struct("block", "at", F.col("own").alias("text"))).alias("text"))
               .select("file", "run", F.from_json("text", ELEMENT, PERMISSIVE).alias("a")))
    headers = (p.groupBy("file").agg(_joined(F.when(F.col("left").isNotNull(), F.struct("block", "at", F.col("left").alias("text")))).alias("text"))
               .select("file", F.from_json("text", HEADER, PERMISSIVE).alias("h")))
    headers = cut_lineage(headers.select("file", "h.*"))
    runs = headers.select("file", F.explode("analyses").alias("r")).select("file", F.col("r.#").alias("run"))
    records = cut_lineage(records.join(runs.where("run IS NOT NULL"), ["file", "run"], "left_semi").select("file", "a.*"))

    broken = records.where(F.col(BAD).isNotNull()).select("file").distinct().withColumn("_broken", F.lit(True))
    judged = headers.join(broken, "file", "left").select(
        F.col("file").alias("_file"), F.when(F.col(BAD).isNotNull() | F.col("_broken"), "not JSON").when(F.col("analyses").isNull(), "no analyses key").alias("problem"))
    problems = judged.where("problem IS NOT NULL")
    empty = runs.where("run IS NULL").select("file", *(F.lit(None).cast(f.dataType).alias(f.name) for f in ANALYSIS_SCHEMA))
    rows = records.drop(BAD).unionByName(empty).join(problems.select(F.col("_file").alias("file")), "file", "left_anti").drop("file")
    return rows.withColumn("timestamp", F.to_timestamp("timestamp")), problems
