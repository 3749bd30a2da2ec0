"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 7).

1. Sizes (words) of all documents are written once as a small table.
2. Targets: ``share`` of all words by weight; a source stops at ``most`` times its
   size and what it cannot take goes to the others by weight (solved at once: one
   level L with sum(min(most * size, L * weight)) = total).
3. Blocks of ``block`` words are allocated to the sources by the highest quotients
   target / (2k + 1), and each source's blocks to its shards in the same way, so
   every shard has an integer quota. A shard is a hash part of a source with about
   ``shard_words`` words: a large source has many.
4. In a shard the documents lie one after the other in seeded order and are cut
   into blocks. With n blocks and a quota q every block is taken q div n times, and
   the q mod n blocks of the lowest seeded hash once more. A document takes what
   its blocks take of it.

The allocation starts from the rounded shares of n/2 seats less, which n parties cannot
exceed, and gives the D <= n seats that are left to the highest quotients: a party of
weight t of T wins at most t * (D + n) / T + 1 of them, so only so many quotients are
made for each (linear in n).

Native: DataFrame functions only. Defined results: a null text has size 0, takes 0;
a null source is a source of its own; repeated rows take part each (equal rows are
interchangeable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import word_count, written

WEIGHTS = (3, 1, 2)
SHARE, MOST, BLOCK, SHARD_WORDS, SEED = 1.5, 2.0, 64, 1 << 17, "mix"
#: parts of a copy: sums of them are exact
UNIT = 1 << 24


def seeded(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *(F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts)))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with the weight and the target of each. One row a source."""
    by_name, by_room = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("room", F.asc_nulls_last("source"))
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(by_name) - 1) % len(weights))
    s = sources.withColumn("weight", w).withColumn("cap", most * F.col("source_size")).withColumn("room", F.col("cap") / F.col("weight"))
    s = s.withColumn("total", share * F.sum("source_size").over(every))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source, by room, that the level of the rest does not fill sets the level for all
    s = s.withColumn("nth", F.row_number().over(by_room))
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("nth", "level"))).over(every)["level"]
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, group: list[str], key: list[str], weight: str, seats: str, name: str) -> DataFrame:
    """``parties`` with the seats that each gets of its group's ``seats`` by the highest
    quotients weight / (2k + 1); equal quotients go to the lower ``key``."""
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_t", F.sum(weight).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    some = F.greatest(F.lit(0), F.col(seats) - F.col("_n") / 2)  # rounded up at most by half a seat a party
    p = p.withColumn("_first", F.when(F.col("_t") > 0, F.floor(F.col(weight) * some / F.col("_t") + 0.5)).otherwise(0).cast("long"))
    p = p.withColumn("_d", F.when(F.col("_t") > 0, F.col(seats) - F.sum("_first").over(g)).otherwise(0).cast("long"))
    reach = (F.ceil(F.col(weight) * (F.col("_d") + F.col("_n")) / F.col("_t")) + 1).cast("long")
    none = F.array(F.lit(0).cast("long"))
    p = p.withColumn("_k", F.explode(F.when((F.col("_d") == 0) | (F.col(weight) <= 0), none).otherwise(F.sequence(F.lit(0).cast("long"), reach))))
    order = g.orderBy(F.desc(F.col(weight) / (2 * (F.col("_first") + F.col("_k")) + 1)), *(F.asc_nulls_last(k) for k in key))
    won = (F.col(weight) > 0) & (F.row_number().over(order) <= F.col("_d"))
    p = p.withColumn("_won", F.when(won, 1).otherwise(0).cast("long"))
    # the explode left every party in its group's partition
    return p.groupBy(*parties.columns, "_first").agg(F.sum("_won").alias("_m")).withColumn(name, F.col("_first") + F.col("_m")).drop("_first", "_m")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK,
        shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, size, source, source_size, target, taken and print (of the text) of every row."""
    sizes = written(docs.select(F.col("doc_id"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"),
                                F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("print")), "sizes")
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    blocks = F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block + 0.5).cast("long")
    sources = apportion(sources.withColumn("blocks", blocks), [], ["source"], "target", "blocks", "quota")
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    # one row a source, and the sources' names and six numbers are all it holds
    sources = written(sources.select(F.col("source").alias("src"), "source_size", "target", "quota", "shards"), "sources")

    d = sizes.join(sources, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    d = d.withColumn("order", seeded("doc_id", "print"))
    d = d.withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.col("shards"))
    shards = d.groupBy("source", "shard", "quota").agg(F.sum("size").alias("words"))
    shards = apportion(shards, ["source"], ["shard"], "words", "quota", "mine")
    shards = shards.withColumn("n", F.ceil(F.col("words") / block).cast("long")).withColumn("mine", F.least("mine", F.floor(most * F.col("n")).cast("long")))
    shards = shards.select(F.col("source").alias("src"), F.col("shard").alias("part"), "mine", "n")

    place = Window.partitionBy("source", "shard")
    line = place.orderBy("order", "doc_id", "print")
    d = d.join(shards, F.col("source").eqNullSafe(F.col("src")) & (F.col("shard") == F.col("part"))).drop("src", "part")
    d = (d.withColumn("at", F.row_number().over(line))
         .withColumn("from", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")))
    span = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("size") - 1) / block)))
    d = d.withColumn("block", F.explode_outer(span))
    d = d.withColumn("part", F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("from"), F.col("block") * block))
    pick = place.orderBy(F.col("block").isNull(), seeded("source", "shard", "block"), "block")
    times = F.floor(F.col("mine") / F.col("n")) + F.when(F.dense_rank().over(pick) <= F.col("mine") % F.col("n"), 1).otherwise(0)
    d = d.withColumn("taken", F.when(F.col("block").isNull(), 0).otherwise(F.col("part") * times))
    return (d.groupBy("source", "shard", "at", "doc_id", "print", "size", "source_size", "target")
            .agg(F.sum("taken").cast("long").alias("taken"))
            .select("doc_id", "size", "source", "source_size", "target", "taken", "print"))


def whole_copies(taken: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``taken`` (doc_id, source, print, size, source_size, taken; one row a group of equal rows)
    with ``copies``: the whole copies of what is taken, and one more of some of the rest.

    The rests, as parts of a copy, are summed up along the documents of a source, and a
    document gets its copy where the sum passes a half. In a shard the documents lie by
    size (falling and rising by turns, seeded where equal): a copy then replaces rests of
    documents of about its size, so a shard's words stay within its longest document of
    what is taken. Parts are whole numbers, so reruns agree.
    """
    size, part = F.col("size"), f"((taken % size) * {UNIT}) div size"
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    d = taken.where("size > 0").withColumn("order", seeded("doc_id", "print"))
    d = d.withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % shards)
    d = written(d.withColumn("part", F.expr(part)), "rests")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("source", "shard").agg(F.sum("part").alias("parts"))  # one row a shard
    sums = sums.select(F.col("source").alias("_src"), F.col("shard").alias("_shard"), (F.coalesce(F.sum("parts").over(before), F.lit(0)) + UNIT // 2).alias("_start"))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_src")) & (F.col("shard") == F.col("_shard")))
    line = Window.partitionBy("source", "shard").orderBy(F.when(F.col("shard") % 2 == 0, -size).otherwise(size), "order", "doc_id", "print")
    d = d.withColumn("_sum", F.col("_start") + F.sum("part").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return d.withColumn("copies", F.expr(f"taken div size + _sum div {UNIT} - (_sum - part) div {UNIT}")).drop("order", "shard", "part", "_src", "_shard", "_start", "_sum")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its words in whole copies
    (``whole_copies``; ``docs`` has the columns doc_id, text and source; empty texts go).

    A document's text and source say which rows are its equals; rows that are equal in
    id, text and source share the copies: each gets as many, and some get one more.
    """
    group = ["doc_id", "source", "print", "size", "source_size"]
    taken = mix(docs, **options).groupBy(*group).agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    times = whole_copies(taken, options.get("shard_words", SHARD_WORDS)).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("print").alias("_print"),
        F.expr("cast(copies div rows as int)").alias("_times"), F.expr("copies % rows").alias("_more"))
    times = written(times, "copies")  # its size is known then: the rare uneven groups are broadcast
    d = docs.select(F.struct("*").alias("_doc"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_md5"))  # no name can clash
    met = F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & F.col("_doc.source").eqNullSafe(F.col("_source")) & (F.col("_md5") == F.col("_print"))
    even = d.join(times.where("_more = 0"), met).select("_doc", "_times")
    out = even.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")
    uneven = times.where("_more > 0")
    if uneven.isEmpty():
        return out
    # only rows with equals come here: they are numbered, and the first get one more
    nth = F.row_number().over(Window.partitionBy("_id", "_source", "_print").orderBy(F.xxhash64(F.to_json("_doc"))))
    dealt = d.join(uneven, met).withColumn("_times", F.col("_times") + (nth <= F.col("_more")).cast("int")).where("_times > 0")
    return out.unionByName(dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*"))
