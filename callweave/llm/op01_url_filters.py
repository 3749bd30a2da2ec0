"""URL filters by association rules (operator 1).

A URL is a set of tokens (scheme, host labels, path segments, query keys; digits
become ``#``). Tokens that occur in exactly the same labelled URLs say the same and are
one item. Spark's FP-growth mines the combinations of items of block-labelled URLs; an
item that only block rows hold is a rule already and is not combined. The rules
"tokens => block" that pass a minimum of support (a number of rows, not a share) and
confidence are kept. If a URL has more than 12 items left, combinations of any length are found
level by level instead: one that only block rows hold, or that the same rows hold as a part of
it, is not made longer, as a longer one could decide nothing else. No combination is left out.
Each rule is filed under its rarest token. A URL looks up its own tokens there, so
it meets only rules whose rarest token it has, and each is verified against the
whole token set. Distinct token sets are looked up once, then joined back: sets of more
than a thousandth of all pages (at most a thousand) by broadcast under a fingerprint of
128 bits, the others by a shuffle, so no task takes all rows of a common set.

Rules given by hand (host, path, verdict) come before the mined ones; the longest
that fits wins. They are a parameter and become one expression: no join.

What is counted grows with the combinations that differ in their rows: many long block-labelled
URLs that share most, not all, of their parts with allowed ones have very many.

Native: Spark ML's FP-growth and DataFrame functions only. Defined results: a null
url, or one without ``://``, has empty host and path, no tokens, no rule, and is
allowed; repeated rows are judged each; without labelled URLs no rule is mined; an empty
table gives no rows; other columns of the tables, whatever their names, are not read; a
URL may be of any length.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import written

ALLOW, BLOCK = "allow", "block"
#: a rule needs this number of block-labelled URLs, at every size of the table, and this confidence
MIN_COUNT, MIN_CONFIDENCE = 5, 0.6
#: items in one list of FP-growth, which makes every subset; longer ones are mined by levels
WIDTH = 12
#: a key of more than 1 / HOT_SHARE of the rows is hot; hot tokens are dealt over SALTS tasks
HOT_SHARE, SALTS = 1000, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL (null or no ``://``: none)."""
    numbered = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    parts = lambda mark, c, sep: F.transform(F.filter(F.split(c, sep), lambda x: x != ""), lambda x: F.concat(F.lit(mark), numbered(x)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.translate(F.regexp_extract(url, "^([^:]*)", 1), UPPER, LOWER))),
        parts("host:", host_of(url), r"\."), parts("path:", path_of(url), "/"),
        F.transform(F.filter(keys, lambda x: x != ""), lambda x: F.concat(F.lit("key:"), numbered(x))))
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def _token_items(sets: DataFrame, min_count: int) -> DataFrame:
    """(token, members, pure): tokens that occur in exactly the same labelled URLs are one item, named by its
    smallest token (equal fingerprints of 128 bits); items of fewer than ``min_count`` block rows go.
    An item of block rows alone is pure: a rule by itself, of which no larger one can be surer."""
    each = sets.select(F.explode("tokens").alias("token"), "n", "bad", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit("b"), "tokens").alias("b"))
    rows = each.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("n").alias("rows"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("sets"))
    same = rows.where(F.col("bad") >= min_count).groupBy("a", "b", "sets", "rows", "bad").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return same.select(F.col("members")[0].alias("token"), "members", (F.col("bad") == F.col("rows")).alias("pure"))  # members share a URL: no longer than one


def _meet(sets: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct token sets with the rows of ``index`` filed under one of their tokens. A token of
    more than 1 / HOT_SHARE of the sets is salted: there are at most HOT_SHARE x mean set size of these."""
    each = sets.withColumn("token", F.explode("tokens"))
    uses = each.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    hot = uses.where(F.col("uses") * HOT_SHARE > sets.count()).select("token", F.lit(True).alias("hot"))
    left = each.join(F.broadcast(hot), "token", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("tokens"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = index.join(F.broadcast(hot), "token", "left").withColumn("salt", F.explode(salts)).drop("hot")
    return left.join(right, ["token", "salt"]).where(F.size(F.array_except("rule", "tokens")) == 0)


def _combinations(sets: DataFrame, named: DataFrame, min_count: int) -> DataFrame:
    """(tokens): the combinations of items, of any length, that ``min_count`` block rows hold and that may
    be rules. A combination held by the same rows as a part of it says what the part says; nor can any longer
    one be surer than one of block rows alone: neither is extended, and no rule is lost."""
    key = [F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit("b"), "tokens").alias("b")]
    each = written(_meet(sets, named).select(*key, "n", "bad", F.col("rule")[0].alias("item")), "url-items-of-sets")
    level, found, live = each.select("a", "b", "n", "bad", F.array("item").alias("rule")), [], None
    while True:
        counted = level.groupBy("rule").agg(F.sum("n").alias("all"), F.sum("bad").alias("bad")).where(F.col("bad") >= min_count)
        if live is not None:  # each part of one item less must have been extended, and be held by more rows
            part = F.explode(F.transform("rule", lambda x: F.array_remove("rule", x))).alias("part")
            parts = counted.select("*", part).join(live.select(F.col("rule").alias("part"), F.col("all").alias("of")), "part")
            counted = (parts.groupBy("rule", "all", "bad").agg(F.count(F.lit(1)).alias("parts"), F.min("of").alias("least"))
                       .where((F.col("parts") == F.size("rule")) & (F.col("least") > F.col("all"))))
        counted = written(counted.select("rule", "all", "bad"), "url-level")
        found.append(counted.select(F.col("rule").alias("tokens")))
        live = counted.where("bad < all")
        if live.isEmpty():
            return reduce(DataFrame.unionByName, found)
        longer = level.join(live.select("rule"), "rule", "left_semi").join(each.select("a", "b", "item"), ["a", "b"]).where(F.col("item") > F.element_at("rule", -1))
        level = written(longer.select("a", "b", "n", "bad", F.concat("rule", F.array("item")).alias("rule")), "url-longer")


def mine_rules(labelled: DataFrame, url_col: str = "url", label_col: str = "label", min_count: int = MIN_COUNT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, support, confidence) of the rules tokens => block. ``label`` is allow or block.

    Candidates are the combinations of items that at least ``min_count`` block rows hold, whatever the
    number of labelled rows; confidence and support come of one count over all labelled URLs. A rule
    goes when a part of it is a rule of the same confidence or more: it could decide nothing."""
    spark = labelled.sparkSession
    sets = written(labelled.where(F.col(label_col).isin(ALLOW, BLOCK)).select(url_tokens(F.col(url_col)).alias("tokens"), (F.col(label_col) == BLOCK).alias("is_bad"))
                   .where(F.size("tokens") > 0).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_bad").alias("bad")), "labelled-urls")
    n, bad = sets.agg(F.sum("n"), F.sum("bad")).first()
    if (bad or 0) < min_count:
        return spark.createDataFrame([], "tokens array<string>, support double, confidence double")
    items = written(_token_items(sets, min_count), "url-items")
    named = items.where(~F.col("pure")).select("token", F.array("token").alias("rule"))
    held = _meet(sets.where("bad > 0"), named).groupBy("tokens", "bad").agg(F.array_sort(F.collect_list("token")).alias("items"))
    # min_count copies of a set are as good as more: the counts of the rules are taken below
    lists = written(held.select("items", F.explode(F.sequence(F.lit(1), F.least("bad", F.lit(min_count)).cast("int"))).alias("copy")), "url-items-of-rows")
    found, size = items.where("pure").select(F.array("token").alias("tokens")), lists.count()
    if not lists.where(F.size("items") > WIDTH).isEmpty():
        found = found.unionByName(_combinations(sets, named, min_count))
    elif size:
        model = FPGrowth(itemsCol="items", minSupport=max(min_count - 0.5, 0.5) / size).fit(lists)  # Spark rounds the count up
        found = found.unionByName(model.freqItemsets.select(F.array_sort("items").alias("tokens")))
    found = written(found, "url-combinations")
    met = _meet(sets, rule_index(found).withColumnRenamed("tokens", "rule"))
    counted = met.groupBy("rule").agg(F.sum("n").alias("all"), F.sum("bad").alias("bad")).where(F.col("bad") >= min_count)
    sure = counted.select("rule", (F.col("bad") / F.lit(n)).alias("support"), (F.col("bad") / F.col("all")).alias("confidence")).where(F.col("confidence") >= min_confidence)
    parts = sure.withColumn("token", F.explode("rule")).join(items, "token")
    rules = written(parts.groupBy("rule", "support", "confidence").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("tokens"))
                    .select("tokens", "support", "confidence"), "url-rules-all")
    smaller = rule_index(rules).select("token", F.col("tokens").alias("rule"), F.col("confidence").alias("c"))
    idle = _meet(rules, smaller).where((F.size("rule") < F.size("tokens")) & (F.col("c") >= F.col("confidence"))).select("tokens").distinct()
    return written(rules.join(idle, "tokens", "left_anti"), "url-rules")


def rule_index(rules: DataFrame) -> DataFrame:
    """Rules filed under the token that the fewest rules use (ties: the smaller token)."""
    uses = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    each = rules.withColumn("token", F.explode("tokens")).join(uses, "token")
    return each.groupBy(*rules.columns).agg(F.min(F.struct("uses", "token"))["token"].alias("token"))


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined_rule, confidence): of the distinct token sets, those that a rule fits, with
    the most confident rule (ties: the smaller token list)."""
    index = rule_index(rules.select("tokens", "confidence")).withColumnRenamed("tokens", "rule")
    met = _meet(sets.select("tokens"), index)
    best = met.groupBy("tokens").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.concat_ws(" ", "rule").alias("rule"))).alias("b"))
    return best.select("tokens", F.col("b.rule").alias("mined_rule"), (-F.col("b.c")).alias("confidence"))


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest given rule (host, path, verdict) that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id",
                url_col: str = "url", min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """host, path, rule, verdict, mined_rule and confidence of every page."""
    url = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), url_tokens(url).alias("tokens"))
    sets = written(p.groupBy("tokens").agg(F.count(F.lit(1)).alias("pages")), "url-sets")
    total = sets.agg(F.sum("pages")).first()[0] or 0
    found = written(sets.join(match_rules(sets, mine_rules(labelled, url_col, "label", min_count, min_confidence)), "tokens", "left"), "url-matches")
    keys = [F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit("b"), "tokens").alias("k2")]
    hot = F.broadcast(found.where(F.col("pages") * HOT_SHARE > total).select(*keys, "mined_rule", "confidence"))  # at most HOT_SHARE rows
    keyed = p.select("*", *keys)
    rare = keyed.join(hot.select("k1", "k2"), ["k1", "k2"], "left_anti").join(found.where("mined_rule IS NOT NULL").drop("pages"), "tokens", "left")
    judged = keyed.join(hot, ["k1", "k2"]).unionByName(rare).withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    mined = F.when(F.col("mined_rule").isNotNull(), BLOCK).otherwise(ALLOW)
    return judged.select(id_col, "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", mined).alias("verdict"), "mined_rule", "confidence")
