"""Whole driver tables with their texts led by what the text functions look for.

The invented prose of the tables holds no lexicon word, section mark, signature or routing
word, so the functions over it would only ever take one branch. Here every row keeps its
text, and the row's number chooses a lead in front of it (one in seven rows has none). Each
frame has its SQL twin for the oracles, built from the same leads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.sources.tables import table

NBSP = "\u00a0"
DOCUMENT_LEADS = [
    "Definitely, clearly and exactly so.\n", "It seems likely, but might be unclear.\n", f"{NBSP} async def run_it(a, b):\n", "ANALYSIS: the cause\nANALYSIS: again\n",
    "  def go(x):  \n    maybe\u3000certain\n", "possibly, could be\n",
]
#: a blank lead of a query stands for the whole text
QUERY_LEADS = ["the function named parse ", "which callers depends on this ", "something similar to ", f" {NBSP}\t", "called 'run_it' ", "long " * 220]
PATH_LEADS = ["src/test_a.py/", "pkg.py/test/", "a/b.py"]


def _lead(leads: list[str], number: Column, rest: Column, blank: str | None = None) -> Column:
    n = len(leads) + 1
    out = rest
    for i, lead in enumerate(leads):
        out = F.when(number % n == i, F.lit(lead) if lead == blank else F.concat(F.lit(lead), rest)).otherwise(out)
    return out


def _lead_sql(leads: list[str], number: str, rest: str, blank: str | None = None) -> str:
    quoted = lambda s: " || ".join("chr(10)" if x == "\n" else "chr(9)" if x == "\t" else "'" + x.replace("'", "''") + "'" for x in _pieces(s))
    cases = " ".join(f"WHEN {i} THEN {quoted(lead)}{'' if lead == blank else ' || ' + rest}" for i, lead in enumerate(leads))
    return f"CASE ({number}) % {len(leads) + 1} {cases} ELSE {rest} END"


def _pieces(s: str) -> list[str]:
    out = [""]
    for c in s:
        if c in "\n\t":
            out += [c, ""]
        else:
            out[-1] += c
    return [x for x in out if x]


DOCUMENTS_SQL = f"(SELECT * REPLACE ({_lead_sql(DOCUMENT_LEADS, 'doc_id', 'text')} AS text) FROM documents)"
CONVERSATIONS_SQL = f"(SELECT * REPLACE ({_lead_sql(QUERY_LEADS, 'conv_id * 5 + turn', 'text', QUERY_LEADS[3])} AS text) FROM conversations)"
PAGES_SQL = f"(SELECT * REPLACE ({_lead_sql(PATH_LEADS, 'page_id', 'url')} AS url) FROM pages)"


def documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", _lead(DOCUMENT_LEADS, F.col("doc_id"), F.col("text")))


def conversations(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("text", _lead(QUERY_LEADS, F.col("conv_id") * 5 + F.col("turn"), F.col("text"), QUERY_LEADS[3]))


def pages(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").withColumn("url", _lead(PATH_LEADS, F.col("page_id"), F.col("url")))
