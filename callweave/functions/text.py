"""Scalar text functions S1-S24 as native Column expressions.

Each takes Columns (or column names) and returns a Column, so it stays inside
whole-stage codegen and runs on every row of whole texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.fixed import (
    APPROACH_GRAPH, APPROACH_LOOKUP, CONFIDENCE_DEFAULT, CONFIDENCE_HIGH, CONFIDENCE_LOW,
    CONFIDENCE_MEDIUM, CONFIDENCE_WEIGHTS, MARK_ANALYSIS, MARK_CONFIDENCE, MARK_CONTEXT,
    MARK_FIXES, MARK_GRAPH, MAX_QUERY_LENGTH, SPACE_CLASS, TRUNCATION_MARKER,
)

NL = "\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lines(text) -> Column:
    return F.split(_c(text), NL, -1)


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


# ------------------------------------------------------------- S1, S2, S8
def module_name(relative_path) -> Column:
    """S1: '/' -> '.', and every '.py' removed (not only the suffix)."""
    return F.replace(F.replace(_c(relative_path), F.lit("/"), F.lit(".")), F.lit(".py"), F.lit(""))


def file_name(path) -> Column:
    """Last '/' part."""
    return F.element_at(F.split(_c(path), "/", -1), -1)


def repo_name(path) -> Column:
    """Last part of a directory path (a trailing '/' ignored)."""
    return file_name(F.regexp_replace(_c(path), "/+$", ""))


def file_extension(path) -> Column:
    """Suffix from the last dot of the file name; '' for dot files and no dot."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def is_test_file(path) -> Column:
    """``test_*``, ``*_test.py``, or a path part equal to ``test``."""
    name = F.lower(file_name(path))
    return (name.startswith("test_") | name.endswith("_test.py")
            | F.array_contains(F.split(_c(path), "/", -1), "test"))


# ------------------------------------------------------------ S3 - S7
def numbered_code(code, start_line) -> Column:
    """S3: every line as ``'%4d: line'`` numbered from ``start_line`` ('' for empty code)."""
    def numbered(line: Column, i: Column) -> Column:  # '%4d' by padding: a formatter a line is slow
        n = F.coalesce((_c(start_line) + i).cast("string"), F.lit("null"))
        return F.concat(F.when(F.length(n) < 4, F.lpad(n, 4, " ")).otherwise(n), F.lit(": "), line)

    body = F.array_join(F.transform(_lines(code), numbered), NL)
    return F.when(F.coalesce(_c(code), F.lit("")) == "", F.lit("")).otherwise(body)


def signature(code) -> Column:
    """First line that starts (after stripping) with 'def ' or 'async def ', stripped."""
    # only lines that hold the word are stripped
    hits = F.filter(F.transform(F.filter(_lines(code), lambda l: l.contains("def ")), _strip),
                    lambda l: l.startswith("def ") | l.startswith("async def "))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(""))


def snippet(code, max_lines: int = 20) -> Column:
    """First ``max_lines`` lines plus ``... (k more lines)`` when longer."""
    lines = _lines(code)
    n = F.size(lines)
    cut = F.concat(F.array_join(F.slice(lines, 1, max_lines), NL),
                   F.lit("\n... ("), (n - max_lines).cast("string"), F.lit(" more lines)"))
    return F.when(n <= max_lines, _c(code)).otherwise(cut)


def truncate(content, max_length: int) -> Column:
    """Cut at ``max_length``; back off to the last newline when it lies beyond 80 %."""
    c = _c(content)
    head = F.substring(c, 1, max_length)
    back = F.instr(F.reverse(head), NL)
    last_nl = F.when(back > 0, F.length(head) - back).otherwise(F.lit(-1))  # 0-based
    cut = F.when(last_nl > max_length * 0.8, F.substring(head, 1, last_nl)).otherwise(head)
    return F.when(F.length(c) <= max_length, c).otherwise(F.concat(cut, F.lit(TRUNCATION_MARKER)))


def collapse_whitespace(text) -> Column:
    """Strip, then every whitespace run becomes one space."""
    return F.trim(F.regexp_replace(_c(text), f"{SPACE_CLASS}+", " "))  # one space at either end at most


# ------------------------------------------------------------- S16, S17
def clean_query(query, max_length: int = MAX_QUERY_LENGTH) -> Column:
    """Trimmed and cut to ``max_length``; null when blank."""
    t = _strip(_c(query))
    return F.when(F.length(t) == 0, F.lit(None).cast("string")).otherwise(F.substring(t, 1, max_length))


def query_context_prefix(repo_name_col, tech_stack_col, priority_col, variant: str = "pipe") -> Column:
    """Context prefix from repo name, tech stack list and priority.

    ``pipe``: ``'Repository: r | Tech: a, b | Priority: p | '`` ('' without context);
    ``lines``: one ``'Key: value\\n'`` line per present key; ``none``: ''.
    """
    repo, tech, prio = _c(repo_name_col), _c(tech_stack_col), _c(priority_col)
    has = lambda x: x.isNotNull() & (x != "")
    tech_s = F.when(F.size(tech) > 0, F.array_join(tech, ", "))
    if variant == "none":
        return F.lit("")
    if variant == "lines":
        return F.concat(
            F.when(has(repo), F.concat(F.lit("Repository: "), repo, F.lit(NL))).otherwise(""),
            F.when(tech_s.isNotNull(), F.concat(F.lit("Tech Stack: "), tech_s, F.lit(NL))).otherwise(""),
            F.when(has(prio), F.concat(F.lit("Priority: "), prio, F.lit(NL))).otherwise(""))
    items = F.concat_ws(" | ",
                        F.when(has(repo), F.concat(F.lit("Repository: "), repo)),
                        F.when(tech_s.isNotNull(), F.concat(F.lit("Tech: "), tech_s)),
                        F.when(has(prio), F.concat(F.lit("Priority: "), prio)))
    return F.when(items == "", F.lit("")).otherwise(F.concat(items, F.lit(" | ")))


# ------------------------------------------------------------------ S18
def _section_values(response, marker: str) -> Column:
    return F.transform(F.filter(_lines(response), lambda l: l.startswith(marker)),
                       lambda l: _strip(F.substring(l, len(marker) + 1, 1 << 30)))


def _last_given(values: Column) -> Column:
    """Last value that is neither empty nor 'None' (such a line leaves the earlier value)."""
    return F.try_element_at(F.filter(values, lambda v: (v != "") & (v != "None")), F.lit(-1))


def response_confidence(response) -> Column:
    """The number between the first and second ':' of the last CONFIDENCE_SCORE
    line that parses; 0.5 when none does."""
    parsed = F.transform(F.filter(_lines(response), lambda l: l.startswith(MARK_CONFIDENCE)),
                         lambda l: _strip(F.split(l, ":", -1).getItem(1)).try_cast("double"))
    return F.coalesce(F.try_element_at(F.filter(parsed, lambda v: v.isNotNull()), F.lit(-1)),
                      F.lit(CONFIDENCE_DEFAULT))


def response_context_ids(response) -> Column:
    """ADDITIONAL_CONTEXT_NEEDED split on ',' and stripped; empty for none/'None'."""
    t = _last_given(_section_values(response, MARK_CONTEXT))
    return F.when(t.isNull(), F.array().cast("array<string>")) \
            .otherwise(F.transform(F.split(t, ",", -1), _strip))


def response_fixes(response) -> Column:
    """SUGGESTED_FIXES split on ';' into ``array<struct<description, type>>``."""
    t = _last_given(_section_values(response, MARK_FIXES))
    empty = F.array().cast("array<struct<description:string,type:string>>")
    return F.when(t.isNull(), empty).otherwise(
        F.transform(F.split(t, ";", -1),
                    lambda x: F.struct(_strip(x).alias("description"), F.lit("code_change").alias("type"))))


def response_graph_insights(response, approach) -> Column:
    """GRAPH_INSIGHTS text, only for the call-graph approach."""
    return F.when(_c(approach) == APPROACH_GRAPH,
                  F.try_element_at(_section_values(response, MARK_GRAPH), F.lit(-1)))


# ------------------------------------------------------------- S19 - S23
def lexicon_confidence(text) -> Column:
    """Weighted mean over the distinct lexicon words present (substring test)."""
    low = F.lower(_c(text))
    count = lambda words: reduce(lambda a, b: a + b,
                                 [F.when(low.contains(w), 1).otherwise(0) for w in words])
    h, m, lo = count(CONFIDENCE_HIGH), count(CONFIDENCE_MEDIUM), count(CONFIDENCE_LOW)
    total = h + m + lo
    score = (h * CONFIDENCE_WEIGHTS["high"] + m * CONFIDENCE_WEIGHTS["medium"]
             + lo * CONFIDENCE_WEIGHTS["low"]) / total
    return F.when(total == 0, F.lit(CONFIDENCE_DEFAULT)).otherwise(F.least(F.greatest(score, F.lit(0.0)),
                                                                            F.lit(1.0)))


def confidence_band(score) -> Column:
    """>= 0.8 high, >= 0.6 medium, else low."""
    s = _c(score)
    return F.when(s >= 0.8, "high").when(s >= 0.6, "medium").otherwise("low")


def relevance_band(score) -> Column:
    """> 0.8 High, > 0.5 Medium, else Low."""
    s = _c(score)
    return F.when(s > 0.8, "High").when(s > 0.5, "Medium").otherwise("Low")


def analysis_section(text) -> Column:
    """The text between the first and second 'ANALYSIS:' marker, else the whole text."""
    t = _c(text)
    return F.when(F.instr(t, MARK_ANALYSIS) > 0, F.split(t, MARK_ANALYSIS, -1).getItem(1)).otherwise(t)


def preview(text, n: int) -> Column:
    """First ``n`` characters plus '...' when longer."""
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


# ------------------------------------------------------------------ S24
# Our word lists, taken from the four routing examples (the source defines none).
ROUTE_EXACT = r"(?i)(named|called)\s+'[^']+'|function\s+named"
ROUTE_DEPENDENCY = r"(?i)\b(calls?|callers?|depends?|dependenc\w*|uses|invok\w*)\b"
ROUTE_CONCEPT = r"(?i)\b(similar|like|related|about)\b"


def route_query(query) -> Column:
    """Exact pattern -> lookup table; dependency words -> call graph;
    conceptual words -> vector search; otherwise hybrid."""
    q = _c(query)
    return (F.when(q.rlike(ROUTE_EXACT), APPROACH_LOOKUP)
             .when(q.rlike(ROUTE_DEPENDENCY), APPROACH_GRAPH)
             .when(q.rlike(ROUTE_CONCEPT), "vector_search")
             .otherwise("hybrid"))
