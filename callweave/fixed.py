"""Fixed values that must equal the behaviour being matched.

FIXED VALUES — do not edit. Each list is given whole, in its natural order.
"""

# FIXED VALUES: Python built-in names that never become call-graph edges.
BUILTIN_NAMES = [
    "abs", "all", "any", "ascii", "bin", "bool", "breakpoint", "bytearray", "bytes",
    "callable", "chr", "classmethod", "compile", "complex", "delattr", "dict", "dir",
    "divmod", "enumerate", "eval", "exec", "filter", "float", "format", "frozenset",
    "getattr", "globals", "hasattr", "hash", "help", "hex", "id", "input", "int",
    "isinstance", "issubclass", "iter", "len", "list", "locals", "map", "max",
    "memoryview", "min", "next", "object", "oct", "open", "ord", "pow", "print",
    "property", "range", "repr", "reversed", "round", "set", "setattr", "slice",
    "sorted", "staticmethod", "str", "sum", "super", "tuple", "type", "vars", "zip",
]

# FIXED VALUES: directory names skipped by the corpus scan.
EXCLUDED_DIRS = ["tests", "test", ".git", "venv", "__pycache__", ".pytest_cache"]

# FIXED VALUES: default path exclusion patterns (matched anchored at the start).
DEFAULT_EXCLUDE_PATTERNS = [
    r"test_.*\.py$",
    r".*_test\.py$",
    r".*/tests/.*",
    r".*/test/.*",
    r".*/__pycache__/.*",
    r".*/\.git/.*",
    r".*/venv/.*",
    r".*/env/.*",
]

# FIXED VALUES: confidence lexicon (substring match on lower-cased text) and weights.
CONFIDENCE_HIGH = ["definitely", "clearly", "obvious", "certain", "exactly", "precisely"]
CONFIDENCE_MEDIUM = ["likely", "probably", "appears", "seems", "suggests", "indicates"]
CONFIDENCE_LOW = ["might", "could", "possibly", "maybe", "uncertain", "unclear"]
CONFIDENCE_WEIGHTS = {"high": 1.0, "medium": 0.6, "low": 0.2}
CONFIDENCE_DEFAULT = 0.5

# FIXED VALUES: words in a query that let error handling add to the metadata score.
ERROR_QUERY_WORDS = ["error", "exception", "bug", "issue"]

# FIXED VALUES: metadata relevance weights (name, module, error handling).
SCORE_NAME = 10
SCORE_MODULE = 5
SCORE_ERROR = 3

# FIXED VALUES: limits and thresholds.
MAX_FUNCTIONS_PER_SEARCH = 20
MAX_QUERY_LENGTH = 1000
CONFIDENCE_THRESHOLD = 0.8
MAX_ITERATIONS = 3
MAX_HISTORY_ENTRIES = 1000
DEFAULT_CONTEXT_DEPTH = 3
MAX_CONTEXT_DEPTH = 3
SIMILARITY_THRESHOLD = 0.7
TRUNCATION_MARKER = "\n... (truncated)"

# FIXED VALUES: response section markers.
MARK_CONFIDENCE = "CONFIDENCE_SCORE:"
MARK_CONTEXT = "ADDITIONAL_CONTEXT_NEEDED:"
MARK_FIXES = "SUGGESTED_FIXES:"
MARK_GRAPH = "GRAPH_INSIGHTS:"
MARK_ANALYSIS = "ANALYSIS:"
MARK_ISSUES = "ISSUES_FOUND:"

# FIXED VALUES: graph-weighted re-rank factors (depth weight, related boost,
# path-length penalty, most context functions).
RERANK_DEPTH_WEIGHT = 0.8
RERANK_RELATED_BOOST = 1.2
RERANK_PATH_PENALTY = 0.9
RERANK_MAX_CONTEXT = 10

# FIXED VALUES: approach names.
APPROACH_LOOKUP = "function_lookup_table"
APPROACH_GRAPH = "call_graph"
APPROACHES = [APPROACH_LOOKUP, APPROACH_GRAPH]

# FIXED VALUE: white space as Python's str.strip takes it, as a character class that means
# the same to Java's and to RE2's regular expressions.
SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# FIXED VALUES: excluded directories of the second list (settings), added to the first on request.
MORE_EXCLUDED_DIRS = ["node_modules"]

# FIXED VALUES: lines of the analysis context (nested functions; graph context). {} is filled in.
NESTED_HEAD = "\nNested Function Dependencies for {}:"
NESTED_LINE = "  - {} ({})"
GRAPH_HEAD = "\nCall Graph Context for {}:"
GRAPH_LINES = ["  - Dependencies: {}", "  - Graph Depth: {}", "  - Files Involved: {}", "  - Has Error Handling: {}"]
