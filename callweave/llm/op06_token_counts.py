"""Token counts of whole documents (operator 6) without making ids.

1. Every document becomes rows (document, pre-token, frequency).
2. The rows are partitioned and sorted by pre-token; each distinct pre-token's pieces
   are counted once, by the prefix dynamic programme, and joined to its rows.
3. Frequency times pieces is summed per document.

Hot keys: pre-tokens that most documents use would each fill one partition. The most
used ones of a sample (``sample`` documents; ``common`` pre-tokens, so a few MB whatever
the input) are counted beforehand and broadcast, and their part of a document's sum is
made where the document is read. Which pre-tokens these are moves work, never results.

Defined results: a null text has 0 bytes and 0 tokens; repeated rows are counted
each; rows with a null doc_id are kept. A special token's string in a text counts
as one token, as the library does by default.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callweave.llm.bpe import SPACE, prefix_bpe, byte_letters
from callweave.llm.common import prepare_python, vocabulary, written

COMMON, SAMPLE = 131_072, 20_000
#: pre-tokens kept with their counts; a full memory is emptied
MEMORY = 400_000
TOKEN_LIMIT = 512

#: fixed value: the byte-level pattern of the vocabulary, with the white space spelt out
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + "]+")


class PreTokens:
    """Frequencies of the pre-tokens of a text, in the vocabulary's letters."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        p = d["pre_tokenizer"]
        if d["normalizer"] or p["type"] != "ByteLevel" or p["add_prefix_space"] or not p["use_regex"]:
            raise ValueError("not a byte-level tokenizer")
        self.special = [x["content"] for x in d["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.pattern, self.rare, self.odd = regex.compile(PIECES), regex.compile("[԰-\U0010ffff]"), regex.compile("[\x1c-\x1f]")
        self.library, self.letters = Tokenizer.from_str(spec).pre_tokenizer, byte_letters()
        #: white space other than the space and the line feed (and what Python also takes for it)
        self.gaps = regex.compile("[\t\x0b-\r\x1c-\x1f" + SPACE[4:] + "]")

    def split(self, text: str) -> list[str]:
        if self.rare.search(text):  # the library's own tables of letters and digits
            return [x for x, _ in self.library.pre_tokenize_str(text)]
        if text.isascii() and text.isprintable():
            return [x.replace(" ", "Ġ") for x in self.pattern.findall(text)]
        return [x.encode().decode("latin-1").translate(self.letters) for x in self.pattern.findall(text)]

    def parts(self, text: str | None) -> tuple[int, list[str]]:
        """Special tokens in a text, and the texts between them."""
        if not text:
            return 0, []
        if not any(s in text for s in self.special):
            return 0, [text]
        between = self.cut.split(text)
        return len(between) - 1, [x for x in between if x]

    def chunks(self, text: str) -> tuple[list[str], list[str]] | None:
        """A text's first chunk (as pre-tokens) and its other chunks, if it parts at single
        spaces with a letter or sign on both sides: no neighbour changes the pre-tokens of such a
        chunk and the space before it. Else None."""
        if "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or self.gaps.search(text):
            return None
        first, *rest = text.split(" ")
        return self.split(first), rest


@lru_cache(2)
def pre_tokens(spec: str) -> PreTokens:
    return PreTokens(spec)


def common_pieces(docs: DataFrame, spec, sample: int, common: int) -> dict[str, int]:
    """Pieces of the most used pre-tokens of some ``sample`` documents: at most ``common``."""
    n = docs.count()
    some = docs.select("text").sample(False, min(1.0, sample / max(n, 1)), 7)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pre_tokens(spec.value)
        for b in batches:
            counts: Counter = Counter()
            for x in b.column(0):
                for part in p.parts(x.as_py())[1]:
                    counts.update(p.split(part))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "uses"])

    uses = some.mapInArrow(frequencies, "piece string, uses long").groupBy("piece").agg(F.sum("uses").alias("uses"))
    uses = written(uses.where("uses > 1"), "common-pieces")
    # the classes of use (by quarter powers of two) that fit together
    level = F.floor(4 * F.log2("uses")).cast("int")
    cut, total = 1 << 30, 0
    for r in sorted(uses.groupBy(level.alias("level")).count().collect(), reverse=True):  # some 250 rows
        total += r["count"]
        if total > common:
            break
        cut = r["level"]
    bpe = prefix_bpe(spec.value)
    return {r[0]: len(bpe.encode_letters(r[0])) for r in uses.where(level >= cut).select("piece").collect()}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = TOKEN_LIMIT, common: int = COMMON, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = docs.sparkSession
    prepare_python(spark)
    spec = vocabulary(spark, tokenizer_path)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = spark.sparkContext.broadcast(common_pieces(texts, spec, sample, common))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (its own key, bytes, tokens of the common pre-tokens) and one
        for each other pre-token of it."""
        p, get = pre_tokens(spec.value), known.value.get
        seen: dict[str, tuple[int, list[str]]] = {}

        def of(pieces: list[str]) -> tuple[int, list[str]]:
            """Tokens of the common pre-tokens, and the others."""
            return sum(get(x, 0) for x in pieces), [x for x in pieces if x not in known.value]

        for b in batches:
            row, doc, key, n, size = [], [], [], [], []
            for r, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = x.as_py()
                tokens, parts = p.parts(text)
                others, uses = [], []
                for part in parts:
                    found = p.chunks(part)
                    more, rare = of(found[0] if found else p.split(part))
                    tokens += more
                    others += rare
                    uses += [1] * len(rare)
                    for c, times in Counter(found[1]).items() if found else ():
                        if c not in seen:
                            if len(seen) >= MEMORY:
                                seen.clear()
                            seen[c] = of(p.split(" " + c))
                        more, rare = seen[c]
                        tokens += more * times
                        if rare:
                            others += rare
                            uses += [times] * len(rare)
                row += [r] * (1 + len(others))
                doc += [d] * (1 + len(others))
                key.append(f" {r}")  # no pre-token in letters holds a space
                key += others
                n.append(tokens)
                n += uses
                size.append(len(text.encode()) if text else 0)
                size += [None] * len(others)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(key, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64())],
                ["row", "doc_id", "piece", "n", "n_bytes"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of each row, of batches sorted by pre-token: each is counted once."""
        bpe, last, pieces = prefix_bpe(spec.value), None, 0
        for b in batches:
            key = b.column(2).dictionary_encode()
            count = []
            for x in key.dictionary.to_pylist():
                if x != last:
                    last, pieces = x, 1 if x[0] == " " else len(bpe.encode_letters(x))
                count.append(pieces)
            n = pc.multiply(b.column(3), pa.array(count, pa.int64()).take(key.indices))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, b.column(4)], ["row", "doc_id", "n", "n_bytes"])

    rows = texts.mapInArrow(documents, "row long, doc_id long, piece string, n long, n_bytes long")
    rows = rows.repartition("piece").sortWithinPartitions("piece").mapInArrow(joined, "row long, doc_id long, n long, n_bytes long")
    return (rows.groupBy("row", "doc_id").agg(F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
