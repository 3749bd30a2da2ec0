"""Byte-pair encoding by dynamic programming over prefixes.

Every prefix of a pre-token has exactly one encoding, so it is enough to know
that encoding's *last* token. An automaton over the vocabulary lists, for each
position, the tokens that end there; a token ends the encoding of the prefix iff
it may follow the last token of the shorter prefix it leaves over. Walking the
stored tokens back from the end gives the ids. The work is linear in the length
of the pre-token (times the few vocabulary matches at a position), also for a
pre-token of any length.

Two tokens may stand side by side iff no merge across their border would have
been applied before the merges that build them. Merges are ranked, and every part
of a token is made by an earlier merge than the token (checked on loading), so
the symbol at the right edge of the left token over time is a chain of tokens
with the rank at which each is merged away, and likewise at the left edge of the
right token: the border is safe iff no pair of the two chains has a merge whose
rank comes before both.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from callweave.llm.common import keep_for, only_for

NEVER = 1 << 60
#: entries kept of each memory of a worker; a full one is emptied (bounded memory, same results).
#: Words take half of it twice, so those in use outlive that
MEMORY = 200_000


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: a byte
    that prints as itself in Latin-1 keeps its letter, the others take 256, 257, ... in order."""
    kept = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return {b: chr(b if b in kept else next(others)) for b in range(256)}


class PrefixBpe:
    """Encodes one pre-token by a vocabulary file in the tokenizers library's format."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, t = self.ids[left], self.ids[right], self.ids[left + right]
            if t in made or any(x in made and made[x][0] >= r for x in (a, b)):
                raise ValueError("merges are not in the order in which tokens are made")
            made[t] = (r, a, b)
            self.rank[a, b] = r
        self.made = made
        self.memory: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})  # chains at the left and at the right edge
        self.inner, self.finals, self.longest = ahocorasick.Automaton(), {}, 0
        for token, i in self.ids.items():
            if not self._makes_itself(i):
                continue
            if self.end and token.endswith(self.end) and token != self.end:
                stem = token[: -len(self.end)]
                self.finals[stem] = i
                self.longest = max(self.longest, len(stem))
            else:
                self.inner.add_word(token, (i, len(token)))
        self.inner.make_automaton()

    def _makes_itself(self, t: int) -> bool:
        """Whether encoding a token's own text gives the token."""
        return t not in self.made or self.may_follow(self.made[t][1], self.made[t][2], self.made[t][0])

    def _chain(self, t: int, side: int) -> list[tuple[int, int]]:
        chain = self.edges[side].get(t)
        if chain is None:
            chain, gone = [(t, NEVER)], t
            while gone in self.made:
                r, *parts = self.made[gone]
                gone = parts[side]
                chain.append((gone, r))
            self.edges[side][t] = chain
        return chain

    def may_follow(self, a: int, b: int, allowed: int = NEVER) -> bool:
        """Whether b may stand right after a: no merge across the border (but the one of
        rank ``allowed``) comes first. Of equal ranks the left one is applied first."""
        for x, gone_x in self._chain(a, 1):
            for y, gone_y in self._chain(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < gone_x and r <= gone_y and r != allowed:
                    return False
        return True

    def _fits(self, a: int, b: int) -> bool:
        key = a << 24 | b
        known = self.memory.get(key)
        if known is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            known = self.memory[key] = self.may_follow(a, b)
        return known

    def letters_of(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.letters)

    def encode(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        return self.encode_letters(self.letters_of(piece))

    def encode_letters(self, s: str) -> list[int]:
        n = len(s)
        if n == 0:
            return []
        last, width = [-1] * n, [0] * n
        stop = n - 1 if self.end else n
        fits = self._fits
        for at, (t, size) in self.inner.iter(s):
            if at >= stop or last[at] >= 0:
                continue
            before = at - size
            if before < 0 or last[before] >= 0 and fits(last[before], t):
                last[at], width[at] = t, size
        if self.end:
            for size in range(min(n, self.longest), 0, -1):
                t = self.finals.get(s[n - size:])
                if t is not None and (size == n or last[n - 1 - size] >= 0 and fits(last[n - 1 - size], t)):
                    last[n - 1], width[n - 1] = t, size
                    break
        ids, at = [], n - 1
        while at >= 0:
            ids.append(last[at])
            at -= width[at]
        ids.reverse()
        return ids


#: white space of the tokenizer's patterns (the Unicode property); str.split() also parts at 1C to 1F
SPACE = "\t-\r \x85\xa0  -     　"


class WordTokenizer:
    """A whole text to ids and back, for a lower-cased vocabulary with word ends whose
    pre-tokens never hold white space (the settings are read from the file and checked)."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        kinds = [x["type"] for x in d["normalizer"]["normalizers"]]
        split = d["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or d["decoder"]:
            raise ValueError("not a tokenizer of lower-cased words")
        self.bpe = PrefixBpe(spec)
        self.piece = regex.compile(split["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = tuple(self.special)
        self.odd, self.gap = regex.compile("[\x1c-\x1f]"), regex.compile(f"[{SPACE}]+")
        size = 1 + max([*self.bpe.ids.values(), *self.special.values()])
        self.tokens = [""] * size
        for t, i in [*self.bpe.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        # the words of late, and those of the time before: what is in use stays when a memory is full
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # letters beyond the Greek and Cyrillic ones: the library's own tables of letters, digits and
        # cases decide (they are of another Unicode version than Python's)
        self.rare = regex.compile("[\u0530-\U0010ffff]")
        # without the model, which is not asked and takes as much memory as all else
        library = Tokenizer.from_str(json.dumps(d | {"model": d["model"] | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer

    def _pieces(self, word: str) -> list[str]:
        """Pre-tokens of a word without white space, in the vocabulary's letters."""
        if self.rare.search(word):
            plain = self.normalizer.normalize_str(word)
            return [x for x, _ in self.pre_tokenizer.pre_tokenize_str(plain)]
        # the library lowers letter by letter, without the sigma for a word's end
        plain = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        return [self.bpe.letters_of(x) for x in self.piece.findall(plain)]

    def _word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = np.array([i for piece in self._pieces(word) for i in self.bpe.encode_letters(piece)], "<u4").tobytes()
        if len(word) > 64:  # rare and long: not worth remembering
            return found
        if len(self.words) >= MEMORY // 2:
            self.older = self.words.copy()
            self.words.clear()
        self.words[word] = found
        return found

    def forget(self) -> None:
        self.words, self.older = {}, {}
        self.bpe.memory = {}

    def _plain(self, text: str) -> list[bytes]:
        parts = [x for x in self.gap.split(text) if x] if self.odd.search(text) else text.split()
        known, word = self.words.get, self._word
        return [known(x) or word(x) for x in parts]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers (null: none)."""
        if not text:
            return b""
        if any(m in text for m in self.marks):
            out = []
            for i, part in enumerate(self.cut.split(text)):
                out += [np.array([self.special[part]], "<u4").tobytes()] if i % 2 else self._plain(part)
            return b"".join(out)
        return b"".join(self._plain(text))

    def decode(self, ids: bytes) -> str:
        """The text of ids, special ones included: tokens parted by a space."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def _word_tokenizer(spec: str) -> WordTokenizer:
    keep_for("bpe", _forget)
    return WordTokenizer(spec)


@lru_cache(1)
def _prefix_bpe(spec: str) -> PrefixBpe:
    keep_for("bpe", _forget)
    return PrefixBpe(spec)


def _forget() -> None:
    _word_tokenizer.cache_clear()
    _prefix_bpe.cache_clear()


@contextmanager
def word_tokenizer(spec: str) -> Iterator[WordTokenizer]:
    """The tokenizer of a Python worker, one for all its tasks; a task's words are forgotten with it."""
    only_for("bpe")
    t = _word_tokenizer(spec)
    try:
        yield t
    finally:
        t.forget()
        pa.default_memory_pool().release_unused()


def prefix_bpe(spec: str) -> PrefixBpe:
    """The encoder of a Python worker, one for all its tasks."""
    only_for("bpe")
    return _prefix_bpe(spec)
