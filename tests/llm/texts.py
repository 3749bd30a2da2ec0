"""Texts at the edges of what the operators define."""

import random


def odd_texts(seed: int = 5, n: int = 60) -> list:
    r = random.Random(seed)
    fixed = [None, "", " ", "\n", "a", " a", "a ", "a\n b", "a \nb", "x  y z", "a\tb c", "<|endoftext|>a <|endoftext|> b", "it's we'll 12 34",
             "日本 語 x", " é  ü\n\n\nz  ", "Σ ΑΣ Σ.", "a\u0085b\x1cc \x1d", "</w> a</w>b", "İstanbul ﬁ é", "a" * 5_000,
             "word " * 4_000, "'S'll 'T it'S 12³4²", "x　y﻿z", "🙂🙂👍🏽 z​q"]
    return fixed + ["".join(r.choice("ab 1'sé\n\t  <|>日\x1c lth ") for _ in range(r.randrange(1, 120))) for _ in range(n)]


def documents(spark, texts, source=None):
    rows = [(i, t, "en", source(i) if source else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
