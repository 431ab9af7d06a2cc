"""Embedding providers; the default needs no network and is equal in every process."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_WORD = re.compile(r"\w+")


class HashingEmbedder:
    """Signed hashed counts of words and word pairs, normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._memo: dict[str, tuple[int, float]] = {}

    def _place(self, term: str) -> tuple[int, float]:
        if term not in self._memo:
            h = int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
            if len(self._memo) > 200_000:
                self._memo.clear()
            self._memo[term] = h % self.dim, 1.0 if h >> 63 else -1.0
        return self._memo[term]

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text; blank texts are refused."""
        out = []
        for t in texts:
            words = _WORD.findall(t.lower())
            if not words:
                raise ValueError("a text to embed holds no word")
            v = np.zeros(self.dim)
            for term in [*words, *map(" ".join, zip(words, words[1:]))]:
                i, sign = self._place(term)
                v[i] += sign
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else np.eye(1, self.dim)[0]).tolist())
        return out


def embedded(df: DataFrame, text_col: str, provider=None, out_col: str = "vector") -> DataFrame:
    """``df`` with a vector of each text, batch by batch; null for texts without a word."""
    maker = provider or HashingEmbedder()

    @pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            some = x.map(lambda t: t is not None and bool(_WORD.search(t)))
            vectors = iter(maker.embed(x[some].tolist()))
            yield pd.Series([next(vectors) if ok else None for ok in some], index=x.index)

    return df.withColumn(out_col, run(F.col(text_col)))
