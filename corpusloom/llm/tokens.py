"""Sizes in tokens of a public tokenizer; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64

#: A byte-level vocabulary for many languages, where this box has it.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once in a process."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def tokens(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """The tokens of a text; lone surrogates count as replacement characters."""
    try:
        return encoding(vocabulary).encode_ordinary(text)
    except UnicodeEncodeError:
        return encoding(vocabulary).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8"))
