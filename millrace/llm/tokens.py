"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

#: A byte-level BPE vocabulary in tiktoken's format; the folder's ``__init__.py`` has its splitting pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file, once per Python worker."""
    import tiktoken

    with Path(vocabulary).open("rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("millrace", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[int | None]:
    """Tokens of each whole text; None for null and blank ones. Special tokens' strings are ordinary text."""
    enc = encoding(vocabulary)
    return [len(enc.encode_ordinary(t)) if t and not t.isspace() else None for t in texts]
