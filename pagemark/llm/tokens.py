"""Token ids of a public byte-level BPE vocabulary inside Python workers.

The ids are those of the ``tokenizers`` library. The same vocabulary as a rank
file gives the same ids several times faster, and is used for texts made only
of characters on which both libraries' pre-tokenizers agree (Latin, Greek and
Cyrillic letters, ASCII and general punctuation, no special-token string, no
run of ``LONG_RUN`` white-space characters, on which the rank file's pattern
would exhaust its stack); every other text goes through ``tokenizers`` itself.
"""
from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏͰ-ͳΆ-ώЀ-џ‐-‧]")
_SPECIAL = re.compile(r"<\|endoftext\|>")
LONG_RUN = 100_000
_RUN = re.compile(r"\s+")


@lru_cache(maxsize=4)
def _ranks(path: str):
    import public_tokenizers as public
    import tiktoken

    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ranks, encoding


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _long_run(text: str) -> bool:
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in _RUN.finditer(text))


def default_paths() -> tuple[str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")


def encode(text: str | None, json_path: str, rank_path: str) -> list[int]:
    """Token ids without added special tokens; null text: none."""
    if not text:
        return []
    if _OTHER.search(text) or _SPECIAL.search(text) or _long_run(text):
        return _tokenizer(json_path).encode(text, add_special_tokens=False).ids
    return _ranks(rank_path)[1].encode_ordinary(text)


@lru_cache(maxsize=4)
def sentence_ends(rank_path: str) -> np.ndarray:
    """For each id, whether a sentence may end after it: the token closes with a
    full stop, question or exclamation mark, or holds a line break."""
    ranks, _ = _ranks(rank_path)
    ends = np.zeros(max(ranks.values()) + 2, dtype=bool)
    closers = (b".", b"!", b"?", "…".encode(), "。".encode())
    for token, rank in ranks.items():
        ends[rank] = b"\n" in token or token.rstrip(b" \"')]}").endswith(closers)
    return ends
