"""Splits text before byte-level merges just as the tokenizer libraries do.

The pattern is `public_tokenizers.PATTERN`. The `regex` module can know letters and numbers of a
newer Unicode version than the libraries; such characters are found by asking the library once per
process, and stand for punctuation while a text that holds them is split.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

SPLIT = regex.compile(public_tokenizers.PATTERN)


def tiktoken_joins() -> Callable[[str, str], bool]:
    """Tells whether tiktoken keeps an ASCII character and a following one in one piece."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    for first in b"a1":
        for second in range(128, 256):
            ranks[bytes([first, second])] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda first, second: probe.encode_ordinary(first + second)[0] >= 256


def tokenizers_joins() -> Callable[[str, str], bool]:
    """The same for the byte-level pre-tokenizer of the tokenizers library."""
    from tokenizers.pre_tokenizers import ByteLevel

    probe = ByteLevel(add_prefix_space=False, use_regex=True)
    return lambda first, second: len(probe.pre_tokenize_str(first + second)) == 1


@lru_cache(maxsize=4)
def strangers(joins: Callable[[], Callable[[str, str], bool]]) -> tuple[dict[int, str], regex.Pattern | None, int]:
    """Characters that are letters or numbers for `regex` alone: a table to '!', a pattern, the least lead byte."""
    joined, table = joins(), {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if unicodedata.category(c) != "Cn":
            continue
        first = "a" if regex.match(r"\p{L}", c) else "1" if regex.match(r"\p{N}", c) else ""
        if first and not joined(first, c):
            table[code] = "!"
    if not table:
        return {}, None, 256
    return table, regex.compile("[" + "".join(map(chr, table)) + "]"), chr(min(table)).encode()[0]


def pieces(text: str, utf8: bytes, joins: Callable[[], Callable[[str, str], bool]]) -> list[str]:
    """The matches of the pattern in the text, which they cover without gaps."""
    table, strange, lead = strangers(joins)
    if strange is None or not utf8 or np.frombuffer(utf8, np.uint8).max() < lead or not strange.search(text):
        return SPLIT.findall(text)
    return [text[m.start() : m.end()] for m in SPLIT.finditer(text.translate(table))]
