"""Characters of recent Unicode versions, which libraries with tables of different ages class differently."""

from __future__ import annotations

import functools
import unicodedata

#: Characters found to have a category already; at most as many as Unicode has.
_SETTLED = set(map(chr, range(128)))


def has_late(text: str) -> bool:
    """Whether ``text`` has characters that Python's Unicode tables don't assign, so that others may or may not."""
    if text.isascii() or _SETTLED.issuperset(text):
        return False
    new = set(text) - _SETTLED
    late = {c for c in new if unicodedata.category(c) == "Cn"}
    _SETTLED.update(new - late)
    return bool(late)


@functools.cache
def _probe(kind: str):
    import tiktoken

    return tiktoken.Encoding(f"probe-{kind}", pat_str=rf"\p{{{kind}}}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})


@functools.lru_cache(maxsize=1 << 16)
def _stand_in(c: str) -> str:
    """A long-assigned character of the class that tiktoken's tables give ``c``: a letter, a number or neither."""
    if unicodedata.category(c) != "Cn":
        return c
    return "é" if _probe("L").encode_ordinary(c) else "²" if _probe("N").encode_ordinary(c) else "§"


def split_as_tiktoken(pattern, text: str) -> list[str]:
    """The matches of ``pattern``, whose classes are letters, numbers, white space and the rest, by tiktoken's tables."""
    if not has_late(text):
        return pattern.findall(text)
    return [text[slice(*m.span())] for m in pattern.finditer("".join(map(_stand_in, text)))]
