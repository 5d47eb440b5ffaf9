"""Whole-text tokenising with a tokenizer file, and token counts by heap-and-linked-list merging."""

from __future__ import annotations

import functools
import heapq
import json
import re
import string
import unicodedata
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import with_columns_of, without
from .charclass import has_late


class Cache:
    """A bounded cache: the first ``most`` entries stay, as frequent words come early; later ones are kept for a while."""

    def __init__(self, most: int) -> None:
        self.most, self.early, self.late = most, {}, {}

    def get(self, key):
        found = self.early.get(key)
        return self.late.get(key) if found is None else found

    def put(self, key, value):
        if len(self.early) < self.most:
            self.early[key] = value
        else:
            if len(self.late) >= self.most // 2:
                self.late.clear()
            self.late[key] = value
        return value


@functools.cache
def merges_of(path: str) -> tuple[dict[tuple[str, str], tuple[int, str]], list]:
    """Rank and result of every adjacent pair, and the strings of the special tokens, of a tokenizer file."""
    spec = json.loads(Path(path).read_text())
    pairs = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        pairs[a, b] = (rank, a + b)
    return pairs, [t["content"] for t in spec["added_tokens"]]


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def _merged(symbols: list, pairs: dict) -> tuple[list, int]:
    """Byte-pair merging over a linked list: pops the lowest-ranked adjacent pair, leftmost first, until none is left.

    ``pairs`` maps two symbols to (rank, merged symbol). Gives the list with None where a symbol went into its
    neighbour, and the number of merges; n symbols take O(n log n).
    """
    n, merges = len(symbols), 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(pairs[p][0], i) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in pairs]
    heapq.heapify(heap)
    symbols = list(symbols)
    while heap:
        rank, i = heapq.heappop(heap)
        if symbols[i] is None or (j := after[i]) >= n:
            continue
        now = pairs.get((symbols[i], symbols[j]))
        if now is None or now[0] != rank:  # one of the two has merged otherwise meanwhile
            continue
        symbols[i], symbols[j] = now[1], None
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := pairs.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (p[0], i))
        if (h := before[i]) >= 0 and (p := pairs.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (p[0], h))
    return symbols, merges


def merge(symbols: list, pairs: dict) -> list:
    """The symbols that are left when no pair can merge."""
    return [s for s in _merged(symbols, pairs)[0] if s is not None]


def merge_count(symbols: list, pairs: dict) -> int:
    """Tokens of a word: its symbols minus the merges made; no identifiers are looked up."""
    return len(symbols) - _merged(symbols, pairs)[1]


_ENDS = (".", ",")


class MarkCuts:
    """Whether the library always begins a new pre-token at a sentence mark that follows a word.

    It does where the word's last character is a letter once the tokenizer has normalised it. Some letters turn
    into a letter and a combining mark there, which would join the sentence mark. Each character is asked once.
    """

    def __init__(self, library) -> None:
        self.library, self.known = library, dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", True)

    def __call__(self, piece: str) -> bool:
        if piece[-1:] not in _ENDS or not (word := piece[:-1]).isalpha():
            return False
        last = word[-1]
        found = self.known.get(last)
        return self._ask(last) if found is None else found

    def _ask(self, letter: str) -> bool:
        said, (normal, split) = True, (self.library.normalizer, self.library.pre_tokenizer)
        for mark in _ENDS:
            text = letter + mark
            parts = split.pre_tokenize_str(normal.normalize_str(text) if normal else text)
            said = said and parts[-1][0] == mark
        self.known[letter] = said
        return said


#: The split that the tokenizer file of the word-end vocabulary names.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BLANKS = regex.compile(r"\p{White_Space}+")


class WordEndCounter:
    """Counts tokens as the tokenizers library gives them for a lower-casing vocabulary with word ends.

    White space never joins a token there, so texts are cut at blanks and line ends, and what stands between
    them is counted once while it is in the cache.
    """

    def __init__(self, path: str, cache: int = 400_000) -> None:
        self.pairs, special = merges_of(path)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.path, self.known, self.words = path, Cache(cache), Cache(cache // 2)
        self.cuts = MarkCuts(self.library)

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            table = byte_symbols()
            n = self.words.put(word, self.symbols([table[b] for b in word.encode("utf-8", "replace")]))
        return n

    def symbols(self, symbols: list[str]) -> int:
        symbols[-1] += "</w>"
        return merge_count(symbols, self.pairs)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def late(self, text: str) -> int:
        """Of a text with characters that Python's tables lack: the file's own splitting decides what the words are."""
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return sum(self.symbols(list(w)) for w, _ in words)

    def plain(self, text: str) -> int:
        if has_late(text):
            return self.late(text)
        text = _BLANKS.sub(" ", unicodedata.normalize("NFC", text))
        return sum(map(self.word, WORDS.findall("".join(c.lower() for c in text) if not text.isascii() else text.lower())))

    def piece(self, text: str) -> int:
        if self.special is None or "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def word_comma(self, p: str) -> int:
        """A word and one sentence mark, which is always a word of its own."""
        n = self.known.get(p[:-1])
        return self.word(p[-1]) + (self.known.put(p[:-1], self.piece(p[:-1])) if n is None else n)

    def count(self, text: str | None) -> int:
        get, total, known = self.known.early.get, 0, self.known
        for line in (text or "").split("\n"):
            pieces = line.split(" ")
            counts = list(map(get, pieces))
            if None in counts:
                for k, n in enumerate(counts):
                    if n is None:
                        p = pieces[k]
                        if (n := known.late.get(p)) is None:
                            n = self.word_comma(p) if self.cuts(p) else known.put(p, self.piece(p))
                        counts[k] = n
            total += sum(counts)
        return total


def count_tokens(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (n_tokens > limit); columns so named are replaced.

    Whole texts, without truncation; null counts as empty, which has no tokens.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    docs = without(docs, "n_bytes", "n_tokens", "over_limit")
    where = docs.columns.index(text_col)

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            texts = batch.column(where).to_pylist()
            n = np.fromiter(map(counter.count, texts), np.int64, len(texts))
            size = np.fromiter((len((t or "").encode("utf-8", "replace")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(n), pa.array(n > limit)], names=[*batch.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return with_columns_of(docs, run, {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()})


@functools.lru_cache(maxsize=4)
def _counter(path: str) -> WordEndCounter:
    return WordEndCounter(path)


def direct_words(library) -> dict[str, tuple[str, bool]]:
    """How words of ASCII letters reach the tokenizer's model: what stands for the blank before them, and if lower-cased.

    By what precedes the word, "" or a blank. A case is left out where the tokenizer splits such words, changes them
    otherwise, could find an added token in them, or cuts or pads its output.
    """
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    if library.truncation or library.padding or any(not t.strip() or (t.strip().isascii() and t.strip().isalpha()) for t in special):
        return {}
    normal, split, out = library.normalizer, library.pre_tokenizer, {}
    a, b = string.ascii_lowercase, string.ascii_uppercase
    for lead in ("", " "):
        found = set()
        for word in (a + b, b + a, *a, *b):
            text = normal.normalize_str(lead + word) if normal else lead + word
            parts = [x for x, _ in split.pre_tokenize_str(text)] if split else []
            whole = parts[0] if len(parts) == 1 else ""
            found.add(next(((whole[: -len(w)], low) for w, low in ((word, False), (word.lower(), True)) if whole.endswith(w)), None))
        kinds = {x for x in found if x is not None}
        if None not in found and len({x[0] for x in kinds}) == 1:
            out[lead] = (kinds.pop()[0], any(low for _, low in found))
    return out


class Encoder:
    """Identifiers of whole texts by the tokenizers library, as little-endian unsigned bytes of ``width``.

    The library encodes every distinct piece once; pieces are cut where its own splitting must cut: at single
    blanks and line ends between characters that are not white space, and before a mark that ends a word.
    A text with any other white space at a piece's edge goes to the library whole. Words of ASCII letters go
    straight to the library's model where its normalising and splitting keep such words whole.
    """

    def __init__(self, path: str, width: int = 2, cache: int = 600_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cuts = MarkCuts(self.library)
        self.model, self.direct = self.library.model, direct_words(self.library)
        self.code = {2: "H", 4: "I"}[width]
        self.first, self.later = Cache(cache // 4), Cache(cache)
        self.newline, *marks = self._encode(["\n", *_ENDS])
        self.marks = dict(zip(_ENDS, marks, strict=True))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _model_ids(self, lead: str, word: str) -> bytes:
        before, lower = self.direct[lead]
        return array(self.code, [t.id for t in self.model.tokenize(before + (word.lower() if lower else word))]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        out, missing, slots = [], [], []
        for line in text.split("\n"):
            if out:
                out.append(self.newline)
            first, *rest = line.split(" ")
            for lead, cache, part in (("", self.first, [first]), (" ", self.later, rest)):
                at = len(out)
                out += map(cache.early.get, part)
                if None in out[at:]:
                    for k, p in enumerate(part, at):
                        if out[k] is None and (ids := cache.late.get(p)) is not None:
                            out[k] = ids
                        elif out[k] is None:
                            if not p or p[0].isspace() or p[-1].isspace():
                                return self._encode([text])[0]
                            word, mark = (p[:-1], self.marks[p[-1]]) if self.cuts(p) else (p, b"")
                            if mark and (ids := cache.get(word)) is not None:
                                out[k] = cache.put(p, ids + mark)
                            elif lead in self.direct and word.isascii() and word.isalpha():
                                out[k] = cache.put(word, self._model_ids(lead, word)) + mark
                            else:
                                slots.append((k, cache, word, mark))
                                missing.append(lead + word)
        if missing:
            for (k, cache, word, mark), ids in zip(slots, self._encode(missing), strict=True):
                out[k] = cache.put(word, ids) + mark
        return b"".join(out)


@functools.lru_cache(maxsize=4)
def encoder(path: str, width: int) -> Encoder:
    return Encoder(path, width)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
