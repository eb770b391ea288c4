"""Byte-level BPE ids of whole texts, as ``tokenizers`` gives them for the same vocabulary.

The vocabulary files are read where a task runs; only their path is passed. ``tiktoken`` holds the same
ids as ``tokenizers`` and is several times faster. Texts of plain Latin script are cut into words by the
standard library's pattern, words met before come from a bounded table; any other text goes to ``tiktoken`` whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

CACHED_WORDS = 1 << 16  # of a worker; frequent words come early, so that more would take memory and save little
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_OTHER = re.compile("[^\t\n\r -~¡-©À-ſ]")
_WORD = re.compile(
    rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
)


class _Words(dict):
    """Word -> its ids as little-endian 32-bit numbers."""

    def __init__(self, single):
        super().__init__()
        self.single = single

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.single(word.encode())).tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = ids
        return ids


class Bpe:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.coding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = _Words(self.coding._core_bpe.encode_single_piece)

    def ids(self, text: str) -> bytes:
        if _OTHER.search(text):
            return array("I", self.coding.encode_ordinary(text)).tobytes()
        return b"".join(map(self.words.__getitem__, _WORD.findall(text)))


    def ids_with_added(self, text: str, added: tuple[tuple[str, int], ...]) -> bytes:
        """As ``tokenizers`` encodes by default: added tokens that stand in the text are their ids, what lies between is text."""
        present = dict((t, i) for t, i in added if t in text)
        if not present:
            return self.ids(text)
        parts = re.split(f"({'|'.join(re.escape(t) for t in sorted(present, key=len, reverse=True))})", text)
        return b"".join(present[x].to_bytes(4, "little") if x in present else self.ids(x) for x in parts if x)


@lru_cache(maxsize=2)
def load(ranks_path: str, pattern: str) -> Bpe:
    return Bpe(ranks_path, pattern)
