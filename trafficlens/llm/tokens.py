"""Token ids of texts by a public vocabulary, with a cache of parts in each Python worker.

The vocabulary drops white space and its pieces never cross it, so a text's ids are those of its parts between blanks
one after the other; each distinct part is encoded once and remembered. The cache holds two generations of at most
``limit`` parts, so a worker's memory stays bounded. Words of plain letters go straight to the vocabulary's merge
model; everything else takes the library's whole path. Another vocabulary file, for which these short ways give other
ids on :data:`PROBE`, has every text encoded whole by the library.

Most distinct parts are rare, so what a part costs that is not in the cache counts most: a word stands in the cache once,
also for its capitalised forms and those with a comma, and a generation ends without being copied.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from trafficlens.llm.worker_memory import held

LIMIT = 250_000
PROBE = "The CAT's 12 dogs,  über\tØl naïve co-op don't!\n \r\nÉCOLE (straße) İ ǅ x_y 3.14 日本 "


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Parts(dict):
    """Maps a part of a text to its ids as little-endian unsigned 32-bit bytes; takes from ``older`` what it has not met."""

    def __init__(self, tokenizer, letters: list[str], packed: list[bytes], older: dict[str, bytes]):
        super().__init__({"": b""})
        self.tokenizer, self.letters, self.packed, self.older = tokenizer, letters, packed, older
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.fresh(part)
        self[part] = ids
        return ids

    def fresh(self, part: str) -> bytes:
        # letters below U+0250 are in composed form already and their lower case does not depend on context; where
        # it is no single letter, the vocabulary would cut the word there
        if part.islower() and part.isalpha() and (part.isascii() or max(part) < "ɐ"):
            word = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            return b"".join([self.packed[t.id] for t in self.tokenize(word)])
        core = part.rstrip(string.punctuation)
        lower = core.lower()
        if core and lower != part and lower.isalpha() and (core.isascii() or max(core) < "ɐ"):
            return self[lower] + self[part[len(core) :]]
        return Encoder.pack(self.tokenizer.encode(part, add_special_tokens=False).ids)


class Encoder:
    """Gives the ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = LIMIT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.packed = [self.pack([i]) for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.limit = limit
        self.parts = self.generation({})
        self.whole = False
        self.whole = self.encode(PROBE, b"") != self.pack(self.tokenizer.encode(PROBE, add_special_tokens=False).ids)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def generation(self, older: dict[str, bytes]) -> Parts:
        return Parts(self.tokenizer, self.letters, self.packed, older)

    def encode(self, text: str | None, end: bytes) -> bytes:
        if self.whole:
            return self.pack(self.tokenizer.encode(text or "", add_special_tokens=False).ids) + end
        parts = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.parts.__getitem__, parts)) + end

    def trim(self) -> None:
        """Between batches: what is in use moves on, what was not asked for since the last time goes."""
        if len(self.parts) > self.limit:
            self.parts.older = {}
            self.parts = self.generation(self.parts)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    return held("encoder", path, Encoder)


def encoded(batches: Iterator[pa.RecordBatch], path: str, text_col: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the id bytes of its texts (null counts as empty), the end id included."""
    enc = encoder(path)
    end = Encoder.pack([end_id])
    for batch in batches:
        yield batch, [enc.encode(t, end) for t in batch.column(text_col).to_pylist()]
        enc.trim()
