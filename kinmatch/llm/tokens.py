"""Helpers for token ids."""

from __future__ import annotations

import re
import zlib

import numpy as np
from tokenizers import Tokenizer

from kinmatch.llm.flat import worker_cache


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, loaded once per worker, without truncation and padding."""
    cache = worker_cache()
    key = f"tokenizer {path}"
    if key not in cache:
        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        cache[key] = found
    return cache[key]


#: A full stop or comma beside another mark: the two are one word of the pattern.
GLUED = re.compile(r"[.,](?=[^\w\s]|_)|[.,](?<=[^\w\s][.,])|[.,](?<=_[.,])")


class ChunkEncoder:
    """Ids of texts by a tokenizer that never joins what white space parts, remembering the ids of such chunks.

    Holds for tokenizers that compose characters, lower-case, drop white space, and take runs of letters and runs of marks
    as words. To meet fewer chunks, texts in Latin-1 are lower-cased first, and full stops and commas that stand between
    letters, digits and white space are set apart. Texts that hold a special token's string, in any case, are encoded
    whole. At most LIMIT chunks of at most LONGEST characters are
    remembered; that bounds memory and never changes a result.
    """

    LIMIT, LONGEST, JOINED = 700_000, 40, 1000
    #: White space of the normaliser that str.split() does not know, or the other way round, and the one letter that
    #: grows when lower-cased: such texts go whole.
    ODD = [chr(c) for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x180E, 0x200B, 0xFEFF, 0x130)]

    def __init__(self, path: str) -> None:
        self.whole = tokenizer(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _fresh(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks, JOINED at a time. Each chunk of letters ends with the only word end in it; the tokens of other
        chunks are those whose offsets lie in it."""
        made = {}
        for plain in (True, False):
            some = [c for c in chunks if c.isalpha() == plain]
            parts = [some[i : i + self.JOINED] for i in range(0, len(some), self.JOINED)]
            for part, e in zip(parts, self.whole.encode_batch([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                cuts = np.flatnonzero(self.final[ids]) + 1
                if not plain or len(cuts) != len(part):
                    at = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
                    cuts = np.searchsorted(at, np.cumsum([len(c) + 1 for c in part]))
                data, cuts = ids.tobytes(), (cuts * 4).tolist()
                made.update((c, data[x:y]) for c, x, y in zip(part, [0, *cuts[:-1]], cuts, strict=True))
        return made

    def _chunks(self, text: str) -> list[str] | None:
        """None: to be encoded whole."""
        low = text.lower()
        if any(s in low for s in self.special) or any(c in text for c in (self.ODD[:4] if text.isascii() else self.ODD)):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            low = text
        if not GLUED.search(low):
            low = low.replace(".", " . ").replace(",", " , ")
        return low.split()

    def _whole(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        known = self.known
        pieces = [self._chunks(t) for t in texts]
        fresh = list(set().union(*[p for p in pieces if p is not None]).difference(known))
        made = self._fresh(fresh)
        long = [c for c in fresh if len(c) > self.LONGEST]
        full = len(known) + len(made) > self.LIMIT
        known.update(made)
        out = []
        for t, chunks in zip(texts, pieces, strict=True):
            if chunks is None:
                out.append(np.array(self._whole(t), np.uint32))
            else:
                out.append(np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.uint32))
        for c in fresh if full else long:
            del known[c]
        return out


def chunk_encoder(path: str) -> ChunkEncoder:
    cache = worker_cache()
    key = f"chunks {path}"
    if key not in cache:
        cache[key] = ChunkEncoder(path)
    return cache[key]


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
