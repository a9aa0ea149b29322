"""Whole texts to ids with the tokenizers library, each distinct piece of text once.

A byte-level tokenizer of the usual pattern splits a text into pieces, and no
merge crosses a split.  Texts of Latin letters are split here by the same
pattern over arrays of bytes, many texts at a time; the distinct pieces of such
a block are looked up, and the library's model encodes each that the cache does
not hold.  All other texts, and those with strings of special tokens, go to
the library whole, so the ids are the library's in every case.  The same is done
with all texts where a tokenizer file has other parts than these.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from propflow.llm.latin import LETTERS, NUMBERS, OTHER, SPACES, byte_letters, parts
from propflow.llm.shared import once_a_process

#: Pieces of a generation of the cache; a full generation becomes the old one, and the old one goes.
CACHE_PIECES = 300_000
#: A longer piece is not kept.
LONGEST_KEPT = 64
#: Characters of a text that are worked on at a time.
BLOCK_CHARS = 1 << 20
#: The parts of a tokenizer file whose pieces are found by a pattern here.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Kinds of characters below U+0250.
_SPACE, _LETTER, _NUMBER, _MARK = range(4)
_KIND = np.full(0x250, _MARK, np.uint8)
for _kind, _of in ((_SPACE, SPACES), (_LETTER, LETTERS), (_NUMBER, NUMBERS)):
    _KIND[[ord(c) for c in _of]] = _kind
_BYTE_KIND = np.r_[_KIND[:128], np.full(128, _MARK, np.uint8)]
#: Letters that, after an apostrophe, are a piece with it.
_AFTER = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def piece_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of Latin texts begin; ``texts`` are the places in ``data`` where texts (none empty) begin.

    The pattern is: an apostrophe with certain letters; letters, numbers or other
    marks, each with one blank before it if there is one; white space, of which
    the last character stands alone if more of the text follows.
    """
    kind = _BYTE_KIND[data]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = _KIND[(data[lead].astype(np.int32) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    first = np.zeros(len(data) + 4, bool)
    first[texts] = True
    first[len(data) :] = True
    start = np.empty(len(data), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first[: len(data)]
    # after white space: its last character begins a piece, and a blank takes the next one along
    after = np.flatnonzero(start[1:] & (kind[:-1] == _SPACE) & ~first[1 : len(data)]) + 1
    last = after - 1
    start[last - ((data[last] & 0xC0) == 0x80)] = True
    start[after[data[last] == 0x20]] = False
    quote = np.flatnonzero((data == 0x27) & start)
    if len(quote):
        beyond = np.r_[data, np.zeros(4, np.uint8)]
        for letters in _AFTER:
            at = quote
            for k, letter in enumerate(letters, 1):
                at = at[(beyond[at + k] == letter) & ~first[at + k]]
            start[at + 1] = False
            rest = at + 1 + len(letters)
            rest = rest[~first[rest]]
            start[rest[kind[rest] == _LETTER]] = True
    return np.flatnonzero(start)


def encoder(json_text: str) -> ByteEncoder:
    """The encoder of a tokenizer file, one a process: tasks that share a worker share its cache."""
    return once_a_process("encoder", json_text, ByteEncoder)


class ByteEncoder:
    def __init__(self, json_text: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(json_text)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.code = "I" if self.wide else "H"
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.letters = byte_letters()
        file = json.loads(json_text)
        model = file["model"]
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        # special tokens that take in white space around them do so only where their strings are, and such texts go whole
        self.by_pattern = plain and file.get("normalizer") is None and file.get("post_processor") is None and file.get("pre_tokenizer") == PRE_TOKENIZER

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.known) > CACHE_PIECES:
            self.old, self.known = self.known, {}
        known, old, code, letters, tokenize = self.known, self.old.get, self.code, self.letters, self.library.model.tokenize
        out = list(map(known.get, pieces))
        if None in out:
            blank = chr(letters[32])
            for i in [i for i, x in enumerate(out) if x is None]:
                p = pieces[i]
                ids = old(p)
                if ids is None:
                    text = p.decode("latin-1")
                    symbols = text.replace(" ", blank) if p.isascii() and text.isprintable() else text.translate(letters)
                    ids = array(code, [t.id for t in tokenize(symbols)]).tobytes()
                out[i] = ids
                if len(p) <= LONGEST_KEPT:
                    known[p] = ids
        return out

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of Latin texts, none of them empty."""
        raws = [t.encode() for t in texts]
        ends = np.cumsum([len(r) for r in raws])
        joined = b"".join(raws)
        starts = piece_starts(np.frombuffer(joined, np.uint8), np.r_[0, ends[:-1]])
        bounds = np.r_[starts, len(joined)].astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]).dictionary_encode()
        distinct = self._pieces(pieces.dictionary.to_pylist())
        which = pieces.indices.to_numpy()
        # a block has some megabytes, so that places in it fit 32 bits
        size = np.array(list(map(len, distinct)), np.int32) // self.dtype.itemsize
        at = np.cumsum(size, dtype=np.int32) - size
        sizes = size[which]
        before = np.cumsum(sizes, dtype=np.int32) - sizes
        ids = np.frombuffer(b"".join(distinct), self.dtype)[np.repeat(at[which] - before, sizes) + np.arange(sizes.sum(), dtype=np.int32)]
        cuts = np.r_[before, len(ids)][np.searchsorted(starts, ends)]
        return np.split(ids, cuts[:-1])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, of ``dtype``."""
        empty = np.zeros(0, self.dtype)
        block: list[str] = []
        waiting: list = []  # of each text its ids, or None where the block has them
        size = 0

        def out():
            done = iter(self._block(block) if block else ())
            for x in waiting:
                yield next(done) if x is None else x

        for text in texts:
            if not text:
                waiting.append(empty)
            elif not self.by_pattern or OTHER.search(text) or any(s in text for s in self.special):
                waiting.append(self.ids(text))
            elif len(text) > BLOCK_CHARS:
                waiting.append(np.concatenate([self._block([part])[0] for part in parts(text, BLOCK_CHARS)]))
            else:
                waiting.append(None)
                block.append(text)
                size += len(text)
                if size > BLOCK_CHARS:
                    yield from out()
                    block, waiting, size = [], [], 0
        yield from out()
