"""BPE encoding and decoding by a prefix-sharing trie traversal.

The encoding of a prefix is settled by its last token: it is the encoding of
what stands before that token, and the token.  A token may follow another if no
merge could have joined parts of the two before each was whole.  So the distinct
words of a block are put into a trie (in sorted order, which is its preorder),
and a depth-first walk propagates the last-token state from each node to its
children: a prefix that many words share is encoded once.  The end-of-word
marker makes a word's last symbol a symbol of its own, the leaf.

Texts of Latin letters are split into words by the tokenizer file's pattern, as
Python has it; all others are normalised and split by the library.  Ids of words
are kept while the cache holds them, so only words not met before are walked.

Cases: a null text counts as empty and has no ids; strings of special tokens in
a text give their ids, as the library does.  Null identifiers and repeated rows
are encoded like any other.  A very long text of Latin letters is worked on in
parts cut between words, any other goes to the library whole; either way its ids
are one value.  An empty table gives an empty result.  Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propflow.llm.latin import LETTERS, NUMBERS, OTHER, SPACES, byte_letters, parts
from propflow.llm.shared import give_back, table, text_of

#: Words of a generation of the cache; a full generation becomes the old one, and the old one goes.
CACHE_WORDS = 300_000
#: A longer word is not kept for later blocks.
LONGEST_KEPT = 64
#: Entries of what is known of pairs of tokens, and of steps of the walk; each is emptied when it holds more.
CACHE_PAIRS = 500_000
#: Characters whose words go into one trie, and of which a longer text is worked on at a time.
BLOCK_CHARS = 1 << 20
_NEVER = 1 << 40
#: The parts of a tokenizer file whose words are found by a pattern here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The same for Latin texts.  Letters come first, for no other part begins with one.
_WORDS = re.compile(rf"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


class TrieBPE:
    """A word-level BPE vocabulary with an end-of-word suffix (or none).

    A file whose model does more than merge pairs is refused.  A file whose
    normaliser or pre-tokenizer are others than those named above has its texts
    normalised and split whole by the library; one with special tokens that
    take in their surroundings is encoded by the library alone.
    """

    def __init__(self, json_text: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(json_text)
        self.library.no_padding()
        self.library.no_truncation()
        file = json.loads(json_text)
        model = file["model"]
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("this operator encodes by BPE merges alone: no dropout, unknown token, prefix, byte fallback or ignored merges")
        self.by_pattern = file.get("normalizer") == NORMALIZER and file.get("pre_tokenizer") == PRE_TOKENIZER
        added = file.get("added_tokens") or []
        self.by_words = file.get("post_processor") is None and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.rank: dict[int, dict[int, int]] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank.setdefault(a, {})[b] = rank
            self.halves.setdefault(whole, (a, b, rank))
        # without this a walk over times of merges would not be BPE
        if any(self.halves.get(x, (0, 0, -1))[2] >= rank for a, b, rank in self.halves.values() for x in (a, b)):
            raise ValueError("a merge comes before one that makes its parts")
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.dtype = np.dtype("<u4")
        self.letters = byte_letters()
        # what a token may go on from: the texts that are the beginning of a longer one
        bodies = (t.removesuffix(self.suffix) if self.suffix else t for t in self.vocab)
        self.begun = {body[:k] for body in bodies for k in range(1, len(body))}
        self._follows: dict[int, bool] = {}
        self._ends: dict[int, list[tuple[int, int]]] = {}
        self._begins: dict[int, list[tuple[int, int]]] = {}
        self._whole: dict[int, bool] = {}
        self._steps: dict[str, tuple[str, list[tuple[int, int]]]] = {}
        self._leaves: dict[str, list[tuple[int, int]]] = {}
        self.known: dict[str | tuple[str], bytes] = {}
        self.old: dict[str | tuple[str], bytes] = {}

    def _edge(self, token: int, side: int, known: dict) -> list[tuple[int, int]]:
        """The parts that have stood at one edge of a token, each with the rank that ended it."""
        if token not in known:
            parts, until = [(token, _NEVER)], _NEVER
            part = token
            while part in self.halves:
                until = self.halves[part][2]
                part = self.halves[part][side]
                parts.append((part, until))
            known[token] = parts
        return known[token]

    def _crosses(self, a: int, b: int, limit: int) -> bool:
        """Whether a merge over the border of ``a`` and ``b`` comes before both are whole, and before ``limit``."""
        begins = self._begins.get(b) or self._edge(b, 0, self._begins)
        for x, x_until in self._ends.get(a) or self._edge(a, 1, self._ends):
            ranks = self.rank.get(x)
            if ranks:
                for y, y_until in begins:
                    rank = ranks.get(y)
                    # of equal ranks the left one is merged first
                    if rank is not None and rank < x_until and rank <= y_until and rank < limit:
                        return True
        return False

    def follows(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is how their joined text is encoded."""
        return not self._crosses(a, b, _NEVER)

    def whole(self, token: int) -> bool:
        """Whether the token's text is encoded as the token."""
        found = self._whole.get(token)
        if found is None:
            if token not in self.halves:
                found = True
            else:
                a, b, rank = self.halves[token]
                found = self.whole(a) and self.whole(b) and not self._crosses(a, b, rank)
            self._whole[token] = found
        return found

    def _ending(self, text: str, suffix: str) -> list[tuple[int, int]]:
        """Sizes and ids of the tokens that end ``text``, the longest first."""
        found = ((len(text) - k, self.vocab.get(text[k:] + suffix)) for k in range(len(text)))
        return [(size, token) for size, token in found if token is not None and self.whole(token)]

    def _step(self, path: str) -> tuple[str, list[tuple[int, int]]]:
        """How the walk goes on from a node: what a token may have begun there, and the tokens that end there.

        ``path`` is what a token may have begun at the node's parent, and the node's symbol.
        """
        if len(self._steps) > CACHE_PAIRS:
            self._steps.clear()
        begun = next((path[k:] for k in range(len(path)) if path[k:] in self.begun), "")
        step = self._steps[path] = (begun, self._ending(path, ""))
        return step

    def _leaf(self, path: str) -> list[tuple[int, int]]:
        if len(self._leaves) > CACHE_PAIRS:
            self._leaves.clear()
        found = self._leaves[path] = self._ending(path, self.suffix)
        return found

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of distinct words (of the vocabulary's symbols) by one walk over their trie."""
        out = {}
        pairs, steps, leaves = self._follows, self._steps, self._leaves
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        start_id = len(self.names)  # stands before each word's first token
        deepest = max(map(len, words), default=0) + 1
        # of each node of the current path: its last token and that token's size, and what may have begun there
        lasts, sizes, begun, before = [start_id] * deepest, [0] * deepest, [""] * deepest, ""
        depth = 0  # nodes of the current path whose state is known
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(depth, n - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            depth, before = n - 1, word
            # the nodes below the shared ones, and last the leaf, whose symbol has the end-of-word marker
            for end in range(shared + 1, n + 1):
                path = begun[end - 1] + word[end - 1]
                if end < n:
                    begun[end], ending = steps.get(path) or self._step(path)
                else:
                    ending = leaves.get(path) or self._leaf(path)
                for size, token in ending:
                    key = lasts[end - size] << 24 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = size == end or self.follows(lasts[end - size], token)
                    if fits:
                        break
                else:
                    break
                if end < n:
                    lasts[end], sizes[end] = token, size
            else:
                ids, at = [token], n - size
                while at:
                    ids.append(lasts[at])
                    at -= sizes[at]
                ids.reverse()
                out[word] = array("I", ids).tobytes()
                continue
            # a symbol that the vocabulary lacks: what then stands for it is the library's to say
            depth = end - 1
            out[word] = array("I", [t.id for t in self.library.model.tokenize(word)]).tobytes()
        return out

    def _words(self, text: str) -> list:
        """Words of a text as keys of the cache, and ids of special tokens.

        A word in the vocabulary's symbols is a tuple of one, which no word found by the pattern can be.
        """
        if self.by_pattern and not OTHER.search(text) and not any(t in text for t in self.added):
            return _WORDS.findall(text.lower())
        out = []
        for part in self.split_added.split(text) if self.split_added else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                out += [(w,) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)] if self.library.pre_tokenizer else [(normal,)]
        return out

    def _symbols(self, word: str | tuple[str]) -> str:
        """The word in the vocabulary's symbols, of which each byte has one."""
        if isinstance(word, tuple):
            return word[0]
        if word.isascii() and word.isprintable():
            return word
        return word.encode().decode("latin-1").translate(self.letters)

    def _learn(self, words: set) -> dict:
        """Ids of words that are not known; all but very long ones are known from then on."""
        if len(self.known) > CACHE_WORDS:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        met = {w: old[w] for w in words if w in old}
        symbols = {w: self._symbols(w) for w in words if w not in met}
        ids = self.encode_words(set(symbols.values()))
        met |= {w: ids[s] for w, s in symbols.items()}
        known |= {w: x for w, x in met.items() if len(w[0] if isinstance(w, tuple) else w) <= LONGEST_KEPT}
        return met

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        get = self.known.get
        split = [self._words(text) for text in texts]
        found = [list(map(get, words)) for words in split]
        new = {w for words, got in zip(split, found) if None in got for w, g in zip(words, got) if g is None and not isinstance(w, int)}
        met = self._learn(new) if new else {}
        for words, got in zip(split, found):
            if None in got:
                got = [g if g is not None else array("I", [w]).tobytes() if isinstance(w, int) else met[w] for w, g in zip(words, got)]
            yield b"".join(got)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, little-endian and of 32 bits."""
        if not self.by_words:
            for text in texts:
                yield array("I", self.library.encode(text or "", add_special_tokens=False).ids).tobytes()
            return
        block: list[str] = []
        size = 0
        for text in texts:
            if self.by_pattern and text and len(text) > BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
                yield b"".join([raw for part in parts(text, BLOCK_CHARS) for raw in self._block([part])])
                continue
            block.append(text or "")
            size += len(block[-1])
            if size > BLOCK_CHARS:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def decode(self, ids: np.ndarray) -> str:
        """Token texts joined by blanks: what the library does where a file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def _coder(spark: SparkSession, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    if json.loads(text)["decoder"] is not None:
        raise ValueError("this operator decodes for tokenizer files without a decoder")
    return spark.sparkContext.broadcast(text)


def _with_coder(file, batches: Iterator[pa.RecordBatch], coded) -> Iterator[pa.RecordBatch]:
    """``coded(coder, rows)`` for some rows at a time; the coder and its caches go with the task, so idle workers hold none."""
    coder = TrieBPE(file.value)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            yield coded(coder, batch.slice(a, 256))
    del coder
    give_back()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary) for each row: little-endian ids of 32 bits."""
    file = _coder(docs.sparkSession, tokenizer)

    def coded(coder: TrieBPE, rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(coder.encode(rows.column(1).to_pylist())), pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _with_coder(file, batches, coded), "id long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids binary)."""
    file = _coder(encoded.sparkSession, tokenizer)

    def coded(coder: TrieBPE, rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [coder.decode(np.frombuffer(x or b"", coder.dtype)) for x in rows.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), "ids")
    return rows.mapInArrow(lambda batches: _with_coder(file, batches, coded), "id long, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, without the ids leaving it."""
    file = _coder(docs.sparkSession, tokenizer)

    def coded(coder: TrieBPE, rows: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, text = [], [], []
        for raw in coder.encode(rows.column(1).to_pylist()):
            n.append(len(raw) // 4)
            ids.append(hashlib.sha256(raw).hexdigest())
            text.append(hashlib.sha256(coder.decode(np.frombuffer(raw, coder.dtype)).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(lambda batches: _with_coder(file, batches, coded), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, ids) for each row."""
    rows = encode(docs, tokenizer, id_col, text_col)
    return rows.select(id_col, F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
