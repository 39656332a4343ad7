"""BPE encoding and decoding over a word trie.

A word's encoding has one property that makes prefixes shareable: the encoding of a prefix ends in
exactly one token, and what stands before that token is the encoding of a shorter prefix. So the
whole state of a prefix is its last token. Distinct words go into a trie, a depth-first walk gives
each node the last token of its prefix, and the encodings of shared prefixes are computed once.

A token may end a prefix if it is a suffix of it and the pair of the token before it and itself
is stable: byte-pair merging of the two tokens' bytes gives just these two. Exactly one does.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.llm.text import Shelf, text_or_empty

# Fixed value: the published pre-tokenization pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words that an encoder keeps, and bytes that they may take: half of either in the table in use, half
#: in the one before it, from which words that come again move on.
KEEP_WORDS = 600_000
KEEP_BYTES = 120 << 20
#: Token pairs that an encoder keeps; beyond them their table starts anew.
KEEP_PAIRS = 500_000
#: Bytes of a kept word's place in the table, beside the word and its ids.
PLACE_BYTES = 70
#: Characters whose words are split, made distinct and put into tries together. Of a batch, the rows
#: of so many bytes are encoded and handed on before the next are read.
BLOCK_CHARS = 2_000_000
#: Bytes of new words per trie: what the trie's nodes may cost at once.
TRIE_BYTES = 256 << 10
#: Bytes above which a word shares too little to be worth a path of nodes.
LONG_BYTES = 256


_BYTES = [bytes([b]) for b in range(256)]
#: Before a special token's string in the word table; the pattern never yields such a word, as it
#: parts control characters from what follows.
_MARK = "\ue000\x00 "


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieEncoder:
    """Encodes and decodes with a vocabulary file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        self.ids = {raw[t]: i for t, i in vocab.items()}
        #: merged pair of ids -> (rank, merged id)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        #: every suffix of a token -> the token it is, or -1
        self.suffixes = {t[k:]: -1 for t in self.ids for k in range(len(t))} | self.ids
        self._stable: dict[tuple[int, int], bool] = {}
        self._marks = {_MARK + t: i.to_bytes(4, "little") for t, i in self.special.items()}
        self._words: dict[str, bytes] = dict(self._marks)
        self._before: dict[str, bytes] = {}
        self._kept = 0
        self._pattern = regex.compile(PATTERN)
        strings = sorted(self.special, key=len, reverse=True)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens gives the two tokens again.

        With -1 on the left, at the start of a word: whether the right token's own bytes merge to it.
        """
        if len(self._stable) > KEEP_PAIRS:
            self._stable.clear()
        head = self.bytes_of[left] if left >= 0 else b""
        out = self._merged(head + self.bytes_of[right]) == ([left, right] if left >= 0 else [right])
        self._stable[left, right] = out
        return out

    def _merged(self, raw: bytes) -> list[int]:
        """Plain byte-pair merging, lowest rank first, leftmost first; for short strings."""
        ids = [self.byte_ids[b] for b in raw]
        merges = self.merges
        while len(ids) > 1:
            found = [(hit[0], k, hit[1]) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if (hit := merges.get(pair))]
            if not found:
                break
            _, at, token = min(found)
            ids[at : at + 2] = [token]
        return ids

    def _keep(self, word: str, ids: bytes) -> None:
        self._words[word] = ids
        self._kept += PLACE_BYTES + sys.getsizeof(word) + sys.getsizeof(ids)

    def encode_words(self, words: list[str]) -> None:
        """Add the encodings of ``words`` to the table, trie by trie."""
        block: list[tuple[str, bytes]] = []
        size = 0
        for word in words:
            raw = word.encode()
            if len(raw) > LONG_BYTES:
                self._keep(word, self._encode_alone(raw))
                continue
            block.append((word, raw))
            size += len(raw)
            if size >= TRIE_BYTES:
                self._encode_block(block)
                block, size = [], 0
        if block:
            self._encode_block(block)

    def _encode_block(self, block: list[tuple[str, bytes]]) -> None:
        root: dict = {}
        for word, raw in block:
            node = root
            for b in raw:
                below = node.get(b)
                if below is None:
                    below = node[b] = {}
                node = below
            node[-1] = word
        # Depth first. Along the path, ``last[d]`` is the last token of the prefix of d bytes.
        suffixes, stable = self.suffixes, self._stable
        last: list[int] = [-1]
        stack: list[tuple[bytes, dict]] = [(b"", root)]
        while stack:
            path, node = stack.pop()
            n = len(path)
            if n:
                del last[n:]
                found, k = [], n - 1
                while k >= 0 and (token := suffixes.get(path[k:])) is not None:
                    if token >= 0:
                        found.append((k, token))
                    k -= 1
                for k, token in reversed(found):
                    pair = (last[k], token)
                    fits = stable.get(pair)
                    if fits or (fits is None and self.fits(*pair)):
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            for b, below in node.items():
                if b == -1:
                    self._keep(below, self._read(last))
                else:
                    stack.append((path + _BYTES[b], below))

    def _encode_alone(self, raw: bytes) -> bytes:
        """A long word by itself, by the same last-token states; no suffix is longer than a token."""
        suffixes, stable = self.suffixes, self._stable
        last = array("i", [-1])
        for n in range(1, len(raw) + 1):
            found, k = [], n - 1
            while k >= 0 and (token := suffixes.get(raw[k:n])) is not None:
                if token >= 0:
                    found.append((last[k], token))
                k -= 1
            for pair in reversed(found):
                fits = stable.get(pair)
                if fits or (fits is None and self.fits(*pair)):
                    last.append(pair[1])
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return self._read(last)

    def _read(self, last: list[int] | array) -> bytes:
        """Walk the last tokens back from the end of the word."""
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return struct.pack(f"<{len(out)}I", *out[::-1])

    def encode(self, text: str, special: bool = True) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        return next(self.encode_many([text], special))

    def encode_many(self, texts: list[str], special: bool = True) -> Iterator[bytes]:
        """The ids of each text. New words meet in one trie for every couple of million characters.

        Unless ``special``, the strings of special tokens are ordinary text.
        """
        at = 0
        while at < len(texts):
            if len(self._words) > KEEP_WORDS // 2 or self._kept > KEEP_BYTES // 2:
                self._before, self._words, self._kept = self._words, dict(self._marks), 0
            table, before = self._words, self._before
            pieces, chars, missing = [], 0, {}
            while at < len(texts) and (not pieces or chars + len(texts[at]) <= BLOCK_CHARS):
                words = self._split(texts[at], special)
                pieces.append(words)
                chars += len(texts[at])
                missing.update(dict.fromkeys(w for w in words if w not in table))
                at += 1
            new = []
            for word in missing:
                if (ids := before.get(word)) is None:
                    new.append(word)
                else:
                    self._keep(word, ids)
            self.encode_words(new)
            for words in pieces:
                yield b"".join(map(table.__getitem__, words))

    def _split(self, text: str, special: bool) -> list[str]:
        """The words of a text; a special token's string is a word of its own, marked by a null."""
        if not special or self._cut is None or not self._cut.search(text):
            return self._pattern.findall(text)
        out = []
        for part in self._cut.split(text):
            if part in self.special:
                out.append(_MARK + part)
            else:
                out += self._pattern.findall(part)
        return out

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """This process's encoder for a vocabulary file; a worker that lives on keeps its word table."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose texts, the last column, have up to BLOCK_CHARS bytes, or of one row.

    Spark's batches are of 10,000 rows, of which neither the texts nor the ids need stand in memory at once.
    """
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(), dtype=np.int64)
        at = done = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_CHARS, "right")))
            yield batch.slice(at, to - at)
            at, done = to, ends[to - 1]


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` without the text, with ``token_ids`` (array, if ``ids``), ``n_tokens``, ``ids_sha256``
    and ``decoded_sha256``.

    ``vocabulary`` names a byte-level BPE file that every executor can read. A null text counts as
    empty and has no tokens. Texts of any length are encoded whole; a word of any length costs in
    proportion to it. Strings of special tokens become these tokens. Repeated rows are encoded
    alike; an empty table gives an empty result. A column of ``docs`` that clashes with a result
    column gives way to it.
    """
    made = {"token_ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    shelf = Shelf(docs, (text, *made))
    out = shelf.table.select(
        *shelf.columns, *[F.lit(None).cast(kind).alias(name) for name, kind in made.items() if ids or name != "token_ids"]
    )
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in parts(batches):
            lists, counts, id_digests, text_digests = [], [], [], []
            for packed in bpe.encode_many(batch.column(batch.num_columns - 1).to_pylist()):
                counts.append(len(packed) // 4)
                id_digests.append(hashlib.sha256(packed).hexdigest())
                text_digests.append(hashlib.sha256(bpe.decode(packed).encode()).hexdigest())
                if ids:
                    lists.append(np.frombuffer(packed, "<u4").astype(np.int32))
            columns = [*batch.columns[:-1]]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            columns += [pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)]
            yield pa.RecordBatch.from_arrays(columns, names)

    whole = shelf.table.select(*shelf.columns, text_or_empty(shelf.of(text)).alias("whole"))
    return shelf.back(whole.mapInArrow(run, out.schema))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_encode(docs, default_vocabulary(), ids=False)
