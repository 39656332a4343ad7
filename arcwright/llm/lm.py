"""Language-model scoring from a log-frequency Bloom filter.

Bigram counts are quantised to levels a factor of about sqrt(2) apart, and a bigram of level q is
entered as the keys (bigram, 1) ... (bigram, q). A query probes level after level until one is
absent; the last one present gives the count. Every bigram of the training documents is entered,
so the filter grows with them and no bound on its size can be proven: it is not broadcast. Its
segments stay distributed, chunks of documents send their bigrams to the segments, and the levels
that the probes found go back to the chunks.

Probabilities are interpolated with absolute discounting: what the held bigrams of a context leave
over goes to the add-half unigram model. Unigram counts are exact and stay distributed: words meet
by hash segment, are summed there, and go back to the chunks of documents that asked for them.

Documents are tokenised once, into chunks of a bounded number of bytes that are written down: the
distinct words and a stream of word numbers. Everything exchanged after that is one packed row per
chunk and segment, so a frequent word or bigram is one entry per chunk, never one per occurrence.
Questions are sorted by segment and answers come back in the order of the questions, so an answer
carries no keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.llm.text import text_or_empty
from arcwright.session import materialize

#: Bits of the filter per entered key, and probes per key: one absent key in a thousand is found.
BITS_PER_KEY, PROBES = 16, 6
#: Bytes of text that a chunk holds, unless one document has more.
CHUNK_BYTES = 16 << 20
#: Bytes of text per hash segment, and the least number of segments.
SEGMENT_BYTES, MIN_SEGMENTS = 8 << 20, 64
#: The end of a text; no word is empty.
END = b""

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and fold."""
    x = (x ^ (x >> np.uint64(31))) * _GOLD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def _bigram_keys(h: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Upper half: the context's hash. Lower half: the pair's."""
    low = _mix(h[left] * np.uint64(3) + h[right]) & np.uint64(0xFFFFFFFF)
    return (h[left] & ~np.uint64(0xFFFFFFFF)) | low


def _levels() -> np.ndarray:
    """Smallest counts of the levels: 1, 2, 3, 4, 6, 8, 12, ..."""
    return np.array([1, 2, *(x << k for k in range(60) for x in (3, 4))], np.int64)


LEVELS = _levels()


class Filter:
    """One segment of the Bloom filter, sized by what it holds; probes vectorise over keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        level = np.searchsorted(LEVELS, counts, side="right")
        self.words = np.zeros(-(-int(level.sum()) * BITS_PER_KEY // 64), np.uint64)
        self.top = int(level.max(initial=0))
        for q in range(1, self.top + 1):
            part = keys[level >= q]
            for probe in range(PROBES):
                bit = self._bit(part, q, probe)
                np.bitwise_or.at(self.words, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))

    def _bit(self, keys: np.ndarray, level: int, probe: int) -> np.ndarray:
        salt = np.uint64((level * 0x9E3779B97F4A7C15 + probe * 0xD1B54A32D192ED03) & (2**64 - 1))
        return _mix(keys + salt) % np.uint64(len(self.words) * 64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level that the probes find for each key, 0 if it is not held."""
        out = np.zeros(len(keys), np.uint8)
        alive = np.arange(len(keys) if len(self.words) else 0)
        for level in range(1, self.top + 1):
            for probe in range(PROBES):
                bit = self._bit(keys[alive], level, probe)
                word = self.words[(bit >> np.uint64(6)).astype(np.int64)]
                alive = alive[(word >> (bit & np.uint64(63))) & np.uint64(1) == 1]
            if not len(alive):
                break
            out[alive] = level
        return out


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(raw: bytes) -> bytes:
    return _ZIP.compress(raw)


def _expand(raw: bytes) -> bytes:
    return _UNZIP.decompress(raw)


def _pack(numbers: np.ndarray) -> bytes:
    """The numbers by byte planes: of sorted or small ones, most planes nearly vanish."""
    return _squeeze(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(_expand(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [part.split() for part in schema.split(",")]
    columns = [pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


def _in_batches(rows: Iterator[tuple], schema: str, size: int = 2000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield _rows(part, schema)
            part = []
    if part:
        yield _rows(part, schema)


# Chunks: documents as distinct words and a stream of their numbers.

_CHUNK_SCHEMA = "chunk long, bytes long, learned long, words binary, stream binary, marks binary"


def _chunk_row(number: int, texts: list[bytes], marks: list[tuple]) -> tuple:
    """Training documents first, so that their pairs are the first ones. Marks: held out, id lacks, id, tokens."""
    ids: dict[bytes, int] = {END: 0}
    stream, rows, learned = [0], [], 0
    for k in sorted(range(len(texts)), key=lambda k: marks[k][0]):
        before = len(stream)
        stream += [ids.setdefault(w, len(ids)) for w in texts[k].lower().split()]
        stream.append(0)
        held, ident = marks[k]
        rows.append((held, ident is None, ident or 0, len(stream) - before))
        learned += 0 if held else len(stream) - before
    size = sum(map(len, texts))
    return (
        number, size, learned, _squeeze(b" ".join(ids)), _pack(np.array(stream, np.uint32)), _pack(np.array(rows, np.int64).ravel())
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # The table is written once, so a number need only be unlike the others of this one write.
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts, marks, size = [], [], 0
        for text, held, ident in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if texts and size + len(text) > CHUNK_BYTES:
                yield _rows([_chunk_row(number, texts, marks)], _CHUNK_SCHEMA)
                number, texts, marks, size = number + 1, [], [], 0
            texts.append(text)
            marks.append((held, ident))
            size += len(text)
        if texts:
            yield _rows([_chunk_row(number, texts, marks)], _CHUNK_SCHEMA)
            number += 1


@dataclass
class Chunk:
    """A chunk as read back. ``words[0]`` is END; pair k is of ``stream[k]`` and ``stream[k + 1]``."""

    words: list[bytes]
    stream: np.ndarray
    h: np.ndarray

    @classmethod
    def of(cls, words: bytes, stream: bytes) -> Chunk:
        words = _expand(words).split(b" ")  # END comes first and is empty
        return cls(words, _unpack(stream, np.uint32).astype(np.int64), np.array([_word_hash(w) for w in words], np.uint64))

    def pairs(self, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigram keys by segment, then value; each pair's key number; segments; their first keys."""
        keys, at = np.unique(_bigram_keys(self.h, self.stream[:-1], self.stream[1:]), return_inverse=True)
        order, some, cuts = _by_segment(_segment(keys, segments))
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        return keys[order], place[at], some, cuts

    def by_word_segment(self, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers in the order of their segments; segments; their first places."""
        return _by_segment(_context_segment(self.h >> np.uint64(32), segments))


def _by_segment(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by segment, the segments that occur, and the bounds of each in that order."""
    order = np.argsort(part, kind="stable")
    some, first = np.unique(part[order], return_index=True)
    return order, some, np.concatenate((first, [len(part)]))


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return (_mix(keys ^ _GOLD) % np.uint64(segments)).astype(np.int64)


def _context_segment(context: np.ndarray, segments: int) -> np.ndarray:
    return (_mix(context) % np.uint64(segments)).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list[list]]]:
    """Rows of consecutive equal first columns, as lists of the other columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True):
            if rows and row[0] != now:
                yield now, rows
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield now, rows


# Pass 1: bigrams of all chunks, counted over the training documents.

_ASKED_SCHEMA = "segment int, chunk long, keys binary, counts binary"


def _ask_bigrams(segments: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for number, learned, words, stream in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                keys, at, some, cuts = Chunk.of(words, stream).pairs(segments)
                counts = np.bincount(at[:learned], minlength=len(keys)).astype(np.uint32)
                for s, a, b in zip(some.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    yield s, number, _pack(keys[a:b]), _pack(counts[a:b])

    return lambda batches: _in_batches(asked(batches), _ASKED_SCHEMA)


#: Kinds of answers: a segment's counts of counts, contexts' masses, the levels that a chunk asked for.
STATS, CONTEXTS, FOUND = 0, 1, 2
_ANSWER_SCHEMA = "kind int, to long, segment int, packed binary, once long, twice long"


def _answer_bigrams(segments: int):
    """Per segment: fill its part of the filter, then answer each chunk's questions by probing it."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for segment, rows in _groups(batches, 4):
            asked = [_unpack(k, np.uint64) for _, k, _ in rows]
            counts = np.concatenate([_unpack(c, np.uint32) for _, _, c in rows])
            keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
            counts = np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)
            held = counts > 0
            found = Filter(keys[held], counts[held]).level(keys)
            yield STATS, -1, segment, b"", int((counts == 1).sum()), int((counts == 2).sum())
            entered = LEVELS[np.searchsorted(LEVELS, counts[held], side="right") - 1]
            context, at = np.unique(keys[held] >> np.uint64(32), return_inverse=True)
            mass = np.bincount(at, weights=entered, minlength=len(context)).astype(np.int64)
            types = np.bincount(at, minlength=len(context)).astype(np.int64)
            order, some, cuts = _by_segment(_context_segment(context, segments))
            for s, a, b in zip(some.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                k = order[a:b]
                yield CONTEXTS, s, segment, _pack(np.concatenate([context[k].astype(np.int64), mass[k], types[k]])), 0, 0
            ends = np.cumsum([len(a) for a in asked])
            for (chunk, _, _), part in zip(rows, np.split(inverse, ends[:-1]), strict=True):
                yield FOUND, chunk, segment, _squeeze(found[part].tobytes()), 0, 0

    return lambda batches: _in_batches(answers(batches), _ANSWER_SCHEMA)


# Pass 2: words of all chunks, counted over the training documents.

_WORD_SCHEMA = "segment int, kind int, chunk long, words binary, counts binary"
_NUMBER_SCHEMA = "chunk long, segment int, numbers binary, tokens long, kinds long"
#: Kinds of rows that reach a word segment: masses of contexts, words of a chunk.
_MASSES, _WORDS = 0, 1


def _ask_words(segments: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for number, learned, words, stream in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                chunk = Chunk.of(words, stream)
                counts = np.bincount(chunk.stream[1 : learned + 1], minlength=len(chunk.words))
                order, some, cuts = chunk.by_word_segment(segments)
                for s, a, b in zip(some.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    mine = [chunk.words[k] for k in order[a:b].tolist()]
                    yield s, _WORDS, number, _squeeze(b" ".join(mine)), _pack(counts[order[a:b]])

    return lambda batches: _in_batches(asked(batches), _WORD_SCHEMA)


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment and chunk: counts, masses and types over the corpus of the words that the chunk sent, in its order."""
    return _in_batches(_numbers(batches), _NUMBER_SCHEMA)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for segment, rows in _groups(batches, 5):
        contexts = [_unpack(packed, np.int64).reshape(3, -1) for kind, _, packed, _ in rows if kind == _MASSES]
        flat = np.concatenate([np.zeros((3, 0), np.int64), *contexts], axis=1)
        known, at = np.unique(flat[0], return_inverse=True)
        mass = np.bincount(at, weights=flat[1], minlength=len(known)).astype(np.int64)
        types = np.bincount(at, weights=flat[2], minlength=len(known)).astype(np.int64)
        ids: dict[bytes, int] = {}
        asked = []
        for kind, chunk, packed, counts in rows:
            if kind == _WORDS:
                numbers = np.array([ids.setdefault(w, len(ids)) for w in _expand(packed).split(b" ")], np.int64)
                asked.append((chunk, numbers, _unpack(counts, np.int64)))
        if not asked:
            continue
        total = np.bincount(
            np.concatenate([n for _, n, _ in asked]), weights=np.concatenate([c for _, _, c in asked]), minlength=len(ids)
        ).astype(np.int64)
        h = (np.array([_word_hash(w) for w in ids], np.uint64) >> np.uint64(32)).astype(np.int64)
        k = np.searchsorted(known, h)
        hit = np.flatnonzero(k < len(known))
        hit = hit[known[k[hit]] == h[hit]]
        table = np.zeros((3, len(ids)), np.int64)
        table[0] = total
        table[1, hit], table[2, hit] = mass[k[hit]], types[k[hit]]
        tokens, kinds = int(total.sum()), int((total > 0).sum())
        for chunk, numbers, _ in asked:
            yield chunk, segment, _pack(table[:, numbers].ravel()), tokens, kinds
            tokens = kinds = 0  # once per segment


# Pass 3: scores, chunk by chunk.

_DEALT_SCHEMA = "chunk long, kind int, segment int, a binary, b binary, c binary"
_OUT_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


@dataclass
class Model:
    """What a scoring task needs besides its chunk's words and bigrams."""

    tokens: int
    kinds: int
    discount: float
    segments: int


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 6):
            numbers = [_unpack(a, np.int64).reshape(3, -1) for kind, _, a, _, _ in rows if kind == 0]
            levels = [np.frombuffer(_expand(a), np.uint8) for kind, _, a, _, _ in rows if kind == 1]
            (body,) = [row for row in rows if row[0] == 2]
            yield _scored(Chunk.of(body[2], body[3]), _unpack(body[4], np.int64).reshape(-1, 4), numbers, levels, model)

    return run


def _scored(chunk: Chunk, marks: np.ndarray, numbers: list[np.ndarray], levels: list[np.ndarray], model: Model) -> pa.RecordBatch:
    """Scores of the chunk's documents from the answers, which come in the order of its questions."""
    order, _, _ = chunk.by_word_segment(model.segments)
    table = np.zeros((3, len(order)), np.int64)
    table[:, order] = np.concatenate(numbers, axis=1)
    c, mass, types = table
    p1 = (c + 0.5) / (model.tokens + 0.5 * (model.kinds + 1))
    log1 = np.log10(p1)
    used = np.maximum(mass - model.discount * types, 0.0)
    rest = np.where(c > 0, np.clip(1.0 - used / np.maximum(c, 1), 1e-3, 1.0), 1.0)
    keys, at, _, _ = chunk.pairs(model.segments)
    found = np.concatenate(levels)
    if len(found) != len(keys):
        raise ValueError("a segment did not answer")
    seen = np.concatenate(([0], LEVELS))[found][at]
    left, right = chunk.stream[:-1], chunk.stream[1:]
    # A held bigram's context was seen; a false positive's may not have been.
    direct = np.where(c[left] > 0, np.maximum(seen - model.discount, 0.0) / np.maximum(c[left], 1), 0.0)
    log_p = np.log10(np.minimum(direct + rest[left] * p1[right], 1.0))
    held, lacks, ident, lengths = marks.T
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    n = len(lengths)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ident, pa.int64(), mask=lacks.astype(bool)),
            pa.array(held.astype(bool)),
            pa.array(lengths, pa.int64()),
            pa.array(np.add.reduceat((c[right] > 0).astype(np.int64), starts)),
            pa.array(np.full(n, model.tokens, np.int64)),
            pa.array(np.add.reduceat(log1[right], starts)),
            pa.array(np.add.reduceat(log_p, starts)),
        ],
        [part.split()[0] for part in _OUT_SCHEMA.split(", ")],
    )


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of each row of ``docs``.

    The model learns from documents whose crc32 of the id as text, modulo ``folds``, is not
    ``held_fold``. A null id counts as an empty string there. A null or empty text is its end
    alone. Texts of any length are learned from and scored whole, and repeated rows each count.
    Without training documents every probability is that of an empty count. An empty table gives
    an empty result. Columns other than id and text are left out, so their names cannot clash.
    """
    ident = F.col(id_col).cast("long")
    held = F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_fold
    rows = docs.select(text_or_empty(text).cast("binary").alias("_t"), held.alias("_h"), ident.alias("_i"))
    chunks = materialize(rows.mapInArrow(_chunks, _CHUNK_SCHEMA), "lm-chunks")
    size = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    segments = max(MIN_SEGMENTS, size // SEGMENT_BYTES)
    texts = chunks.select("chunk", "learned", "words", "stream")

    def at_segments(questions: DataFrame, answer, schema: str) -> DataFrame:
        return questions.repartition("segment").sortWithinPartitions("segment").mapInArrow(answer, schema)

    grams = texts.mapInArrow(_ask_bigrams(segments), _ASKED_SCHEMA)
    grams = materialize(at_segments(grams, _answer_bigrams(segments), _ANSWER_SCHEMA), "lm-bigrams")
    stats = grams.filter(F.col("kind") == STATS).agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).first()
    masses = grams.filter(F.col("kind") == CONTEXTS).select(
        F.col("to").cast("int").alias("segment"), F.lit(_MASSES).alias("kind"), F.lit(-1).cast("long").alias("chunk"),
        F.col("packed").alias("words"), F.lit(b"").alias("counts"),
    )
    words = texts.mapInArrow(_ask_words(segments), _WORD_SCHEMA).union(masses)
    words = materialize(at_segments(words, _answer_words, _NUMBER_SCHEMA), "lm-words")
    totals = words.agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v")).first()
    once, twice = stats["once"] or 0, stats["twice"] or 0
    discount = once / (once + 2 * twice) if once + twice else 0.5
    model = Model(totals["n"] or 0, totals["v"] or 0, discount, segments)
    none = F.lit(b"")
    dealt = (
        words.select("chunk", F.lit(0).alias("kind"), "segment", F.col("numbers").alias("a"), none.alias("b"), none.alias("c"))
        .union(grams.filter(F.col("kind") == FOUND).select("to", F.lit(1), "segment", "packed", none, none))
        .union(chunks.select("chunk", F.lit(2), F.lit(-1), "words", "stream", "marks"))
        .repartition("chunk")
        .sortWithinPartitions("chunk", "kind", "segment")
    )
    return dealt.mapInArrow(_score(model), _OUT_SCHEMA)


def lm_query(spark, sf_dir):
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
