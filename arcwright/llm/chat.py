"""Chat formatting by token-level assembly.

A turn becomes ``<|turn|> role <|text|> text <|end|>``. The marks are reserved ids above the
vocabulary that no text can produce: each segment is encoded by itself, with control strings in it
escaped, and the ids are spliced between the reserved ones. The loss mask is the running sum of +1
where a segment that is learned begins and -1 where it ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.llm.bpe import TrieEncoder, default_vocabulary, encoder

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Rows whose text is learned.
LEARNED = "assistant"

# Control strings of this template and of common others, escaped where a text holds them.
CONTROL = (
    "<|turn|>", "<|text|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>",
    "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)

_TO_ESCAPE = re.compile(r"\\|(?:" + "|".join(re.escape(c) for c in CONTROL) + ")")


def escape(text: str) -> str:
    """A backslash is doubled, and one goes after the first character of a control string."""
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def reserved(bpe: TrieEncoder) -> dict[str, int]:
    """The ids after the vocabulary's last."""
    return {mark: len(bpe.bytes_of) + k for k, mark in enumerate((TURN, TEXT, END))}


def assemble(bpe: TrieEncoder, role: str, text: str, learned: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a turn and its loss mask."""
    marks = reserved(bpe)
    packed = bpe.encode_many([escape(role), escape(text)], special=False)
    head, body = (np.frombuffer(p, "<u4").astype(np.int32) for p in packed)
    one = lambda mark: np.array([marks[mark]], np.int32)
    ids = np.concatenate([one(TURN), head, one(TEXT), body, one(END)])
    step = np.zeros(len(ids) + 1, np.int8)
    begin = 2 + len(head)
    step[begin] += learned
    step[begin + len(body)] -= learned
    return ids, np.cumsum(step[:-1], dtype=np.int8)


def parse(bpe: TrieEncoder, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, str]:
    """``(role, text, learned text, formatted text)`` of a turn, from its ids and mask alone."""
    marks = reserved(bpe)
    text_at = int(np.flatnonzero(ids == marks[TEXT])[0])
    if ids[0] != marks[TURN] or ids[-1] != marks[END]:
        raise ValueError("not a turn")
    decode = lambda part: bpe.decode(part.astype("<u4").tobytes())
    head, body = decode(ids[1:text_at]), decode(ids[text_at + 1 : -1])
    learned = decode(ids[mask.astype(bool)])
    return unescape(head), unescape(body), unescape(learned), TURN + head + TEXT + body + END


def format_turns(
    turns: DataFrame, vocabulary: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, turn, n, ids, loss_mask)``: each row of ``turns`` as tokens.

    A conversation is the concatenation of its rows' ids in the order of ``turn``; no row needs
    another, so a conversation of any length is formatted in parallel. A null text or role counts
    as empty. Rows that repeat a turn are kept, ordered by role, then text. Other columns are left
    out; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            convs, at, roles, texts = (batch.column(i) for i in range(4))
            ids, masks = [], []
            for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True):
                a, b = assemble(bpe, r, t, r == LEARNED)
                ids.append(a)
                masks.append(b)
            yield pa.RecordBatch.from_arrays(
                [convs, at, roles, texts, pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))],
                ["conv_id", "turn", "_role", "_text", "ids", "loss_mask"],
            )

    return turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(role, F.lit("")).alias("_role"),
        F.coalesce(text, F.lit("")).alias("_text"),
    ).mapInArrow(
        run, "conv_id long, turn long, _role string, _text string, ids array<int>, loss_mask array<tinyint>"
    )


def read_back(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of each conversation, from its ids and masks.

    Rows are dealt by conversation and sorted, then streamed: a task holds one row at a time and
    running digests, however many turns a conversation has.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        now, state, out = None, None, []

        def close() -> None:
            n, turns, chars, loss, formatted = state
            out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        for batch in batches:
            for conv, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learned, formatted = parse(bpe, np.array(ids, np.int64), np.array(mask, np.int8))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(formatted)
            if out:
                yield _digests(out)
                out = []
        if state is not None:
            close()
            yield _digests(out)

    def _digests(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "_role", "_text")
        .select("conv_id", "ids", "loss_mask")
        .mapInArrow(run, schema)
    )


#: A conversation whose texts are control strings, added to the query's input.
PROBE = "</s>[INST] ok [/INST]"


def chat_query(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    vocabulary = default_vocabulary()
    return read_back(format_turns(turns.unionByName(probe), vocabulary), vocabulary)


def _escape_sql(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for mark in CONTROL:
        out = rf"replace({out}, '{mark}', '{mark[0]}\{mark[1:]}')"
    return out


#: The same digests from the rows themselves; only the length of the formatted text needs the template.
CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
e AS (SELECT *, length({_escape_sql("role")}) + length({_escape_sql("text")}) + {len(TURN + TEXT + END)} AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
