"""Chat formatting by token-level assembly.

Each turn's text is encoded by itself, reserved ids that no text can produce are
spliced in between, and the loss mask is the prefix sum of +1 and -1 marks at the
ends of the assistants' texts.  Control strings that occur inside a text are
escaped: a backslash goes after their first character, one more where some stand
there already, so taking one away restores the text exactly.

Nulls: a null role or text is empty; turns with a null ``conv_id`` form one
conversation of their own; null turns come first.  Repeated rows are repeated
turns, ordered by their ids.  An empty table gives no rows.  Further columns are
not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.llm.common import batch_of, map_arrow, slices
from tenderspark.llm.tokens import encoder

CONTROLS = ("<s>", "</s>", "[SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
BOS, END, SYSTEM, USER, ASSISTANT, ROLE, ROLE_END = range(len(CONTROLS))
MARKS = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
ROLES = {mark: role for role, mark in MARKS.items()}
PIECE = 1 << 16

_RAW = re.compile("|".join(rf"({re.escape(c[0])})(\\*)(?={re.escape(c[1:])})" for c in ("<s>", "</s>"))
                  + r"|(\[)(\\*)(?=(?:SYS|/?INST|/?ROLE)\])")
_ESCAPED = re.compile(r"(?:(<)(\\+)(?=/?s>))|(?:(\[)(\\+)(?=(?:SYS|/?INST|/?ROLE)\]))")

TURN = pa.schema([("conv", pa.int64()), ("unnamed", pa.bool_()), ("turn", pa.int64()), ("ids", pa.binary()), ("low", pa.int64()),
                  ("high", pa.int64()), ("loss", pa.bool_())])
PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary())])
READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                  ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64())])


def escape(text: str) -> str:
    return _RAW.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


def _encode_turns(path: str):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special_as_text=True)
        for batch in slices(batches, "text"):
            conv, turn, roles, texts = (batch.column(i).to_pylist() for i in range(4))
            bodies = enc.encode([escape(t) for t in texts])
            names = enc.encode([escape(r) for r in roles])
            ids, low, high = [], [], []
            for role, name, body in zip(roles, names, bodies):
                mark = MARKS.get(role)
                head = [mark] if mark is not None else [ROLE, *(-1 - i for i in np.frombuffer(name, enc.dtype).tolist()), ROLE_END]
                head = np.array([enc.size + x if x >= 0 else -1 - x for x in head], dtype="<u4")
                content = np.frombuffer(body, enc.dtype).astype("<u4")
                ids.append(np.concatenate([head, content, np.array([enc.size + END], dtype="<u4")]).tobytes())
                low.append(len(head))
                high.append(len(head) + len(content))
            yield batch_of(TURN, conv=[0 if c is None else c for c in conv], unnamed=[c is None for c in conv], turn=turn, ids=ids,
                           low=low, high=high, loss=[r == "assistant" for r in roles])

    return work


def _assemble(path: str):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bos = np.array([encoder(path, special_as_text=True).size + BOS], dtype="<u4")
        last, parts, marks, held, piece, start = None, [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, marks, held, piece, start
            ids = np.concatenate(parts)
            change = np.zeros(len(ids) + 1, dtype=np.int8)
            for a, b in marks:
                change[a] += 1
                change[b] -= 1
            out = batch_of(PIECES, conv_id=[None if last[1] else last[0]], piece=[piece], start=[start], ids=[ids.tobytes()],
                           mask=[np.cumsum(change[:-1], dtype=np.int8).tobytes()])
            parts, marks, held, piece, start = [], [], 0, piece + 1, start + len(ids)
            return out

        for batch in batches:
            for conv, unnamed, ids, low, high, loss in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                                             for c in ("conv", "unnamed", "ids", "low", "high", "loss"))):
                if (conv, unnamed) != last:
                    if parts:
                        yield flush()
                    last, piece, start, parts, held = (conv, unnamed), 0, 0, [bos], 1
                elif held >= PIECE:
                    yield flush()
                turn = np.frombuffer(ids, "<u4")
                if loss and high > low:
                    marks.append((held + low, held + high))
                parts.append(turn)
                held += len(turn)
        if parts:
            yield flush()

    return work


def format_chats(conversations: DataFrame, path: str) -> DataFrame:
    """``conv_id, piece, start, ids, mask``: the ids of each conversation (32-bit, little-endian) and its loss mask, one byte for each id.

    A conversation longer than `PIECE` ids goes on in further pieces, cut between
    turns.  Texts are encoded before the shuffle; after it a task streams through
    its conversations turn by turn and holds one piece.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")),
                                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    coded = map_arrow(turns, _encode_turns(path), "conv long, unnamed boolean, turn long, ids binary, low long, high long, loss boolean")
    dealt = coded.repartition("conv", "unnamed").sortWithinPartitions("conv", "unnamed", F.asc_nulls_first("turn"), "ids")
    return map_arrow(dealt, _assemble(path), "conv_id long, piece int, start long, ids binary, mask binary")


def _read(path: str):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special_as_text=True)
        state, rows = None, []

        def close() -> None:
            turns, loss = state["turns"].hexdigest(), state["loss"].hexdigest()
            rows.append((state["conv"], state["n"], turns, state["loss_chars"], loss, state["chars"], state["ids"], state["masked"]))

        for batch in batches:
            for conv, piece, data, mask in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "piece", "ids", "mask"))):
                if piece == 0:
                    if state:
                        close()
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "ids": 0, "masked": 0}
                ids, under = np.frombuffer(data, "<u4"), np.frombuffer(mask, np.int8)
                state["ids"] += len(ids)
                state["masked"] += int(under.sum())
                where = np.flatnonzero(ids >= enc.size)
                marks = (ids[where] - enc.size).tolist()
                state["chars"] += sum(len(CONTROLS[m]) for m in marks)
                spans = list(itertools.pairwise([*where.tolist(), len(ids)]))
                strings = enc.tokenizer.decode_batch([ids[a + 1:b].tolist() for a, b in spans], skip_special_tokens=False)
                role = ""
                for mark, (a, b), string in zip(marks, spans, strings):
                    state["chars"] += len(string)
                    if mark == ROLE:
                        role = unescape(string)
                    elif mark in ROLES or mark == ROLE_END:
                        text = unescape(string)
                        state["n"] += 1
                        state["turns"].update(f"{ROLES.get(mark, role)}\n{text}\n".encode())
                    if b > a + 1 and under[a + 1:b].any():
                        kept = ids[a + 1:b][under[a + 1:b] > 0]
                        said = unescape(string if len(kept) == b - a - 1 else enc.tokenizer.decode(kept.tolist(), skip_special_tokens=False))
                        state["loss"].update(said.encode())
                        state["loss_chars"] += len(said)
                if len(rows) >= 2000:
                    yield batch_of(READ, **dict(zip(READ.names, map(list, zip(*rows)))))
                    rows = []
        if state:
            close()
        if rows:
            yield batch_of(READ, **dict(zip(READ.names, map(list, zip(*rows)))))

    return work


def read_chats(formatted: DataFrame, path: str) -> DataFrame:
    """Reads `format_chats` back: each conversation's turns and loss text as digests and lengths.

    Expects the pieces of a conversation in order, as `format_chats` gives them.
    """
    return map_arrow(formatted, _read(path), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                             "formatted_chars long, n_tokens long, loss_tokens long")
