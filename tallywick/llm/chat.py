"""Chat formatting by token-level assembly.

A turn is <|im_start|>, its role, a line feed, its text, <|im_end|> and a line feed. Role and text are
encoded apart, and the two markers are spliced in as reserved ids, so no text can make a marker. Control
strings in a text are escaped before it is encoded: in each "<", backslashes, "|" one more backslash is
put in; so escaped texts never hold "<|", and the escape can be taken back. The loss mask is the interval
between two prefix sums of the segments' lengths, first within a turn, then over the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Decoder, Encoder, loaded, send_vocabulary
from .common import map_columns, no_null_text

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
#: Roles of which each Python worker remembers the tokens.
MEMO_ROLES = 1000

_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``; line feeds, which end a role, become \\n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def reserved(size: int) -> tuple[int, int]:
    """Ids of the two markers: the first that the vocabulary leaves free."""
    return size, size + 1


def turns_as_tokens(turns: DataFrame, path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each row of ``turns``: conv_id, turn, role, ids, loss_from, loss_to.

    ``ids`` are the turn's tokens; those in [loss_from, loss_to) are learned: the text of an assistant, and
    nothing else (an empty interval for other roles). Rows are encoded independently, so a conversation
    of any length is spread over all tasks, and repeated rows are turns of their own. Null roles and texts
    are empty; null conv_ids and turns stay null. The ids of a very long text are one value, which grows with
    it. An empty table gives no rows. Extra columns are not read.
    """
    sent, key = send_vocabulary(turns, path)

    def make() -> Callable[..., tuple]:
        import numpy as np

        encoder = loaded(Encoder, sent, key)
        start, end = reserved(1 + max(encoder.vocabulary.tokens))
        splice = [x.to_bytes(4, "little") for x in (start, end)]
        heads: dict[str, bytes] = {}
        after = splice[1] + b"".join(encoder.encode("\n"))

        def call(who: str, said: str) -> tuple:
            head = heads.get(who)
            if head is None:
                head = splice[0] + b"".join(encoder.encode(escape_role(who) + "\n"))
                if len(heads) < MEMO_ROLES:
                    heads[who] = head
            segments = [head, b"".join(encoder.encode(escape(said))), after]
            sums = [0, *accumulate(len(x) // 4 for x in segments)]
            learned = (sums[1], sums[2]) if who == LEARNED else (sums[2], sums[2])
            return np.frombuffer(b"".join(segments), "<i4"), *learned

        return call

    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), no_null_text(role).alias("role"), no_null_text(text).alias("text")
    )
    return map_columns(rows, [F.col("role"), F.col("text")], ("conv_id", "turn", "role"), "ids array<int>, loss_from int, loss_to int", make)


def placed(tokens: DataFrame) -> DataFrame:
    """``turns_as_tokens`` with ``first``, the place of the turn's first token in its conversation (a prefix sum).

    Turns are in the order of ``turn`` (null first), then role and tokens.
    """
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "ids").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("first", F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0).cast("long")))


def read_back(tokens: DataFrame, path: str) -> DataFrame:
    """The rows of ``turns_as_tokens`` with what their tokens say: conv_id, turn, ids, loss_from, loss_to, role, text, learned and formatted_chars.

    Every token is decoded once: those before, under and after the mask. ``learned`` says whether the mask
    holds the whole text, and is an error if it holds another part of the turn.
    """
    sent, key = send_vocabulary(tokens, path)

    def make() -> Callable[..., tuple]:
        decoder = loaded(Decoder, sent, key)
        start, end = reserved(1 + max(decoder.piece))
        heads: dict[tuple, tuple[str, str]] = {}

        def text_of(ids: list[int]) -> str:
            decoder.begin()
            return decoder.push(ids, last=True).decode()

        def call(ids: list[int], loss_from: int, loss_to: int) -> tuple:
            if ids[0] != start or ids.count(start) != 1 or ids.count(end) != 1:
                raise ValueError("not one turn")
            stop = ids.index(end)
            if loss_from < loss_to:
                if loss_to != stop:
                    raise ValueError("the mask is not one text")
                head = tuple(ids[1:loss_from])
                if head not in heads:
                    if len(heads) >= MEMO_ROLES:
                        heads.clear()
                    before = text_of(head)
                    if not before.endswith("\n") or before.count("\n") != 1:
                        raise ValueError("the mask is not one text")
                    heads[head] = before, unescape_role(before[:-1])
                before, who = heads[head]
                said = text_of(ids[loss_from:loss_to])
            else:
                before, _, said = text_of(ids[1:stop]).partition("\n")
                who, before = unescape_role(before), before + "\n"
            chars = len(START) + len(before) + len(said) + len(END) + len(text_of(ids[stop + 1 :]))
            return who, unescape(said), loss_from < loss_to, chars

        return call

    return map_columns(
        tokens, [F.col("ids"), F.col("loss_from"), F.col("loss_to")], ("conv_id", "turn", "ids", "loss_from", "loss_to"), "role string, text string, learned boolean, formatted_chars long", make
    )


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``read_back``: it is assembled from its turns in order, as a stream.

    n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars are of its texts; n_tokens and
    ids_sha256 of its tokens, and mask_sha256 of its loss mask: first and last place of each learned interval
    in the conversation, by the prefix sums of the turns' lengths. A digest is sequential, so a
    conversation's rows pass through one task, sorted and one by one, with nothing kept but sums and the state
    of the hashes; encoding and decoding are done before, in all tasks. Turns are ordered by number (null
    first), then role and text; repeated rows are turns of their own. A null conv_id is a conversation of its
    own. No rows give none.
    """
    import numpy as np

    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", "learned", "formatted_chars", "ids", "loss_from", "loss_to")
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    fields = {
        "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(),
        "n_tokens": pa.int64(), "ids_sha256": pa.string(), "mask_sha256": pa.string(),
    }
    schema = pa.schema(fields)
    hashed = ("turns_sha256", "loss_sha256", "ids_sha256", "mask_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        state: dict | None = None

        def close() -> None:
            if state is not None:
                done.append(state | {k: state[k].hexdigest() for k in hashed})

        for batch in batches:
            names = ("conv_id", "role", "text", "learned", "formatted_chars", "loss_from", "loss_to")
            values = (batch.column(c).to_pylist() for c in names)
            tokens = batch.column("ids")
            ends = tokens.offsets.to_numpy()
            flat = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            for i, (conv, role, text, learned, chars, loss_from, loss_to) in enumerate(zip(*values, strict=True)):
                if state is None or state["conv_id"] != conv:
                    close()
                    state = dict.fromkeys(fields, 0) | {"conv_id": conv} | {k: hashlib.sha256() for k in hashed}
                state["n_turns"] += 1
                state["turns_sha256"].update(f"{role}\n{text}\n".encode())
                state["ids_sha256"].update(flat[ends[i] : ends[i + 1]].tobytes())
                first = state["n_tokens"]
                if learned:
                    state["loss_chars"] += len(text)
                    state["loss_sha256"].update(text.encode())
                    state["mask_sha256"].update(np.array([first + loss_from, first + loss_to], "<u8").tobytes())
                state["n_tokens"] = first + int(ends[i + 1] - ends[i])
                state["formatted_chars"] += chars
            yield pa.RecordBatch.from_pylist(done, schema)
            done.clear()
        close()
        yield pa.RecordBatch.from_pylist(done, schema)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, ids_sha256 string, mask_sha256 string")
