r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and that reply alone under the loss.  Turns after the last reply (or
of a conversation without one) come in one more example that trains nothing,
so that no turn is lost.

A turn is written ``### role: text</turn>`` and a line feed.  Inside texts and
roles a backslash goes before each backslash and ``#``, before the slash of
``</turn>``, and in roles before each colon; so ``###`` and ``</turn>`` stand in
the output only where the template put them, and dropping the backslashes
gives back what was there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)
BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    """Guard control strings; :func:`unescape` undoes it."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def turn_head(role: str) -> str:
    return HEAD + escape(role).replace(":", "\\:") + COLON


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn of a formatted example."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def expand(turns: Iterator[tuple[str, str]], target: str = "assistant") -> Iterator[tuple[str, int, int]]:
    """``(formatted, loss_begin, loss_end)`` for each example; the loss is a span of code points, empty if there is none."""
    so_far, open_turns = "", False
    for role, text in turns:
        head, body = turn_head(role), escape(text)
        begin = len(so_far) + len(head)
        so_far += head + body + TAIL
        open_turns = role != target
        if not open_turns:
            yield so_far, begin, begin + len(body)
    if open_turns:
        yield so_far, len(so_far), len(so_far)


def examples(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """``(conv_id, example, formatted, loss_begin, loss_end)``, each conversation's examples one after the other.

    Turns are ordered by ``turn``, then role, then text, nulls first; repeated
    rows stay.  A null text or role counts as empty; rows without a
    conversation id form one conversation.  Other columns are not read.  An
    example is as long as the conversation so far, which is the method's
    price; a task holds one conversation's text and one batch.
    """
    kind = dict(conversations.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type = None

        def rows():
            nonlocal key_type
            for batch in batches:
                key_type = batch.column(0).type
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())

        source = rows()
        held = next(source, None)
        out, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, numbers, texts, begins, ends = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], names=["conv_id", "example", "formatted", "loss_begin", "loss_end"])

        while held is not None:
            key = held[0]

            def own():
                nonlocal held
                while held is not None and held[0] == key:
                    yield held[1] or "", held[2] or ""
                    held = next(source, None)

            for number, (formatted, begin, end) in enumerate(expand(own(), target)):
                out.append((key, number, formatted, begin, end))
                size += len(formatted)
                if size >= BATCH_CHARS:
                    yield flush()
                    size = 0
        if out:
            yield flush()

    own = conversations.select(F.col("conv_id"), F.col("role").cast("string"), F.col("text").cast("string"), F.col("turn"))
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, example long, formatted string, loss_begin long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """What :func:`examples` wrote, read again: one row of digests for each conversation.

    ``turns_sha256`` is over role, line feed, text, line feed of each turn of
    the last example, ``loss_sha256`` over the texts under the loss of all
    examples in their order, ``formatted_chars`` the code points of all
    examples.  The rows must come as :func:`examples` gives them: neighbours of
    one ``conv_id``, a null one too, are one conversation, so repeated turns
    count as often as they stand there.  Null and empty texts read back as
    empty ones; a conversation without a reply has no loss.  No rows for an
    empty table.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begun, last, loss, loss_chars, chars, out, key_type = None, False, "", sha256(), 0, 0, [], None

        def close() -> None:
            turns = read_turns(last)
            digest = sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
            out.append((key, len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            key_type = batch.column(0).type
            for k, _, text, begin, end in zip(*[c.to_pylist() for c in batch.columns]):
                if begun and k != key:
                    close()
                    loss, loss_chars, chars = sha256(), 0, 0
                key, begun, last = k, True, text
                under = unescape(text[begin:end])
                loss.update(under.encode())
                loss_chars += len(under)
                chars += len(text)
            if len(out) >= 4096:
                yield flush()
        if begun:
            close()
            yield flush()

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
