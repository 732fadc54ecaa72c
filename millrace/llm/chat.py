"""Chat formatting by prefix-target expansion: one example for each assistant turn.

An example holds all preceding turns as context and one assistant turn as the only trainable span.
Turns that follow a conversation's last assistant turn (all of them, where it has none) go into one
closing example without a trainable span, so the output holds every turn. Inside texts and roles
each control string gets a backslash after its first character (one more where backslashes already
stand there), which ``unescape`` takes away again: the round trip is exact.

Rows are dealt by conversation, sorted by turn and streamed: a task holds the rendered prefix of one
conversation, never a group of them. The examples of a conversation of n turns have in sum a length
that grows with n squared, which is what this format means.

Edge cases: null text and role are empty; turns with the same number are ordered by role, then text;
repeated rows are turns of their own; rows with a null conversation id form one conversation; an
empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches

#: The template's own marks, and marks of other common templates.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TRAINABLE_ROLE = "assistant"
#: Arrow batches of about so many characters.
FLUSH_CHARS = 4_000_000

_CONTROLS = (TURN, TEXT, END, *FOREIGN)
_ESCAPE = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in _CONTROLS))
_UNESCAPE = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in _CONTROLS))
_RENDERED = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}\n", re.S)

EXAMPLES = "conv_id {id}, example long, n_turns long, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    return [(unescape(role), unescape(text)) for role, text in _RENDERED.findall(formatted)]


def _batched(rows, columns: list[str], size):
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row)
        if chars >= FLUSH_CHARS or len(held) >= 5000:
            yield pd.DataFrame(held, columns=columns)
            held, chars = [], 0
    yield pd.DataFrame(held, columns=columns)


def _turns(batches):
    for pdf in batches:
        yield from zip(*(pdf.iloc[:, i].tolist() for i in range(4)), strict=True)


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


_NONE = object()


def _expand(batches):
    """Examples of each conversation in turn; rows come sorted by conversation and turn."""

    def rows():
        conv, prefix, n, made, open_turns = _NONE, [], 0, 0, 0

        def closing():
            if open_turns:
                text = "".join(prefix)
                yield conv, made, n, text, len(text), len(text)

        for c, _, role, text in _turns(batches):
            if conv is _NONE or not _same(c, conv):
                yield from closing()
                conv, prefix, n, made, open_turns = c, [], 0, 0, 0
            head = f"{TURN}{escape(role or '')}{TEXT}"
            body, n = escape(text or ""), n + 1
            if role == TRAINABLE_ROLE:
                before = "".join([*prefix, head])
                prefix = [f"{before}{body}{END}\n"]
                yield conv, made, n, prefix[0], len(before), len(before) + len(body)
                made, open_turns = made + 1, 0
            else:
                prefix.append(f"{head}{body}{END}\n")
                open_turns += 1
        yield from closing()

    yield from _batched(rows(), ["conv_id", "example", "n_turns", "formatted", "loss_start", "loss_end"], lambda r: len(r[3]))


def format_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each example: its rendered text and the trainable span in code points."""
    bound_batches(turns.sparkSession)
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("n"), F.col(role_col).alias("r"), F.col(text_col).alias("t"))
    kind = rows.schema["c"].dataType.simpleString()
    dealt = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t")
    return dealt.mapInPandas(_expand, EXAMPLES.format(id=kind))


def _digest(batches):
    def rows():
        conv, last, chars, total, loss = _NONE, "", 0, 0, hashlib.sha256()

        def result():
            if conv is not _NONE:
                turns, sha = parse(last), hashlib.sha256()
                for role, text in turns:
                    sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                yield conv, len(turns), sha.hexdigest(), chars, loss.hexdigest(), total

        for pdf in batches:
            for c, formatted, start, end in zip(pdf["conv_id"].tolist(), pdf["formatted"], pdf["loss_start"], pdf["loss_end"], strict=True):
                if conv is _NONE or not _same(c, conv):
                    yield from result()
                    conv, last, chars, total, loss = c, "", 0, 0, hashlib.sha256()
                target = unescape(formatted[start:end])
                loss.update(target.encode("utf-8", "surrogatepass"))
                last, chars, total = formatted, chars + len(target), total + len(formatted)
        yield from result()

    yield from _batched(rows(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], lambda r: 200)


def digest(examples: DataFrame) -> DataFrame:
    """What the examples say when read back, for each conversation.

    Turns come from a conversation's last example, which holds them all; the trainable text is that
    under each example's mask, in order. ``examples`` is what ``format_examples`` returned: rows of
    a conversation are neighbours already, so nothing is dealt again.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()
    return examples.mapInPandas(_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
