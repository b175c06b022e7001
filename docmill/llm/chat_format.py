"""Chat formatting: budgeted, turn-aligned windows with repeated history masked out of the loss."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import table

#: The template's control strings (fixed values).
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_ESCAPE = re.compile(r"\\|<(?=/?s>)|\[(?=/?(?:INST|ROLE)\])|\n")
_IN_TEXT = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\n"}
_IN_ROLE = _IN_TEXT | {"\n": "\\n"}
_UNESCAPE = re.compile(r"\\(.)")
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
_TURN = re.compile(r"\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|\[ROLE\](.*?)\n(.*?)\[/ROLE\]", re.S)

WINDOWS = "conv_id long, window long, formatted string, n_repeated long, n_turns long, loss_starts array<long>, loss_ends array<long>, n_tokens long"


def escape(text: str, role: bool = False) -> str:
    """Text in which no control string occurs; :func:`unescape` undoes it."""
    to = _IN_ROLE if role else _IN_TEXT
    return _ESCAPE.sub(lambda m: to[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _BACK[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text lies in it."""
    body = escape(text)
    if role == "user":
        return f"[INST]{body}[/INST]", 6, 6 + len(body)
    if role == "assistant":
        return f"<s>{body}</s>", 3, 3 + len(body)
    head = f"[ROLE]{escape(role, role=True)}\n"
    return f"{head}{body}[/ROLE]", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    out = []
    for m in _TURN.finditer(formatted):
        user, assistant, role, other = m.groups()
        if user is not None:
            out.append(("user", unescape(user)))
        elif assistant is not None:
            out.append(("assistant", unescape(assistant)))
        else:
            out.append((unescape(role), unescape(other)))
    return out


def bpe_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens with a byte-level BPE given as a tiktoken rank file."""
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(enc.encode_ordinary(x)) for x in texts]


class _Windows:
    """Cuts the turns of one conversation as they come; holds one span and the history only.

    A turn is (role, formatted, start and end of its text, tokens of the formatted turn).
    """

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system = None
        self.past: deque = deque()
        self.past_tokens = 0
        self.repeat: list = []
        self.span: list = []
        self.tokens = 0
        self.window = 0
        self.first = True

    def add(self, turn: tuple) -> Iterator[tuple]:
        role, tokens = turn[0], turn[-1]
        # running prefix sum of the window: a turn that passes the budget opens the next one
        if self.span and self.tokens + tokens > self.budget:
            yield self.flush()
            room = self.budget - tokens
            if self.system and self.system[-1] <= room:
                self.repeat = [self.system]
                room -= self.system[-1]
            keep, total = [], 0
            for old in reversed(self.past):
                if total + old[-1] > min(self.history, room):
                    break
                keep.append(old)
                total += old[-1]
            self.repeat += keep[::-1]
            self.tokens = sum(t[-1] for t in self.repeat)
        if self.first and role == "system":
            self.system = turn
        else:
            self.past.append(turn)
            self.past_tokens += tokens
            while self.past and self.past_tokens > self.history:
                self.past_tokens -= self.past.popleft()[-1]
        self.first = False
        self.span.append(turn)
        self.tokens += tokens

    def flush(self) -> tuple:
        parts, starts, ends, at = [], [], [], 0
        for i, (role, s, a, b, _) in enumerate(self.repeat + self.span):
            if role == "assistant" and i >= len(self.repeat):
                starts.append(at + a)
                ends.append(at + b)
            parts.append(s)
            at += len(s)
        row = (self.conv, self.window, "".join(parts), len(self.repeat), len(self.span) + len(self.repeat), starts, ends, self.tokens)
        self.window += 1
        self.repeat, self.span, self.tokens = [], [], 0
        return row


def chat_windows(turns: DataFrame, tokenizer: str | None = None, budget: int = 2048, history: int = 512, chunk: int = 256) -> DataFrame:
    """Formatted training windows of conversations (conv_id, turn, role, text).

    Prefix sums of turn tokens choose spans of whole turns up to ``budget`` tokens. Tokens are those of turns
    as formatted, marks and escapes included; formatted turns side by side have no more than their sum. A
    later window first repeats the system turn (a first turn with that role) and the latest turns worth at
    most ``history`` tokens, as far as they leave room for its first new turn; only assistant texts that are
    new in a window are under its loss mask, so each is a target once. A turn is never cut: one longer than
    the budget is a window of its own, alone. So every window of two turns or more keeps the budget.

    Turns are taken by (turn, role, text), nulls first, so ties and repeated rows have a fixed order. Null
    text and null role are empty. A null conv_id is a conversation too. Empty input gives no rows. Other
    columns are ignored. ``tokenizer``: a tiktoken rank file; default: the public 50k byte-level BPE.
    One conversation passes through one task as a sorted stream; memory holds a span, not the conversation.
    """
    path = tokenizer

    def run(batches):
        import public_tokenizers

        count = bpe_counter(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        now: _Windows | None = None
        rows: list[tuple] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, chunk):
                part = batch.slice(lo, chunk).to_pydict()
                turns_ = [render(role, text) for role, text in zip(part["role"], part["text"], strict=True)]
                for conv, role, (said, a, b), n in zip(part["conv_id"], part["role"], turns_, count([t[0] for t in turns_]), strict=True):
                    if now is None or now.conv != conv:
                        if now:
                            rows.append(now.flush())
                        now = _Windows(conv, budget, history)
                    rows += now.add((role, said, a, b, n))
                    if len(rows) >= chunk:
                        yield _batch(rows)
                        rows = []
        if now:
            rows.append(now.flush())
        if rows:
            yield _batch(rows)

    ordered = (
        turns.select("conv_id", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.mapInArrow(run, WINDOWS)


_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("n_repeated", pa.int64()), ("n_turns", pa.int64()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())), ("n_tokens", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its windows, which must come in order (as chat_windows gives them)."""

    def run(batches):
        conv, state, out = None, None, []

        def done():
            n, turns, chars, loss, size, k = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, k))

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    if state is not None:
                        done()
                    conv, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                text = row["formatted"]
                for role, said in parse(text)[row["n_repeated"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                    target = unescape(text[a:b])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
                state[5] += 1
            if out:
                yield _digests(out)
                out = []
        if state is not None:
            done()
            yield _digests(out)

    return windows.mapInArrow(run, DIGEST)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("x")
    ).select("conv_id", "x.turn", "x.role", F.lit(said).alias("text"))
    return read_back(chat_windows(turns.unionByName(extra)))
