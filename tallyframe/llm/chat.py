r"""Chat formatting with typed content parts.

A turn is `<turn>` role `<body>` content `</turn>` and a line feed. In roles and texts `\` and `<` are escaped by `\`, so an
unescaped `<` always starts a mark, and what was written can be read back exactly. A visitor flattens a turn's parts, in
order: text as it is, others as placeholders such as `<image 0>`, with a reference to the attachment and the number of
tokens that it expands to. The loss mask covers the bodies of the roles that are learnt.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import in_arrow

TURN, BODY, END = "<turn>", "<body>", "</turn>\n"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("n_tokens", pa.int64())])
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLACEHOLDER = re.compile(r"(?<!\\)((?:\\\\)*)<\w+ \d+>")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flattener:
    """Visits the parts of one turn; `visit_<type>` gives what stands for a part. Unknown types are placeholders of no token."""

    def __init__(self, first: int, at: int, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 800) -> None:
        self.next, self.at, self.out, self.attachments = first, at, [], []
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def _put(self, shown: str) -> None:
        self.out.append(shown)
        self.at += len(shown)

    def _attach(self, kind: str, part: dict, tokens: float) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.at, "n_tokens": math.ceil(tokens)})
        self._put(f"<{kind} {self.next}>")
        self.next += 1

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, (part.get("seconds") or 0) * self.audio_rate)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)


def format_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each turn: conv_id, turn, formatted, loss_first and loss_end (code points of formatted under the loss
    mask, null if none), attachments and n_placeholder_tokens.

    parts: a column of PART arrays; a turn whose parts are null has its text as the only part. Null roles and texts are
    empty. Placeholders are numbered inside a turn. Repeated rows are turns of their own, very long texts are formatted whole;
    an empty table gives no rows. Other columns are left out.
    """
    columns = [F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    source = turns.select(*columns, (F.col(parts) if parts else F.lit(None)).cast(f"array<{PART}>").alias("parts"))

    def run(batches):
        for batch in batches:
            formatted, first, end, attached, tokens = [], [], [], [], []
            for r, t, ps in zip(*(batch.column(c).to_pylist() for c in ("role", "text", "parts")), strict=True):
                head = TURN + escape(r) + BODY
                flat = Flattener(0, len(head))
                for p in [{"type": "text", "text": t}] if ps is None else ps:
                    flat.visit(p or {})
                formatted.append(head + "".join(flat.out) + END)
                first.append(len(head) if r in learnt else None)
                end.append(flat.at if r in learnt else None)
                attached.append(flat.attachments)
                tokens.append(sum(a["n_tokens"] for a in flat.attachments))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(formatted, pa.string()), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(attached, pa.list_(ATTACHMENT)), pa.array(tokens, pa.int64())], names=["conv_id", "turn", "formatted", "loss_first", "loss_end", "attachments", "n_placeholder_tokens"])

    kind, number = source.schema["conv_id"].dataType.simpleString(), source.schema["turn"].dataType.simpleString()
    return in_arrow(source, run, f"conv_id {kind}, turn {number}, formatted string, loss_first long, loss_end long, attachments array<struct<kind:string,ref:string,at:long,n_tokens:long>>, n_placeholder_tokens long")


def parse(formatted: str) -> tuple[str, str]:
    """The role and the text of a formatted turn, placeholders taken out."""
    if not formatted.startswith(TURN) or not formatted.endswith(END):
        raise ValueError("not a formatted turn")
    head, found, body = formatted[len(TURN) : -len(END)].partition(BODY)  # a role's own `<` is escaped
    if not found:
        raise ValueError("a turn without a body")
    return unescape(head), unescape(_PLACEHOLDER.sub(r"\1", body))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row for each conversation of a written table of format_turns, from its formatted turns alone: conv_id, n_turns,
    turns_sha256 (of role, line feed, text, line feed per turn), loss_chars and loss_sha256 (of all text under the loss mask)
    and formatted_chars.

    Turns are in order of turn (nulls first), equal ones of their formatted text. A conversation is streamed, never held:
    its turns pass a running digest in the sorted partition that has them.
    """
    turns = spark.read.parquet(path).select("conv_id", "turn", "formatted", "loss_first", "loss_end")
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches):
        now, n, chars, loss, turns_sha, loss_sha, started, arrow = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), False, None

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            arrow, found = batch.schema.field("conv_id").type, []
            for c, formatted, first, end in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_first", "loss_end")), strict=True):
                if started and c != now:
                    found.append((now, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars))
                if not started or c != now:
                    now, n, chars, loss, turns_sha, loss_sha, started = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), True
                role, text = parse(formatted)
                n, chars = n + 1, chars + len(formatted)
                turns_sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if first is not None:
                    learnt = unescape(_PLACEHOLDER.sub(r"\1", formatted[first:end]))
                    loss += len(learnt)
                    loss_sha.update(learnt.encode("utf-8", "surrogatepass"))
            if found:
                yield rows(found)
        if started:
            yield rows([(now, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars)])

    return in_arrow(ordered, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
