"""Chat formatting by incremental black-box rendering.

A template is any function from a list of messages to a string; nothing is known of how it works. A conversation's
prefixes of 1, 2, ... turns are rendered one after another. Where a rendering starts with the one before, what it adds
is the new turn's span. Where it does not, the template rewrote history: the turn has no span, and the spans of earlier
turns no longer hold in the final rendering. A turn is ``trained`` if it is the assistant's and its span holds.

Rendering every prefix is the price of asking no more of the template; it is quadratic in a conversation's turns, and
only in those.

A template may refuse a prefix by raising. That turn has no span. What the next prefix that renders adds then holds the text of both turns, so it is
rendered once more with its last turn empty: the span is what the text alone has added, if that leaves the rendering before untouched, else unknown. No span is ever claimed for
text that another turn has put there.

Defined results. Turns go in the order of (turn, role, text), nulls first; repeated turns are turns each, ties are interchangeable. A null text is
empty, a null role is the user's. Rows of a null conv_id have no conversation: each is one of its own, so that they never gather in one task. A conversation needs no first user turn. Texts of any length are rendered
whole. Spans count characters, end exclusive, and hold in the last rendering that there is. A refused turn neither rewrites nor is trained. No rows give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.frames import col

Message = dict[str, str]


def marked(messages: list[Message]) -> str:
    """Each turn between markers, with its role."""
    return "".join(f"<|im_start|>{m['role']}\n{m['text']}<|im_end|>\n" for m in messages)


def instructed(messages: list[Message]) -> str:
    """User turns in instruction brackets, assistant turns closed by an end mark."""
    forms = {"system": "<<SYS>>\n{}\n<</SYS>>\n\n", "user": "[INST] {} [/INST]", "assistant": " {}</s>"}
    return "".join(forms.get(m["role"], "{}\n").format(m["text"]) for m in messages)


def late_system(messages: list[Message]) -> str:
    """The system text goes before the last user turn, so each new user turn moves it: this rewrites history."""
    system = "\n\n".join(m["text"] for m in messages if m["role"] == "system")
    users = [k for k, m in enumerate(messages) if m["role"] == "user"]
    out = []
    for k, m in enumerate(messages):
        if m["role"] == "user":
            head = f"{system}\n\n" if system and k == users[-1] else ""
            out.append(f"[INST] {head}{m['text']} [/INST]")
        elif m["role"] != "system":
            out.append(f" {m['text']}</s>")
    return "".join(out)


TEMPLATES: dict[str, Callable[[list[Message]], str]] = {"marked": marked, "instructed": instructed, "late_system": late_system}


def _rendered(render: Callable[[list[Message]], str], messages: list[Message]) -> str | None:
    try:
        return render(messages)
    except Exception:  # a template may refuse a prefix, in ways of its own
        return None


def _added(whole: str, bare: str | None, text: str, least: int) -> tuple[int, int] | None:
    """Where whole has what bare, the same with an empty last turn, lacks; None if that can't be told or begins before least."""
    n = len(whole) - len(bare) if bare is not None else 0
    if n <= 0:
        return None
    start = len(os.path.commonprefix([whole, bare]))
    if start < least or whole[start + n :] != bare[start:]:
        return None
    # Where the text begins as what follows it does, several places would do: that of the text itself is meant.
    places = range(start, max(least, start - n) - 1, -1)
    start = next((s for s in places if whole[s : s + n] == text and whole[s + n :] == bare[s:]), start) if n == len(text) else start
    return start, start + n


def turn_spans(messages: list[Message], render: Callable[[list[Message]], str]) -> list[tuple[int | None, int | None, bool, bool]]:
    """(start, end, whether this turn rewrote history, whether the span holds in the last rendering) of each turn."""
    spans: list[tuple[int | None, int | None, bool]] = []
    before, refused = "", False
    for k, message in enumerate(messages):
        now = _rendered(render, messages[: k + 1])
        if now is None:
            spans.append((None, None, False))
            refused = True
            continue
        if not now.startswith(before):
            spans.append((None, None, True))
        elif refused:
            spans.append((*(_added(now, _rendered(render, [*messages[:k], message | {"text": ""}]), message["text"], len(before)) or (None, None)), False))
        else:
            spans.append((len(before), len(now), False))
        before, refused = now, False
    last = max((k for k, s in enumerate(spans) if s[2]), default=-1)
    return [(*s, k > last and s[0] is not None) for k, s in enumerate(spans)]


def format_chats(conversations: DataFrame, templates: dict[str, Callable[[list[Message]], str]] | None = None, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv_id, template, turn, role, start, end, rewrites, trained): a row for each turn and template."""
    templates = TEMPLATES if templates is None else templates
    kind, number = conversations.schema[conv_id].dataType.simpleString(), conversations.schema[turn].dataType.simpleString()
    c = lambda name: col(conversations, name)
    turns = F.struct(c(turn).alias("turn"), c(role).alias("role"), c(text).alias("text"))
    rows = conversations.select(c(conv_id).alias("conv_id"), turns.alias("t"))
    whole = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = [], []
            for k, of in enumerate(batch.column(1).to_pylist()):
                messages = [{"role": t["role"] if t["role"] is not None else "user", "text": t["text"] or ""} for t in of]
                for name, template in templates.items():
                    for t, m, (start, end, rewrites, holds) in zip(of, messages, turn_spans(messages, template), strict=True):
                        ids.append(k)
                        rows.append((name, t["turn"], m["role"], start, end, rewrites, holds and m["role"] == "assistant"))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string(), batch.schema.field(1).type.value_type.field("turn").type, pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))],
                ["conv_id", "template", "turn", "role", "start", "end", "rewrites", "trained"],
            )

    return whole.mapInArrow(render, f"conv_id {kind}, template string, turn {number}, role string, start bigint, end bigint, rewrites boolean, trained boolean")
