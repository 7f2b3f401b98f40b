"""Chat formatting by incremental black-box rendering.

A template is any function from a list of messages to a text.  Rendering the first
turn, the first two, and so on, and comparing each output with the one before, shows
where each turn went, with no look inside the template: what the longer output adds
between the longest common beginning and end is the turn's span.  If the earlier output
isn't wholly there around the addition, the template has rewritten history.  A template
may refuse a prefix by raising whatever it likes; the turn has a reason then, no span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = dict[str, str]
Template = Callable[[list[Message]], str]
_BLANK = " \t\r\n"


@dataclass(frozen=True)
class Format:
    """A template as data: what is around all turns and around each, {role} and {content}."""

    turn: str
    start: str = ""
    end: str = ""
    #: A system turn that is put first where there is none.
    default_system: str | None = None
    #: Contents without blanks around them.
    trim: bool = False
    #: What stands for all of the assistant's turns but the last: such a template rewrites history.
    past: str | None = None
    #: Raises unless user and assistant alternate, a system turn may come first, and there is a user turn.
    alternate: bool = False

    def __call__(self, messages: list[Message]) -> str:
        if self.alternate:
            spoken = messages[bool(messages) and messages[0]["role"] == "system" :]
            if any(m["role"] != ("user", "assistant")[k % 2] for k, m in enumerate(spoken)):
                raise ValueError("roles must alternate")
            if not spoken:
                raise ValueError("no user turn")
        if self.default_system is not None and not (messages and messages[0]["role"] == "system"):
            messages = [{"role": "system", "content": self.default_system}, *messages]
        last = max((k for k, m in enumerate(messages) if m["role"] == "assistant"), default=-1)
        out = [self.start]
        for k, m in enumerate(messages):
            content = m["content"].strip(_BLANK) if self.trim else m["content"]
            if self.past is not None and m["role"] == "assistant" and k < last:
                content = self.past
            out.append(self.turn.format(role=m["role"], content=content))
        return "".join([*out, self.end])


TEMPLATES: dict[str, Template] = {
    "tagged": Format("<|{role}|>\n{content}<|end|>\n"),
    "closed": Format("[{role}] {content}\n", "<chat>", "</chat>"),  # a frame whose end moves on with each turn
    "recent": Format("<|{role}|>\n{content}<|end|>\n", past="..."),
    "defaulted": Format("<|im_start|>{role}\n{content}<|im_end|>\n", default_system="You are a helpful assistant.", trim=True),
    "strict": Format("[{role}]{content}[/{role}]", "<s>", alternate=True),
}


def _common(a: str, b: str) -> int:
    """Length of the longest common beginning, by bisection over slices that compare at C speed."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def step(before: str, after: str) -> tuple[int, int, bool]:
    """(start, end, rewrites): what ``after`` adds to ``before``.

    Where the addition could be placed in more than one way, it is as far right as
    possible.  A rewrite's span goes from the first difference to what both end with.
    """
    start = _common(before, after)
    tail = _common(before[start:][::-1], after[start:][::-1])
    return start, len(after) - tail, start + tail < len(before)


def _rendered(messages: list[Message], template: Template) -> tuple[str | None, str | None]:
    """(text, None), or (None, why there is no text)."""
    try:
        text = template([dict(m) for m in messages])
    except Exception as e:  # whatever a black box raises is its answer
        return None, f"{type(e).__name__}: {e}"
    return (text, None) if isinstance(text, str) else (None, f"{type(text).__name__} is no text")


def trace(messages: list[Message], template: Template) -> tuple[list[tuple[int | None, int | None, bool, str | None]], str]:
    """Each turn's (start, end, rewrites, reason) and the whole output, empty if there is none.

    Spans are in the whole output.  A turn's is null from the moment a later turn
    changes the output before its end: where it is then can't be told from outside.  It
    is null too, with a reason, if the template refuses the prefix that the turn ends;
    what the turns since the last prefix that was rendered add is then the span of the
    next one that is.  The first prefix is that of no turns, if the template takes it.
    """
    spans: list[tuple[int | None, int | None, bool, str | None]] = []
    before = _rendered([], template)[0] or ""
    for k in range(len(messages)):
        after, reason = _rendered(messages[: k + 1], template)
        if after is None:
            spans.append((None, None, False, reason))
            continue
        start, end, rewrites = step(before, after)
        rewrites &= k > 0  # there is no history before the first turn, though a default may give way to it
        if rewrites:
            spans = [(a, b, *r) if b is not None and b <= start else (None, None, *r) for a, b, *r in spans]
        spans.append((start, end, rewrites, None))
        before = after
    return spans, before if any(r is None for *_, r in spans) else ""


def spans(conversations: DataFrame, templates: dict[str, Template] | None = None, target_roles: tuple[str, ...] = ("assistant",), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(template, conv_id, turn, role, start, end, is_target, rewrites, n_chars, reason):
    where each turn is in its conversation's rendering, in code points, ends exclusive,
    whether it is one to train on, whether adding it rewrote what was rendered before, the
    length of the whole rendering, and why there is none of the turn.

    Turns are ordered by number, nulls first, equal ones by role and text; repeated
    rows are turns of their own.  A null role or text renders as an empty one; a null
    role isn't a target; each row with a null conv_id is a conversation of its own; very
    long texts are rendered whole; an empty table gives an empty one; other columns are
    ignored.  A template that raises, or returns no text, gives a reason and no span.
    """
    used = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                messages = [{"role": t["role"] or "", "content": t["text"] or ""} for t in turns]
                for name, template in used.items():
                    found, whole = trace(messages, template)
                    for t, (a, b, rewrites, reason) in zip(turns, found):
                        for column, x in zip(out, (name, conv, t["turn"], t["role"], a, b, t["role"] in target_roles and reason is None, rewrites, len(whole), reason)):
                            column.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], ["template", "conv_id", "turn", "role", "start", "end", "is_target", "rewrites", "n_chars", "reason"])

    one = F.struct(F.col(turn).cast("bigint").isNotNull().alias("n"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = conversations.select(F.col(conv_id).cast("bigint").alias("conv_id"), one.alias("x"))
    grouped = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    alone = rows.filter("conv_id is null").select("conv_id", F.array("x").alias("turns"))
    return grouped.unionByName(alone).mapInArrow(run, "template string, conv_id bigint, turn bigint, role string, start int, end int, is_target boolean, rewrites boolean, n_chars int, reason string")


def loss_mask(n_chars: int, targets: list[tuple[int, int]]) -> np.ndarray:
    """True on the characters of a rendering to train on."""
    mask = np.zeros(n_chars, bool)
    for a, b in targets:
        mask[a:b] = True
    return mask


def sql() -> str:
    """``spans`` in DuckDB SQL over ``conversations`` whose conv_ids aren't null: every prefix
    is rendered, and neighbours are compared character by character from either end."""
    differ = "coalesce(nullif(list_position(list_transform(range(1, least(len({0}), len({1})) + 1), lambda i: {0}[i] <> {1}[i]), true), 0) - 1, least(len({0}), len({1})))"
    agg = lambda x: f"coalesce(string_agg({x}, '' order by k), '')"
    tag = lambda c: f"'<|' || r || '|>' || chr(10) || {c} || '<|end|>' || chr(10)"
    im = lambda r, c: f"'<|im_start|>' || {r} || chr(10) || {c} || '<|im_end|>' || chr(10)"
    names = ("tagged", "closed", "recent", "defaulted", "strict")
    return f"""
    with m as (select conv_id, turn, role, coalesce(role, '') as r, coalesce(text, '') as c, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k from conversations where conv_id is not null),
    led as (select *, max(case when k = 1 and r = 'system' then 1 else 0 end) over (partition by conv_id) as lead from m),
    odd as (select *, k > lead and r <> case when (k - lead) % 2 = 1 then 'user' else 'assistant' end as odd from led),
    prefix as (select conv_id, k from m union all select distinct conv_id, 0 from m),
    part as (select p.conv_id, p.k as n, m.k, r, c, lead, odd, max(case when r = 'assistant' then m.k end) over (partition by p.conv_id, p.k) as last from prefix p left join odd m on p.conv_id = m.conv_id and m.k <= p.k),
    o as (select conv_id, n, {agg(tag("c"))} as tagged, '<chat>' || {agg("'[' || r || '] ' || c || chr(10)")} || '</chat>' as closed, {agg(tag("case when r <> 'assistant' or k = last then c else '...' end"))} as recent,
        case when coalesce(max(lead), 0) = 0 then {im("'system'", "'You are a helpful assistant.'")} else '' end || {agg(im("r", "trim(c, ' ' || chr(9) || chr(13) || chr(10))"))} as defaulted,
        case when n > coalesce(max(lead), 0) and not coalesce(bool_or(odd), false) then '<s>' || {agg("'[' || r || ']' || c || '[/' || r || ']'")} end as strict from part group by conv_id, n),
    every as ({" union all ".join(f"select '{x}' as template, conv_id, n, {x} as t from o" for x in names)}),
    clean as (select template, conv_id, n, case when t = '' then [] else string_split(t, '') end as a from every where t is not null),
    pair as (select *, coalesce(lag(a) over (partition by template, conv_id order by n), []) as b from clean),
    begun as (select *, {differ.format("b", "a")} as s from pair where n > 0),
    rest as (select *, list_reverse(b[s + 1 :]) as y, list_reverse(a[s + 1 :]) as x from begun),
    step as (select template, conv_id, n, len(a) as size, s, len(b) as before, {differ.format("y", "x")} as tail from rest),
    found as (select template, conv_id, n, s, size - tail as e, n > 1 and s + tail < before as rewrites, last_value(size) over (partition by template, conv_id order by n rows between unbounded preceding and unbounded following) as n_chars,
        min(case when n > 1 and s + tail < before then s end) over (partition by template, conv_id order by n rows between 1 following and unbounded following) as changed from step),
    size as (select template, conv_id, max(n_chars) as n_chars from found group by template, conv_id),
    named as (select unnest([{", ".join(f"'{x}'" for x in names)}]) as template)
    select template, conv_id, turn, role, cast(case when changed is null or e <= changed then s end as integer) as start, cast(case when changed is null or e <= changed then e end as integer) as "end",
        coalesce(role = 'assistant', false) and there is not null as is_target, coalesce(rewrites, false) as rewrites, cast(coalesce(size.n_chars, 0) as integer) as n_chars,
        case when there is null then case when k <= lead then 'ValueError: no user turn' else 'ValueError: roles must alternate' end end as reason
    from (select *, k as n from named cross join led) l left join (select *, true as there, n as at from found) f using (template, conv_id, n) left join size using (template, conv_id)"""
