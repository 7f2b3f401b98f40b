"""Templates that refuse, rewrite, add turns of their own or return no text."""

from __future__ import annotations

import pytest

from lodestone.llm import chat

TALK = [{"role": r, "content": c} for r, c in (("system", "s1"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"))]


def first_role(messages):
    return f"<{messages[0]['role']}>" + "".join(m["content"] for m in messages)


def changes_its_input(messages):
    for m in messages:
        m["content"] = m["content"].upper()
    return "".join(m["content"] for m in messages)


def test_a_template_that_looks_at_the_first_message():
    spans, whole = chat.trace(TALK, first_role)
    assert whole == "<system>s1u1a1u2" and [s[:2] for s in spans] == [(0, 10), (10, 12), (12, 14), (14, 16)]
    assert all(r is None for *_, r in spans) and chat.trace([], first_role) == ([], "")


def test_refused_prefixes_have_a_reason():
    spans, whole = chat.trace(TALK, chat.TEMPLATES["strict"])
    assert whole == "<s>[system]s1[/system][user]u1[/user][assistant]a1[/assistant][user]u2[/user]"
    assert spans[0] == (None, None, False, "ValueError: no user turn")
    assert whole[slice(*spans[1][:2])] == "<s>[system]s1[/system][user]u1[/user]" and whole[slice(*spans[3][:2])] == "[user]u2[/user]"
    twice = [*TALK[:2], TALK[1], TALK[2]]
    assert [r for *_, r in chat.trace(twice, chat.TEMPLATES["strict"])[0]] == ["ValueError: no user turn", None, "ValueError: roles must alternate", "ValueError: roles must alternate"]


@pytest.mark.parametrize("template, reason", [(lambda m: None, "NoneType is no text"), (lambda m: m[9]["content"], "IndexError: list index out of range"), (lambda m: 1 / 0, "ZeroDivisionError: division by zero")])
def test_templates_that_never_render(template, reason):
    assert chat.trace(TALK, template) == ([(None, None, False, reason)] * 4, "")


def test_what_a_template_does_to_its_input_stays_inside():
    talk = [dict(m) for m in TALK]
    spans, whole = chat.trace(talk, changes_its_input)
    assert talk == TALK and whole == "S1U1A1U2" and [s[:2] for s in spans] == [(0, 2), (2, 4), (4, 6), (6, 8)]


def test_default_turns_trimmed_contents_and_tools():
    own = chat.TEMPLATES["defaulted"]
    spans, whole = chat.trace([{"role": "user", "content": "  u \n"}, {"role": "tool", "content": "{x}"}], own)
    assert whole == "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>tool\n{x}<|im_end|>\n"
    assert [whole[a:b] for a, b, *_ in spans] == ["<|im_start|>user\nu<|im_end|>\n", "<|im_start|>tool\n{x}<|im_end|>\n"]
    spans, whole = chat.trace(TALK, own)
    assert not any(r for _, _, r, _ in spans) and "helpful" not in whole


def test_refusals_do_not_fail_the_job(spark):
    rows = [(1, k, m["role"], m["content"]) for k, m in enumerate(TALK)] + [(None, 1, "user", "x"), (None, 1, "user", "x"), (2, 1, None, None)]
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = chat.spans(talks, {"first": first_role, "never": lambda m: None}).collect()
    assert len(found) == 14 and all((r["start"] is None) == (r["reason"] is not None) for r in found)
    assert [r["n_chars"] for r in found if r["conv_id"] is None and r["template"] == "first"] == [7, 7]
