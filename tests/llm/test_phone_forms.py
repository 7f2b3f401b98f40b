"""Phone numbers without separators."""

from __future__ import annotations

import pytest

from lodestone.llm import pii


@pytest.mark.parametrize(
    "text, number",
    [
        ("+14155552671", "+14155552671"), ("phone: +4915112345678", "+4915112345678"), ("call (415)5552671 now", "(415)5552671"), ("tel 4155552671", "4155552671"), ("Mobile: 015112345678.", "015112345678"), ("+49 15112345678", "+49 15112345678"),
        ("+1(415)5552671", "+1(415)5552671"), ("fax 5552671, please", "5552671"),
        ("the number 4155552671 is large", None), ("order 4155552671", None), ("tel +123456", None), ("+1234567890123456", None), ("call 3,14159265", None), ("tel 123456", None), ("call x4155552671", None), ("call 4155552671.25", None),
    ],
)
def test_numbers_without_separators(text, number):
    assert [(k, text[a:b]) for k, a, b, _ in pii.spans(text)] == ([("phone", number)] if number else [])
