"""Pages whose elements aren't closed."""

from __future__ import annotations

import pytest

from lodestone.llm import html_text

P = " ".join(f"word{k}" for k in range(50))


def _texts(page):
    return [b[0] for b in html_text.blocks(page)]


@pytest.mark.parametrize(
    "head",
    [
        "<head><title>x</title><body>", "<HEAD lang=en>\n<meta charset=utf-8><title>x</title><link rel=a href=b>\n", "<head><title>x</title></head>", "<head><style>p {}</style><script>'</head>'</script><!-- > --><title>a < b</title></head><body>",
        "<head><noscript><link href=x></noscript><body>", "<head><noscript><link href=x><body>", "<body><select>", "<body><noscript>", "<body><template>", "<body><iframe src=x>", "<body><textarea>", "<body><svg>", "<body><svg/>", "<body><![CDATA[>",
        "<body><select><svg><title>no</title><svg>no</svg></svg>", "<body><iframe src=x>", "<body><template>no<template>no</template>no</template>", "<body><textarea><script>no</textarea>",
    ],
)
def test_text_after_what_is_not_closed_is_kept(head):
    page = f"<html>{head}<p>{P}</p></body></html>"
    assert _texts(page) == [P]
    assert html_text.extract_text(page)[0] == P


@pytest.mark.parametrize("tag", ["select", "noscript", "template", "iframe", "textarea", "svg"])
def test_a_later_closed_element_takes_only_its_own(tag):
    assert _texts(f"<{tag}><p>{P}</p><{tag} id=x>no</{tag}><p>end</p>") == [P, "end"]


@pytest.mark.parametrize("start", ["<script>", "<style>", "<!--"])
def test_scripts_styles_and_comments_run_to_the_end(start):
    assert _texts(f"<p>{P}</p>{start}<p>no</p>") == [P]


def test_a_head_ends_at_what_cannot_be_in_it():
    assert _texts(f"<head><meta a=b><div>{P}</div><title>no</title></head><p>end</p>") == [P, "end"]


def test_many_tags_take_linear_time():
    for part in ("<select>", "<svg>", "<textarea>", "<head>", "<template></select>", "<head><title>"):
        html_text.blocks(part * 20_000)
