"""Main text: made pages whose article is known, the given pages with their marks taken away, and long pages."""
import collections
import os
import random
import re
import time

import pytest

from tidewatch.llm import html_extract as H

FOLDER = "/root/testdata/sf0.001"
STOP = "the of and to in that it was for on with as is his her not which were from had".split()


def sentence(rng, words):
    return " ".join(rng.choice(STOP) if rng.random() < 0.35 else "".join(rng.choices("bdfgklmnprst", k=rng.randint(3, 8)))
                    for _ in range(words)).capitalize() + "."


def made_page(rng, marked):
    """(html, the article's blocks) with menus, notices and comments around it."""
    paragraphs = [sentence(rng, rng.choice([3, 8, 25, 40, 70])) for _ in range(rng.randint(4, 9))]
    paragraphs[rng.randrange(len(paragraphs))] = sentence(rng, 60)
    heading = sentence(rng, 6)
    body = f"<h1>{heading}</h1>" + "".join(f"<p>{p.replace('the', '<b>the</b>', 1)}</p>" for p in paragraphs)
    menu = "<ul>" + "".join(f'<li><a href="/{i}">{sentence(rng, 2)}</a></li>' for i in range(6)) + "</ul>"
    if marked:
        page = f"<nav>{menu}</nav><div class='cookie-notice'>{sentence(rng, 30)}</div><article>{body}</article>" \
               f"<section id='comments'><p>{sentence(rng, 40)}</p></section><footer>{sentence(rng, 20)}</footer>"
    else:
        page = f"<div>{menu}</div><div>{body}</div><div>{menu}</div>"
    return f"<html><head><title>x</title><script>var a = '<p>no</p>';</script></head><body>{page}</body></html>", [heading, *paragraphs]


@pytest.mark.parametrize("seed", range(30))
def test_made_articles_are_found_whole(seed):
    page, want = made_page(random.Random(seed), True)
    assert H.main_text(page).split("\n") == want


def test_articles_without_a_mark_are_found_by_density():
    found = missed = extra = 0
    for seed in range(60):
        page, want = made_page(random.Random(seed), False)
        got = collections.Counter(H.main_text(page).split("\n"))
        want = collections.Counter(want)
        size = lambda blocks: sum(len(text) * n for text, n in blocks.items())
        found += size(want & got)
        missed += size(want - got)
        extra += size(got - want)
    assert found / (found + missed) > 0.95 and extra / found < 0.02


def blanked(page):
    page = re.sub(r"<(/?)(article|main|nav|aside|footer|header|section|form|menu)\b", r"<\1div", page)
    return re.sub(r'\s(class|id|role)="[^"]*"', "", page)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")
def test_given_pages_without_their_marks():
    import pyarrow.parquet as pq
    likeness, labels = [], collections.Counter()
    for page in pq.read_table(f"{FOLDER}/pages.parquet").column("html").to_pylist():
        if not page:
            continue
        want, got = (collections.Counter(H.main_text(text).split("\n")) for text in (page, blanked(page)))
        size = lambda blocks: sum(len(text) * n for text, n in blocks.items())
        likeness.append(2 * size(want & got) / max(1, size(want) + size(got)))
        found = H.blocks(page)
        has_article = any(b.article and not b.outside for b in found)
        labels.update(H.first_pass(b, has_article) for b in found if len(b.text) >= H.SHORT_CHARS and not b.outside)
    assert sum(likeness) / len(likeness) >= 0.9
    # Long blocks are decided by their stop words.
    assert labels[H.GOOD] > 0.8 * sum(labels.values())


def test_pages_of_one_block_and_linked_lines():
    assert H.main_text("<p>One short line.</p>") == "One short line."
    assert H.main_text("<body><div>Just this</div></body>") == "Just this"
    assert H.main_text("<article><p>See below.</p><p><a href='/x'>The whole line is a link</a></p></article>") == \
        "See below.\nThe whole line is a link"
    menu = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(5))
    text = sentence(random.Random(1), 40)
    assert H.main_text(f"<article><p>{text}</p><ul>{menu}</ul><p>{text}</p></article>") == f"{text}\n{text}"
    assert H.main_text("<nav><a href=x>a</a></nav><footer>b</footer>") == ""


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</q>" * 100_000, "<div>x" * 100_000 + "</div>" * 100_000,
                                  "<p>a" * 200_000, "<b>" * 200_000 + "x", "</div>" * 200_000, "<ul><li>" * 50_000,
                                  "<article>" + "<p>the words of a text</p>" * 50_000])
def test_long_pages_take_time_in_proportion(page):
    started = time.time()
    H.main_text(page)
    assert time.time() - started < 15
