import random
import time

import numpy as np
import pytest

from importscape.llm import extract

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>'</script></head><body><nav><a href='/x'>menu</a></nav><div class=\"ad\">buy</div><article><h1>Head &amp; line</h1><p><b>First  \n para.<br><p>Second &lt;b&gt;</p><aside>side</aside><div class='comments'><p>me too</p></div></article><footer>&copy; f</footer></body></html>"


@pytest.mark.parametrize(
    "html,text",
    [
        (PAGE, "Head & line\n\nFirst para.\n\nSecond <b>"),
        (None, ""),
        ("", ""),
        ("plain &amp text", "plain & text"),
        ("<main><p>a</p><form>f<input name=q>g</form><p hidden>h</p>tail", "a\n\ntail"),
        ("<article>cut in a tag <p", "cut in a tag"),
        ("<article><p>x</p><!-- <p>no</p> --><p>y</article>z", "x\n\ny"),
        ("<div id='content'><header class=x>no<nav>n</nav></header><p>a<ul><li>1<li>2</ul></div><div id=sidebar>s</div>", "no\n\na\n\n1\n\n2"),
        ("<article><header><h1>T</h1></header><p>a &#233;&#x41;</p><div role=navigation>n</div></article>", "T\n\na éA"),
        ("<article><p>5 < 6 and <3</p></article>", "5 < 6 and <3"),
    ],
)
def test_blocks(html, text):
    assert "\n\n".join(b for _, b in extract.blocks(html)) == text


def test_suffix_runs_against_counting():
    rng = np.random.default_rng(1)
    pages = np.repeat(np.arange(12), 30)
    stream = rng.integers(0, 4, 360).astype(np.uint64)
    for run in (1, 2, 3, 5, 6):
        order, first, held = extract.suffix_runs(stream, pages, run)
        wanted = {}
        for i in range(360 - run + 1):
            if pages[i] == pages[i + run - 1]:
                wanted.setdefault(tuple(stream[i : i + run]), set()).add(pages[i])
        got = {tuple(stream[order[f] : order[f] + run]): h for f, h in zip(first, held, strict=True)}
        assert got == {k: len(v) for k, v in wanted.items()}


def test_repeated_runs_go_and_unique_ones_stay(spark):
    rows = [(i, f"http://h.example/{i}", f"<div>All rights reserved by the example company of example</div><div>story number {i} tells of {i * 7} things and of {i * 11} more</div>") for i in range(12)]
    rows += [(100, "http://other.example/", rows[0][2]), (101, None, None), (102, "http://h.example/a", PAGE)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    parsed = extract.parsed(pages, False).withColumn("row", extract.F.monotonically_increasing_id())
    for shard in (extract.SHARD_TOKENS, 40):
        bad = extract.boilerplate(extract.dealt(parsed, shard)).collect()
        assert {r.host for r in bad} == {"h.example"}
        assert {r.page_id: r.text for r in extract.main_text(pages, shard_tokens=shard).collect()}[3] == "story number 3 tells of 21 things and of 33 more"
    got = {r.page_id: r.text for r in extract.main_text(pages).collect()}
    assert got[3] == "story number 3 tells of 21 things and of 33 more"
    assert got[100].startswith("All rights") and got[101] == "" and got[102].startswith("Head & line")
    assert len(got) == 15
    assert extract.main_text(pages.where("false")).count() == 0


DEEP = "<article>" + "<div><span><b>" * 20000 + "deep" + "</i></em></p>" * 20000 + "</article>"


@pytest.mark.parametrize("html,text", [(DEEP, "deep"), ("<article><p>" + "word " * 200000 + "</article>", ("word " * 200000).strip()), ("<nav>" * 30000 + "</div>" * 30000 + "x", "")])
def test_long_and_deep_pages_take_time_in_proportion(html, text):
    began = time.time()
    assert "\n\n".join(b for _, b in extract.blocks(html)) == text
    assert time.time() - began < 5


def by_force(rows, run=extract.RUN, least=extract.PAGES):
    """The texts of pages (page_id, host, html), by looking every run of tokens up in every page of its host."""
    found = {i: extract.blocks(html) for i, _, html in rows}
    open_, host = {i: [b.split(" ") for kind, b in f if kind == extract.OPEN] for i, f in found.items()}, {i: h for i, h, _ in rows}
    grams = {i: {tuple(s[k : k + run]) for s in [sum(bs, [])] for k in range(len(s) - run + 1)} for i, bs in open_.items()}
    texts = {}
    for i, f in found.items():
        if f and f[0][0] == extract.ARTICLE:
            texts[i] = "\n\n".join(b for _, b in f)
            continue
        pages = [j for j in found if host[j] == host[i] and open_[j]]
        left = []
        for tokens in open_[i]:
            gone = set()
            for k in range(len(tokens) - run + 1):
                held = sum(tuple(tokens[k : k + run]) in grams[j] for j in pages)
                if held >= least:
                    gone |= set(range(k, k + run))
            left.append(" ".join(t for k, t in enumerate(tokens) if k not in gone))
        texts[i] = "\n\n".join(b for b in left if b)
    return texts


def test_whole_query_against_force_on_pages_with_and_without_an_article(spark):
    r = random.Random(3)
    word = lambda: r.choice(["sun", "moon", "star", "sea", "wind", "rain", "hill", "road"]) + str(r.randrange(40))
    notice, menu = " ".join(word() for _ in range(9)), " ".join(word() for _ in range(12))
    rows = []
    for i in range(60):
        body = "".join(f"<p>{' '.join(word() for _ in range(r.randint(3, 20)))}</p>" for _ in range(r.randint(1, 4)))
        around = f"<div>{menu}</div>{{}}<div>{notice} {word() if i % 2 else ''}</div>"
        rows.append((i, f"h{i % 3}", around.format(f"<article>{body}</article>" if i % 4 == 0 else f"<section>{body}</section>")))
    pages = spark.createDataFrame([(i, f"https://{h}/p{i}", html) for i, h, html in rows], "page_id long, url string, html string").repartition(4)
    wanted = by_force(rows)
    assert {r.page_id: r.text for r in extract.main_text(pages).collect()} == wanted
    assert not any(notice in t or menu in t for t in wanted.values())


def test_repetition_runs_over_marked_pages_too_and_the_check_follows(spark):
    menu, story = "all news of the day and of the night", "one story that every paper of the land has printed"
    page = lambda i, body: f"<nav>{menu}</nav><article><p>{body}</p></article><footer>number {i}</footer>"
    rows = [(i, "http://h.example/", page(i, story if i < 6 else f"own text of page {i} and {i * 7} words more")) for i in range(9)]
    rows += [(20, "http://h.example/", f"<div>{menu}</div><div>{story}</div>"), (21, "http://other.example/", f"<div>{menu}</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for shard in (extract.SHARD_TOKENS, 30):
        got = {r.page_id: (r.text, r.n_repeated, r.n_restored) for r in extract.main_text(pages, shard_tokens=shard).collect()}
        # the menu of a page without an article is known from pages with one; the story is not boilerplate, as articles hold it
        assert got[20] == (story, 9, 0) and got[21] == (menu, 0, 0)
        assert got[0] == (story, 9, 0) and got[8] == ("own text of page 8 and 56 words more", 9, 0)
    rows = [(i, "http://h.example/", f"<nav>{menu}</nav><article><p>{menu}</p><p>{i}</p></article>" if i == 0 else page(i, i)) for i in range(5)]
    got = {r.page_id: (r.text, r.n_repeated, r.n_restored) for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == (f"{menu}\n\n0", 18, 9) and got[1] == ("1", 9, 0)
