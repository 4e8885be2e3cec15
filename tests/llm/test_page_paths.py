"""Pages whose marks mislead, a plain computation of the scores, and the test pages without their marks."""

import math
import random
import re

import pytest

from yardframe.llm import html_extraction
from yardframe.llm.html_extraction import HEADINGS, LOWER, PUNCTUATION, RAISE, SPREAD, THRESHOLD, PageReader, choose, main_text, void_marks

BODY = "<h1>A head</h1><p>A first paragraph, which is long enough, as it seems.</p><p>And a second one, with commas, and more text.</p>"
TEXT = "A head\n\nA first paragraph, which is long enough, as it seems.\n\nAnd a second one, with commas, and more text."
LONG = "".join(f"<p>Paragraph {i} has a good number of words, some commas, and an end.</p>" for i in range(5))


@pytest.mark.parametrize("page,text", [
    (f"<body><nav><a href=x>Home</a></nav><div class='content has-sidebar'>{BODY}</div><div class='sidebar'><p>Side.</p></div></body>", TEXT),
    (f"<body><form action=x><input type=hidden>{BODY}</form></body>", TEXT),
    (f"<body><div class='legal-text'>{BODY}</div></body>", TEXT),
    (f"<body><div class='post tag-search'>{BODY}</div></body>", TEXT),
    (f"<body><article>{BODY}</article><article class='comment'><p>I agree, in every point, as ever.</p></article></body>", TEXT),
    (f"<body><article>{BODY}<div id='comments'><article class='comment'><p>I agree, in every point.</p></article></div></article></body>", TEXT),
    (f"<body><div>{BODY}</div><footer>Foot.</footer>", TEXT),
    ("<article><p>One, two.</p><p>a <b then", "One, two.\n\na <b then"),
    ("a <b then", "a <b then"), ("a <b class='x", "a"), ("a <b", "a"), ("a </b then", "a"),
    (f"<body><article>{BODY}<table><tr><td>5</td><td>6</td></tr></table><ul><li>x</li></ul></article><div class=ad>Buy, now, or never, as it is cheap.</div>",
     TEXT + "\n\n5\n\n6\n\nx"),
    ("<body><article><p>Hm</p></article><div class=ad>Buy, now, or never, as it is cheap.</div>", "Hm"),
    ("<body><article><h1></h1></article><div class=ad>Buy, now.</div>", ""),
    (f"<body><form><article>{BODY}</article><input></form>", TEXT),
    (f"<body><article>{BODY}</article><form><p>Your name, please.</p></form><div class='cookie-notice'>We use cookies, as all do.</div>", TEXT),
])
def test_pages_with_misleading_marks(page, text):
    assert main_text(page) == text


def test_short_main_part_does_not_win():
    got = main_text(f"<body><main><p>Short.</p></main><div>{LONG}</div></body>")
    assert got.count("Paragraph") == 5


def brute_choose(blocks):
    """The rule of the module's docstring, block by block."""
    void = void_marks(blocks)
    low = [LOWER ** len([m for m in b.marks if m not in void]) for b in blocks]
    same = [[j for j, o in enumerate(blocks) if (o.path, low[j]) == (b.path, low[i])] for i, b in enumerate(blocks)]
    plain = [len(b.text) - min(b.link_chars, len(b.text)) for b in blocks]
    own = []
    for group in same:
        length = sum(len(blocks[j].text) for j in group)
        marks = sum(len(PUNCTUATION.findall(blocks[j].text)) for j in group)
        own.append(sum(plain[j] for j in group) * (1 + marks / (1 + length / 100)) / len(group))
    last = len(blocks) - 1
    near = [sum(own[min(max(i + d, 0), last)] * low[min(max(i + d, 0), last)] for d in range(-SPREAD, SPREAD + 1)) / (2 * SPREAD + 1) for i in range(last + 1)]
    score = [math.sqrt(own[i] * sum(near[j] for j in same[i]) / len(same[i])) * low[i] for i in range(last + 1)]
    weight = [plain[i] * low[i] for i in range(last + 1)]
    total = sum(weight)
    if not total:
        return []
    level = sum(s * w for s, w in zip(score, weight, strict=True)) / total
    share = sum(w for w, b in zip(weight, blocks, strict=True) if b.article) / total
    keep = []
    for i, b in enumerate(blocks):
        linked = 1 - sum(plain[j] for j in same[i]) / sum(len(blocks[j].text) for j in same[i])
        raised = score[i] * (RAISE if b.article else 1 - share)
        keep.append([raised > 0 and raised >= THRESHOLD * level and (b.article or linked <= 0.5), linked])
    for i in range(last - 1, -1, -1):
        b = blocks[i]
        if b.tag in HEADINGS and low[i] == 1 and (b.article or keep[i][1] <= 0.5) and keep[i + 1][0] and b.article == blocks[i + 1].article:
            keep[i][0] = True
    return [b for b, k in zip(blocks, keep, strict=True) if k[0]]


def random_page(seed):
    rnd = random.Random(seed)

    def words(most):
        return " ".join(rnd.choice(["word", "and,", "so.", "longer-word", "a", "&amp;"]) for _ in range(rnd.randint(0, most)))

    def part(depth):
        kind = rnd.choice(["p", "div", "ul", "h2", "a", "article", "form", "section", "td"])
        names = rnd.choice(["", "", "", " class=ad", " class='post'", " id=sidebar", " class='has-menu x'", " class=comments"])
        inner = "".join(part(depth - 1) for _ in range(rnd.randint(1, 4))) if depth and kind in ("div", "section", "article", "form") else words(rnd.choice([3, 30, 90]))
        return f"<{kind}{names}>{inner}" + (f"</{kind}>" if rnd.random() < 0.9 else "")
    return "<body>" + "".join(part(3) for _ in range(rnd.randint(1, 6)))


def test_choice_equals_plain_computation():
    kept = 0
    for seed in range(300):
        blocks = PageReader().read(random_page(seed))
        got = [id(b) for b in choose(blocks)]
        assert got == [id(b) for b in brute_choose(blocks)], seed
        kept += 0 < len(got) < len(blocks)
    assert kept > 50


def test_pages_without_article_marks(spark):
    """The same text within 2 percent when `article` and `main` are plain `div`s: the ratios find it alone."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    marked = [html_extraction.main_text(r["html"]) for r in rows]
    plain = [html_extraction.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"] or "")) for r in rows]
    assert sum(abs(len(a) - len(b)) for a, b in zip(marked, plain, strict=True)) <= 0.02 * sum(map(len, marked))
