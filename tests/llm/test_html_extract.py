import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from govflow.llm import html_extract
from govflow.llm.html_extract import BAD, BRIEF, GOOD, NEAR, extract, second_pass

LONG = "The history of the town is long and it was written by many people who have lived there for all of their lives. " * 3


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy the best of it now</div><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p><b>First   part<br>second<p>Short.</p><div class="share-buttons">Share</div>
    <ul><li>one</li><li>two &#8212; &eacute;&nbsp;x</li></ul><form><p>Mail</p><input></form><table><tr><td>cell</td></tr></table>
    </article><section id="comments"><p>{LONG}</p></section><aside>Related</aside><footer>&copy; 2024</footer></body></html>"""
    assert extract(page) == "Head & line\nFirst part second\nShort.\none\ntwo — é x\ncell"


def test_pages_without_article_go_by_the_block_rules():
    page = f"<body><ul><li><a href=a>Start page</a></li><li><a href=b>About us</a></li></ul><h2>Title</h2><p>{LONG}</p><p>Brief one.</p><p>{LONG}</p><p>xqz vbn jkl mnp rst vwx qrs tuv wxy zab cde fgh ijk lmn opq rst uvw xyz abc def</p></body>"
    assert extract(page) == f"Title\n{LONG.strip()}\nBrief one.\n{LONG.strip()}"


def test_text_in_divs_beside_article_teasers():
    text = LONG.strip()
    page = f"<body><div>{LONG}</div><div>{LONG}</div><div><a href=m>More of the news of the day</a></div><article class=card><h3>Teaser</h3><p>Read on.</p></article><article class=card><p>Another one.</p></article></body>"
    assert extract(page) == f"{text}\n{text}"
    assert extract(f"<main><p>{LONG}</p></main><div>{LONG}</div><div>{LONG}</div>") == f"{text}\n{text}\n{text}"


def test_block_rules_inside_main():
    junk = "xqz vbn jkl mnp rst vwx qrs tuv wxy zab cde fgh ijk lmn opq rst uvw xyz abc def"
    page = f"<main><div>{junk}</div><div>{junk}</div><p><a href=a>All of the other news</a></p><h1>Title</h1><p>{LONG}</p><p>The end.</p><div>Go on: <a href=b>Mail</a> <a href=c>Print</a></div><p>{LONG}</p></main>"
    assert extract(page).split("\n")[-4:] == ["Title", LONG.strip(), "The end.", LONG.strip()]
    assert extract("<main><p>Short.</p><p>Brief.</p></main>") == "Short.\nBrief."


@pytest.mark.parametrize("name", ["post category-social", "post tag-ads", "post alert", "notices", "no-sidebar has-search"])
def test_marks_do_not_drop_articles_and_layouts(name):
    text = LONG.strip()
    body = f"<h2 id='form-validation'>Form</h2><p>{LONG}</p><h2 id=search>Search</h2><p>Brief one.</p><p>{LONG}</p>"
    assert extract(f"<body><article class='{name}'>{body}</article><footer>no</footer></body>") == f"Form\n{text}\nSearch\nBrief one.\n{text}"
    assert extract(f"<body><div class='{name}'>{body}</div></body>") == f"Form\n{text}\nSearch\nBrief one.\n{text}"


def test_marks_are_weighed():
    text = LONG.strip()
    assert extract(f"<article><p>{LONG}</p><section id='related-work'><h2>Related work</h2><p>Brief.</p></section></article>") == f"{text}\nRelated work\nBrief."
    assert extract(f"<article><p>{LONG}</p><section class=related><p>{LONG}</p><p>Brief.</p></section></article>") == f"{text}\n{text}"
    assert extract(f"<div><p>{LONG}</p><p>{LONG}</p><div class='site-notice'>A notice of the day</div><div class=shareButtons>Share it</div><p>{LONG}</p></div>") == f"{text}\n{text}\n{text}"
    assert extract("<article class=alert><p>Short.</p></article><footer>no</footer>") == "Short."
    assert extract(f"<article><p>{LONG}</p></article><div class=comments><p>{LONG}</p></div><article hidden><p>{LONG}</p></article>") == text


def test_self_closed_and_custom_elements_keep_what_follows():
    for empty in ("<svg class='i'/>", "<svg class=i/>", "<math/>", "<svg />", '<svg title="a>b" />'):
        assert extract(f"<article><p>one</p>{empty}<p>two</p><svg><text>no</text></svg><p>three</p></article>") == "one\ntwo\nthree"
    for name in ("button-group", "object-view", "title-bar", "svg-icon"):
        assert extract(f"<article><p>one</p><{name} a=b><p>two</p></{name}><p>three</p></article>") == "one\ntwo\nthree"
    assert extract("<article><p>one</p><script>x</script-y></script ><p>two</p><style\n>z</style><button/>no</button></article>") == "one\ntwo"


def test_second_pass():
    assert second_pass([BAD, BRIEF, BAD], [False] * 3) == [False] * 3
    assert second_pass([GOOD, BRIEF, GOOD], [False] * 3) == [True] * 3
    assert second_pass([BAD, NEAR, GOOD], [False] * 3) == [False, True, True]
    assert second_pass([BAD, BRIEF, GOOD], [False, True, False]) == [False, True, True]
    assert second_pass([GOOD, BRIEF, BRIEF, BRIEF, BAD], [False] * 5) == [True, True, True, False, False]
    assert second_pass([BRIEF], [False]) == [False] and second_pass([NEAR], [False]) == [True] and second_pass([], []) == []


@pytest.mark.parametrize("page", ["", None, "<", "<p", "</p>", "<!--", "<script>", "a < b > c", "<p title=\"x>y", "<article><p>a" * 500, "&#0; &#x110000; &unknown;", "<div>" * 3000 + "x"])
def test_broken_markup_does_not_fail(page):
    assert isinstance(extract(page), str)


def test_unclosed_and_nested_elements():
    assert extract("<article><p>a<p>b<div>c<nav><p>no</div>d</article>e") == "a\nb\nc\nd"
    assert extract("<article><header><h1>Kept</h1><p>by line</p></header><p>x</p></article>") == "Kept\nx"
    assert extract("<article><p>a<br><br>b<br/>c</p></article>") == "a\nb c"
    assert extract("<div class='sidebar-wrapper'><article><p>in</p></article></div>") == "in"
    assert extract("<article><p hidden>no</p><p style='display:none'>no</p><p class=post-body>yes</p></article>") == "yes"


def test_frames(spark):
    rows = [(1, "u", "<article><p>a b</p></article>"), (None, None, None), (2, "v", ""), (2, "v", ""), (3, "w", "<article>" + "<p>long é</p>" * 20_000)]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url): r for r in html_extract.extract_pages(pages).collect()}
    assert got[(1, "u")].text == "a b" and got[(None, None)].text == "" and got[(2, "v")].n_chars == 0
    assert got[(3, "w")].n_chars == 20_000 * 7 - 1 == len(got[(3, "w")].text)
    assert html_extract.extract_pages(pages.limit(0)).collect() == []


def test_second_pass_against_a_plain_search():
    rng = random.Random(4)
    for _ in range(400):
        labels = [rng.choice([GOOD, BAD, NEAR, BRIEF]) for _ in range(rng.randrange(0, 12))]
        headings = [rng.random() < 0.2 for _ in labels]
        want = []
        for i, x in enumerate(labels):
            # The nearest decided block on each side, the page's ends counting as bad ones farther than any.
            left = next(((labels[j], i - j) for j in range(i - 1, -1, -1) if labels[j] in (GOOD, BAD)), (BAD, len(labels) + i + 2))
            right = next(((labels[j], j - i) for j in range(i + 1, len(labels)) if labels[j] in (GOOD, BAD)), (BAD, 2 * len(labels) - i + 1))
            if x in (GOOD, BAD):
                want.append(x == GOOD)
            elif left[0] == right[0]:
                want.append(left[0] == GOOD or (x == NEAR and GOOD not in labels))
            else:
                want.append(x == NEAR or (right[0] if heading_goes_on(headings[i]) else min(left, right, key=lambda s: s[1])[0]) == GOOD)
        assert second_pass(labels, headings) == want, (labels, headings)


def heading_goes_on(heading):
    return heading


RUSSIAN = "В начале века город был небольшим, и в нём жили люди, которые не знали, что будет с ними и с их домами. Они работали на реке и на заводе, а по вечерам сидели у огня и говорили о том, что было в их жизни и чего не было. "
POLISH = "Miasto nie było duże, a ludzie, którzy w nim mieszkali, nie wiedzieli, co się z nimi stanie i co się stanie z ich domami. Pracowali na rzece i w fabryce, a wieczorem siedzieli przy ogniu i mówili o tym, co było w ich życiu i czego nie było. "
CHINESE = "这座城市历史悠久，许多人在这里生活了一辈子，他们在河边工作，晚上坐在火边谈论过去的日子和将来的打算。后来工厂建成了，年轻人纷纷离开家乡，只有老人还记得从前的街道和桥梁。"


@pytest.mark.parametrize("text", [RUSSIAN * 2, POLISH * 2, CHINESE * 3])
def test_pages_in_other_languages_keep_their_text(text):
    text = text.strip()
    menu = "<div><a href=a>Start</a> <a href=b>Kontakt</a></div>"
    page = f"<body>{menu}<div><p>{text}</p><p>{text}</p></div><div><p>{text}</p></div>{menu}<footer>2024</footer></body>"
    assert extract(page) == f"{text}\n{text}\n{text}"
    assert extract(f"<body>{menu}<p>{text}</p></body>") == text


def test_cells_and_links_between_paragraphs_stay():
    text, facts = LONG.strip(), "Population 12,345; area 45 km2; founded 1890; elevation 312 m; postcode 99423; phone 03643"
    assert extract(f"<body><p>{LONG}</p><table><tr><td>{facts}</td></tr></table><p>{LONG}</p></body>") == f"{text}\n{facts}\n{text}"
    assert extract(f"<article><p>{LONG}</p><p><a href=a>The whole story of the town</a></p><p>{LONG}</p></article>") == f"{text}\nThe whole story of the town\n{text}"


def test_forms_around_a_page():
    text = LONG.strip()
    assert extract(f"<body><form><nav><a href=a>Start</a></nav><div><p>{LONG}</p><p>Brief one.</p><p>{LONG}</p></div></form><footer>x</footer></body>") == f"{text}\nBrief one.\n{text}"
    assert extract(f"<body><p>{LONG}</p><form><p>{LONG}</p></form></body>") == text


def test_text_decides_in_and_beside_articles():
    text, junk = LONG.strip(), "xqz vbn jkl mnp rst vwx qrs tuv wxy zab cde fgh ijk lmn opq rst uvw xyz abc def"
    links = "<ul><li><a href=a>Other news of the day</a></li><li><a href=b>More of it</a></li></ul>"
    # Links at the end of an article go, a long text right beside it stays, a short one apart from it goes.
    assert extract(f"<article><p>{LONG}</p><p>{LONG}</p>{links}</article><footer>no</footer>") == f"{text}\n{text}"
    assert extract(f"<article><p>{LONG}</p><p>{LONG}</p></article><div>{LONG}</div>") == f"{text}\n{text}\n{text}"
    assert extract(f"<article><p>{LONG}</p><p>{LONG}</p></article><footer>no</footer><div>Short.</div>") == f"{text}\n{text}"
    # Noise in main goes, as it does without any.
    assert extract(f"<main><p>{LONG}</p><p>{LONG}</p><nav>x</nav><ul>{links}</ul><div>{junk}</div></main>") == f"{text}\n{text}"


class Plain(HTMLParser):
    """Blocks of well-formed pages as [text, linked, inside, outside, marked, heading]."""

    def __init__(self):
        super().__init__()
        self.stack, self.found, self.text, self.linked, self.link, self.heading = [], [], "", 0, False, False

    def flush(self):
        words = " ".join(self.text.split())
        if words:
            tags = [t for t, _ in self.stack]
            last = max((i for i, t in enumerate(tags) if t in ("article", "main")), default=-1)
            names = [n for _, n in self.stack[last + 1 :] if n]  # names around an article say nothing of it
            inside = 2 if "article" in tags else 1 if "main" in tags else 0
            self.found.append([words, self.linked, inside, any(t in ("nav", "aside", "footer") for t in tags), bool(names), self.heading])
        self.text, self.linked, self.heading = "", 0, False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
            return
        self.flush()
        if tag in ("p", "h2"):
            self.heading = tag == "h2"
        else:
            self.stack.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
            return
        self.flush()
        if tag not in ("p", "h2"):
            self.stack.pop()

    def handle_data(self, data):
        self.text += data
        self.linked += len(data) * self.link


def plain_extract(page):
    """The rules of the operator, one after the other, for English pages without forms; None for pages that are hardly English."""
    parser = Plain()
    parser.feed(page)
    rows = parser.found
    stops = set(html_extract.STOP_WORDS["en"].split())
    base, english, all_words = [], 0, 0
    for text, linked, *_ in rows:
        words = text.lower().replace(".", "").replace(",", "").split()
        share = sum(w in stops for w in words) / len(words)
        if len(text) >= 70 and linked <= 0.33 * len(text):
            all_words += len(words)
            english += len(words) * (share >= 0.15)
        if linked > 0.33 * len(text):
            base.append(-3)
        elif len(text) < 70:
            base.append(0)
        else:
            base.append((2 if len(text) > 200 else 1) + (2 if share >= 0.25 else 1 if share >= 0.15 else -2))
    if 4 * english < all_words:
        return None
    weight = Counter()
    for (text, linked, inside, outside, marked, _), e in zip(rows, base, strict=True):
        if not outside and not marked and linked <= 0.33 * len(text):
            weight[inside > 0] += len(text) * (3 if e >= 3 else 2 if e > 0 else 1)
    leads = weight[True] > 0 and weight[True] >= weight[False]
    names = any(not r[4] for r, e in zip(rows, base, strict=True) if not r[3] and (e > 0 or (leads and r[2] and e != -3)))
    kept = []
    for (text, _, inside, outside, marked, heading), e in zip(rows, base, strict=True):
        e -= 6 * outside + 4 * (marked and names and not heading)
        if leads:
            e += inside if inside else -3
        if not (e <= -2 and leads and inside and (outside or marked)):
            kept.append((text, heading, e))
    out = []
    for i, (text, heading, e) in enumerate(kept):
        sides = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(kept) and -2 < kept[j][2] < 3:
                j += step
            ends = not 0 <= j < len(kept)
            sides.append((False if ends else kept[j][2] >= 3, len(kept) + 1 + abs(j - i) if ends else abs(j - i)))
        (before, far_before), (after, far_after) = sides
        if e >= 3 or e <= -2:
            keep = e >= 3
        elif before == after:
            keep = before or (e > 0 and all(x[2] < 3 for x in kept))
        elif e != 0:
            keep = e > 0
        else:
            keep = after if heading else before if far_before <= far_after else after
        if keep:
            out.append(text)
    return "\n".join(out)


def test_whole_operator_against_a_plain_version():
    rng = random.Random(11)
    texts = [LONG, LONG[:112], "The end of it.", "Brief.", "qx vbn jkl mnp rst " * 5, "qx vbn jkl mnp rst " * 13, "The town of xqz vbn jkl mnp and rst vwx qrs tuv wxy zab cde fgh ijk lmn", "<a href=x>More of the news</a>", "<a href=x>Mail</a> or <a href=y>print it</a>"]

    def element(depth):
        if depth == 0 or rng.random() < 0.6:
            tag = rng.choice(["p", "p", "p", "h2"])
            return f"<{tag}>{rng.choice(texts)}</{tag}>"
        tag = rng.choice(["div", "div", "section", "article", "main", "nav", "aside", "footer", "div class=sidebar", "section class=comments"])
        return f"<{tag}>{''.join(element(depth - 1) for _ in range(rng.randrange(1, 5)))}</{tag.split()[0]}>"

    kept = 0
    for _ in range(1500):
        page = f"<body><p>{LONG}</p>{''.join(element(3) for _ in range(rng.randrange(1, 7)))}</body>"
        want = plain_extract(page)
        if want is not None:
            assert extract(page) == want, page
            kept += bool(want)
    assert kept > 1000
