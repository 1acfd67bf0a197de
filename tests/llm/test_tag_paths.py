import math
import random
import time

from emberlog.llm.tag_paths import PUNCTUATION, Page, extracted, main_text, selected, tags

PARAGRAPHS = ["The first paragraph of the article is long, with commas, and it ends here.",
              "Short one.", "A third paragraph &amp; more text follows; it has marks, too: yes!"]
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>
<body class="page"><header><h1>Site name</h1><p>A slogan, with a comma.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and we tell you so.</div><!-- <p>not this</p> -->
<div class="{wrap}"><article><h1>The heading</h1>{body}<form><p>Your mail, please.</p></form></article></div>
<aside><p>Sidebar text, which is long enough to look like content, or is it.</p></aside>
<div id="comments"><p>A reader's comment, long and full of marks, as they are!!!</p></div>
<div class="ad">Buy this, now.</div><footer>&copy; nobody, anywhere.</footer></body></html>"""


def page(body, wrap="wrap"):
    return PAGE.format(body=body, wrap=wrap)


def test_article_without_the_rest():
    text = main_text(page("".join(f"<p>{p}</p>" for p in PARAGRAPHS)))
    assert text == "\n\n".join(["The heading", *PARAGRAPHS]).replace("&amp;", "&")


def test_unclosed_and_nested_markup():
    body = "<p><b>Bold start, never closed.<br>After   a\nbreak.<p>Next, with <a href=x>a link</a> and <i>more</i>.<div><p>Deep, too.</div>"
    assert main_text(page(body)).split("\n\n") == [
        "The heading", "Bold start, never closed. After a break.", "Next, with a link and more.", "Deep, too."]


def test_without_article_element():
    text = "".join(f"<p>{p} {p} {p}</p>" for p in PARAGRAPHS)
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(30))
    html = f"<body><div><ul>{links}</ul></div><div><div>{text}</div></div><div><a href=x>more</a></div></body>"
    assert main_text(html).split("\n\n") == [f"{p} {p} {p}".replace("&amp;", "&") for p in PARAGRAPHS]


LONG = [f"{p} {p} {p}".replace("&amp;", "and") for p in PARAGRAPHS]


def blocks(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_heading_outside_the_body_div():
    body = f"<div>{blocks(*LONG)}</div>"
    menu = "<nav><a href='/'>Home</a></nav>"
    for html in (f"<body>{menu}<article><h1>Title</h1>{body}</article></body>",
                 f"<body>{menu}<main><h1>Title</h1><article>{body}</article></main></body>",
                 f"<body>{menu}<div><h1>Title</h1>{body}</div></body>",
                 f"<body>{menu}<h1>Ti<i>tle</i></h1>{body}</body>"):
        assert main_text(html).split("\n\n") == ["Title", *LONG], html


def test_unequal_sibling_sections():
    most, rest = LONG * 2, ["A last section, which is short, ends it."]
    for tag in ("section", "div"):
        html = f"<article><{tag}>{blocks(*most)}</{tag}><{tag}>{blocks(*rest)}</{tag}></article>"
        assert main_text(f"<body><nav>Menu</nav>{html}</body>").split("\n\n") == most + rest
    table = f"<p>Before.</p><table><tr><td>{blocks(*LONG)}</td></tr></table><p>After.</p>"
    assert main_text(f"<body><div>{table}</div></body>").split("\n\n") == ["Before.", *LONG, "After."]


def test_links_of_the_article_stay():
    items = "<ul><li><a href=/1>A source</a></li><li><a href=/2>Another source</a></li></ul>"
    html = f"<body><article>{blocks(*LONG)}{items}</article></body>"
    assert main_text(html).split("\n\n") == [*LONG, "A source", "Another source"]


def test_page_without_container():
    html = f"<ul><li><a href='/'>Home</a></li></ul><h1>Title</h1>{blocks(*LONG)}<p>Bye</p><footer>(c)</footer>"
    for page in (html, f"<html><body>{html}</body></html>"):
        assert main_text(page).split("\n\n") == ["Title", *LONG, "Bye"]


def test_odd_input():
    assert main_text("") == "" == main_text("<div></div>") == main_text("<script>a, b.</script>")
    assert main_text("just   text, no tags") == "just text, no tags"
    assert main_text("<p>a &lt;b&gt; &#233; &nbsp; c") == "a <b> é c"
    assert main_text("<!-- never closed <p>x</p>") == ""
    assert main_text("<p>1 < 2, and 3 > 2.</p>") == "1 < 2, and 3 > 2."
    assert len(main_text("<article>" + "<p>word, word.</p>" * 20_000 + "</article>").split("\n\n")) == 20_000
    assert main_text("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."


def test_every_page_has_a_row(rows):
    df = rows([(1, "u", page("<p>One, two.</p>"), "x"), (2, None, None, None), (None, "v", "", None), (1, "u", "<p>a.", None)],
              "page_id bigint, url string, html string, text string")
    got = sorted(((r["page_id"] or -1, r["text"], r["n_chars"]) for r in extracted(df).collect()))
    assert got == [(-1, "", 0), (1, "The heading\n\nOne, two.", 22), (1, "a.", 2), (2, "", 0)]
    assert extracted(rows([], "page_id bigint, url string, html string")).collect() == []


def test_names_and_styles_of_wrappers_leave_the_article_alone():
    six = [f"{t} {i}" for i in range(2) for t in LONG]
    want = ["Title", *six]
    body = f"<h1>Title</h1>{blocks(*six)}"
    side = "<div class='sidebar'><p>Some text beside it, not long.</p></div>"
    for attribute in ("style='overflow:hidden'", "title='hidden gems'", "class='layout with-sidebar'",
                      "class='no-sidebar'", "class='post comments-open'", "aria-label='Our search for water'",
                      "data-state='hidden'", "id='sidebar-layout' class='has-menu'", "hidden='until-found'"):
        for html in (f"<div {attribute}><article>{body}</article></div>", f"<article><div {attribute}>{body}</div></article>",
                     f"<div {attribute}>{body}</div>"):
            assert main_text(f"<body><nav>Menu</nav>{html}{side}</body>").split("\n\n") == want, (attribute, html)
    kept = f"<body><article><h1>Title</h1><p data-state='hidden'>{six[0]}</p>{blocks(*six[1:])}</article></body>"
    assert main_text(kept).split("\n\n") == want


def test_what_cannot_be_seen_goes():
    for attribute in ("hidden", "hidden=''", "style='display: none'", "style=visibility:hidden", "aria-hidden=true"):
        html = f"<body><article>{blocks(*LONG)}<div {attribute}>{blocks(LONG[0])}</div></article></body>"
        assert main_text(html).split("\n\n") == LONG, attribute


def test_header_notice_and_search_in_an_article():
    html = (f"<body><header><p>Site, with a slogan.</p></header><article><header><h1>Title</h1></header>{blocks(*LONG)}"
            f"<section id='search'>{blocks(LONG[0])}</section><p class='notice'>{LONG[2]}</p></article></body>")
    assert main_text(html).split("\n\n") == ["Title", *LONG, LONG[0], LONG[2]]


def test_comments_beside_the_article_go():
    comments = "".join(f"<div class='c{i}'><p>A reader says: this is long, it has marks, and it goes on.</p></div>" for i in range(4))
    for box in ("<div class='discussion'>", "<div id='comments'>", "<section class='comment-list'>", "<div class='x'>"):
        html = f"<body><article><h1>Title</h1>{blocks(*LONG)}</article>{box}{comments}</body>"
        assert main_text(html).split("\n\n") == ["Title", *LONG], box
    html = f"<body><div><h1>Title</h1>{blocks(*LONG)}<div class='discussion'>{comments}</div></div></body>"
    assert main_text(html).split("\n\n") == ["Title", *LONG]


def test_broken_pages_take_linear_time():
    for bit in ("<a ", "<![CDATA[", "<a title=\"", "<!-- ", "<a b='", "</", "<p class=x", "<? ", "<a '>\" "):
        began = time.process_time()
        main_text(bit * (1_000_000 // len(bit)))
        assert time.process_time() - began < 4, bit


def test_tags_are_told_from_text():
    page = "a < b <p x='>'>t</P ><!-- <i> --><![CDATA[<b>]]><!x><br/><a title=\"q>c<"
    assert [(page[s:e], closes, tag) for s, e, closes, tag, _ in tags(page)] == [
        ("<p x='>'>", False, "p"), ("</P >", True, "p"), ("<!-- <i> -->", False, None), ("<![CDATA[<b>]]>", False, None),
        ("<!x>", False, None), ("<br/>", False, "br"), ("<a title=\"q>", False, "a")]


def test_selection_equals_a_plain_version():
    """The ratios worked out node by node from the tag paths as texts."""
    rng = random.Random(3)
    for _ in range(150):
        html = "".join(rng.choice(["<div>", "<p>", "</p>", "</div>", "<ul><li>", "</ul>", "<a>", "</a>", "word ",
                                   "some longer text, with marks. ", "x " * 30 + "! "]) for _ in range(rng.randint(1, 60)))
        parsed = Page(html)
        texts = [(e, " ".join(t.split())) for e, t, _ in parsed.texts if t.strip()]

        def path(e):
            return (path(e.parent) if e.parent else "") + "/" + e.tag
        if not texts:
            continue
        fused = []
        sums = {}
        for e, t in texts:
            x = sums.setdefault(path(e), [0, 0, 0])
            x[0], x[1], x[2] = x[0] + 1, x[1] + len(t), x[2] + sum(1 for c in t if PUNCTUATION.match(c))
        ratios = [[sums[path(e)][k] / sums[path(e)][0] for e, _ in texts] for k in (1, 2)]
        if len(texts) >= 5:
            for k in (0, 1):
                weights = [[math.exp(-(i - j) ** 2 / 2) if abs(i - j) <= 2 else 0 for j in range(len(texts))]
                           for i in range(len(texts))]
                ratios[k] = [sum(w * r for w, r in zip(ws, ratios[k])) / sum(ws) for ws in weights]
        fused = [a * (b + 0.1) for a, b in zip(*ratios)]
        mean = sum(fused) / len(fused)
        bound = min(0.5 * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)), max(fused))
        got = selected(texts, 0.5)
        assert all(g == (f >= bound) or abs(f - bound) < 1e-9 * bound for g, f in zip(got, fused))
