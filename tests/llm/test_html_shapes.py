"""Pages of common shapes against an independent parser: nothing of an article is lost to words of wrappers or broken tags."""

from html.parser import HTMLParser

import pytest

from strandline.llm import html_extract

BODY = "".join(f"<p>Paragraph {k} of the article has quite some words in it, to be long enough to count as text.</p>" for k in range(4))
SIDE = '<div class="sidebar"><p>Popular posts of this week</p><form><label>Search</label><input name="q"></form></div>'
COMMENTS = '<div class="comments"><article class="comment"><p>I disagree with all of this.</p></article></div>'

#: name: page, with the article's elements in an element that has the attribute data-article.
SHAPES = {
    "layout class": f'<body><div class="wrapper right-sidebar"><div class="text" data-article><h1>Title</h1>{BODY}</div>{SIDE}</div></body>',
    "layout class, no heading": f'<body><div class="wrapper right-sidebar"><div class="text" data-article>{BODY}</div>{SIDE}</div></body>',
    "state class": f'<body><article class="post comments-open" data-article><h1>Title</h1>{BODY}</article>{COMMENTS}</body>',
    "section on a social matter": f'<body><div data-article><h1>Town</h1>{BODY}<section id="social-history">{BODY}</section></div></body>',
    "page builder": f'<body><div class="elementor-widget elementor-widget-theme-post-content"><div data-article>{BODY}</div></div>{COMMENTS}</body>',
    "form around the page": f'<body><form id="aspnetForm" action="x"><input type="hidden"><div id="middle" data-article><h2>Title</h2>{BODY}</div><label>Your name</label><button>Send</button></form></body>',
    "data attributes": f'<body><div data-id="ad" data-class="comments" title="class=ad hidden" data-article>{BODY}</div></body>',
    "custom element before": f"<body><title-bar></title-bar><select-box></select-box><math-x></math-x><div data-article>{BODY}</div></body>",
    "apostrophe in a bare value": f"<body><div data-article><p data-x=it's>First words of the text</p>{BODY}</div></body>",
    "void svg": f'<body><svg class="icon" /><div data-article>{BODY}</div></body>',
    "quotes of the other kind": f"""<body><div data-article title='say "no"'><p title="it's > that">First words of the text</p>{BODY}</div></body>""",
    "short post with long comments": f'<body><div class="post" data-article><h1>Title</h1><p>A short text of just some words, no more.</p></div><div id="comments">{BODY}{BODY}</div></body>',
    "empty elements with slashes": f'<body><div class=a/><div data-article><h1>Title</h1>{BODY}<br/><p/></div></div></body>',
    "long related part": f'<body><main data-article><h1>Title</h1>{BODY}</main><div class="related"><p>More to read: a text about other things that goes on for quite some time.</p></div></body>',
}


class Reference(HTMLParser):
    """Text of headings and paragraphs in the marked element, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.open, self.inside, self.blocks = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("input", "br"):
            return
        self.open.append(tag)
        if any(k == "data-article" for k, _ in attrs):
            self.inside = len(self.open)
        if tag in ("p", "h1", "h2") and self.inside:
            self.blocks.append("")

    def handle_startendtag(self, tag, attrs):
        if tag not in ("svg", "br"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if self.inside and len(self.open) < self.inside:
            self.inside = None

    def handle_data(self, data):
        if self.inside and self.blocks:
            self.blocks[-1] += data


def reference(html):
    parser = Reference()
    parser.feed(html)
    return "\n".join(" ".join(b.split()) for b in parser.blocks if b.strip())


@pytest.mark.parametrize("name", SHAPES)
def test_page_shapes(name):
    found = html_extract.page_blocks(SHAPES[name])
    assert html_extract.text_under(found, html_extract.best_path(found)) == reference(SHAPES[name]) != ""


@pytest.mark.parametrize("page", ['<div>{}<p class="x>Last words</p></div>', "<div>{}<p title='x>Last words</p></div>", "<div>{}<p a=\"b\" c='>Last words</p></div>"])
def test_unclosed_quotes_leave_no_markup(page):
    found = html_extract.page_blocks(page.replace("{}", BODY))
    text = html_extract.text_under(found, html_extract.best_path(found))
    assert "<" not in text and "class" not in text and text.endswith("Last words") and text.count("\n") == 4


def test_pages_over_spark(spark):
    rows = [(k, f"https://h{k}.example/", page) for k, page in enumerate(SHAPES.values())] + [(99, None, None), (98, "https://h0.example/2", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extracted(frame).collect()}
    assert found.pop(99) == found.pop(98) == ""
    assert found == {k: reference(page) for k, page in enumerate(SHAPES.values())}
