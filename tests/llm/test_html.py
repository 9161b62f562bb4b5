import pytest

from gridloom.llm import html_text as h

ARTICLE = "<h1>A title</h1><p>First words of the <a href='/x'>linked</a> story &amp; more.</p><p>Second   part\n with <b>bold<br>text</p>"
TEXT = "A title First words of the linked story & more. Second part with bold text"


@pytest.mark.parametrize(
    "around",
    [
        "<html><body><nav><ul><li><a>Home</a><li><a>News</a></ul></nav><article>{}</article><footer>end</footer></body></html>",
        "<body><header><p>The site of many words and things</p></header><main>{}<div class='ad'>Buy this thing now</div></main><div class=sidebar><p>other words here</p></div>",
        "<div id=cookie-banner><p>We use cookies on this fine site, please agree</p></div><div class='post-body'>{}</div><section class=comments><p>What a great text, I like it very much indeed</p></section>",
        "<article>{}<form><label>Your mail</label><input><button>Send</button></form><aside><p>Related words</p></aside><script>var a='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --></article>",
    ],
)
def test_what_stands_around_goes(around):
    assert h.main_text(around.format(ARTICLE)) == TEXT


def test_markup_that_does_not_close():
    assert h.main_text("<article><p>One <b>two<p>three<p>four &lt;five&gt; &#x41;&#66;") == "One two three four <five> AB"
    assert h.main_text("<article><p>text <a href='broken") == "text"


@pytest.mark.parametrize("page", [None, "", "   ", "<html><head><title>t</title></head></html>", "<script>x", "<!-- never closed"])
def test_nothing(page):
    assert h.main_text(page) == ""


def test_plain_text_and_long_page():
    assert h.main_text("just words\n here") == "just words here"
    long = "<article>" + "<p>" + "</p><p>".join(f"word{k} and more" for k in range(20_000)) + "</p></article>"
    assert h.main_text(long).count("word") == 20_000


def test_labelled_pages_are_learned():
    """Held-out pages of the labelled kind: nearly every block is decided as labelled."""
    wrong = total = 0
    for page in h.labelled_pages(60, seed=99):
        html = "".join(p for p, _ in page)
        words = lambda y: sum(len(h.re.sub(r"<[^>]*>", " ", p).split()) for p, k in page if k == y)  # noqa: E731, B023
        got = len(h.main_text(html).split())
        total += words(True)
        wrong += abs(got - words(True))
    assert wrong / total < 0.05


def test_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", f"<article>{ARTICLE}</article>", "x")]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.n_chars for r in out)) == [0, 0, len(TEXT), len(TEXT)] and {r.text for r in out} == {"", TEXT}
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


NOISE = [
    "<div class='menu-main'><ul><li><a href=/a>Home page</a></li><li><a href=/b>Other page here</a></li></ul></div>", "<div class='col-md-4 sidebar'><h3>Popular</h3><p>Lots of side words that are not article at all, really many words</p></div>",
    "<div class='notice notice-info'><p>Please note that our site will be down on Monday for some maintenance work</p></div>", "<section id=comments><h2>3 comments</h2><div class=comment><p>I liked this article so much that I read it twice</p></div></section>",
    "<form action=/s><input name=q><label>Search the site</label><select><option>All things</option></select></form>", "<aside class=related><h3>Related</h3><ul><li>Other story one</li></ul></aside>", "<div class='ad-slot'><span>Sponsored message for you</span></div>",
    "<header><h2>The Daily</h2><p>news of the world every day</p></header>", "<footer class='site-footer'><p>Copyright 2024 by the company of many words all rights</p></footer>",
]


@pytest.mark.parametrize("noise", NOISE)
@pytest.mark.parametrize("around", ["{n}<article>{a}</article>{n}", "{n}<main>{a}</main>", "<div class=container>{n}<div class=content>{a}</div>{n}</div>", "{n}<div class='post-content'>{a}</div>{n}", "{n}<div>{a}</div>{n}", "<article>{a0}{n}{a1}</article>"])
def test_noise_before_after_and_inside(noise, around):
    head, rest = ARTICLE.split("</h1>")
    page = around.format(n=noise, a=ARTICLE, a0=head + "</h1>", a1=rest)
    assert h.main_text(f"<html><body>{page}</body></html>") == TEXT


def test_noise_inside_a_paragraph_leaves_the_paragraph():
    words = "The river rose in the night and the people of the town went up to the old mill to wait there. "
    for noise in ("ad", "share", "comment"):
        inside = f'{words}<b>bold <span class="{noise}">zzz</span></b>{words}'
        page = f"<html><body><div><p>{words * 3}</p><p>{inside} tail</p><p>{words * 3}</p></div></body></html>"
        found = h.main_text(page)
        assert found.count("old mill") == 8 and "tail" in found, noise


STORY = "".join(f"<p>{'The river rose in the night and the people of the town went up to the old mill to wait there. ' * 2}</p>" for _ in range(4))
TOLD = " ".join(["The river rose in the night and the people of the town went up to the old mill to wait there."] * 8)
MENU = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
END = "<footer><p>Copyright by the company</p></footer>"


@pytest.mark.parametrize(
    "page",
    [
        "<body><form id=aspnetForm>{m}<h1>Title</h1>{s}{e}</form></body>", "<body><form id=aspnetForm>{m}<div>{s}</div>{e}</form></body>", "<body><div class='has-sidebar'>{m}<h1>Title</h1>{s}{e}</div></body>", "<body><div class='has-sidebar'>{m}{s}{e}</div></body>",
        "<body class='post-template with-sidebar nav-open'>{m}<article>{s}</article>{e}</body>", "<body>{m}<main class='page page--news social-policy'>{s}</main>{e}</body>", "<body>{m}<div class='print-friendly article'><h1>Title</h1>{s}</div>{e}</body>",
        "<body>{m}<article class='alert-analysis'>{s}</article>{e}</body>", "<body>{m}<article><p title=don't></p>{s}</article>{e}</body>", "<body>{m}<article><p class=\"a\"\"></p>{s}</article>{e}</body>",
        "<html><head><title>t</title><meta charset=utf-8><link rel=x>{m}<article>{s}</article>{e}", "<head>{m}<div>{s}</div>{e}", "<body>{m}<article><svg><path d='M0'>{s}</article>{e}</body>", "<body>{m}<article><video src=x>{s}</article>{e}</body>", "<body>{m}<article><svg><g></g></svg>{s}</article>{e}</body>",
    ],
)
def test_what_holds_the_page_hides_nothing(page):
    found = h.main_text(page.format(m=MENU, s=STORY, e=END))
    assert found.removeprefix("Title ") == TOLD


def test_attributes_by_the_rules():
    def keys(tag):
        return next(v.keys for k, v in h.events_of(tag + "x") if k == "open")

    assert keys("<p class='a > b' id=c>") == ("p", ".a", ".b", ".c")
    assert keys('<p title=don\'t class="big box">') == ("p", ".big", ".box")
    assert keys('<p class="one"" id=two>') == ("p", ".one", ".two")
    assert keys("<P CLASS=Ad/>") == ("p", ".ad") and keys("<p = class=x>") == ("p", ".x")


def test_time_is_linear():
    import time

    start = time.perf_counter()
    for page in ("<div>" * 100_000 + "some words here", "<b>" * 50_000 + "x" + "</i>" * 50_000, "<p><b>" * 30_000 + "words", "<!--" + "<p>" * 100_000, '<p class="' * 20_000, "<" * 100_000, "<a b=" * 30_000, "<svg>" * 30_000 + "<p>text</p>" * 1000):
        h.main_text(page)
    assert time.perf_counter() - start < 20


def test_best_run_against_all_runs():
    rng = h.random.Random(4)
    for _ in range(400):
        gains = [(-rng.randrange(0, 6), rng.randrange(1, 8)) for _ in range(rng.randrange(0, 9))]
        sums = {(i, j): sum(b + o for b, o in gains[i:j]) - gains[i][0] for i in range(len(gains)) for j in range(i + 1, len(gains) + 1)}
        first, end = h.best_run(gains)
        assert max(sums.values(), default=0) == (sums[first, end] if gains else 0)
