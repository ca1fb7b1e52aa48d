import pytest

from spoor.llm.pages import extract_pages, main_text

LONG = "A plain sentence that goes on for a while, so that it counts as running text."

PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("just text", "just text"),
    ("<p>one&nbsp; two<br>three &amp; four</p>", "one two three & four"),
    (f"<nav><p>{LONG}</p></nav><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>{LONG}</footer>",
     f"Title\n\n{LONG}\n\nShort."),
    (f"<div class='ad'>Buy <div>now</div> {LONG}</div><main><p>{LONG}</p><aside>{LONG}</aside>"
     f"<section id=comments><p>{LONG}</p></section><p>End</p></main>", f"{LONG}\n\nEnd"),
    (f"<script>var t='</p><p>{LONG}';</script><style>p{{}}</style><!-- <p>{LONG} --><p>{LONG}", LONG),
    (f"<ul><li><a href='/a'>Home page</a><li><a href=/b>About</a></ul><p>{LONG}</p><p>{LONG}</p>",
     f"{LONG}\n\n{LONG}"),
    (f"<form><p>{LONG}</p><input><button>Go</button></form><p>{LONG}", LONG),
    (f"<nav><ul><li>open menu<article><p>{LONG}</p></article>", LONG),
    (f"<p class=notice>We use cookies<p>{LONG}</p>", LONG),
    (f"<article><p>&lt;b&gt; &#233;&#x41; a &lt; b {LONG}</p></article>", f"<b> éA a < b {LONG}"),
    (f"<p>a < b and c > d {LONG}</p>", f"a < b and c > d {LONG}"),
    (f"<div>{LONG}</div>" + "<div></div>" * 9 + "<div class=menu>x</div>" * 9 + "<div>tiny</div>", LONG),
    ("<article>" + "<p>x</p>" * 4000 + "</article>", "\n\n".join(["x"] * 4000)),
    ("<" * 5000, "<" * 5000),
    ("<a href='" * 2000, ""),
]


@pytest.mark.parametrize("number", range(len(PAGES) - 1))
def test_text(number):
    html, want = PAGES[number]
    assert main_text(html) == want


def test_broken_markup_ends():
    assert isinstance(main_text(PAGES[-1][0]), str)


def test_rows(spark):
    rows = [(i, "u", h, "x") for i, (h, _) in enumerate(PAGES[:8])] + [(None, None, None, None), (4, "u", PAGES[4][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in extract_pages(df).collect())
    want = sorted((str(i), main_text(h), len(main_text(h))) for i, _, h, _ in rows)
    assert got == want
    assert extract_pages(df.limit(0)).collect() == []


def test_window_sums_choose_with_and_without_an_article():
    menu = "<ul><li><a href=/a>Home page</a><li><a href=/b>About us</a></ul>"
    text = "".join(f"<p>{n} {LONG}</p>" for n in range(8))
    want = "\n\n".join(f"{n} {LONG}" for n in range(8))
    assert main_text(f"{menu}<div>{text}</div>{menu}") == want
    # A teaser of an eighth of the text does not stand for the page, nor does a menu in it.
    far = "<div class=ad>x</div>" * 9
    assert main_text(f"<div>{text}</div>{far}<article><p>Card. {LONG}</p></article>") == want
    assert main_text(f"<main>{menu}<div>{text}</div></main>") == want


@pytest.mark.parametrize("html, want", [
    (f'<div class="content has-sidebar"><p>{LONG}</p></div>', LONG),
    (f'<article><div class="social-science"><p>{LONG}</p></div></article>', LONG),
    (f'<div class="sidebar-left main-nav">{LONG}</div><p>One {LONG}</p>', f"One {LONG}"),
    (f"<div id='comments-list'>{LONG}</div><div class='ad_slot_3'>{LONG}</div><p>One {LONG}</p>", f"One {LONG}"),
    (f"<form><article><p>{LONG}</p><p>{LONG}</p></article><input></form>", f"{LONG}\n\n{LONG}"),
    (f"<form><div>{LONG}</div><div>End</div></form><p>x</p>", f"{LONG}\n\nEnd\n\nx"),
    (f"<datalist><option>A<option>B</datalist><p>{LONG}</p>", LONG),
    (f"<object data=x><p>{LONG}</p>", LONG), (f"<title>T<body><p>{LONG}</p>", LONG),
    (f"<title>T</title><select><option>A</select><p>{LONG}</p>", LONG),
    (f"<object><p>Fallback</p></object><p>{LONG}</p>", LONG),
    (f"<article><p>{LONG}</p><p><a href=/x>Linked words</a></p><p>{LONG}</p></article>",
     f"{LONG}\n\nLinked words\n\n{LONG}"),
    (f"<div><p>{LONG}</p><p><a href=/x>Linked words</a></p><p>{LONG}</p></div>",
     f"{LONG}\n\nLinked words\n\n{LONG}"),
    (f"<p><a href=#m>Skip to content</a></p><div>{LONG}</div>", LONG),
    ("<article>" + f"<p>{LONG}</p>" * 8 + "<div class=ad>x</div>" * 7 + "<p>The end.</p></article>",
     "\n\n".join([LONG] * 8 + ["The end."])),
])
def test_main_text_is_not_lost(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize("tag", ["<svg/>", "<canvas/>", "<object>", "<option>", "<title>", "<svg>",
                                 "<form>", "<fieldset></fieldset>"])
def test_time_is_linear_in_tags(tag):
    import time

    start = time.process_time()
    main_text(tag * 40_000)
    assert time.process_time() - start < 6


def test_kept_lines_are_those_of_window_sums():
    """Against a plain reading of the sums, line by line."""
    import random

    from spoor.llm.pages import LINKS, SHARE, SURGE, WINDOW, kept_lines

    rng = random.Random(3)
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(0, 60)):
            size = rng.choice([0, 0, 0, 5, 30, 200])
            lines.append(("x" * size, size if rng.random() < 0.2 else 0, 0))
        size = [0 if n > LINKS * max(len(t), 1) else len(t) for t, n, _ in lines]
        half = WINDOW // 2
        sums = [sum(size[max(0, i - half) : i + half + 1]) for i in range(len(lines))]
        regions, run = [], []
        for i in range(len(lines) + 1):
            if i < len(lines) and sums[i]:
                run.append(i)
            elif run:
                regions.append(run)
                run = []
        totals = [sum(size[i] for i in r) for r in regions]
        want = [
            lines[i][0] for r, total in zip(regions, totals)
            if total == max(totals) or max(sums[i] for i in r) >= SURGE and total >= SHARE * max(totals)
            for i in r if size[i]
        ]
        assert kept_lines(lines) == want
