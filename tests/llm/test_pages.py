"""Odd attributes, long pages and titles above the container."""

import time

from tidemark.llm.html_extract import main_text

LONG = [" ".join(f"{k}{i}," for i in range(60)) for k in "abc"]


def test_quotes_in_unquoted_values():
    assert main_text("<p title=don't>First paragraph</p>") == "First paragraph"
    assert main_text("<p title=don't>Hello, lost text here.</p><p class=it's>More text.</p>") == "Hello, lost text here.\n\nMore text."
    assert main_text("<p title = \"a > b\" data-x='<p>' checked>One</p><p =odd \"stray\">Two</p>") == "One\n\nTwo"
    assert main_text("<div hidden=''>no</div><p style=display:none>no<p>a <a href=/x/>link</a> b") == "a link b"
    assert main_text("a < b and <3, c<d>e") == "a < b and <3, ce"
    assert main_text('<p class="open>text</p><p id="x">more</p>') == "more"


def test_long_pages_take_linear_time():
    def page(n):
        return "<div><ul><li>" * n + "".join(f"<div><p>some words, and more {i}</p></b></section>" for i in range(n)) + "</div>" * n

    main_text(page(200))
    took = []
    for n in (4_000, 16_000):
        t = time.process_time()
        text = main_text(page(n))
        took.append(time.process_time() - t)
        assert text.count("some words") == n
    assert took[1] < 12 * took[0] and took[1] < 8
    nested = "<div class=related>text, " * 20_000
    t = time.process_time()
    assert main_text(nested).count("text,") > 19_900  # the innermost have too little text
    assert time.process_time() - t < 8
    assert len(nested) < 2_000_000 and len(main_text(f"<p>{'word, ' * 400_000}</p>")) == 2_399_999


def test_titles_above_the_container():
    body = "".join(f"<p>{t}</p>" for t in LONG)
    page = f"<body><nav>x</nav><h1>Old</h1><h1>Title</h1><div><div class=meta><a href=x>by me</a></div><div>{body}</div></div><div><h1>After</h1></div></body>"
    assert main_text(page).split("\n\n") == ["Title", *LONG]
    assert main_text(f"<body><h1>Site</h1><div><article><h1>Own</h1>{body}</article></div></body>").split("\n\n") == ["Own", *LONG]


def test_wrappers_named_widget():
    body = "".join(f"<p>{t}</p>" for t in LONG)
    assert main_text(f"<body><div class='post-widget'>{body}</div><div><p>Some text, of the foot, stays out</p></div></body>").split("\n\n") == LONG
