"""What of an article stays and what goes, alike at every length."""

import pytest

from tidemark.llm.html_extract import main_text

LONG = [" ".join(f"{k}{i}," for i in range(60)) for k in "ab"]
LENGTHS = [50, 139, 141, 2000]


def words(n):
    return ("A finding of some words, that was said here, " * (n // 40 + 1))[: n - 1].rstrip(" ,") + "."


def inside(part, wrap="<article>{}</article>"):
    body = wrap.format(f"<p>{LONG[0]}</p>{part}<p>{LONG[1]}</p>")
    return main_text(f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>Legal</footer></body></html>").split("\n\n")


@pytest.mark.parametrize("n", LENGTHS)
@pytest.mark.parametrize(
    "part",
    [
        "<p class='share-price'>{}</p>", "<section id='related-work'><h2>Related work</h2><p>{}</p></section>", "<p class='tags-explained'>{}</p>", "<div class='discussion'><p>{}</p></div>",
        "<p class='notice'>{}</p>", "<div class='content with-sidebar'><p>{}</p></div>", "<h2 id='comments'>{}</h2>", "<div class='widget'><p>{}</p></div>", "<div class='adventure'><p>{}</p></div>", "<div id='headers-explained'>{}</div>",
    ],
)
def test_parts_of_the_article_stay(n, part):
    text = words(n)
    assert inside(part.format(text)) == [LONG[0], *(["Related work"] if "related" in part else []), text, LONG[1]]


@pytest.mark.parametrize("n", LENGTHS)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div class='post'><div>{}</div></div>"])
@pytest.mark.parametrize(
    "part",
    [
        "<section class='comments'><div><b>Ann</b><p>{0}</p></div><div><b>Bob</b><p>{0}</p></div></section>", "<div id='comments'><p>{0}</p></div>", "<div class='cookie-notice'>{0}</div>", "<div class='advertisement'><p>{0}</p></div>",
        "<div class='newsletter'><p>{0}</p></div>", "<div class='related'><p>{0}</p></div>", "<div class='relatedPosts box-1'><p>{0}</p></div>", "<ol class='commentlist'><li><p>{0}</p></li></ol>", "<div class='ad'>{0}</div>",
        "<div class='discussion'><div><span class='author'>Ann</span><p>{0}</p></div><div><span class='author'>Bob</span><p>{0}</p></div></div>",
        "<div><div><time>1 May</time><p>{0}</p><a href=x>Reply</a></div><div><time>2 May</time><p>{0}</p><a href=x>Reply</a></div></div>",
        "<article class='comment'><p>{0}</p></article>", "<p class='tags'><a href=x>{0}</a></p>", "<ul class='share'><li><a href=x>{0}</a></li></ul>",
    ],
)
def test_comments_notices_and_adverts_go(n, wrap, part):
    assert inside(part.format(words(n)), wrap) == LONG


def test_a_name_around_the_whole_article_means_something_else():
    body = "".join(f"<p>{t}</p>" for t in LONG)
    assert main_text(f"<body><div class='notice'><div class='notice-body'>{body}</div></div></body>").split("\n\n") == LONG
    assert main_text(f"<body><div id='comments'>{body}<div class='ad'>Buy, now</div></div></body>").split("\n\n") == LONG
