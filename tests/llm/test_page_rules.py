"""Pages whose outcome each rule of the block classifier changes."""

import pytest

from ledgerlake.llm import pages

BODY = "The cat and the dog of the house that is in the street were with us for a day and it was as good as it has been."
CHINESE = "今天天气很好，我们去公园散步，看到了很多花和树，还有很多人在跑步和聊天，大家都觉得非常开心。"
RUSSIAN = "Сегодня мы гуляли по парку и видели много цветов и деревьев, а потом долго говорили о книгах и музыке у реки."


@pytest.mark.parametrize("text", ["Hello world", CHINESE, RUSSIAN, BODY, "x"])
def test_pages_without_an_article_keep_their_text(text):
    assert pages.main_text(f"<body><p>{text}</p></body>") == text
    assert pages.main_text(f"<html><nav><a href=x>Home</a></nav><div><p>{text}</p></div><footer>Imprint</footer></html>") == text


def test_links_decide_where_the_language_is_unknown():
    page = f"<body><div><a href=a>{RUSSIAN}</a></div><h2>Парк</h2><p>{RUSSIAN}</p><p>{CHINESE}</p></body>"
    assert pages.main_text(page) == f"Парк\n{RUSSIAN}\n{CHINESE}"
    assert pages.main_text(f"<body><p>{BODY}</p><p>{RUSSIAN}</p></body>") == BODY  # few stop words on a page of a known language


def test_boxes_inside_articles_go():
    page = f"""<article><h1>Title</h1><p>{BODY}</p>
    <section><h3>Discussion</h3><div class="comment">I liked it</div><div class="comment">Me too</div></section>
    <div><h3>You may also like</h3><ul><li><a href=1>One more</a></li><li><a href=2>And one</a></li></ul></div>
    <div>We use cookies to improve. Accept</div><h2>Part two</h2><p>Short end.</p></article>"""
    assert pages.main_text(page) == f"Title\n{BODY}\nPart two\nShort end."


def test_what_looks_like_boxes_stays():
    """One line of links, a heading with text after a furniture box, an article's own heading, a text about cookies."""
    about = "Cookies are small files that a site stores, and the law asks for consent to many of them."
    page = f"""<article><div><h1>Title</h1><aside>Ad</aside></div><p>{BODY}</p><p><a href=x>All of it a link</a></p><p>{about}</p>
    <section><h2>Results</h2><aside>Box</aside><p>Short.</p></section></article>"""
    assert pages.main_text(page) == f"Title\n{BODY}\nAll of it a link\n{about}\nResults\nShort."


def test_each_pass_changes_outcomes():
    """Without the second pass short blocks are lost, without the first everything outside furniture stays."""
    page = f"<body><p>Short head</p><p>{BODY}</p><p>{'<a href=x>tag</a> ' * 30}</p><p>Lorem ipsum {'dolor sit amet consectetur ' * 5}</p><p>last</p></body>"
    found = pages.blocks(page)
    first = [pages.first_pass(b) for b in found]
    assert first == [pages.OPEN, pages.GOOD, pages.BAD, pages.BAD, pages.OPEN]
    assert pages.second_pass(first, found) == pages.kept(found) == [True, True, False, False, False]
