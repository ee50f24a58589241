"""What the surge and dive points decide, and what is kept between them."""

from ledgerlens.llm.html import extract_text

TEXT = "A sentence that is long enough to be the body of the page, and then some more of it."


def test_a_body_outside_of_articles_is_kept():
    cards = "".join(f"<article><h3><a href={i}>Card {i}</a></h3></article>" for i in range(3))
    page = f"<body><div><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul>{cards}"
    assert extract_text(page).startswith(f"{TEXT}\n\n{TEXT}\n\n{TEXT}")


def test_hints_hold_for_articles():
    page = f"<body><div><p>{TEXT}</p><p>{TEXT}</p></div><article class=comment><p>{TEXT} Me too!</p></article>"
    assert extract_text(page) == f"{TEXT}\n\n{TEXT}"


def test_lines_of_links_are_kept():
    links = "".join(f"<li><a href={i}>Source {i}</a></li>" for i in range(4))
    sources = "\n\n".join(f"Source {i}" for i in range(4))
    for tag in ("article", "div"):
        body = f"<h1><a href=t>Title</a></h1><p>{TEXT}</p><ul>{links}</ul><p>{TEXT}</p><p><a href=n>Read on</a></p>"
        page = f"<body><ul>{links}</ul><{tag}>{body}</{tag}><ul>{links}</ul>"
        assert extract_text(page) == f"Title\n\n{TEXT}\n\n{sources}\n\n{TEXT}\n\nRead on"


def test_a_short_last_paragraph_is_kept():
    assert extract_text(f"<article><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p><p>Bye.</p></article>").endswith("\n\nBye.")


def test_end_tags_are_implied():
    assert extract_text("<article><p class=ad>Buy<p>Text</article>") == "Text"
    assert extract_text(f"<article><ul><li class=promo>Buy<li>{TEXT}</ul></article>") == TEXT
    assert extract_text(f"<article><dl><dt class=ad>Buy<dd>{TEXT}</dl></article>") == TEXT
    assert extract_text(f"<article><table><tr class=ad><td>Buy<tr><td class=ad>Now<td>{TEXT}</table></article>") == TEXT
    assert extract_text(f"<article><p class=ad>Buy<div>{TEXT}</div></article>") == TEXT
    nested = f"<article><ul><li class=promo>Buy<ul><li>more</ul><li>{TEXT}</ul></article>"
    assert extract_text(nested) == TEXT


def test_a_wrapper_is_no_extra():
    for name in ("layout has-sidebar", "content no-comments", "sidebar"):
        assert extract_text(f"<body><div class='{name}'><article><p>{TEXT}</p></article></div>") == TEXT
    page = f"<body><div class=widget><div><p>{TEXT}</p></div><div class=share>Share</div></div><div>ok</div>"
    assert extract_text(page).startswith(TEXT) and "Share" not in extract_text(page)
