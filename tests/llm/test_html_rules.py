"""Main text of page shapes labelled by hand, and which rule decides how many blocks."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

from cadenza.llm import html_extract as H

PROSE = "The harbour was quiet in the morning and the boats that had come in at night were still at their moorings, so that there was not much to do for the men on the quay but to wait for the tide and for the fish that it would bring with it."
MORE = "When the tide came in at last it was late and most of them had gone, but those who had stayed were glad of it, for the catch was the best that they had seen in all the years they had been there."
MIDDLING = "It was not a day like the others, and there was more to come when the sun had gone down over the hills to the west of us."
NAMES = "Anker Bolle Crane Dorset Elbow Fender Gannet Hawser Isobar Jetty Keel Lanyard Mizzen Nadir Oakum Pintle Quoin Reeve"
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News of the day and of the week</a></li></ul>'
P = f"<p>{PROSE}</p>"

SHAPES = {
    "teaser article beside the text": (f'<div id="content"><h1>Harbour</h1>{P}<p>{MORE}</p></div><div class="more"><article><a href="/t">Teaser</a><p>short teaser text here</p></article></div>', f"Harbour\n{PROSE}\n{MORE}"),
    "user comments in an article": (f'<article>{P}<section class="user-comments"><p>{MORE}</p></section></article>', PROSE),
    "an advert unit": (f'<article>{P}<div class="ad-unit">{MORE}</div><p>{MORE}</p></article>', f"{PROSE}\n{MORE}"),
    "related stories": (f'<article>{P}<div id="related-stories"><p>{MORE}</p></div></article>', PROSE),
    "a share bar": (f'<article>{P}<div class="share-bar">Share this with all of your friends</div></article>', PROSE),
    "a cookie bar in main": (f'<main>{P}<div class="cookie-bar">We use cookies for the best of your visit and for ours.</div></main>', PROSE),
    "a menu beside middling text": (f'<div><a href="/">Home</a> <a href="/n">News</a></div><div><p>{MIDDLING}</p><p>Short one.</p>{P}</div>', f"{MIDDLING}\nShort one.\n{PROSE}"),
    "names that tell of a state": (f'<div class="layout has-sidebar"><article class="post comments-open">{P}</article></div>', PROSE),
    "a form around the page": (f'<form id="aspnetForm"><div>{MENU}</div><article>{P}</article></form>', PROSE),
    "no article at all": (f"<div>{MENU}</div><h2>Tides</h2>{P}<p>Short.</p><p>{MORE}</p><div>{MENU}</div>", f"Tides\n{PROSE}\nShort.\n{MORE}"),
    "few stop words in an article": (f"<article>{P}<p>{NAMES}</p><p>{MORE}</p></article>", f"{PROSE}\n{NAMES}\n{MORE}"),
    "few stop words outside": (f"{P}<p>{MORE}</p><div>{NAMES}</div>", f"{PROSE}\n{MORE}"),
    "a list of links in an article": (f'<article>{P}<p>Short one.</p><p><a href="/x">See all that was said of it before</a></p><p>Short two.</p><p>{MORE}</p></article>', f"{PROSE}\nShort one.\nShort two.\n{MORE}"),
    "an article of short lines": ("<nav>" + MENU + "</nav><article><h1>Tide</h1><p>The tide is in,</p><p>the tide is out.</p></article><footer>All rights reserved</footer>", "Tide\nThe tide is in,\nthe tide is out."),
    "only middling blocks": (f"<div>{MENU}</div><p>{MIDDLING}</p><p>{MIDDLING}</p>", f"{MIDDLING}\n{MIDDLING}"),
    "a sidebar without a name": (f"<article>{P}<p>{MORE}</p></article><div><p>{MIDDLING}</p></div>", f"{PROSE}\n{MORE}"),
    "a header inside an article": (f"<article><header><h1>Harbour</h1><p>By a hand</p></header>{P}</article>", f"Harbour\n{PROSE}"),
    "character references and space": (f"<article><p>{PROSE}</p><p>{MORE} A&amp;B\n  &lt;C&gt; &#233;</p></article>", f"{PROSE}\n{MORE} A&B <C> é"),
    "scripts, styles and templates": (f"<article><script>var a = '<p>no</p>';</script><style>p {{}}</style>{P}<template>{MORE}</template></article>", PROSE),
    "nothing but a menu": (f"<body>{MENU}</body>", ""),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_page_shapes(shape):
    page, want = SHAPES[shape]
    assert H.main_text(page)[0] == want


def test_a_very_long_page_is_read_whole():
    page = "<div>" + MENU + "</div>" + (P + "<p>Short.</p>") * 4000
    assert H.main_text(page)[0] == "\n".join([PROSE, "Short."] * 4000)


def test_density_and_neighbours_decide_most_blocks_of_the_pages():
    rules, kept = Counter(), 0
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        found = H.blocks(r["html"] or "")
        H.settle(found)
        rules.update(b.rule for b in found)
        kept += any(b.label == H.GOOD for b in found)
    assert kept > 200 and rules["article"] == 0
    assert rules["stop words"] > 300 and rules["neighbour"] > 1500
    assert rules["stop words"] + rules["length"] + rules["neighbour"] + rules["links"] > rules["element"] + rules["name"]
