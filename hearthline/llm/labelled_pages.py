"""Labelled pages that the HTML extractor's weights are counted from: main text stands between <!--[--> and <!--]-->.

Layouts are written after those of common publishing systems: blogs, newspapers, documentation, forums, table layouts. Their parts come in several orders and under the names that such systems give them.
"""

from __future__ import annotations

_PARAGRAPHS = [
    "The council met on Monday to hear the plan for the old harbour and the people who live beside it.",
    "In the second hour the speakers turned to the cost, which had grown since the spring, and to the jobs it may bring to the town in the years after the last ship has gone.",
    "Nobody expects a vote before winter, a member said, but <a href='/x'>the report</a> is due in a few weeks.",
    "It is <em>not</em> the first time: <b>two plans</b> failed before,<br>and each left a hole in the budget that had to be filled by the county.",
    "We will read every letter.",
]
_LINKS = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in "Home News Sport Weather About Contact".split())
#: Names that publishing systems give to parts that aren't the article.
LINK_NAMES = "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar sidebar side widget share sharing social related recommended recommendations popular trending tags pagination pager skip toc contentinfo masthead header footer bottom".split()
TEXT_NAMES = "banner aside ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay copyright legal complementary paywall disclaimer".split()
FORM_NAMES = "subscribe subscription newsletter signup login search form".split()
COMMENT_NAMES = "comment comments commentlist comment-list reply replies respond response responses disqus discussion thread".split()
#: Names of the article, of its heading, and of what holds the whole page.
MAIN_NAMES = "article main content post entry story text body single post-content entry-content article-body story-body markdown-body mw-parser-output".split()
HEADING_NAMES = "entry-header post-header article-header headline title entry-title post-title".split()
WRAPPER_NAMES = "page wrap wrapper container site layout row col grid inner outer".split()


def _links(name: str) -> str:
    return f"<div class='{name}'><ul>{_LINKS}</ul></div>"


def _text(name: str) -> str:
    return f"<div class='{name}'><p>Read our offers today and save on all you buy here</p></div>"


def _form(name: str) -> str:
    return f"<div class='{name}'><form><label>Mail</label><input><button>Send</button></form><p>Your mail is safe with us</p></div>"


def _comments(name: str) -> str:
    return f"<div class='{name}'><h3>What readers say</h3><p>I was there that day and saw it all from the bridge</p><p>They should have asked us before</p></div>"


def _article(i: int) -> str:
    p = [f"<p>{t}</p>" for t in _PARAGRAPHS]
    rest = ["<h2>What comes next</h2>", f"<blockquote>{_PARAGRAPHS[4]}</blockquote>", "<ul><li>Letters are open until May and all are read</li><li>Talks go on in June</li></ul>", "<table><tr><th>Year</th><td>1994</td></tr></table>", "<pre>a = b</pre>"]
    return p[0] + p[1 + i % 3] + rest[i % 5] + p[1 + (i + 1) % 3] + rest[(i + 2) % 5] + p[3]


def pages() -> list[str]:
    out = []
    parts = [(make, name) for make, names in ((_links, LINK_NAMES), (_text, TEXT_NAMES), (_form, FORM_NAMES), (_comments, COMMENT_NAMES)) for name in names]
    for i, (make, name) in enumerate(parts):
        part, main, heading, wrapper = make(name), MAIN_NAMES[i // 3 % len(MAIN_NAMES)], HEADING_NAMES[i // 7 % len(HEADING_NAMES)], WRAPPER_NAMES[i % len(WRAPPER_NAMES)]
        title, body = "<h1>Plan for the harbour</h1>", _article(i)
        own = [
            f"<article>[{title}{body}]</article>",
            f"<main>[{title}{body}]</main>",
            f"<div class='{main}'>[{title}{body}]</div>",
            f"<article><header class='{heading}'>[{title}</header><div class='{main}'>{body}]</div><footer>Filed under news</footer></article>",
            f"<div class='{heading}'>[{title}</div><div class='{main}'>{body}]</div>",
            f"<table><tr><td><a href='/a'>One</a> <a href='/b'>Two</a></td><td>[{title}{body}]</td></tr></table>",
            f"<section id='{main}'>[{title}{body}]</section>",
        ][i % 7].replace("[", "<!--[-->").replace("]", "<!--]-->")
        around = [f"{part}{own}", f"{own}{part}", f"{part}{own}{part}"][i % 3]
        head = "<html><head><meta charset='utf-8'><title>Harbour</title><style>p{margin:0}</style></head><body>"
        out.append(f"{head}<header><a href='/'>Daily Paper</a></header><nav><ul>{_LINKS}</ul></nav><div class='{wrapper}'>{around}</div>"
                   f"<aside><h3>More</h3><ul>{_LINKS}</ul></aside><footer><p>Printed here. All rights are kept by the paper.</p></footer></body></html>")
    return out
