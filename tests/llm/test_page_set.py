"""Hand-written pages of many layouts, each with the text that a reader would call the article."""

import itertools
import random
import re
import time

import numpy as np
import pytest

from buildlens.llm import html_extract

LONG = "The ferry leaves the northern harbour twice a day and takes about forty minutes, longer when the tide is against it."
MORE = "Passengers with bicycles wait on the left, and the crew loads them last, so arrive early in the summer months."
THIRD = "Tickets are sold on board, in cash only, and the return journey costs less after six in the evening."

#: name, page, text
PAGES = [
    ("plain", f"<html><body><nav><a href=/>Home</a> <a href=/b>Boats</a></nav><article><h1>Ferries</h1><p>{LONG}</p><p>{MORE}</p></article><footer>&copy; 2023 Harbour</footer></body></html>", f"Ferries {LONG} {MORE}"),
    ("divs", f'<body><div class="menu"><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></div><div class="content"><h1>Ferries</h1><p>{LONG}</p><p>{THIRD}</p></div><div class="footer">All rights reserved</div></body>', f"Ferries {LONG} {THIRD}"),
    ("entities", f"<body><header><h1>Site</h1></header><main><p>Fish &amp; chips cost &lt;5&nbsp;&euro; here. {LONG}</p><p>{MORE}</p></main><footer>About us</footer></body>", f"Fish & chips cost <5 € here. {LONG} {MORE}"),
    ("whitespace", f"<body><article>\n <h1>  Two\n words </h1>\n<p>\t{LONG}\n\n</p>\n</article></body>", f"Two words {LONG}"),
    ("inline", f"<body><nav><a href=/>Home</a></nav><article><p>Some <b>bold</b> and <i>slanted</i> words, and a <a href=/l>link</a>. {LONG}</p></article></body>", f"Some bold and slanted words, and a link. {LONG}"),
    ("breaks", f"<body><article><p>{LONG}<br>{MORE}</p></article></body>", f"{LONG} {MORE}"),
    ("list", f"<body><article><h2>What to bring</h2><p>{LONG}</p><ul><li>A warm coat for the deck</li><li>Small coins for the meter</li></ul><p>{THIRD}</p></article><footer>Imprint</footer></body>", f"What to bring {LONG} A warm coat for the deck Small coins for the meter {THIRD}"),
    ("script", f"<body><article><p>{LONG}</p><script>var a = '<p>never</p>';</script><style>p {{ color: red }}</style><p>{MORE}</p></article></body>", f"{LONG} {MORE}"),
    ("sidebar", f'<body><article><h1>Ferries</h1><p>{LONG}</p><p>{MORE}</p></article><aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>Trains</a></li><li><a href=/2>Buses</a></li></ul></aside></body>', f"Ferries {LONG} {MORE}"),
    ("comments", f'<body><article><h1>Ferries</h1><p>{LONG}</p><p>{MORE}</p></article><section class="comments"><h3>2 comments</h3><div class="comment"><p>I took it last week and it was late.</p></div><div class="comment"><p>Same here, but the view is good.</p></div></section></body>', f"Ferries {LONG} {MORE}"),
    ("cookie", f'<body><div class="cookie-notice"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><article><h1>Ferries</h1><p>{LONG}</p><p>{MORE}</p></article></body>', f"Ferries {LONG} {MORE}"),
    ("advert inside", f'<body><article><p>{LONG}</p><div class="advert">Buy our new boots, half price this week only.</div><p>{MORE}</p></article></body>', f"{LONG} {MORE}"),
    ("form", f'<body><form class="search"><label>Search</label><input name=q><button>Go</button></form><article><h1>Ferries</h1><p>{LONG}</p><p>{THIRD}</p></article></body>', f"Ferries {LONG} {THIRD}"),
    ("unclosed", f"<body><nav><a href=/>Home</a></nav><article><h1>Ferries</h1><p>{LONG}<p>{MORE}<p>{THIRD}</article><footer>Imprint</footer></body>", f"Ferries {LONG} {MORE} {THIRD}"),
    ("upper case", f"<HTML><BODY><NAV><A HREF=/>Home</A></NAV><ARTICLE><H1>Ferries</H1><P>{LONG}</P><P>{MORE}</P></ARTICLE><FOOTER>Imprint</FOOTER></BODY></HTML>", f"Ferries {LONG} {MORE}"),
    ("table", f"<body><article><h1>Fares</h1><p>{LONG}</p><table><tr><td>Adult</td><td>Nine</td></tr><tr><td>Child</td><td>Four</td></tr></table><p>{THIRD}</p></article></body>", f"Fares {LONG} Adult Nine Child Four {THIRD}"),
    ("quote", f"<body><main><article><h1>Ferries</h1><p>{LONG}</p><blockquote><p>{MORE}</p></blockquote><p>{THIRD}</p></article></main><footer><p>Copyright</p></footer></body>", f"Ferries {LONG} {MORE} {THIRD}"),
    ("wrapped", f'<body><div id="wrapper"><div id="header"><a href=/>The Harbour Post</a></div><div id="nav"><a href=/a>A</a> | <a href=/b>B</a></div><div id="content"><h1>Ferries</h1><p>{LONG}</p><p>{MORE}</p><p>{THIRD}</p></div><div id="footer">Copyright 2020</div></div></body>', f"Ferries {LONG} {MORE} {THIRD}"),
    ("post", f'<body><header class="masthead"><div>The Harbour Post</div></header><div class="post"><h1>Ferries</h1><p>{LONG}</p><p>{MORE}</p><div class="share"><a href=/s>Share</a> <a href=/t>Send</a></div></div></body>', f"Ferries {LONG} {MORE}"),
    ("comment mark", f"<body><article><!-- <p>hidden</p> --><h1>Ferries</h1><p>{LONG}</p><p>{MORE}</p></article></body>", f"Ferries {LONG} {MORE}"),
    ("other script", "<body><nav><a href=/>首页</a></nav><article><h1>渡轮</h1><p>渡轮每天从北港出发两次，大约需要四十分钟，逆潮时更久。</p><p>携带自行车的乘客在左侧等候，船员最后装载。</p></article><footer>版权所有</footer></body>", "渡轮 渡轮每天从北港出发两次，大约需要四十分钟，逆潮时更久。 携带自行车的乘客在左侧等候，船员最后装载。"),
    ("no article", "<body><nav><a href=/>Home</a> <a href=/n>News</a></nav><footer>Copyright 2020</footer></body>", ""),
    ("templates", f"<body><nav><a href=/>Home</a></nav><article><h1>Ferries</h1><p>{LONG}</p><template><div><template><p>inner</p></template><p>rest of the outer one</p></div></template><p>{MORE}</p></article></body>", f"Ferries {LONG} {MORE}"),
    ("open template", f"<body><nav><a href=/>Home</a></nav><article><h1>Ferries</h1><div><template><p>shadow</div><p>{LONG}</p><p>{MORE}</p></article></body>", f"Ferries {LONG} {MORE}"),
    ("one paragraph", f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><p>{LONG}</p></article><footer>Imprint</footer></body>", LONG),
    ("attributes", f"<body><nav><a href=/>Home</a></nav><article data-x='a > b' class=\"story\"><h1 title='5 > 4'>Ferries</h1><p>{LONG}</p><p>{MORE}</p></article></body>", f"Ferries {LONG} {MORE}"),
]


@pytest.mark.parametrize("name, page, text", PAGES, ids=[p[0] for p in PAGES])
def test_page(name, page, text):
    assert html_extract.extract(page, html_extract.trained()) == text


def test_decoding_is_the_likeliest_of_all():
    """Against every consistent assignment of states to small trees."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 7))
        dom = html_extract.read_dom("")
        dom.parent = [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        p = rng.random(n)

        def allowed(state):
            # below what is cut all is cut; nothing outside is below what is inside; only what is below inside is cut
            return state[0] != 2 and all({0: (0, 1), 1: (1, 2), 2: (2,)}[state[dom.parent[i]]].__contains__(state[i]) for i in range(1, n))

        cost = lambda state: sum(np.log(p[i]) if s == 1 else np.log(1 - p[i]) for i, s in enumerate(state))
        best = max(cost(s) for s in itertools.product(range(3), repeat=n) if allowed(s))
        got = html_extract.decode(dom, p).tolist()
        assert allowed(got) and cost(got) == pytest.approx(best)


@pytest.mark.parametrize("tag", ["div", "p", "ul", "li", "template", "span", "td"])
def test_deep_nesting_costs_no_square(tag):
    began = time.process_time()
    dom = html_extract.read_dom(f"<{tag}>" * 100_000 + "deep" + f"</{tag}><td>" * 50_000 + "<li>x<svg/>" * 10_000)
    assert time.process_time() - began < 6 and len(dom.tag) == len(dom.end) > 1


def plain_nesting(page):
    """Open elements by lists that are searched each time."""
    names, out = ["html"], []
    scope = {"li": {"ul", "ol", "menu"}, "td": {"tr", "table"}, "tr": {"table"}}
    for closing, name in re.findall(r"<(/?)(\w+)>", page):
        if closing:
            if name in names[1:]:
                del names[len(names) - 1 - names[::-1].index(name) :]
            continue
        if name in html_extract.CLOSES_P and "p" in names:
            del names[len(names) - 1 - names[::-1].index("p") :]
        if name in scope:
            for k in range(len(names) - 1, 0, -1):
                if names[k] in ({"td", "th"} if name == "td" else {name}):
                    del names[k:]
                    break
                if names[k] in scope[name]:
                    break
        out.append(len(names))
        names.append(name)
    return out


def test_nesting_equals_searched_lists():
    rng = random.Random(4)
    for _ in range(500):
        page = "".join(f"<{rng.choice(['', '', '/'])}{rng.choice(['p', 'div', 'li', 'ul', 'td', 'tr', 'table', 'section'])}>" for _ in range(rng.randrange(25)))
        dom = html_extract.read_dom(page)
        depth = [0]
        for p in dom.parent[1:]:
            depth.append(depth[p] + 1)
        assert depth[1:] == plain_nesting(page), page
