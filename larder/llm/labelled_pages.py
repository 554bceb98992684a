"""Hand-labelled pages that the page model is trained on.

``data-keep`` marks an element whose text is main text, with all that it holds; ``data-drop`` marks what is not within
it.  The layouts differ on purpose: semantic tags, bare divs with classes, tables, and pages with neither.
"""

from __future__ import annotations

_LONG = (
    "The harbour opened again in spring, and the first boats left before dawn. Nobody had expected so many of them, "
    "least of all the keeper, who counted forty from the pier. By noon the market was full. People came from the hills "
    "to buy, to talk, and to hear what the winter had done to the coast."
)
_MID = "It took the crew three days to reach the strait, because the wind had turned. They waited, slept and mended nets."
_SHORT = "Then it rained."
_NAV = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Weather", "Contact"))
_LINES = (
    "The nets were dry by evening.",
    "He counted the boats once more, and then again.",
    "Nobody answered him; the wind was loud that day",
    "What was left of the pier stood in the water, black and bent.",
    "They sold salt, rope and dried fish from open carts",
)
_LINES_TEXT = "".join(f"<p>{x}</p>" for x in _LINES)
_PARAS = f"<p>{_LONG}</p><p>{_SHORT}</p><p>{_LINES[1]}</p><p>{_MID}</p><p>{_LINES[2]}</p><p>Indeed.</p>"
_MENU = f"<nav><ul>{_NAV}</ul></nav>"
_FOOT = "<footer>&copy; 2024 Harbour Press. All rights reserved. <a href='/i'>Imprint</a></footer>"
_FOOT_TEXT = "<footer>&copy; press.example &middot; The keeper wrote this line, and it stands under every page. So it does.</footer>"
_AD = '<div class="ad">Buy our ropes today, they last. Order now and save.</div>'
_AD_LONG = f'<div class="ad">{_MID}</div>'
_COMMENTS = (
    f'<section class="comments"><h3>Comments</h3><div class="comment"><p>I was there too. {_SHORT}</p></div>'
    f'<div class="comment"><p>{_MID}</p></div></section>'
)
_ASIDE = f'<aside><h2>Related</h2><ul><li><a href="/a">Boats of the north</a></li></ul><p>{_MID}</p></aside>'
_NOTICE = '<div class="cookie-notice"><p>We use cookies to improve this site. By using it you agree.</p><button>OK</button></div>'
_FORM = '<form action="/s"><label>Mail</label><input name="m"><p>Subscribe to our letter. It is free.</p><button>Send</button></form>'

LABELLED_PAGES = [
    f"<html><body>{_MENU}{_AD}<article data-keep><h1>Spring at the harbour</h1>{_PARAS}</article>{_FOOT}</body></html>",
    f"<html><head><title>Forty boats</title></head><body>{_MENU}{_AD_LONG}<article data-keep><h1>Forty boats</h1><p><b>{_LONG}<br><p>{_SHORT}</p>{_LINES_TEXT}</article>{_FOOT_TEXT}",
    f"<html><body><header><h1>Harbour Press</h1>{_MENU}</header><main data-keep><h1>The strait</h1>{_PARAS}"
    f"<ul><li>Nets</li><li>Ropes and sails.</li></ul></main>{_ASIDE}{_FOOT}</body></html>",
    f'<html><body>{_NOTICE}<div id="header">Harbour Press</div><div class="menu"><ul>{_NAV}</ul></div>'
    f'<div id="wrapper"><div class="content" data-keep><h2>Wind</h2>{_PARAS}<blockquote><p>{_MID}</p></blockquote></div>'
    f'<div class="sidebar"><h3>Popular</h3><p>{_MID}</p><ul>{_NAV}</ul></div></div><div class="footer"><p>All rights reserved.</p></div></body></html>',
    f"<html><body>{_MENU}<article data-keep><header><h1>Market day</h1></header>{_PARAS}<div data-drop class='share'>"
    f"<a href='/t'>Share</a> <a href='/f'>Print</a></div>{_COMMENTS.replace('<section', '<section data-drop', 1)}</article>{_FOOT}</body></html>",
    f"<html><body><header><p>Harbour Press, daily since 1902. A paper for the coast.</p></header>{_MENU}<main><article data-keep><h1>Nets</h1>"
    f"<p>{_MID}</p><figure><figcaption>The pier at noon.</figcaption></figure><p>{_LONG}</p>{_AD.replace('<div', '<div data-drop', 1)}<p>{_SHORT}</p>"
    f"</article>{_COMMENTS}{_ASIDE}</main>{_FORM}{_FOOT_TEXT}</body></html>",
    f"<html><body><div><div><ul>{_NAV}</ul></div><div data-keep><h1>Hills</h1>{_PARAS}<pre>net = rope * 2</pre></div>"
    f"<div><a href='/p'>Previous</a> <a href='/n'>Next</a></div></div></body></html>",
    f"<html><body data-keep><h1>Notes</h1><p>{_LONG}</p>{_LINES_TEXT}<p>{_MID}</p></body></html>",
    f"<div data-keep><p>{_MID}</p><p>{_SHORT}</p>{_LINES_TEXT}</div>",
    f"<html><head></head><body>{_MENU}{_AD}<article data-keep><h1>{_LINES[1]}</h1>{_LINES_TEXT}</article>{_FOOT_TEXT}</body></html>",
    f"<html><head></head><body>{_MENU}{_AD}<article data-keep><h1>Salt</h1><p>{_LINES[4]}</p></article>{_FOOT}</body></html>",
    f"<html><body><section><article data-keep><h2>Salt</h2><section><h3>Old ways</h3><p>{_LONG}</p></section><table><tr><th>Year</th>"
    f"<th>Boats</th></tr><tr><td>1902</td><td>Forty</td></tr></table><ol><li>{_MID}</li><li>Dry them.</li></ol><dl><dt>Keeper</dt>"
    f"<dd>Who minds the light.</dd></dl></article></section><aside class='sidebar'>{_MID}</aside><dialog><p>Sign in to read on.</p></dialog>"
    f"<div hidden><p>{_MID}</p></div>{_FOOT}</body></html>",
    f"<html><body><div role='banner'>Harbour</div><div role='navigation'><ul>{_NAV}</ul></div><div role='main' data-keep><h1>Light</h1>{_PARAS}"
    f"<address>The pier, coast road.</address></div><div role='complementary'><p>{_MID}</p></div><div role='contentinfo'><p>{_SHORT} {_MID}</p></div></body></html>",
    f"<html><body>{_MENU}{_NOTICE}<article data-keep><h1>Storm</h1>{_PARAS}<aside data-drop><p>{_MID}</p></aside><form data-drop><p>Vote for the best "
    f"boat of the year.</p><button>Vote</button></form><p>{_MID}</p><footer data-drop>Filed under <a href='/c'>coast</a></footer></article>{_COMMENTS}</body></html>",
    f"<html><body><article data-keep><h1>{_SHORT}</h1><p>To.</p><p>And so on</p><div>{_LONG}</div><details><summary>More</summary><p>{_MID}</p>"
    f"</details></article><menu>{_NAV}</menu><fieldset><p>{_SHORT}</p></fieldset></body></html>",
]
