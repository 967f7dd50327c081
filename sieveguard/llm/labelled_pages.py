"""Hand-labelled pages that the content model of the extractor is trained on.

``data-y="1"`` marks an element whose text is content, ``data-y="0"`` one whose text is not; what
stands below inherits it. The attribute is no feature of the model.
"""

LONG = ("The committee met on Tuesday to weigh the plan, and after three hours it agreed that "
        "the bridge should be rebuilt before the winter floods return to the valley.")
MID = "Residents had asked for the change for years, and many spoke in favour of it."
SHORT = "A short remark closes the piece."


def _page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


def _links(n: int) -> str:
    return "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(n))


def _paragraphs(*texts: str) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


LABELLED_PAGES = [
    _page(f'<nav data-y="0"><ul>{_links(6)}</ul></nav><div class="ad" data-y="0">Buy two, get one '
          f'free today.</div><article data-y="1"><h1>Bridge to be rebuilt</h1>'
          f'{_paragraphs(LONG, MID, LONG, SHORT)}</article>'
          f'<footer data-y="0">&copy; Valley Post &middot; All rights reserved.</footer>'),
    _page(f'<header data-y="0"><a href="/">Home</a><nav><a href="/a">News</a> <a href="/b">Sport'
          f'</a></nav></header><main data-y="1"><article><h1>Flood plan</h1><p>{LONG}</p>'
          f'<h2>What is next</h2><p>{MID}</p><ul><li>First the old pillars are taken down.</li>'
          f'<li>Then new ones are set.</li></ul><p>{LONG}</p></article></main>'
          f'<aside class="sidebar" data-y="0"><h3>Most read</h3><ul>{_links(5)}</ul></aside>'
          f'<footer data-y="0"><p>Contact</p><p>Imprint</p></footer>'),
    _page(f'<div class="cookie-notice" data-y="0"><p>We use cookies to improve your visit. Please '
          f'accept them to go on.</p><button>Accept</button></div><div class="menu" data-y="0">'
          f'<a href="/1">One</a> <a href="/2">Two</a></div><div class="post"><h1 data-y="1">On '
          f'bread</h1><div class="entry-content" data-y="1">{_paragraphs(LONG, MID, LONG)}'
          f'<blockquote><p>{MID}</p></blockquote></div><div class="comments" data-y="0"><h3>3 '
          f'comments</h3><div class="comment"><p>{MID}</p></div><div class="comment"><p>I never '
          f'knew this, thank you for writing it down so well for all of us.</p></div></div></div>'
          f'<div class="footer" data-y="0">Powered by a press</div>'),
    _page(f'<article data-y="1"><h1>Weather</h1><p>{LONG}</p><div class="ad" data-y="0"><p>Our '
          f'partner offers fine umbrellas at half the price this week only.</p></div><p>{MID}</p>'
          f'<aside class="related" data-y="0"><p>Read also: <a href="/x">Rain in June</a></p>'
          f'</aside><p>{LONG}</p><form class="newsletter" data-y="0"><p>Sign up for our letter '
          f'and get the news each morning.</p><label>Mail</label></form></article>'
          f'<section id="comments" class="comments" data-y="0"><h2>Comments</h2>'
          f'<article class="comment"><p>{LONG}</p></article><article class="comment"><p>{MID}</p>'
          f'</article></section><footer data-y="0">&copy; 2020</footer>'),
    _page(f'<div id="header" class="header" data-y="0"><h1>The Gazette</h1><p>News for all</p></div>'
          f'<div id="content" class="content" data-y="1"><h2>Harvest</h2><p>{LONG}</p><p>{LONG}</p>'
          f'<table><tr><td>Wheat</td><td>40 tons</td></tr><tr><td>Rye</td><td>12 tons</td></tr>'
          f'</table><p>{MID}</p><pre>sum = 52</pre></div><div id="sidebar" class="sidebar widget" '
          f'data-y="0"><h3>Archive</h3><ul>{_links(8)}</ul><p>{MID}</p></div>'
          f'<div id="footer" class="footer" data-y="0"><p>Write to us at any time.</p></div>'),
    _page(f'<ul class="breadcrumb" data-y="0"><li><a href="/">Home</a></li><li><a href="/g">Garden'
          f'</a></li></ul><section class="article-body" data-y="1"><h1>Roses</h1>'
          f'{_paragraphs(LONG, SHORT, LONG, MID, LONG)}<figure><figcaption>A rose in May.'
          f'</figcaption></figure></section><div class="share social" data-y="0"><a href="#">Share'
          f'</a> <a href="#">Post</a></div><div class="tags" data-y="0"><a href="/t">garden</a>'
          f'</div><div class="promo banner" data-y="0"><p>Try the paper for four weeks at no cost '
          f'and cancel when you like.</p></div>'),
    _page(f'<div data-y="1"><h1>Plain page</h1><p>{LONG}</p><p>{MID}</p><p>{LONG}</p></div>'
          f'<div data-y="0"><a href="/prev">Back</a> | <a href="/next">Next</a></div>'),
    _page(f'<div class="notice alert" data-y="0"><p>This site will be down for repair on Sunday '
          f'from two to four in the morning.</p></div><main data-y="1"><h1>Notes</h1><p>{SHORT}</p>'
          f'<p>{LONG}</p><dl><dt>Pier</dt><dd>A pillar that holds a bridge.</dd></dl><p>{MID}</p>'
          f'</main><div class="login-form" data-y="0"><form><p>Log in to read more of our '
          f'stories.</p></form></div><nav class="pagination" data-y="0"><a href="/2">2</a></nav>'),
    _page(f'<article data-y="1"><header><h1>Long walk</h1></header><p>{LONG}</p><p>{MID}</p><p>'
          f'{LONG}</p><p>{SHORT}</p><footer data-y="0">Filed under <a href="/w">walks</a></footer>'
          f'</article><div class="reader-comments" data-y="0"><ol><li><p>{MID}</p></li><li><p>'
          f'{LONG}</p></li></ol></div><div class="advertisement sponsored" data-y="0"><p>Shoes '
          f'that last. Order them now and walk for ever in comfort.</p></div>'),
    _page(f'<table><tr><td class="nav" data-y="0"><a href="/1">One</a><br><a href="/2">Two</a></td>'
          f'<td data-y="1"><h1>Old style</h1><p>{LONG}</p><p>{LONG}</p><p>{MID}</p></td></tr></table>'
          f'<div class="copyright" data-y="0">Copyright by the makers of this page.</div>'),
    _page(f'<div class="popup modal subscribe" data-y="0"><p>Subscribe now and never miss a story '
          f'from your town.</p></div><div class="story main"><div class="text" data-y="1">'
          f'{_paragraphs(MID, LONG, MID, LONG)}</div><div class="related-posts" data-y="0"><h4>More '
          f'stories</h4><p><a href="/q">The old mill</a></p><p><a href="/r">The new mill</a></p>'
          f'</div></div>'),
    _page(f'<nav data-y="0"><ul>{_links(4)}</ul></nav><div class="ad" data-y="0">{MID}</div>'
          f'<article data-y="1"><h1>{SHORT}</h1><p>{SHORT}</p><p>Yes.</p><p>{MID}</p></article>'
          f'<footer data-y="0">&copy; m.site.example &middot; {MID}</footer>'),
    _page(f'<nav data-y="0"><ul>{_links(3)}</ul></nav><div class="ads" data-y="0">{SHORT}</div>'
          f'<article data-y="1"><h1>Small</h1><p>Short.</p></article>'
          f'<footer data-y="0">{SHORT}</footer>'),
    _page(f'<div id="top" class="navbar" data-y="0"><a href="/">Start</a></div><article data-y="1">'
          f'<h1>Ten rules</h1><p>{MID}</p><ol><li>Rise early and walk to the river.</li><li>{MID}'
          f'</li><li>Read one page.</li></ol><p>{LONG}</p><figure><figcaption>The river at dawn.'
          f'</figcaption></figure><dl><dt>Ford</dt><dd>A shallow place to cross.</dd></dl>'
          f'<div id="comments" class="comment-list" data-y="0"><article class="comment-body"><p>'
          f'{LONG}</p></article><article class="comment-body"><p>{MID}</p><p>{SHORT}</p></article>'
          f'</div></article><div class="site-footer" data-y="0"><p>{SHORT}</p></div>'),
    _page(f'<header class="site-header" data-y="0"><h1>The Herald</h1><p>Founded long ago</p></header>'
          f'<article data-y="1"><h1>Market day</h1><p>{LONG}</p><ul><li>{SHORT}</li><li>Apples sold '
          f'well.</li></ul><p>{MID}</p><figure><figcaption>Stalls in the square.</figcaption></figure>'
          f'<p>{LONG}</p></article><section class="comments" data-y="0"><h2>Comments</h2><ul>'
          f'<li class="comment"><p>{LONG}</p></li><li class="comment"><p>{MID}</p></li></ul><form>'
          f'<p>Leave a reply</p></form></section><aside data-y="0"><p>{MID}</p></aside>'
          f'<footer data-y="0"><p>{SHORT}</p></footer>'),
    _page(f'<div class="banner cookie consent" data-y="0"><p>{MID}</p></div><form data-y="0"><p>Search '
          f'the site</p></form><article data-y="1"><h1>Old songs</h1><p>{LONG}</p><p>{LONG}</p>'
          f'<aside class="ad" data-y="0"><p>{MID}</p></aside><p>{MID}</p></article><div class="comment '
          f'reader" data-y="0"><p>{LONG}</p></div><div class="comment" data-y="0">{MID}</div>'
          f'<div class="sidebar" data-y="0"><p>{LONG}</p></div><footer data-y="0">{MID}</footer>'),
]
