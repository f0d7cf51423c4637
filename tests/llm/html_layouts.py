"""Layouts written by hand, apart from the training templates: (name, page, text wanted)."""

A = "Long before the harbour was built, boats were drawn up on the shingle and mended there through the winter months."
B = "In 1887 the town council voted, by nine to four, for a stone pier; work began in the spring of the next year."
C = "Visitors who walk out to the lighthouse today can still see iron rings set into the rocks at low tide."
D = "Most of the fleet has gone, yet three families keep to the old trade and sell their catch on the quay each morning."
T = "The old harbour and its boats"
ALL = f"{T} {A} {B} {C} {D}"
PS = f"<p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p>"
NAV = '<nav class="site-nav"><ul><li><a href="/">Home</a></li><li><a href="/travel">Travel</a></li><li><a href="/food">Food</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = '<footer class="site-footer"><p>&copy; 2023 The Coast Journal. All rights reserved.</p><a href="/terms">Terms</a> <a href="/privacy">Privacy</a></footer>'


def page(body: str, head: str = "<title>T</title>") -> str:
    return f"<!doctype html><html><head>{head}</head><body>{body}</body></html>"


LAYOUTS = [
    ("plain div", page(f"{NAV}<div><h1>{T}</h1>{PS}</div>{FOOT}"), ALL),
    ("div row col", page(f'{NAV}<div class="row"><div class="col-md-8"><h1>{T}</h1>{PS}</div></div>{FOOT}'), ALL),
    ("body itself", page(f"{NAV}<h1>{T}</h1>{PS}{FOOT}"), ALL),
    ("main with aside", page(f'{NAV}<main><h1>{T}</h1>{PS}</main><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten walks</a></li><li><a href="/2">Best pies</a></li></ul></aside>{FOOT}'), ALL),
    ("weblog", page(f'<div id="page"><header id="masthead"><a href="/">The Coast Journal</a><p>News from the shore</p></header>{NAV}<div id="content"><div class="post hentry"><h1 class="entry-title">{T}</h1><div class="entry-content">{PS}</div></div><div id="comments"><h3>2 responses</h3><ol class="commentlist"><li class="comment"><p>Lovely piece, thank you for writing about my home town.</p></li><li class="comment"><p>My grandfather was one of the nine who voted for it.</p></li></ol></div></div>{FOOT}</div>'), ALL),
    ("story with related", page(f'{NAV}<div class="story"><h1>{T}</h1>{PS}</div><section class="related-stories"><h2>Related</h2><ul><li><a href="/x">A pier for the people</a></li><li><a href="/y">The last lighthouse keeper</a></li></ul></section>{FOOT}'), ALL),
    ("cookie bar first", page(f'<div class="cookie-banner"><p>We use cookies to improve this site. By going on you accept them.</p><button>Accept</button></div>{NAV}<article><h1>{T}</h1>{PS}</article>{FOOT}'), ALL),
    ("advert inside", page(f'{NAV}<article><h1>{T}</h1><p>{A}</p><p>{B}</p><div class="ad-slot"><p>Buy two raincoats and get a third one free, this week only!</p></div><p>{C}</p><p>{D}</p></article>{FOOT}'), ALL),
    ("newsletter inside", page(f'{NAV}<article><h1>{T}</h1><p>{A}</p><p>{B}</p><form class="newsletter-signup"><label>Get our weekly letter</label><input type="email"><button>Join</button></form><p>{C}</p><p>{D}</p></article>{FOOT}'), ALL),
    ("table layout", page(f'<table><tr><td class="menu"><a href="/">Home</a><br><a href="/travel">Travel</a><br><a href="/food">Food</a></td><td><h1>{T}</h1>{PS}</td></tr></table>{FOOT}'), ALL),
    ("no head end", f"<html><head><title>x</title><body>{NAV}<article><h1>{T}</h1>{PS}</article>{FOOT}", ALL),
    ("unclosed paragraphs", page(f"{NAV}<div class=text><h1>{T}</h1><p>{A}<p>{B}<p>{C}<p>{D}</div>{FOOT}"), ALL),
    ("links in the text", page(f'{NAV}<article><h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C} <a href="/rings">More of the iron rings</a> in our archive.</p><p>{D}</p></article>{FOOT}'), f"{T} {A} {B} {C} More of the iron rings in our archive. {D}"),
    ("lists and quotes", page(f"{NAV}<main><h1>{T}</h1><p>{A}</p><ul><li>{B}</li><li>{C}</li></ul><blockquote>{D}</blockquote></main>{FOOT}"), ALL),
    ("words in values", page(f'{NAV}<article><h1>{T}</h1><p title="hidden sponsor ad">{A}</p><p data-type="ad-free">{B}</p><p>{C}</p><p>{D}</p></article>{FOOT}'), ALL),
    ("header in article", page(f'{NAV}<article><header><h1>{T}</h1></header>{PS}</article><div class="share-buttons"><a href="#">Share</a><a href="#">Tweet</a><a href="#">Mail</a></div>{FOOT}'), ALL),
    ("scripts and styles", page(f'<script>var a = "<p>no</p>";</script><style>p {{ margin: 0 }}</style>{NAV}<div class="container"><h1>{T}</h1>{PS}<script>track("x")</script></div>{FOOT}'), ALL),
    ("breadcrumb and pager", page(f'<div class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/travel">Travel</a></div><div class="main-content"><h1>{T}</h1>{PS}</div><div class="pagination"><a href="/1">1</a><a href="/2">2</a><a href="/3">Next</a></div>'), ALL),
    ("two wrappers and a rail", page(f'<div class="wrapper"><div class="inner">{NAV}<div class="left"><h1>{T}</h1>{PS}</div><div class="right-rail"><h4>Trending</h4><a href="/a">Storm warning</a><a href="/b">Ferry strike</a></div></div></div>{FOOT}'), ALL),
    ("login and search", page(f'<div class="topbar"><form action="/search"><input name=q><button>Search</button></form><a href="/login">Log in</a></div>{NAV}<section><h1>{T}</h1>{PS}</section>{FOOT}'), ALL),
    ("section articles", page(f"{NAV}<section id=s1><h1>{T}</h1><p>{A}</p></section><section id=s2><p>{B}</p><p>{C}</p></section><section id=s3><p>{D}</p></section>{FOOT}"), ALL),
    ("popup last", page(f'{NAV}<article>{"<h1>" + T + "</h1>"}{PS}</article>{FOOT}<div id="modal-overlay"><p>Wait! Before you go, take ten percent off your first order with us.</p></div>'), ALL),
    ("hidden part", page(f'{NAV}<div class="article"><h1>{T}</h1>{PS}<div style="display: none">This is only shown to machines and not to anyone who reads.</div></div>{FOOT}'), ALL),
    ("breaks for paragraphs", page(f"{NAV}<div><h1>{T}</h1>{A}<br><br>{B}<br><br>{C}<br><br>{D}</div>{FOOT}"), ALL),
]
