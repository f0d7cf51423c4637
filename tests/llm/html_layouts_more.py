"""More layouts written by hand, before the model was changed: classes of containers that mention other parts, titles in boxes named header, legal lines."""

from html_layouts import A, ALL, B, C, D, FOOT, NAV, PS, T

E = "Beside the slipway stands a shed of tarred boards where sails were once cut, and where children now learn to tie knots."
LONG = f"<p>{A}</p><p>{B}</p><h2>After the pier</h2><p>{C}</p><p>{D}</p><p>{E}</p>"
LONG_ALL = f"{T} {A} {B} After the pier {C} {D} {E}"


def doc(body: str, body_class: str = "", lang: str = "en") -> str:
    return f'<!DOCTYPE html>\n<html lang="{lang}"><head><meta charset="utf-8"><title>x</title></head><body{f" class={chr(34)}{body_class}{chr(34)}" if body_class else ""}>{body}</body></html>'


PLAIN = f"<div><h1>{T}</h1>{PS}</div>"
LINKS = '<ul><li><a href="/1">Tide tables for the week</a></li><li><a href="/2">Where to eat crab</a></li><li><a href="/3">The ferry is late again</a></li></ul>'
NOTES = '<div class="comment"><b>Ann</b><p>My grandfather rowed one of these boats.</p></div><div class="comment"><b>Bob</b><p>Is the shed open at Easter?</p></div>'
MORE = [
    ("body has-footer", doc(f"{NAV}{PLAIN}{FOOT}", "home has-footer"), ALL),
    ("body no-comments", doc(f"{PLAIN}", "single no-comments"), ALL),
    ("body single-post has-sidebar", doc(f'{NAV}<div class="content">{PLAIN}</div><div class="sidebar">{LINKS}</div>{FOOT}', "single-post has-sidebar"), ALL),
    ("body right-sidebar", doc(f"<div class='wrap'><h1>{T}</h1>{PS}</div><aside>{LINKS}</aside>", "right-sidebar"), ALL),
    ("body ad-free", doc(f"<h1>{T}</h1>{PS}", "ad-free"), ALL),
    ("body page-template has-header", doc(f"<header><a href='/'>Coast</a></header><h1>{T}</h1>{PS}{FOOT}", "page-template has-header"), ALL),
    ("container content with-sidebar", doc(f'{NAV}<div class="content with-sidebar"><h1>{T}</h1>{LONG}</div>{FOOT}'), LONG_ALL),
    ("container content has-comments", doc(f'<div class="content has-comments"><h1>{T}</h1>{LONG}</div><div id="comments">{NOTES}</div>'), LONG_ALL),
    ("container post has-banner", doc(f'<div class="post has-banner"><h1>{T}</h1>{LONG}</div>{FOOT}'), LONG_ALL),
    ("container entry no-sidebar", doc(f'{NAV}<div class="entry no-sidebar"><h1>{T}</h1>{LONG}</div>'), LONG_ALL),
    ("article-header box", doc(f'{NAV}<article><div class="article-header"><h1>{T}</h1></div>{PS}</article>{FOOT}'), ALL),
    ("banner section title", doc(f'{NAV}<section class="banner"><h1>{T}</h1></section><div class="text">{PS}</div>{FOOT}'), ALL),
    ("entry-header and entry-footer", doc(f'<article class="post"><header class="entry-header"><h1 class="entry-title">{T}</h1></header><div class="entry-content">{PS}</div><footer class="entry-footer"><a href="/c">Travel</a> <a href="/t">Boats</a></footer></article>'), ALL),
    ("page-header title", doc(f'{NAV}<div class="container"><div class="page-header"><h1>{T}</h1></div><div class="page-content">{LONG}</div></div>{FOOT}'), LONG_ALL),
    ("hero with a standfirst", doc(f'{NAV}<main><div class="hero"><h1>{T}</h1><p>{E}</p></div>{PS}</main>{FOOT}'), f"{T} {E} {A} {B} {C} {D}"),
    ("legal line in a last cell", doc(f"<table><tr><td><h1>{T}</h1>{PS}</td></tr><tr><td>Copyright 1999 by the town of Porthaven. All rights reserved.</td></tr></table>"), ALL),
    ("german foot", doc(f'<div class="kopf"><a href="/">Start</a> <a href="/a">Archiv</a></div><div class="haupt"><h1>{T}</h1>{PS}</div><div class="fuss"><a href="/impressum">Impressum</a> <a href="/datenschutz">Datenschutz</a></div>', lang="de"), ALL),
    ("small legal paragraph", doc(f"{NAV}<div><h1>{T}</h1>{PS}</div><p><small>&copy; 2021 Coast Media Ltd. All rights reserved.</small></p>"), ALL),
    ("layout id columns", doc(f'<div id="layout" class="two-columns sidebar-right"><div id="col1"><h1>{T}</h1>{LONG}</div><div id="col2"><h4>Popular</h4>{LINKS}</div></div>'), LONG_ALL),
    ("drupal", doc(f'<div id="page-wrapper"><div id="header"><a href="/">Porthaven</a></div><div id="main-wrapper"><div id="main" class="clearfix"><div id="content" class="column"><h1 id="page-title">{T}</h1><div class="region region-content"><div class="node node-story"><div class="content">{PS}</div></div></div></div><div id="sidebar-first" class="sidebar">{LINKS}</div></div></div><div id="footer">Porthaven town council, 2 Quay Street</div></div>', "html not-front not-logged-in one-sidebar sidebar-first page-node"), ALL),
    ("wordpress body", doc(f'<div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Coast</a></p>{NAV}</header><div id="primary" class="content-area"><main id="main"><article class="post type-post has-post-thumbnail"><h1 class="entry-title">{T}</h1><div class="entry-content">{LONG}</div></article></main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2>{LINKS}</section></aside>{FOOT}</div>', "post-template-default single single-post postid-7 logged-in admin-bar has-sidebar has-header-image footer-widgets"), LONG_ALL),
    ("bootstrap", doc(f'<nav class="navbar navbar-light"><a class="navbar-brand" href="/">Coast</a><a href="/a">Archive</a></nav><div class="container-fluid"><div class="row"><div class="col-9 order-2 text-start"><h1>{T}</h1>{LONG}</div><div class="col-3"><div class="card"><div class="card-header">More</div>{LINKS}</div></div></div></div><footer class="footer mt-5">Made in Porthaven</footer>', "d-flex flex-column"), LONG_ALL),
    ("sticky header wrapper", doc(f'<div class="site with-sticky-header menu-open">{NAV}<div class="inner"><h1>{T}</h1>{PS}</div></div>{FOOT}'), ALL),
    ("magazine", doc(f'<div class="top-ad"><p>Raincoats at half price, today only!</p></div>{NAV}<div class="article-wrapper no-ads"><h1>{T}</h1>{LONG}<div class="author-box share"><a href="#">Share</a> <a href="#">Mail</a></div></div><div class="newsletter-box"><form><label>Our weekly letter</label><input><button>Join</button></form></div>{FOOT}'), LONG_ALL),
    ("comments form inside", doc(f'<div class="post-body with-comments"><h1>{T}</h1>{PS}<div class="comment-list">{NOTES}</div><form class="comment-form"><textarea></textarea><button>Send</button></form></div>'), ALL),
    ("cookie layer in body class", doc(f'<div class="consent-layer"><p>This site uses cookies. Please choose.</p><button>OK</button></div><div class="page">{NAV}<h1>{T}</h1>{PS}</div>', "cookie-notice-visible has-popup"), ALL),
    ("old frames of tables", doc(f'<table width="100%"><tr><td colspan="2"><a href="/">Home</a> | <a href="/map">Map</a> | <a href="/mail">Mail</a></td></tr><tr><td width="20%">{LINKS}</td><td width="80%"><h1>{T}</h1>{PS}</td></tr><tr><td colspan="2"><font size="1">&copy; 1998 Porthaven. All rights reserved.</font></td></tr></table>'), ALL),
    ("search results box", doc(f'<div class="search-box"><form><input name="q"><button>Go</button></form></div><div class="content no-search"><h1>{T}</h1>{LONG}</div><div class="pager"><a href="/p">Previous</a> <a href="/n">Next</a></div>'), LONG_ALL),
    ("headline in header with site name", doc(f'<header class="site-header"><h1>Coast</h1>{NAV}</header><article><header><h1>{T}</h1></header>{PS}</article>{FOOT}'), ALL),
    ("app shell", doc(f'<div id="root" class="app header-fixed footer-fixed"><div class="toolbar"><a href="/">Home</a><a href="/b">Boats</a></div><div class="view"><div class="prose"><h1>{T}</h1>{LONG}</div></div><div class="tabs"><a href="/1">Read</a><a href="/2">Watch</a></div></div>'), LONG_ALL),
    ("short body of many words in header class", doc(f'<div class="header-layout-2 footer-dark"><h1>{T}</h1>{PS}</div>{FOOT}'), ALL),
]
