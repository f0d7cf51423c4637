import difflib
import itertools
import random

import numpy as np
import pytest
from html_layouts import LAYOUTS
from html_layouts_more import MORE

from seqloom.llm import html_extraction as hx


@pytest.fixture(scope="module")
def model():
    return hx.train()


def test_layouts_outside_the_templates(model):
    right = 0
    for name, page, wanted in LAYOUTS + MORE:
        got = hx.extract([page], model)[0]
        same = sum(m.size for m in difflib.SequenceMatcher(None, got, wanted, autojunk=False).get_matching_blocks())
        assert same >= 0.95 * max(len(got), len(wanted)), (name, got)
        right += got == wanted
    assert len(LAYOUTS) >= 20 and len(MORE) >= 30 and right >= len(LAYOUTS + MORE) - 2


def test_classes_that_speak_of_other_parts():
    words = lambda c: hx.attribute_words(f' class="{c}"')
    assert words("post has-comments no-sidebar ad-free") == ["post"] and words("comments") == ["comments"] and words("site-header") == ["site", "header"]
    kinds = [*hx.KINDS]
    for share, named in ((1, True), (30, False)):
        nodes = hx.nodes_of(hx.parse(f"<body><div class=sidebar>{'text ' * share}</div><p>{'more ' * 10 if share == 1 else ''}</p></body>"))
        x = hx.features(nodes)[[n.tag for n in nodes].index("div")]
        assert x[-2 * len(kinds) + kinds.index("side")] == named


def test_features_and_trees_against_plain_ones():
    made, rng = hx.Templates(5), np.random.default_rng(5)
    nodes = hx.nodes_of(hx.parse(made.page().replace(" data-x", "")))
    x = hx.features(nodes)
    text = lambda n: 0 if n.tag in hx.UNSEEN and all(type(k) is str for k in n.kids) else sum((0 if n.tag in hx.UNSEEN else len(k.strip())) if type(k) is str else text(k) for k in n.kids)
    under = lambda n: 1 + sum(under(k) for k in n.kids if type(k) is not str)
    depth = lambda n: 0 if n.parent is None else 1 + depth(n.parent)
    for n, row in zip(nodes, x):
        kin = [k for k in n.parent.kids if type(k) is not str] if n.parent else []
        assert row[0] == min(30, depth(n)) and row[1] == pytest.approx(np.log1p(text(n)), rel=1e-5) and row[3] == pytest.approx(np.log1p(under(n)), rel=1e-5)
        if kin:
            assert row[13] == sum(type(k) is not str for k in n.kids) and row[9] == pytest.approx(np.log1p(len(kin)), rel=1e-5)
            assert row[11] == pytest.approx(kin.index(n) / len(kin), rel=1e-5) and row[12] == pytest.approx(text(n) / max(1, *map(text, kin)), rel=1e-5)
    a = rng.normal(size=(300, 4))
    y = (a[:, 0] > 0) ^ (a[:, 1] > 0.3)
    fit = hx.Boosted.fit(a, y.astype(float), rounds=12, depth=3)

    def walked(row):
        z = fit.bias
        for feature, cut, value in fit.trees:
            at = 0
            while feature[at] >= 0:
                at = 2 * at + 1 + (row[feature[at]] > cut[at])
            z += value[at]
        return z

    assert np.allclose(fit.log_odds(a), [walked(r) for r in a]) and ((fit.log_odds(a) > 0) == y).mean() > 0.95


def test_attributes():
    assert hx.attribute_words(' title="hidden sponsor ad" data-type="ad-free" class="mainBox big"') == ["main", "box", "big"]
    assert hx.attribute_words(" hidden") == ["hidden"] and hx.attribute_words(" style='x:y; display : none'") == ["hidden"]
    assert hx.attribute_words(" id=a-b role = 'Nav'") == ["a", "b", "nav"] and hx.attribute_words("/ =x") == []


def test_heads_without_ends_and_quotes_without_ends():
    text = lambda page: hx.text_of(hx.parse(page), set())
    assert text("<html><head><title>x</title><body><article>in</article>") == "in"
    assert text("<head><meta charset=x><p>in") == "in" and text("<head><script>a</script></head>in") == "in"
    assert text('<p>a <a title="it>b</a> c</p>') == "a b c" and text('<p>a <a title="it>b</a> <i class="x">c</i></p>') == "a b c"
    assert text('<p title="a > b">c</p><p title="1 < 2">d</p>') == "c d"
    assert text("<p " + 'x="' * 20_000 + ">end") in ("end", "")


def test_decoding_is_the_best_of_all_consistent_choices():
    rng, draw = random.Random(4), np.random.default_rng(4)
    for _ in range(60):
        nodes = [hx.Node("#root", [], None)]
        for _ in range(rng.randrange(1, 9)):
            up = rng.choice(nodes)
            up.kids.append(hx.Node("div", [], up))
            nodes = hx.nodes_of(nodes[0])
        z = draw.normal(0, 3, len(nodes))
        keep, cut = -np.logaddexp(0, z), -np.logaddexp(0, -z)
        place = {id(n): i for i, n in enumerate(nodes)}
        worth = []
        for choice in itertools.product((False, True), repeat=len(nodes) - 1):
            gone = (False, *choice)
            if all(gone[i] or not gone[place[id(n.parent)]] for i, n in enumerate(nodes) if n.parent is not None):
                worth.append((sum(cut[i] if g else keep[i] for i, g in enumerate(gone)), gone))
        got = hx.decode(nodes, z)
        mine = tuple(id(n) in got for n in nodes)
        assert sum(cut[i] if g else keep[i] for i, g in enumerate(mine)) == pytest.approx(max(worth)[0])


def test_very_long_page(model):
    page = "<nav><a href=/>Home</a></nav><article>" + "<p>some words of a long text</p>" * 30_000 + "</article>"
    assert hx.extract([page], model)[0] == " ".join(["some words of a long text"] * 30_000)
