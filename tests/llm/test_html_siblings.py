from seqloom.llm import html_extraction as hx


def test_children_of_long_lists_have_their_sibling_features():
    for size in (3, 49, 50, 400):
        nodes = hx.nodes_of(hx.parse("<div>" + "<p>a b c</p>" * (size - 1) + "<h2>d</h2></div>"))
        x = hx.features(nodes)[2:]
        assert len(x) == size
        assert [round(float(v) * size) for v in x[:, 10]] == [size - 1] * (size - 1) + [1]
        assert [round(float(v) * size) for v in x[:, 11]] == list(range(size))
