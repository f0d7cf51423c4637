import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import html_extraction as hx


@pytest.fixture(scope="module")
def model():
    return hx.train()


def text(page):
    return hx.text_of(hx.parse(page), set())


def test_parsing():
    assert text("<p>a<p>b<b>c</b>d<br>e") == "a bcd e"
    assert text("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>") == "one two in three"
    assert text("x &amp; y&#233; &lt;b&gt;<!-- no --><script>if (a<b) {}</script>") == "x & y\u00e9 <b>"
    assert text("<p><b>open.<br><p>next</p></b>end") == "open. next end"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1 2 3"
    assert text("<div a='>'>t</div></p></div><p") == "t" and text("") == "" and text("plain  text") == "plain text"
    assert text("<style>p{}</style><title>no</title><textarea>no</textarea>yes") == "yes"


def test_nothing_is_kept_below_a_cut(model):
    made = hx.Templates(77)
    for _ in range(40):
        page = made.page().replace(" data-x", "")
        nodes = hx.nodes_of(hx.parse(page))
        cut = hx.decode(nodes, model.log_odds(hx.features(nodes)))
        assert all(id(n) in cut for n in nodes if n.parent is not None and id(n.parent) in cut)


def test_held_out_pages(model):
    made, right = hx.Templates(123), 0
    for _ in range(150):
        page = made.page()
        nodes = hx.nodes_of(tree := hx.parse(hx.re.sub(r"<(\w+) data-x ?", r'<\1 itemprop="zzmarked" ', page)))
        cut = set()
        for n in nodes:
            if "zzmarked" in n.words or n.parent is not None and id(n.parent) in cut:
                cut.add(id(n))
        right += hx.text_of(tree, cut) == hx.extract([page.replace(" data-x", "")], model)[0]
    assert right >= 130


def test_articles_of_the_given_pages(spark, model):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in hx.main_text(pages, model).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        expected = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert got[r["page_id"]]["text"] == expected and got[r["page_id"]]["n_chars"] == len(expected)


def test_edge_pages(spark, model):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<" * 50), (2, "u", "<div>" * 3000 + "deep"), (3, "v", "<nav><a href=x>y</a></nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = hx.main_text(pages, model).collect()
    assert len(got) == 5 and {r["text"] for r in got if r["page_id"] in (1, None)} == {""}
    assert hx.main_text(pages.limit(0), model).count() == 0


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.Workspace(spark, "test").save(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] >= seen[2] >= seen[3] > 0
    out = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    from tokenizers import Tokenizer

    from seqloom.llm.token_files import default_tokenizer

    whole, at = Tokenizer.from_file(default_tokenizer()), 0
    expected = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(out) == len(expected)
    for r, (i, t) in zip(out, expected):
        ids = whole.encode(t, add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        at += len(ids)


def test_mixing_stage_with_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "c", "en", "t", 1), (2, "d e f", "en", "t", 5), (None, "g", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and all(n <= 3 * rows.count(r) for r, n in __import__("collections").Counter(map(tuple, got.collect())).items())
