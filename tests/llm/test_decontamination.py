import random

from pyspark.sql import functions as F

from seqloom.llm.decontamination import Item, Matcher, Pattern, contamination, drop_contaminated, normalised


def fewest_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("abcdefgh")]
    return "".join(out)


def test_distance_is_that_of_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert Pattern(a).search(b)[0] == fewest_edits(a, b)


def test_nothing_in_the_budget_is_lost():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(8, 30))) for i in range(12)]
    matcher = Matcher(items, 0.1)
    for _ in range(150):
        i, item = rng.choice(items)
        doc = normalised(text(20) + " " + edited(rng, item, rng.randrange(0, len(item) // 6)) + " " + text(20))
        expected = {j for j, t in items if fewest_edits(t, doc) <= int(len(t) * 0.1)}
        assert {m[0] for m in matcher.matches(doc)} == expected
    assert all(len(c) >= 1 for c in Item(1, "x" * 50, 0.1).checks)


def test_rows_and_filter(spark):
    item = "The Quick brown fox jumps over the lazy dog, and then over another one."
    rows = [(1, "start " + item.upper().replace(" ", "\n ") + " end", "a"), (2, "clean text " * 50, "b"), (3, None, "c"), (4, "", "d"), (1, item, "e"), (None, item.replace("lazy", "crazy"), "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").withColumn("distance", F.lit("x"))
    items = spark.createDataFrame([(7, item), (8, item), (9, "too short"), (10, None)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["item_id"], r["distance"]) for r in contamination(docs, items).collect())
    assert got == [(0, 7, 2), (0, 8, 2), (1, 7, 0), (1, 7, 0), (1, 8, 0), (1, 8, 0)]
    kept = drop_contaminated(docs, items, block_chars=10)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert contamination(docs, items.limit(0)).count() == 0
    assert contamination(docs.limit(0), items).count() == 0
