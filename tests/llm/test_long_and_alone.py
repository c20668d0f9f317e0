"""Long odd texts in bounded time, and verdicts that do not depend on a text's neighbours."""

import time

import numpy as np

from pairlens.llm.html_extract import FEATURES, features, parse
from pairlens.llm.quality_rules import DIMENSIONS, feature_slots, linear_scores
from pairlens.llm.surrogates import replace_entities


def test_long_texts_are_searched_in_linear_time(spark):
    size = 1 << 20
    texts = [
        "see 1 " + "a" * size, "see 1 " + "a.b" * (size // 3), "7" * size, "Zm9vYmFy0" * (size // 9), "ab1" * (size // 3) + "@x.org",
        "a@" + "b." * (size // 2), "token = " + "1.a/" * 2000, "x..ann.lee@mail.example.org, " * 200,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    start = time.perf_counter()
    out = {r.doc_id: r for r in replace_entities(docs, "k").collect()}
    assert time.perf_counter() - start < 120
    assert [out[k].n_entities for k in (0, 1, 2, 3)] == [0, 0, 0, 0]
    assert [out[k].text == texts[k] for k in (0, 1, 2, 3)] == [True] * 4
    assert out[4].n_entities == 1 and not out[4].text.endswith("ab1@x.org") and out[4].text.endswith(".org")
    assert out[6].n_entities == 1 and "1.a/1.a" not in out[6].text
    assert out[7].n_entities == 200 and "ann.lee" not in out[7].text and "mail.example" not in out[7].text


def test_scores_are_the_same_alone_and_in_a_batch():
    texts = [b"", b"one", "Œuvre café übergroß north-west".encode(), b"a b", b"zzz", b" \n", b"Another text of some words, and more."]
    weights = np.random.default_rng(1).normal(size=2 * DIMENSIONS)
    alone = [linear_scores([t], weights)[0] for t in texts]
    for order in (range(7), reversed(range(7)), (2, 2, 4, 6, 2)):
        order = list(order)
        assert linear_scores([texts[k] for k in order], weights).tolist() == [alone[k] for k in order]


def test_features_are_words_pairs_and_code_points():
    words, of_word, grams, of_gram = feature_slots(["a b a b".encode(), "é".encode(), "éüß".encode(), b""])
    assert np.bincount(of_word, minlength=4).tolist() == [7, 1, 1, 0]
    assert len(set(words[of_word == 0].tolist())) == 4
    assert np.bincount(of_gram, minlength=4).tolist() == [5, 0, 1, 0]


def test_pages_of_many_siblings_and_open_elements():
    for count in (999, 1000, 20_000):
        blocks = parse("<ul>" + "<li>item" * count)
        table = features(blocks)
        places = [row[FEATURES.index("place")] for row, b in zip(table, blocks) if b.tag == "li"]
        assert places == [k / count for k in range(count)]
    start = time.perf_counter()
    page = "<div><b><a href=x>" * 3000 + "text</i></u>" * 20_000 + "<script/>" * 5 + "end"
    assert features(parse(page)).shape[0] == 3002
    assert time.perf_counter() - start < 30
