"""Pages with frames, forms, links between paragraphs and notices without names; texts of the pages aren't from the module's lists."""

import numpy as np
import pytest

from siltstone.llm import html, line_dedup, lm


def w(n, stem="lorem"):
    return " ".join(f"{stem}{i}" for i in range(n))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><form id='aspnetForm'><div><p>{w(60)}</p><p>{w(40, 'b')}</p></div></form></body>", [w(60), w(40, "b")]),
        (f"<body><fieldset><p>{w(60)}</p><p>{w(40, 'b')}</p></fieldset></body>", [w(60), w(40, "b")]),
        (f"<article><p>{w(12)}</p><p><a>{w(10, 'b')}</a></p><p>{w(30, 'c')}</p></article>", [w(12), w(10, "b"), w(30, "c")]),
        (f"<body><p>{w(60)}</p><p>{w(40, 'b')}</p><form><p>{w(25, 'f')}</p>Name <input></form></body>", [w(60), w(40, "b")]),
        (f"<body><p>{w(60)}</p><p>{w(40, 'b')}</p><div>We use cookies to improve things. Accept all</div><div>Copyright 2024 Somebody</div><div>© Somebody</div></body>", [w(60), w(40, "b")]),
        (f"<body><form><p>{w(60)}</p><p>{w(40, 'b')}</p><form><p>{w(30, 'c')}</p></form></form><p>{w(5, 'd')}</p></body>", [w(60), w(40, "b"), w(30, "c"), w(5, "d")]),
        (f"<body><p>Copyright law is old. {w(70)}</p><p>{w(40, 'b')}</p></body>", ["Copyright law is old. " + w(70), w(40, "b")]),
    ],
)
def test_frames_forms_and_notices(page, want):
    assert html.main_text(page) == "\n".join(want)


def test_pages_of_an_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_lines_are_marked_by_alignment_alone(monkeypatch):
    """Blocks that moved are in a later alignment; without alignments there are no marks."""
    a, b = [1, 2, 3, 4, 5, 6], [4, 5, 6, 9, 1, 2, 3]
    assert line_dedup.common_blocks(a, [10] * 6, b, 20) == [0, 1, 2, 3, 4, 5]
    assert line_dedup.common_blocks(a, [10] * 6, b, 31) == []
    monkeypatch.setattr(line_dedup, "patience", lambda *_: [])
    assert line_dedup.common_blocks(a, [10] * 6, b, 20) == []


def test_repeated_alignment_finds_the_blocks_that_spans_find(spark):
    rng = np.random.default_rng(3)
    lines = [w(int(n), f"l{k}x") for k, n in enumerate(rng.integers(1, 12, 300))]
    docs = []
    for i in range(200):
        start = rng.integers(0, 280, rng.integers(1, 4))
        docs.append((i, "\n".join(x for s in start for x in [*lines[s : s + int(rng.integers(1, 12))], f"own {i} {s}"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, i) for r in line_dedup.marked_lines(df).collect() for i in r.marked}
    every = {(r.doc_id, i) for r in line_dedup.marked_lines(df, moved=True).collect() for i in r.marked}
    assert found <= every and len(found) >= 0.99 * len(every) > 100


def test_scores_are_the_same_on_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    one = {r.doc_id: r.score for r in lm.score(docs.repartition(7)).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        two = {r.doc_id: r.score for r in lm.score(docs.coalesce(1)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) <= 1e-9 * abs(one[k]) for k in one)
