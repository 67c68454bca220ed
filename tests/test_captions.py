"""Captions and sources of images and tables in small documents."""

from lexmill.operators import captions as C

SCHEMA = "doc_id long, block_idx int, block_type string, level int, text string"
KINDS = {"i": "image", "t": "table", "h": "heading", "q": "longQuote", "b": "pageBreak"}


def found(spark, *docs):
    """Each document is a list of words: i, t, h, b or the text of a paragraph."""
    rows = [(d, k, KINDS.get(x, "paragraph"), None, None if x in "itb" else x) for d, doc in enumerate(docs) for k, x in enumerate(doc)]
    return {(r.doc_id, r.block_idx): (r.caption, r.place, r.source) for r in C.captioned(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_each_caption_goes_to_one_object(spark):
    one, two, table, either = "Figura 1 – Rio", "FIGURA 2: Mar", "Tabela 3 - Dados", "Quadro 4 Partes"
    got = found(
        spark,
        [one, "texto", "i", "i"],  # the nearest object takes it
        [one, two, "i"],  # the nearest caption counts
        ["i", one, "i"],  # above before below
        ["i", one, "h", "i"],  # not across a heading
        [table, "i", "t"],  # the wrong kind is no title, nor does it jump an object
        ["t", table], [either, "t"], [either, "i"], ["i", table, "t"],
        ["i", "texto", one],
    )
    assert {k: v[:2] for k, v in got.items()} == {
        (0, 2): (one, "above"), (0, 3): (None, None), (1, 2): (two, "above"), (2, 0): (None, None), (2, 2): (one, "above"), (3, 0): (one, "below"), (3, 3): (None, None),
        (4, 1): (None, None), (4, 2): (None, None), (5, 0): (table, "below"), (6, 1): (either, "above"), (7, 1): (either, "above"), (8, 0): (None, None), (8, 2): (table, "above"), (9, 0): (one, "below"),
    }


def test_sources(spark):
    got = found(spark, ["i", "Fonte: A.", "Fonte: B.", "t"], ["i", "Figura 1 - x", "fontes : C"], ["i", "h", "Fonte: D"], ["Fonte: E", "i", "x", "FONTE: F", "b"])
    assert {k: v[2] for k, v in got.items()} == {(0, 0): "Fonte: A.", (0, 3): None, (1, 0): "fontes : C", (2, 0): None, (3, 1): "FONTE: F"}


def test_breaches_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, "image", None, None), (1, 1, "table", None, None), (1, 2, "paragraph", None, "Fonte: x"), (None, 0, "paragraph", None, None)], SCHEMA)
    assert sorted((r.block_idx, r.rule) for r in C.caption_breaches(rows).collect()) == [(0, 40), (0, 41), (1, 42)]
    assert C.captioned(rows.limit(0)).count() == 0
