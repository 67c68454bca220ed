"""The quote scanner against a walk with a stack; citations and their marks."""

import random

from pyspark.sql import functions as F

from lexmill.operators import quotations as Q

PAIRS = {'"': '"', "”": "“", "»": "«"}


def walk(text):
    stack, spans, start = [], [], 0
    for k, c in enumerate(text, 1):
        if c in PAIRS and stack and stack[-1] == PAIRS[c]:
            stack.pop()
            if not stack:
                spans.append((start, k))
        elif c in '"“«':
            if not stack:
                start = k
            stack.append(c)
    return spans


def test_spans_equal_a_walk(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice('a"“”«»é ') for _ in range(rng.randint(0, 25))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", Q.quote_spans(F.col("t")).alias("s")).collect()
    assert [[tuple(s) for s in r.s] for r in sorted(rows, key=lambda r: r.k)] == [walk(t) for t in texts]


def test_citations_and_their_marks(spark):
    rows = [
        (1, 0, "paragraph", 'Diz "a" e “b «c»” (SILVA, 2010, p. 3). Silva e Lima (2011) nega.'),
        (1, 1, "paragraph", "Direta sem aspas (SILVA, 2010, p. 3), de novo (SILVA, 2010, p. 3)."),
        (1, 2, "longQuote", "“Um bloco” (SOUZA, 1999)"),
        (1, 3, "longQuote", "x" * 400 + " (SOUZA, 1999)"),
        (1, 4, "heading", "(SOUZA, 1999)"),
        (1, 5, "paragraph", None),
        (1, 6, "paragraph", "(nada 2010) e (DIAS, 200)"),
    ]
    found = Q.citations(spark.createDataFrame(rows, "doc_id long, block_idx int, block_type string, text string")).orderBy("block_idx", "nth").collect()
    assert [(r.block_idx, r.nth, r.citation, r.page, r.quote and r.quote[:9], r.length_class, r.mark, r.rule) for r in found] == [
        (0, 0, "(SILVA, 2010, p. 3)", "3", "b «c»", "short", "quotes", None),
        (0, 1, "Silva e Lima (2011)", None, None, None, "none", None),
        (1, 0, "(SILVA, 2010, p. 3)", "3", None, None, "none", 27),
        (1, 1, "(SILVA, 2010, p. 3)", "3", None, None, "none", 27),
        (2, 0, "(SOUZA, 1999)", None, "“Um bloco", "short", "indent", 28),
        (3, 0, "(SOUZA, 1999)", None, "xxxxxxxxx", "long", "indent", None),
    ]
    assert [r.start for r in found if r.block_idx == 1] == [18, 47]
