"""Tables of contents against headings, and the longest common order."""

import itertools
import random

from pyspark.sql import functions as F

from lexmill.operators import blocks as B
from lexmill.operators import summary as SM


def findings(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = SM.summary_findings(B.text_blocks(docs)).collect()
    return sorted((r.doc_id, r.kind, r.place, r.text) for r in rows)


def test_longest_increasing_subsequences(spark):
    rng = random.Random(2)
    cases = [[rng.randint(1, 9) for _ in range(rng.randint(0, 9))] for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(cases)), "k long, p array<int>").select("k", SM.increasing(F.col("p")).alias("chain")).collect()
    for r in rows:
        p = cases[r.k]
        longest = max((n for n in range(len(p) + 1) for c in itertools.combinations(p, n) if all(a < b for a, b in itertools.pairwise(c))), default=0)
        kept = [p[i] for i in r.chain]
        assert len(kept) == longest and all(a < b for a, b in itertools.pairwise(kept)) and all(a < b for a, b in itertools.pairwise(r.chain))


def test_each_kind_of_finding(spark):
    body = "\n1 INTRODUÇÃO\nTexto\n2 MÉTODOS\n3 DADOS\nCONCLUSÃO\nREFERÊNCIAS\nSILVA, A. Obra."
    good = "SUMÁRIO\n1 Introdução ..... 3\n2 MÉTODOS\t5\n3 DADOS    7\nCONCLUSÃO … 9\nREFERÊNCIAS ...10"
    assert findings(spark, good + body) == []
    assert findings(spark, "Obra" + body) == [(0, "absent", None, "")]
    swapped = good.replace("2 MÉTODOS\t5\n3 DADOS    7", "RESUMO ... 2\n3 DADOS    7\n2 MÉTODOS\t5").replace("\nREFERÊNCIAS ...10", "\nAVISOS ... 11")
    assert findings(spark, swapped + body) == [
        (0, "extra", 1, "RESUMO"), (0, "extra", 5, "AVISOS"), (0, "misplaced", 3, "2 MÉTODOS"), (0, "missing", 4, "REFERÊNCIAS"),
        (0, "no-references", None, ""), (0, "page", 1, "RESUMO"), (0, "page", 3, "2 MÉTODOS"), (0, "pretextual", 1, "RESUMO"),
    ]


def test_repeated_titles_and_odd_texts(spark):
    """The k-th entry stands for the k-th heading; a table without entries, at the end, or null text."""
    twice = "SUMÁRIO\n1 A ... 1\n1 A ... 2\n1 A ... 3\nREFERÊNCIAS ... 4\n1 A\nx\n1 A\nREFERÊNCIAS"
    assert findings(spark, twice, None, "", "x\nSUMÁRIO", "SUMÁRIO\nsem entradas\n1 A") == [
        (0, "extra", 2, "1 A"), (1, "absent", None, ""), (2, "absent", None, ""), (3, "no-references", None, ""), (4, "missing", 0, "1 A"), (4, "no-references", None, ""),
    ]
