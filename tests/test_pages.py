"""Pages of layout rows against a plain line-by-line count, and lists whose numbers a third pass leaves alone."""

import random
import re

from lexmill.operators import layout as L
from lexmill.operators import pages as P

SCHEMA = "doc_id long, start_page int, seq int, part string, style string, before long, text string"


def plain(rows):
    """The page of each row by walking through them."""
    out, place = {}, {}
    for doc_id, start, seq, part, style, before, text in sorted(rows, key=lambda r: (r[0], r[3] == "body", r[2])):
        page, used = place.get((doc_id, part), (start if part == "body" else 1, 0))
        size, _, _, line, above, after, left, first = L.STYLES.get(style, L.STYLES["paragraph"])
        if style == "pageBreak":
            out[doc_id, seq] = page + max(used - 1, 0) // 14003
            place[doc_id, part] = page + max(-(-used // 14003), 1), 0
            continue
        text = re.sub(r"\t\d+$", "", text or "") if style == "toc" else text
        above = above if before is None else before
        per_line = max((9071 - left) * 100 // (size * 450), 1)
        lines = sum(max(-(-(len(x) + (5 if style == "toc" else 0) + (first * 100 // (size * 450) if k == 0 else 0)) // per_line), 1) for k, x in enumerate((text or "").split("\n")))
        height = size * line * 1150 // 24000
        out[doc_id, seq] = page + (used + above + height - 1) // 14003
        place[doc_id, part] = page, used + above + lines * height + after
    return out


def documents(seed, n=12):
    rng, rows = random.Random(seed), []
    for d in range(n):
        seq, start = 0, rng.randint(4, 9)
        for part in ("front", "body"):
            for _ in range(rng.randint(1, 60)):
                style = rng.choice([*L.STYLES, "paragraph", "paragraph", "simple", "unknown"])
                text = None if rng.random() < 0.05 else "\n".join("x" * rng.randint(0, 900) for _ in range(rng.randint(1, 4)))
                if rng.random() < 0.4:
                    style, text = "paragraph", rng.choice(["Figura {} – Rio", "Tabela {} - Dados", "Quadro {}"]).format(seq)
                rows.append((d, start, seq, part, style, rng.choice([None, None, 900]), text))
                seq += 1
    return rows


def test_pages_equal_a_walk(spark):
    rows = documents(1)
    assert {(r.doc_id, r.seq): r.page for r in P.paged(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()} == plain(rows)


def test_contents_are_the_headings_with_pages(spark):
    rows = documents(2)
    want = {(r[0], r[2]): (L.LEVELS[r[4]], plain(rows)[r[0], r[2]]) for r in rows if r[3] == "body" and r[4] in L.LEVELS and (r[6] or "").strip()}
    assert {(r.doc_id, r.seq): (r.level, r.page) for r in P.contents(P.paged(spark.createDataFrame(rows, SCHEMA))).collect()} == want


def test_lists_reach_their_fixpoint(spark):
    """Numbers are those of the final pages, also where a list fills several pages; captions, entries and nothing else is told apart."""
    many = [(99, 5, 0, "front", "title", None, "SUMÁRIO")] + [(99, 5, 1 + k, "body", "simple", None, f"Figura {k} - Um título comprido " + "x" * (k % 90)) for k in range(400)]
    rows = documents(3) + many + [(50, 5, 0, "front", "cover", None, "A"), (50, 5, 1, "body", "paragraph", None, "sem figuras")]
    found = [tuple(r) for r in P.with_lists(spark.createDataFrame(rows, SCHEMA)).collect()]
    again = plain([r[:7] for r in found])
    assert {(r[0], r[2]): r[7] for r in found} == again
    for d in {r[0] for r in rows}:
        own = sorted((r for r in found if r[0] == d), key=lambda r: r[2])
        captions = [(r[6], r[7]) for r in own if r[3] == "body" and r[4] in ("paragraph", "simple") and (r[6] or "").split(" ")[0] in ("Figura", "Quadro", "Tabela")]
        entries = [tuple(r[6].split("\t")) for r in own if r[4] == "toc" and "\t" in (r[6] or "")]
        assert sorted(entries) == sorted((t, str(p)) for t, p in captions)
        assert len({r[1] for r in own}) == 1 and [r[2] for r in own] == list(range(len(own)))
    start = {r[0]: r[1] for r in found}
    sheets = {r[7] for r in found if r[0] == 99 and r[4] == "toc"}
    assert start[50] == 5 and start[99] == 5 + len(sheets) > 10
