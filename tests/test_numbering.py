"""Automatic numbers against a walk through the paragraphs; formats of counters."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import numbering as N

FORMATS = ("decimal", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "decimalZero", "bullet")


def roman(n):
    out = ""
    for value, figure in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + figure, n - value
    return out or "0"  # beyond Roman figures, decimal ones


def figure(n, kind):
    letter = "abcdefghijklmnopqrstuvwxyz"[(n - 1) % 26] * ((n - 1) // 26 + 1) if n > 0 else ""
    return {"decimal": str(n), "lowerLetter": letter, "upperLetter": letter.upper(), "lowerRoman": roman(n).lower(), "upperRoman": roman(n), "decimalZero": f"{n:02d}", "bullet": ""}[kind]


@pytest.mark.parametrize("kind", FORMATS)
def test_formats(spark, kind):
    rows = spark.range(1, 1200).select("id", N.shown(F.col("id").cast("int"), F.lit(kind)).alias("x")).collect()
    assert [r.x for r in rows] == [figure(r.id, kind) for r in rows]


def test_numbers_equal_a_walk(spark):
    rng = random.Random(8)
    docs, want = [], {}
    for d in range(25):
        kinds = {a: [(rng.randint(0, 4), rng.choice(FORMATS), rng.choice([f"%{k + 1}", ".".join(f"%{j + 1}" for j in range(k + 1)), f"§ %{k + 1}) &amp; %1", "•"])) for k in range(rng.randint(1, 9))] for a in range(2)}
        own = {n: {k: rng.randint(1, 30) for k in range(9) if rng.random() < 0.2} for n in (1, 2, 3)}
        of = {1: 0, 2: 1, 3: 0}
        xml = "".join(f'<w:abstractNum w:abstractNumId="{a}">' + "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="{s}"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for k, (s, f, t) in enumerate(levels)) + "</w:abstractNum>" for a, levels in kinds.items())
        xml += "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{of[n]}"/>' + "".join(f'<w:lvlOverride w:ilvl="{k}"><w:startOverride w:val="{s}"/></w:lvlOverride>' for k, s in own[n].items()) + "</w:num>" for n in of)
        body, counts = "", {}
        for i in range(rng.randint(0, 50)):
            num, lvl = rng.choice([0, 1, 1, 2, 3, 9]), rng.choice([0, 0, 1, 1, 2, 3, 8])
            body += f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="{num}"/></w:numPr></w:pPr><w:r><w:t>t{i}</w:t></w:r></w:p>'
            if not num:
                continue
            c = counts.setdefault(num, [0] * 9)
            c[lvl] += 1
            c[lvl + 1 :] = [0] * (8 - lvl)
            number = None
            if num in of and lvl < len(kinds[of[num]]):
                levels, number = kinds[of[num]], kinds[of[num]][lvl][2].replace("&amp;", "&")
                for k in range(9):
                    value = figure(own[num].get(k, levels[k][0]) + max(c[k], 1) - 1, levels[k][1]) if k < len(levels) else ""
                    number = number.replace(f"%{k + 1}", value)
            want[d, i] = number
        docs.append((d, f"<w:document><w:body>{body}</w:body></w:document>", f"<w:numbering>{xml}</w:numbering>"))
    found = N.numbered(spark.createDataFrame(docs, "doc_id long, document_xml string, numbering_xml string")).collect()
    assert {(r.doc_id, r.idx): r.number for r in found} == want


def test_headings_by_their_numbers(spark):
    xml = '<w:numbering><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="1"/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    p = lambda lvl, text: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    docs = [(1, f"<w:document><w:body>{p(0, 'Introdução')}{p(1, 'Dados')}{p(0, '')}</w:body></w:document>", xml), (2, None, None), (3, "", xml)]
    rows = N.numbered(spark.createDataFrame(docs, "doc_id long, document_xml string, numbering_xml string")).orderBy("idx").collect()
    assert [(r.number, r.text, r.level) for r in rows] == [("1.", "Introdução", 1), ("1.1", "Dados", 2), ("2.", "", None)]
