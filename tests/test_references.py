import pytest

from lexmill.operators import references as R

CASES = [
    ("PEREIRA, Ana. Solos do cerrado: manejo. Recife: Editora Sol, 2010.", "livro", "Solos do cerrado: manejo", "media"),
    ("COSTA, Bia. Rios urbanos. Revista Aquática, Belém, v. 3, n. 1, p. 4-9, 2015.", "artigo", "Revista Aquática", "media"),
    ("LIMA, Caio. Ventos do litoral. 2018. 90 p. Tese (Doutorado em Física) - Universidade X, Natal, 2018.", "tese-dissertacao", "Ventos do litoral", "media"),
    ("BRASIL. Lei nº 1, de 2 de março de 2001. Dispõe sobre exemplos. Brasília, DF, 2001.", "legislacao", None, "baixa"),
    ("COSTA, Bia. Portal de dados. Manaus: Rede, 2019. Disponível em: https://ex.test. Acesso em: 1 jan. 2020.", "site", "Portal de dados", "baixa"),
    ("ROCHA, D. **Marcado à mão**. Natal: Sol, 2020.", "livro", "Marcado à mão", "alta"),
    ("ROCHA, D. *Periódico à mão*. Natal: Sol, 2020.", "livro", "Periódico à mão", "alta"),
    ("ROCHA, D. et al. Obra coletiva. Natal: Sol, 2020.", "livro", "Obra coletiva", "media"),
    ("TEXTO SEM ESTRUTURA RECONHECIVEL 2020", "desconhecido", None, "baixa"),
    ("INSTITUTO X, Setor Y. Guia geral. Natal: Sol, 2020.", "documento-institucional", "Guia geral", "media"),
    ("", "desconhecido", None, "baixa"),
    (None, "desconhecido", None, "baixa"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(1, k, c[0]) for k, c in enumerate(CASES)], "doc_id long, ref_idx int, original string")
    return R.normalized(rows).orderBy("ref_idx").collect()


def test_types_highlights_and_confidence(found):
    assert [(r.ref_type, r.highlight, r.confidence) for r in found] == [c[1:] for c in CASES]


def test_runs_join_to_the_text(found):
    for r in found:
        assert "".join(x.text for x in r.runs) == r.text
    assert [x.text for x in found[7].runs if x.italics] == ["et al."]
    assert [x.text for x in found[5].runs if x.bold] == ["Marcado à mão"]
    assert not any(x.bold for x in found[3].runs)


def test_warnings(found):
    assert found[3].warnings == ["normative-kept", "no-highlight"]
    assert found[10].warnings == ["empty"] == found[11].warnings
    assert found[8].warnings == ["title-not-found", "no-highlight"]


def test_issue_counts_are_one_row_per_code(spark, found):
    rows = spark.createDataFrame([(7, "NETO, A. Nota\n\nDIAS, E. Mapa. Disponível em: https://ex.test\nBRASIL. Lei nº 1, de 2001.")], "doc_id long, references_text string")
    counts = {r.code: r.n for r in R.issue_counts(R.normalized(R.split_references(rows))).collect()}
    assert counts == {"reference-too-short": 1, "reference-year-missing": 2, "reference-access-missing": 1, "reference-highlight-missing": 2, "reference-normative-preserved": 1}


def test_merge_joins_equal_neighbours(spark):
    from pyspark.sql import functions as F

    runs = F.expr("array(named_struct('text','a','bold',true,'italics',false), named_struct('text','','bold',false,'italics',false), named_struct('text','b','bold',true,'italics',false), named_struct('text','c','bold',false,'italics',false))")
    (row,) = spark.range(1).select(R.merge_runs(runs).alias("r")).collect()
    assert [x.text for x in row.r] == ["ab", "c"]
