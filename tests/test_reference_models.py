"""The twenty reference models, one fixture and more each, and what is left alone."""

import pytest

from lexmill.functions import values as V
from lexmill.operators import models

CASES = [
    ("livro", "PEREIRA, Ana. Solos do cerrado: manejo. 2. ed. Recife: Editora Sol, 2010.", {"author": "PEREIRA, Ana", "title": "Solos do cerrado", "place": "Recife", "publisher": "Editora Sol", "year": "2010", "edition": "2"}),
    ("livro", "ROCHA, D. B. Obra. Natal: Sol, 2020.", {"author": "ROCHA, D. B.", "title": "Obra", "place": "Natal"}),
    ("livro-eletronico", "LIMA, Eva. Rios. Belém: Foz, 2019. E-book. Disponível em: https://ex.test/rios. Acesso em: 1 jan. 2020.", {"url": "https://ex.test/rios", "accessed": "1 jan. 2020", "publisher": "Foz"}),
    ("capitulo", "DIAS, Rui. Raízes. In: SOUZA, A. (org.). Plantas do sul. Natal: Sol, 2001. p. 10-20.", {"title": "Raízes", "pages": "10-20", "year": "2001"}),
    ("trabalho-academico", "LIMA, Caio. Ventos do litoral. 2018. 90 p. Tese (Doutorado em Física) - Universidade X, Natal, 2018.", {"title": "Ventos do litoral", "publisher": "Universidade X", "year": "2018", "pages": "90"}),
    ("correspondencia", "SILVA, Bia. [Carta]. Destinatário: Ana Lima. Lavras, 3 mar. 1990. 1 carta.", {"author": "SILVA, Bia"}),
    ("periodico", "REVISTA DO CERRADO. Brasília: Instituto Terra, 1939- . ISSN 0034-723X. Trimestral.", {}),
    ("artigo", "COSTA, Bia. Rios urbanos. Revista Aquática, Belém, v. 3, n. 1, p. 4-9, 2015.", {"container": "Revista Aquática", "place": "Belém", "volume": "3", "number": "1", "pages": "4-9", "year": "2015"}),
    ("artigo-online", "COSTA, Bia. Rios urbanos. Revista Aquática, Belém, v. 3, n. 1, 2015. Disponível em: https://doi.org/10.1234/ab.5. Acesso em: 2 fev. 2021.", {"doi": "10.1234/ab.5", "accessed": "2 fev. 2021", "year": "2015"}),
    ("jornal", "MELO, F. Seca no norte. Folha de Minas, Lavras, 12 maio 2011. Caderno 2, p. 3.", {"container": "Folha de Minas", "year": "2011"}),
    ("evento", "REIS, Ana. Adubos. In: CONGRESSO DE SOLOS, 10., 2009, Natal. Anais [...]. Natal: SBCS, 2009. p. 30-31.", {"title": "Adubos", "year": "2009"}),
    ("patente", "NETO, A. Bomba de sementes. Depositante: Empresa Z. BR n. PI123. Depósito: 3 jan. 2004.", {"title": "Bomba de sementes"}),
    ("juridico", "BRASIL. Lei nº 9.610, de 19 de fevereiro de 1998. Altera a lei. Brasília, DF, 1998.", {"author": "BRASIL", "title": "Lei nº 9.610, de 19 de fevereiro de 1998", "number": "9.610", "year": "1998"}),
    ("audiovisual", "BAGÉ em cena. Direção: Ana Reis. Produção: Sul Filmes. Bagé: Sul, 1999. 1 DVD (90 min).", {"year": "1999"}),
    ("sonoro", "CANTOS do rio. Intérprete: Eva Sol. Belém: Foz Discos, 2003. 1 CD-áudio, faixa 2.", {"place": "Belém"}),
    ("partitura", "VILLA, H. Coros. Rio: Casa, 1960. 1 partitura (23 p.).", {"author": "VILLA, H.", "title": "Coros", "pages": "23"}),
    ("iconografico", "KOB, K. Doenças. 1980. 1 fotografia, color., 16 cm x 56 cm.", {"title": "Doenças", "year": "1980"}),
    ("cartografico", "INSTITUTO GEO. Regiões de Minas. Lavras: IG, 1981. 1 atlas. Escala 1:2.000.", {"author": "INSTITUTO GEO", "place": "Lavras"}),
    ("tridimensional", "DUCH, M. Vaso. 1919. 1 escultura variável.", {"title": "Vaso", "year": "1919"}),
    ("eletronico", "NUVEM. Agenda: software de bolso. Versão 2. Disponível em: https://ex.test/a. Acesso em: 5 jun. 2022.", {"author": "NUVEM", "title": "Agenda", "url": "https://ex.test/a"}),
    ("dados", "SOUZA, Ana. Chuvas de Lavras. Zenodo, 2021. Conjunto de dados. Disponível em: https://ex.test/z.", {"title": "Chuvas de Lavras", "year": "2021"}),
    ("desconhecido", "TEXTO SEM ESTRUTURA RECONHECIVEL 2020", {"year": "2020"}),
    ("desconhecido", "", {"title": None}),
    ("desconhecido", None, {"title": None}),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, x) for k, (_, x, _) in enumerate(CASES)], "k long, original string")
    return {r.k: r for r in models.modelled(rows).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_model_and_fields(found, k):
    model, text, fields = CASES[k]
    assert found[k].model == model and {f: found[k][f] for f in fields} == fields
    assert ("model-unknown" in found[k].model_warnings) == (model == "desconhecido") and found[k].text == (text or "")


def test_every_model_has_a_case_and_a_lead(found):
    assert {c[0] for c in CASES} == set(V.MODEL_WEIGHTS) | {"desconhecido"} and len(V.MODEL_WEIGHTS) == 20
    assert all(found[k].lead >= 1 for k, c in enumerate(CASES) if c[0] != "desconhecido")


def test_missing_fields_are_told(spark):
    rows = spark.createDataFrame([("COSTA, Bia. Rios. Revista Aquática, v. 3, n. 1, p. 4-9.",)], "original string")
    assert models.modelled(rows).first().model_warnings == ["missing-year"]
    blank = models.modelled(rows.limit(0))
    assert blank.count() == 0 and blank.columns[-1] == "model_warnings"
