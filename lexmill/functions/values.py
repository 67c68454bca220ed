"""Fixed values of the document rules: word lists, patterns and limits that results depend on."""

FIELD_KEYS = (
    "author", "title", "subtitle", "workNature", "course", "program", "advisor", "coadvisor", "location", "year",
    "resumo", "palavrasChave", "abstractText", "keywords", "introducao", "conclusao", "referencias", "anexos",
    "apendices", "dedicatoria", "agradecimentos", "epigrafe", "indicadoresImpacto", "impactIndicators", "imageWarnings",
)
WORK_TYPES = ("artigo", "monografia", "dissertacao", "tese", "outro")
ADVISED_TYPES = ("monografia", "dissertacao", "tese")
IMPACT_TYPES = ("dissertacao", "tese")
CONFIDENCES = ("alta", "media", "baixa", "nao-identificado")

TEXT_HEADINGS = ("RESUMO", "ABSTRACT", "REFERENCIAS", "ANEXOS", "APENDICES", "INTRODUCAO")
PRE_TEXTUAL_HEADINGS = (
    "RESUMO", "ABSTRACT", "AGRADECIMENTOS", "DEDICATORIA", "EPIGRAFE", "SUMARIO", "LISTA DE ILUSTRACOES",
    "LISTA DE TABELAS", "LISTA DE QUADROS", "LISTA DE SIGLAS", "INDICADORES DE IMPACTO", "IMPACT INDICATORS",
)
UNNUMBERED_HEADINGS = ("REFERENCIAS", "ANEXOS", "APENDICES", "CONCLUSAO", "CONSIDERACOES FINAIS")
POST_TEXTUAL_HEADINGS = ("REFERENCIAS", "ANEXOS", "ANEXO", "APENDICES", "APENDICE")
TEXTUAL_HEADINGS = ("INTRODUCAO", "CONCLUSAO", "CONSIDERACOES FINAIS")
CONCLUSION_HEADINGS = ("CONCLUSAO", "CONSIDERACOES FINAIS")

CITIES = ("LAVRAS",)
CITY_LINES = ("LAVRAS", "LAVRAS - MG")
GENERIC_COVER_LINES = ("UNIVERSIDADE FEDERAL DE LAVRAS", "UFLA", "AUTOR", "TITULO", "LOCAL", "ANO")
AUTHOR_PLACEHOLDER = "NOME E SOBRENOME DO AUTOR"
INSTITUTIONAL_TERMS = (
    "UNIVERSIDADE", "UNIVERSIDADE FEDERAL", "UFLA", "INSTITUTO", "INSTITUTO DE CIÊNCIAS", "INSTITUTO DE CIENCIAS",
    "DEPARTAMENTO", "FACULDADE", "ESCOLA", "PROGRAMA", "PROGRAMA DE PÓS-GRADUAÇÃO", "PROGRAMA DE POS-GRADUACAO",
    "PÓS-GRADUAÇÃO", "POS-GRADUACAO", "GRADUAÇÃO", "GRADUACAO", "CURSO", "ÁREA DE CONCENTRAÇÃO",
    "AREA DE CONCENTRACAO", "LINHA DE PESQUISA", "LAVRAS", "MINAS GERAIS", "MG", "BRASIL", "FICHA CATALOGRÁFICA",
    "FICHA CATALOGRAFICA", "RESUMO", "ABSTRACT", "SUMÁRIO", "SUMARIO", "ORIENTADOR", "ORIENTADORA", "COORIENTADOR",
    "COORIENTADORA",
)
INSTITUTIONAL_AUTHOR = r"\b(UNIVERSIDADE|UFLA|INSTITUTO|PROGRAMA|POS-GRADUACAO|CURSO|DEPARTAMENTO|FACULDADE|ESCOLA|LAVRAS|MINAS GERAIS|MG)\b"
NOT_AN_AUTHOR = r"\b(RESUMO|ABSTRACT|REFERENCIAS|INTRODUCAO|ANEXOS|APENDICES|SUMARIO)\b"

LEGISLATION_START = r"^(brasil|minas gerais|lavras)\."
LEGISLATION_WORDS = r"\b(lei|decreto|portaria|resolucao|instrucao normativa|norma|nbr)\b"
ACADEMIC_WORDS = r"\b(dissertacao|tese|monografia|trabalho de conclusao de curso)\b"
ACADEMIC_MARK = r"\b(?:tese|dissertacao|monografia|trabalho de conclusao de curso)\s*\("
ELECTRONIC = r"(https?://|doi\b|disponivel em:|acesso em:)"
INSTITUTION_START = r"^(universidade|instituto|ministerio|associacao|fundacao|conselho|ufla|abnt)\b"
PUBLICATION = r"^[\p{Lu}][\p{L}\s.'-]*(?:,\s*\p{Lu}{2})?\s*:\s*.+,\s*(?:19|20)\d{2}"

LABELS = {
    "author": r"autor(?:a)?|discente|aluno(?:a)?",
    "title": r"t[íi]tulo",
    "subtitle": r"subt[íi]tulo",
    "course": r"curso",
    "program": r"programa",
    "location": r"local|cidade",
    "advisor": r"orientador(?:a)?",
    "coadvisor": r"coorientador(?:a)?",
}
UNSAFE_YEAR = r"(refer[êe]ncias?|doi|https?://|www\.|dispon[ií]vel em|acesso em|lei|decreto|portaria|resolu[cç][aã]o|cita[cç][aã]o)"
WORK_NATURE = r"apresentad[ao]\s+[aà]\s+universidade|obten[cç][aã]o\s+do\s+t[ií]tulo"

COVER_BLOCKS = 20
SHORT_REFERENCE = 25
LONG_QUOTE_CHARS = 450
LONG_QUOTE_INDENT = 2200
CITED = r"\([A-ZÁÉÍÓÚÂÊÔÃÕÇ][^)]*,\s*(?:19|20)\d{2}"
#: Form of paragraphs: sizes in half points, lines in 240ths, margins in twips.
SERIF_FONTS = ("Times New Roman", "Times", "Liberation Serif", "DejaVu Serif", "Nimbus Roman", "Nimbus Roman No9 L", "Droid Serif", "Computer Modern Serif")
QUOTE_SIZE = 22
BODY_SIZE = 24
SINGLE_LINE = 240
BODY_LINE = 360
MARGINS = {"top": 1701, "left": 1701, "bottom": 1134, "right": 1134}
MARGIN_SLACK = 6
MIME_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp"}

#: Texts that every laid-out document holds, or holds where a field is empty.
INSTITUTION = "UNIVERSIDADE FEDERAL DE LAVRAS"
DEFAULT_AUTHOR = "AUTOR"
DEFAULT_TITLE = "TÍTULO DO TRABALHO"
DEFAULT_LOCATION = "LAVRAS - MG"
DEFAULT_NATURE = "Trabalho apresentado à Universidade Federal de Lavras como requisito acadêmico, conforme dados revisados pelo usuário."
CATALOGUE_CARD = "Espaço reservado para ficha catalográfica elaborada pela Biblioteca Universitária da UFLA."
IMPACT_PLACE = "Espaço reservado aos indicadores de impacto."
IMPACT_PLACE_ENGLISH = "Reserved space for impact indicators."
SUMMARY_NOTE = "Após abrir no Word, atualize o sumário com F9 para recalcular páginas."

#: Reference models: cues in folded text, what each says for or against a model, and how a model's fields are written.
MODEL_CUES = {
    "imprint": r"[a-z][a-z .'/-]+: [^:,]{2,}, \[?c?(?:19|20)\d{2}",
    "online": r"disponivel em:|https?://|\bdoi\b",
    "access": r"acesso em:",
    "within": r"\bin: ",
    "volume": r"\bv\. ?\d+",
    "number": r"\bn\. ?\d+",
    "pages": r"\bp\. ?\d+-\d+",
    "thesis": r"\b(?:tese|dissertacao|monografia|trabalho de conclusao de curso)\s*\(",
    "letter": r"\b(?:carta|bilhete|correspondencia)\b.*\b(?:destinatario|para)\b|\[(?:carta|correspondencia)\]",
    "serial": r"\bissn\b|\b(?:mensal|bimestral|trimestral|quadrimestral|semestral|anual)\b",
    "running": r"(?:19|20)\d{2}- ?(?:\.|$|,)",
    "day": r"\b\d{1,2}\.? (?:jan|fev|mar|abr|maio|jun|jul|ago|set|out|nov|dez)[a-z]*\.? (?:19|20)\d{2}",
    "newspaper": r"\b(?:jornal|folha de|o estado de|diario|caderno|gazeta)\b",
    "event": r"\b(?:congresso|simposio|anais|seminario|encontro|conferencia|proceedings|reuniao anual)\b",
    "patent": r"\bpatente\b|\bint\. cl\b|\bdepositante\b|\bdeposito: \d",
    "law": r"^(?:brasil|minas gerais|lavras)\b.*\b(?:lei|decreto|portaria|resolucao|constituicao|medida provisoria)\b|\b(?:sumula|acordao|habeas corpus|recurso especial)\b",
    "film": r"\b(?:filme|dvd|vhs|videocassete|direcao:|documentario)\b|\b\d+ min\b",
    "sound": r"\b(?:disco sonoro|cd-audio|podcast|faixa|interprete:|gravadora|audiolivro)\b",
    "music": r"\bpartituras?\b",
    "image": r"\b(?:fotografia|gravura|pintura|oleo sobre tela|cartaz|desenho tecnico)\b|\b\d+ fot\.",
    "map": r"\b(?:mapa|atlas|carta topografica|imagem de satelite)\b|\bescala:? 1:\d",
    "object": r"\b(?:escultura|maquete|ceramica|bronze|marmore|fossil)\b",
    "electronic": r"\b(?:software|base de dados|blog|homepage|rede social|aplicativo|e-mail)\b|\[?site\b",
    "data": r"\b(?:dataset|conjunto de dados|dados de pesquisa|zenodo|figshare|dataverse)\b",
}
MODEL_WEIGHTS = {
    "livro": {"imprint": 4, "within": -3, "online": -2, "volume": -1, "pages": -2, "thesis": -3, "event": -2},
    "livro-eletronico": {"imprint": 3, "online": 2, "access": 1, "within": -3, "pages": -2, "thesis": -3, "event": -2, "volume": -1},
    "capitulo": {"within": 4, "imprint": 2, "pages": 1, "event": -3},
    "trabalho-academico": {"thesis": 7},
    "correspondencia": {"letter": 7},
    "periodico": {"serial": 3, "running": 3, "volume": -1, "pages": -2, "imprint": 1},
    "artigo": {"volume": 2, "number": 2, "pages": 2, "online": -1, "within": -3, "event": -2},
    "artigo-online": {"volume": 2, "number": 2, "pages": 1, "online": 1, "access": 1, "within": -3, "event": -2},
    "jornal": {"day": 2, "newspaper": 4, "volume": -1, "access": -1},
    "evento": {"event": 5, "within": 1, "number": -1},
    "patente": {"patent": 7},
    "juridico": {"law": 7},
    "audiovisual": {"film": 6},
    "sonoro": {"sound": 6},
    "partitura": {"music": 7},
    "iconografico": {"image": 6},
    "cartografico": {"map": 6},
    "tridimensional": {"object": 6},
    "eletronico": {"electronic": 5, "online": 1, "access": 1, "imprint": -1},
    "dados": {"data": 7, "online": 1},
}
LEAST_MODEL_SCORE = 4
#: Weight, pattern and, where only some write it so, the models.
MODEL_FIELDS = {
    "author": (
        (4, r"^(\p{Lu}[\p{Lu} '-]+, (?:\p{Lu}\. ?)+(?:; \p{Lu}[\p{Lu} '-]+, (?:\p{Lu}\. ?)+)*(?:et al\.)?)", None),
        (3, r"^(\p{Lu}[\p{Lu} '-]+, [^.:]+)\. ", None),
        (2, r"^(\p{Lu}[\p{Lu} ,'-]{3,})\. ", None),
        (5, r"^([^.]+)\. ", ("juridico",)),
    ),
    "title": (
        (2, r"^([^.:]{2,}?)[.:]", None),
        (4, r"^(.+?, de \d[^.]*)\.", ("juridico",)),
        (3, r"^([^.:]{2,}?)\. (?:In:|\p{Lu})", ("capitulo", "evento", "artigo", "artigo-online", "jornal")),
    ),
    "container": (
        (4, r"\bIn: (.+?)[.:] ", ("capitulo", "evento")),
        (3, r"^[^.]+\. ([^.,]+),", ("artigo", "artigo-online", "jornal")),
        (2, r"(Anais[^.,]*)", ("evento",)),
    ),
    "place": ((3, r"([\p{L}][\p{L} '/-]*): [^:,]{2,}, \[?c?(?:19|20)\d{2}", None), (2, r"^[^.]+\. [^.,]+, ([\p{L} '-]+), v\.", ("artigo", "artigo-online")), (1, r"\. ([\p{L} '-]+), (?:19|20)\d{2}\.?$", None)),
    "publisher": ((3, r"[\p{L}][\p{L} '/-]*: ([^:,]{2,}), \[?c?(?:19|20)\d{2}", None), (2, r"\) ?[-–] ([^,]+),", ("trabalho-academico",))),
    "year": ((3, r", \[?c?((?:19|20)\d{2})\]?(?:\.|$)", None), (2, r"\b((?:19|20)\d{2})\b", None)),
    "volume": ((1, r"\bv\. ?(\d+)", None),),
    "number": ((1, r"\bn\. ?(\d+)", None), (2, r"\bn[º°] ?([\d.]*\d)", ("juridico", "patente"))),
    "pages": ((2, r"\bp\. ?(\d+-\d+)", None), (1, r"\b(\d+) ?p\.", None)),
    "edition": ((1, r"\b(\d+)\. ed\.", None),),
    "url": ((1, r"(https?://[^\s]*[^\s.,;])", None),),
    "doi": ((1, r"\b(10\.\d{4,9}/[^\s]*[^\s.,;])", None),),
    "accessed": ((1, r"(?i)acesso em: (\d[^,;]*?)\.?$", None),),
}
MODEL_NEEDS = {
    "livro": ("author", "title", "place", "publisher", "year"), "livro-eletronico": ("author", "title", "year", "url", "accessed"), "capitulo": ("author", "title", "container", "year"),
    "trabalho-academico": ("author", "title", "year"), "correspondencia": ("author", "title"), "periodico": ("title",), "artigo": ("author", "title", "container", "volume", "year"),
    "artigo-online": ("author", "title", "container", "volume", "year", "url", "accessed"), "jornal": ("title", "container", "year"), "evento": ("container", "year"), "patente": ("author", "title", "number"),
    "juridico": ("author", "title"), "audiovisual": ("title", "year"), "sonoro": ("title", "year"), "partitura": ("author", "title", "year"), "iconografico": ("title", "year"), "cartografico": ("title", "year"),
    "tridimensional": ("title", "year"), "eletronico": ("title", "url", "accessed"), "dados": ("author", "title", "year", "url"),
}

#: What titles of illustrations and tables begin with, folded; one names tables, one either.
CAPTION_LABELS = ("FIGURA", "IMAGEM", "QUADRO", "GRAFICO", "FOTOGRAFIA", "MAPA", "DESENHO", "ESQUEMA", "FLUXOGRAMA", "ORGANOGRAMA", "PLANTA", "RETRATO", "TABELA")
TABLE_LABEL = "TABELA"
ANY_LABELS = ("QUADRO",)

#: Characters that three lines hold; a quotation of more is a block of its own.
THREE_LINES = 270
