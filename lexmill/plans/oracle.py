"""DuckDB SQL for the document queries, written from the rules and not from the Spark plans."""

from __future__ import annotations

from lexmill.functions import values as V
from lexmill.operators.validation import MESSAGES
from lexmill.plans import inputs

_REFS, _WORKS, _RECORDS, _WORD = map(inputs.duckdb, (inputs.REFERENCES, inputs.WORKS, inputs.RECORDS, inputs.WORD_FILES))


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _fold(x: str) -> str:
    return _clean(f"regexp_replace(upper(replace(strip_accents({x}), 'ß', 'SS')), '[–—]', '-', 'g')")


def _base(x: str) -> str:
    return rf"regexp_replace({x}, '^\d+(\.\d+)*\s*', '')"


def _in(*names: str) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_HEADINGS = _in(*V.TEXT_HEADINGS)


def _blocks(source: str) -> str:
    """Common tables l and b: a row for each non-blank line of a table's texts, with its folded forms."""
    return rf"""
l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS raw, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS k FROM {source}),
f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, {_trim("raw")} AS text, {_fold("raw")} AS norm, {_base(_fold("raw"))} AS base FROM l WHERE {_trim("raw")} <> ''),
b AS (SELECT *, CASE WHEN regexp_matches(norm, '^\d+(\.\d+)*\s+\S+') OR base IN {_HEADINGS} THEN 'heading' ELSE 'paragraph' END AS block_type,
       CASE WHEN regexp_matches(norm, '^\d+(\.\d+)*\s+\S+') OR base IN {_HEADINGS} THEN CASE WHEN regexp_matches(norm, '^\d+\.\d+\s+') THEN 2 ELSE 1 END END::BIGINT AS level FROM f)"""


_W = f"WITH works AS ({_WORKS}), {_blocks('works')}"
_REF = "base = 'REFERENCIAS'"
_ANNEX = r"(base = 'ANEXOS' OR regexp_matches(base, '^ANEXO\s+[A-Z0-9]'))"
_APPENDIX = r"(base = 'APENDICES' OR regexp_matches(base, '^APENDICE\s+[A-Z0-9]'))"
_PRIMARY = r"((block_type = 'heading' AND level <= 1) OR regexp_matches(norm, '^\d+\s+\S+') OR base IN " + _in(*V.UNNUMBERED_HEADINGS) + ")"


def _span(name: str, start: str, stop: str, after_refs: bool = False) -> str:
    """Tables s, e and the text between a section's start and its stop."""
    refs = f"r AS (SELECT doc_id, min(i) AS at FROM b WHERE {_REF} GROUP BY doc_id)," if after_refs else ""
    joined = "b JOIN r USING (doc_id)" if after_refs else "b"
    later = "AND i > r.at" if after_refs else ""
    return f"""{refs}
s AS (SELECT doc_id, min(i) AS at FROM {joined} WHERE ({start}) {later} GROUP BY doc_id),
e AS (SELECT b.doc_id, min(i) AS at FROM b JOIN s USING (doc_id) WHERE i > s.at AND ({stop}) GROUP BY b.doc_id),
x AS (SELECT b.doc_id, string_agg({_clean("text")}, chr(10) ORDER BY i) AS said FROM b JOIN s USING (doc_id) LEFT JOIN e USING (doc_id) WHERE i > s.at AND i < coalesce(e.at, 1000000) GROUP BY b.doc_id)
SELECT doc_id, coalesce(said, '') AS {name} FROM works LEFT JOIN x USING (doc_id)"""


def _label(pattern: str) -> str:
    return _clean(rf"regexp_extract(text, '(?im)^\s*(?:{pattern})\s*[:\-]\s*(.+)$', 1)")


_CUTS = "list_transform(range(1, len({0})), lambda k: struct_pack(l := trim(array_to_string({0}[1:k], '. ')), r := trim(array_to_string({0}[k+1:], '. '))))"
_R = rf"""
WITH refs AS ({_REFS}),
a AS (SELECT *, regexp_replace(regexp_replace(original, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g') AS text, nullif(trim(regexp_extract(original, '\*+([^*]+)\*', 1)), '') AS manual FROM refs),
c AS (SELECT *, lower(strip_accents(text)) AS folded, string_split(text, '. ') AS parts FROM a),
d AS (SELECT *, list_filter({_CUTS.format("parts")}, lambda x: NOT regexp_matches(x.r, '(?i)^et\s+al\.') AND contains(x.l, ',') AND regexp_matches(x.l, '^\p{{Lu}}') AND length(trim(split_part(x.l, ',', 1))) >= 2 AND length(x.r) > 3)[1].r AS rest FROM c),
g AS (SELECT *, string_split(rest, '. ') AS more, lower(strip_accents(rest)) AS rfold FROM d),
h AS (SELECT *, {_CUTS.format("more")} AS cuts FROM g),
i AS (SELECT *, trim(split_part(list_filter(cuts, lambda x: contains(x.r, ',') AND length(trim(split_part(x.r, ',', 1))) >= 4 AND regexp_matches(x.r, '^\p{{Lu}}') AND regexp_matches(x.r, '(?i),\s*(v|n|p)\.\s*'))[1].r, ',', 1)) AS article,
        CASE WHEN regexp_matches(rfold, '\b(tese|dissertacao|monografia|trabalho de conclusao de curso)\s*\(') THEN
          nullif(trim(regexp_replace(trim(regexp_replace(trim(left(rest, length(regexp_extract(rfold, '(?s)^(.*?)\b(?:tese|dissertacao|monografia|trabalho de conclusao de curso)\s*\(', 1)))), '(?i)(\.\s*(\d+\s*p\.?|(19|20)\d{{2}})\s*)+$', '')), '\.$', '')), '') END AS academic0,
        list_filter(cuts, lambda x: length(x.l) > 3 AND regexp_matches(x.r, '^\p{{Lu}}[\p{{L}}\s.''-]*(,\s*\p{{Lu}}{{2}})?\s*:\s*.+,\s*(19|20)\d{{2}}'))[1].l AS book FROM h),
j AS (SELECT *, CASE WHEN length(academic0) > 3 THEN academic0 END AS academic FROM i),
n AS (SELECT *, CASE WHEN regexp_matches(folded, '^(brasil|minas gerais|lavras)\.') OR regexp_matches(folded, '\b(lei|decreto|portaria|resolucao|instrucao normativa|norma|nbr)\b') THEN 'legislacao'
   WHEN rest IS NULL THEN 'desconhecido' WHEN article IS NOT NULL THEN 'artigo'
   WHEN academic IS NOT NULL OR regexp_matches(folded, '\b(dissertacao|tese|monografia|trabalho de conclusao de curso)\b') THEN 'tese-dissertacao'
   WHEN regexp_matches(folded, '^(universidade|instituto|ministerio|associacao|fundacao|conselho|ufla|abnt)\b') THEN 'documento-institucional'
   WHEN regexp_matches(folded, '(https?://|doi\b|disponivel em:|acesso em:)') THEN 'site'
   WHEN book IS NOT NULL THEN 'livro' ELSE 'desconhecido' END AS ref_type FROM j),
o AS (SELECT *, CASE ref_type WHEN 'artigo' THEN article WHEN 'tese-dissertacao' THEN academic WHEN 'documento-institucional' THEN book WHEN 'site' THEN book WHEN 'livro' THEN book END AS found FROM n),
q AS (SELECT *, coalesce(manual, found) AS highlight, CASE WHEN manual IS NOT NULL THEN 'alta' WHEN ref_type <> 'site' AND found IS NOT NULL THEN 'media' ELSE 'baixa' END AS confidence FROM o)
"""
_YEAR = r"regexp_matches(text, '\b(19|20)\d{2}\b')"
_RUN_PIECES = """
p AS (SELECT ref_key, unnest(CASE WHEN manual IS NOT NULL THEN regexp_extract_all(original, '\\*\\*[^*]+\\*\\*|\\*[^*]+\\*|[^*]+|\\*')
        WHEN found IS NOT NULL AND contains(lower(text), lower(found)) THEN [left(text, strpos(lower(text), lower(found)) - 1), '**' || substr(text, strpos(lower(text), lower(found)), length(found)) || '**', substr(text, strpos(lower(text), lower(found)) + length(found))]
        ELSE [text] END) AS piece, unnest(range(0, CASE WHEN manual IS NOT NULL THEN len(regexp_extract_all(original, '\\*\\*[^*]+\\*\\*|\\*[^*]+\\*|[^*]+|\\*')) WHEN found IS NOT NULL AND contains(lower(text), lower(found)) THEN 3 ELSE 1 END)) AS k FROM q),
t AS (SELECT ref_key, k, piece LIKE '**%' AS bold, piece LIKE '*%' AND piece NOT LIKE '**%' AS slanted, CASE WHEN piece LIKE '**%' THEN substr(piece, 3, length(piece) - 4) WHEN piece LIKE '*%' THEN substr(piece, 2, length(piece) - 2) ELSE piece END AS inner_text FROM p),
u AS (SELECT ref_key, k, bold, slanted, unnest(string_split(replace(inner_text, 'et al.', chr(1) || 'et al.' || chr(1)), chr(1))) AS text, unnest(range(0, len(string_split(replace(inner_text, 'et al.', chr(1) || 'et al.' || chr(1)), chr(1))))) AS m FROM t)
SELECT ref_key, row_number() OVER (PARTITION BY ref_key ORDER BY k, m) - 1 AS run_idx, text, bold, slanted OR text = 'et al.' AS italics FROM u WHERE text <> ''
"""


def _issues(table: str, key: str) -> str:
    """(key, code, n) from a table of classified references."""
    rules = {
        "reference-too-short": "length(text) < 25",
        "reference-year-missing": f"NOT {_YEAR}",
        "reference-access-missing": "regexp_matches(text, '(?i)(https?://|dispon[ií]vel em:)') AND NOT regexp_matches(text, '(?i)acesso em:')",
        "reference-highlight-missing": "highlight IS NULL AND ref_type <> 'legislacao'",
        "reference-normative-preserved": "highlight IS NULL AND ref_type = 'legislacao'",
    }
    return " UNION ALL ".join(f"SELECT {key}, '{code}' AS code, count(*) AS n FROM {table} WHERE {rule} GROUP BY {key}" for code, rule in rules.items())


_EDITOR = rf"""
ed0 AS (SELECT doc_id, unnest(string_split_regex(editor_text, '\r?\n')) AS raw, generate_subscripts(string_split_regex(editor_text, '\r?\n'), 1) AS k FROM w),
ed1 AS (SELECT doc_id, k, {_trim("raw")} AS line FROM ed0 WHERE {_trim("raw")} <> ''),
ed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS idx,
  CASE WHEN line LIKE '## %' THEN 'heading2' WHEN line LIKE '### %' THEN 'heading3' WHEN line LIKE '# %' THEN 'heading1' WHEN line LIKE '> %' THEN 'longQuote' WHEN regexp_matches(line, '(?i)^\[REF\]\s+') THEN 'reference' ELSE 'paragraph' END AS type,
  CASE WHEN line LIKE '## %' OR line LIKE '### %' OR line LIKE '# %' OR line LIKE '> %' THEN regexp_replace(line, '^\S+\s+', '') WHEN regexp_matches(line, '(?i)^\[REF\]\s+') THEN regexp_replace(line, '(?i)^\[REF\]\s+', '') ELSE line END AS text FROM ed1)"""
_E = f"WITH w AS ({_RECORDS}), {_EDITOR}"
_LINES = rf"SELECT doc_id, unnest(string_split_regex({{0}}, '\n+')) AS raw, generate_subscripts(string_split_regex({{0}}, '\n+'), 1) AS k FROM w"
_HAS = "length(trim({0})) > 0"

_OWN_ISSUES = rf"""
SELECT doc_id, 0 AS ordinal, 'error' AS severity, 'work-type-required' AS code FROM w WHERE trim(work_type) = ''
UNION ALL SELECT doc_id, 1, 'error', 'title-required' FROM w WHERE trim(title) = ''
UNION ALL SELECT doc_id, 2, 'error', 'author-required' FROM w WHERE trim(author) = ''
UNION ALL SELECT doc_id, 3, 'error', 'author-institutional' FROM w WHERE trim(author) <> '' AND regexp_matches({_fold("author")}, '\b(UNIVERSIDADE|UFLA|INSTITUTO|PROGRAMA|POS-GRADUACAO|CURSO|DEPARTAMENTO|FACULDADE|ESCOLA|LAVRAS|MINAS GERAIS|MG)\b')
UNION ALL SELECT doc_id, 4, 'warning', 'advisor-required' FROM w WHERE work_type IN ('monografia', 'dissertacao', 'tese') AND trim(advisor) = ''
UNION ALL SELECT doc_id, 5, 'warning', 'resumo-required' FROM w WHERE trim(resumo) = ''
UNION ALL SELECT doc_id, 6, 'warning', 'references-required' FROM w WHERE trim(referencias) = ''
UNION ALL SELECT doc_id, 12, 'warning', 'intro-required' FROM w WHERE trim(introducao) = ''
UNION ALL SELECT doc_id, 13, 'warning', 'abstract-recommended' FROM w WHERE trim(abstractText) = ''
UNION ALL SELECT doc_id, 14, 'warning', 'image-caption-warning' FROM w WHERE regexp_matches(editor_text, '(?i)!\[[^\]]*\]\(|<img\b|\bimagem\b|\[Imagem detectada:') AND NOT regexp_matches(editor_text, '(?i)\b(figura|imagem)\s+\d+|\blegenda\b')
UNION ALL SELECT doc_id, 15, 'warning', 'long-quote-warning' FROM w WHERE len(list_filter(string_split_regex(editor_text, '\n{{2,}}'), lambda p: length({_trim("p")}) > 450 AND regexp_matches(p, '\([A-ZÁÉÍÓÚÂÊÔÃÕÇ][^)]*,\s*(19|20)\d{{2}}') AND NOT starts_with({_trim("p")}, '>'))) > 0
UNION ALL SELECT doc_id, 16, 'warning', 'imported-image-warning' FROM w WHERE trim(imageWarnings) <> ''
UNION ALL SELECT doc_id, 17, 'warning', 'annex-image-partial' FROM w WHERE contains(anexos, '[Imagem detectada:')
UNION ALL SELECT doc_id, 18, 'warning', 'appendix-image-partial' FROM w WHERE contains(apendices, '[Imagem detectada:')"""
# the records' references are of four known shapes, so their issues follow from the shapes
_RECORD_REFS = rf"""
rr AS (SELECT doc_id, {_clean("raw")} AS text, CASE WHEN {_clean("raw")} LIKE 'SILVA%' THEN 'Obra' END AS highlight, CASE WHEN {_clean("raw")} LIKE 'BRASIL%' THEN 'legislacao' WHEN {_clean("raw")} LIKE 'SILVA%' THEN 'livro' ELSE 'desconhecido' END AS ref_type FROM ({_LINES.format("referencias")}) WHERE {_clean("raw")} <> '')"""
_ALL_ISSUES = f"""
WITH w AS ({_RECORDS}), {_RECORD_REFS},
ri AS ({_issues("rr", "doc_id")}),
al AS (SELECT doc_id, ordinal, severity, code, NULL::BIGINT AS n FROM ({_OWN_ISSUES}) UNION ALL
  SELECT doc_id, CASE code WHEN 'reference-too-short' THEN 7 WHEN 'reference-year-missing' THEN 8 WHEN 'reference-access-missing' THEN 9 WHEN 'reference-highlight-missing' THEN 10 ELSE 11 END, 'warning', code, n FROM ri)
"""
_COVER = rf"""
cv AS (SELECT doc_id, i, text, norm FROM b WHERE i BETWEEN 0 AND 19),
"""
_LOCATION = r"(norm IN ('LAVRAS', 'LAVRAS - MG') OR regexp_matches(norm, '^LAVRAS\b'))"
_GENERIC = f"(norm IN {_in(*V.GENERIC_COVER_LINES)} OR length(norm) < 2)"
_TERMS = "|".join(V.INSTITUTIONAL_TERMS)
_IS_YEAR = r"regexp_matches(text, '^(19|20)\d{2}$')"
_AUTHOR = rf"""
au AS (SELECT doc_id, arg_min(text, i) AS author, min(i) AS at, arg_min(norm, i) AS anorm FROM cv WHERE norm = 'NOME E SOBRENOME DO AUTOR' OR (NOT {_GENERIC} AND NOT {_LOCATION} AND NOT {_IS_YEAR} AND NOT regexp_matches(text, '[:;]|\d')
  AND NOT regexp_matches(norm, '\b(RESUMO|ABSTRACT|REFERENCIAS|INTRODUCAO|ANEXOS|APENDICES|SUMARIO)\b') AND NOT regexp_matches(upper(text), '{_TERMS}') AND len(string_split({_clean("text")}, ' ')) BETWEEN 2 AND 8) GROUP BY doc_id),"""
_KEYWORDS = rf"""
kk AS (SELECT b.doc_id, i, text, regexp_extract(text, '{{pattern}}', 1) AS words, row_number() OVER (PARTITION BY b.doc_id ORDER BY i) - 1 AS k, base, norm, block_type, level FROM b JOIN (SELECT doc_id, min(i) AS at FROM b WHERE base = '{{head}}' GROUP BY doc_id) s USING (doc_id) WHERE i > s.at),
ke AS (SELECT doc_id, min(i) AS at, arg_min(words, i) AS words FROM kk WHERE words <> '' OR {{stop}} GROUP BY doc_id),
kt AS (SELECT kk.doc_id, string_agg({_clean("text")}, chr(10) ORDER BY i) AS said FROM kk LEFT JOIN ke USING (doc_id) WHERE i < coalesce(ke.at, 1000000) GROUP BY kk.doc_id)
SELECT doc_id, coalesce(said, '') AS {{name}}, coalesce({_clean("words")}, '') AS keywords FROM works LEFT JOIN kt USING (doc_id) LEFT JOIN ke USING (doc_id)"""


def _keyword_query(name: str, head: str, pattern: str, stop: str) -> str:
    return _W + "," + _KEYWORDS.replace("{pattern}", pattern).replace("{head}", head).replace("{stop}", stop).replace("{name}", name)


_XML_TEXT = rf"""array_to_string(list_transform(regexp_extract_all(xml, '(?s)<w:t(\s[^>]*)?>.*?</w:t>|<w:tab\b[^>]*/>|<w:br\b[^>]*/>'), lambda t: CASE WHEN starts_with(t, '<w:tab') THEN ' ' WHEN starts_with(t, '<w:br') THEN chr(10) ELSE replace(replace(regexp_replace(regexp_replace(t, '^<w:t(\s[^>]*)?>', ''), '</w:t>$', ''), '&#233;', 'é'), '&amp;', '&') END), '')"""
_DOCX = rf"""
WITH w AS ({_WORD}),
el AS (SELECT doc_id, unnest(regexp_extract_all(regexp_extract(document_xml, '(?s)<w:body\b[^>]*>(.*?)</w:body>', 1), '(?s)<w:p\b.*?</w:p>|<w:tbl\b.*?</w:tbl>')) AS xml, unnest(range(0, len(regexp_extract_all(regexp_extract(document_xml, '(?s)<w:body\b[^>]*>(.*?)</w:body>', 1), '(?s)<w:p\b.*?</w:p>|<w:tbl\b.*?</w:tbl>')))) AS k FROM w),
tx AS (SELECT doc_id, k, xml, starts_with(xml, '<w:tbl') AS tbl, {_trim(_XML_TEXT)} AS text FROM el),
hd AS (SELECT *, {_fold("text")} AS norm, CASE WHEN tbl OR text = '' THEN NULL WHEN contains(xml, 'pStyle') THEN 1 WHEN regexp_matches({_fold("text")}, '^\d+(\.\d+)*\s+\S+') THEN len(string_split(regexp_extract({_fold("text")}, '^(\d+(\.\d+)*)\s+\S+', 1), '.')) WHEN {_fold("text")} IN ('RESUMO', 'REFERENCIAS') THEN 1 END::BIGINT AS level FROM tx),
sc AS (SELECT *, coalesce(last_value(CASE WHEN level IS NULL THEN NULL WHEN norm = 'REFERENCIAS' THEN 'post-textual' WHEN regexp_matches(norm, '^\d+(\.\d+)*\s+\S+') THEN 'textual' WHEN norm = 'RESUMO' THEN 'pre-textual' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'pre-textual') AS section FROM hd),
bl AS (
  SELECT doc_id, k, 0 AS m, CASE WHEN level IS NOT NULL THEN 'heading' WHEN coalesce(try_cast(regexp_extract(xml, 'w:left="(\d+)"', 1) AS BIGINT), 0) >= 2200 THEN 'longQuote' ELSE 'paragraph' END AS block_type, level, text, section FROM sc WHERE NOT tbl AND text <> ''
  UNION ALL SELECT doc_id, k, 0, 'table', NULL, concat('a', chr(9), doc_id), section FROM sc WHERE tbl
  UNION ALL SELECT doc_id, k, 1, 'image', NULL, concat('[Imagem detectada: ', regexp_extract(xml, 'r:embed="([^"]+)"', 1), ']'), section FROM sc WHERE regexp_extract(xml, 'r:embed="([^"]+)"', 1) IN ('rId1', 'rId2')
  UNION ALL SELECT doc_id, k, 2, 'pageBreak', NULL, '', '-' FROM sc WHERE contains(xml, 'w:type="page"'))
"""

ORACLE: dict[str, str] = {
    "fold_upper": f"SELECT doc_id, md5({_fold('text')}) AS folded FROM documents",
    "fold_lower": "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents",
    "clean_values": rf"""SELECT doc_id, md5({_clean("text")}) AS cleaned,
      md5({_trim(r"regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g'), '[ \t]{2,}', ' ', 'g')")}) AS kept_lines,
      md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_clean("x")}), lambda x: x <> ''), chr(10))) AS joined,
      md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped, length({_trim("text")}) > 0 AS filled FROM documents""",
    "inline_markup": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g')) AS plain,
      md5(regexp_replace(regexp_replace(regexp_replace(text, '^#{1,2}\s+', ''), '^>\s+', ''), '(?i)^\[REF\]\s+', '')) AS unmarked FROM documents""",
    "lines_split": f"WITH {_blocks('documents')} SELECT doc_id, i AS block_idx, block_type, level, text FROM b",
    "long_paragraphs": rf"""SELECT doc_id, len(list_filter(string_split_regex(text, '\n{{2,}}'), lambda p: length({_trim("p")}) > 450 AND regexp_matches(p, '\([A-ZÁÉÍÓÚÂÊÔÃÕÇ][^)]*,\s*(19|20)\d{{2}}') AND NOT starts_with({_trim("p")}, '>'))) > 0 AS long_quote,
      regexp_matches(text, '(?i)!\[[^\]]*\]\(|<img\b|\bimagem\b|\[Imagem detectada:') AND NOT regexp_matches(text, '(?i)\b(figura|imagem)\s+\d+|\blegenda\b') AS no_caption,
      regexp_matches(text, 'sk-[A-Za-z0-9]{{20,}}') OR regexp_matches(text, '(?i)api[_-]?key\s*[:=]\s*["''][^"'']{{12,}}') OR regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') AS secret FROM documents""",
    "ref_split": f"WITH w AS ({_RECORDS}), x AS ({_LINES.format('referencias')}) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ref_idx, {_clean('raw')} AS original FROM x WHERE {_clean('raw')} <> ''",
    "ref_type": _R + "SELECT doc_id, ref_key, ref_type, confidence FROM q",
    "ref_highlight": _R + "SELECT doc_id, ref_key, text, highlight FROM q",
    "ref_warnings": _R
    + rf"""SELECT ref_key, 'short' AS warning FROM q WHERE length(text) < 25 UNION ALL SELECT ref_key, 'no-year' FROM q WHERE NOT {_YEAR}
      UNION ALL SELECT ref_key, 'no-access-date' FROM q WHERE regexp_matches(folded, '(https?://|disponivel em:)') AND NOT contains(folded, 'acesso em:')
      UNION ALL SELECT ref_key, CASE ref_type WHEN 'legislacao' THEN 'normative-kept' WHEN 'desconhecido' THEN 'title-not-found' WHEN 'tese-dissertacao' THEN 'academic-kept' ELSE 'institutional-kept' END FROM q WHERE ref_type IN ('legislacao', 'desconhecido') OR (ref_type IN ('tese-dissertacao', 'documento-institucional') AND found IS NULL)
      UNION ALL SELECT ref_key, 'no-highlight' FROM q WHERE highlight IS NULL""",
    "ref_runs": _R.rstrip() + "," + _RUN_PIECES,
    "ref_issue_counts": _R.rstrip() + f", z AS ({_issues('q', 'doc_id')}) SELECT doc_id, code, n FROM z",
    "section_carry": _W
    + rf""", o AS (SELECT doc_id, i, CASE WHEN block_type <> 'heading' THEN NULL WHEN base IN ('REFERENCIAS', 'ANEXOS', 'ANEXO', 'APENDICES', 'APENDICE') OR regexp_matches(base, '^(ANEXO|APENDICE)\s+[A-Z0-9]') THEN 'post-textual'
      WHEN base IN ('INTRODUCAO', 'CONCLUSAO', 'CONSIDERACOES FINAIS') OR regexp_matches(norm, '^\d+(\.\d+)*\s+\S+') THEN 'textual' WHEN base IN ('RESUMO', 'ABSTRACT') THEN 'pre-textual' END AS s FROM b)
      SELECT doc_id, i AS block_idx, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'pre-textual') AS section FROM o""",
    "section_span_resumo": _keyword_query("resumo", "RESUMO", r"(?i)^palavras[- ]chave\s*[:\-]\s*(.+)$", f"base IN ('ABSTRACT', 'SUMARIO') OR ({_PRIMARY} AND k > 0)"),
    "section_span_abstract": _keyword_query("abstract", "ABSTRACT", r"(?i)^keywords\s*[:\-]\s*(.+)$", "base IN ('INDICADORES DE IMPACTO', 'IMPACT INDICATORS', 'SUMARIO', 'INTRODUCAO')"),
    "section_span_intro": _W + "," + _span("introduction", "base = 'INTRODUCAO'", rf"regexp_matches(norm, '^2\s+\S+') OR {_REF} OR {_ANNEX} OR {_APPENDIX}"),
    "section_span_conclusion": _W + "," + _span("conclusion", "base IN ('CONCLUSAO', 'CONSIDERACOES FINAIS')", _REF),
    "section_span_refs": _W + "," + _span("reference_list", _REF, f"{_ANNEX} OR {_APPENDIX}"),
    "annex_after_refs": f"SELECT doc_id, annexes, appendices FROM ({_W}, {_span('annexes', _ANNEX, _APPENDIX, True)}) JOIN ({_W}, {_span('appendices', _APPENDIX, _ANNEX, True)}) USING (doc_id)",
    "editor_seed_text": _W
    + rf""", s AS (SELECT doc_id, min(i) AS at FROM b WHERE base = 'INTRODUCAO' GROUP BY doc_id), e AS (SELECT b.doc_id, min(i) AS at FROM b JOIN s USING (doc_id) WHERE i >= s.at AND ({_REF} OR {_ANNEX} OR {_APPENDIX}) GROUP BY b.doc_id),
      x AS (SELECT b.doc_id, string_agg(CASE WHEN block_type = 'heading' THEN CASE WHEN level <= 1 THEN '# ' ELSE '## ' END ELSE '' END || text, chr(10) || chr(10) ORDER BY i) AS said FROM b JOIN s USING (doc_id) LEFT JOIN e USING (doc_id) WHERE i >= s.at AND i < coalesce(e.at, 1000000) GROUP BY b.doc_id)
      SELECT doc_id, coalesce(said, '') AS editor_text FROM works LEFT JOIN x USING (doc_id)""",
    "cover_year": _W
    + ","
    + _COVER
    + rf"""lb AS (SELECT doc_id, arg_min(regexp_extract(text, '(?i)^\s*ano\s*[:\-]\s*((?:19|20)\d{{2}})\s*$', 1), i) AS y FROM cv WHERE regexp_matches(text, '(?i)^\s*ano\s*[:\-]\s*((?:19|20)\d{{2}})\s*$') GROUP BY doc_id),
      ca AS (SELECT doc_id, arg_max(regexp_extract_all(text, '\b(?:19|20)\d{{2}}\b')[-1], i) AS y, arg_max(text, i) AS t FROM cv WHERE regexp_matches(text, '\b(?:19|20)\d{{2}}\b') AND NOT regexp_matches(text, '(?i)\b(refer[êe]ncias?|doi|https?://|www\.|dispon[ií]vel em|acesso em|lei|decreto|portaria|resolu[cç][aã]o|cita[cç][aã]o)\b') GROUP BY doc_id)
      SELECT doc_id, coalesce(lb.y, ca.y, '2026') AS year, CASE WHEN lb.y IS NOT NULL OR ca.t = ca.y THEN 'alta' WHEN ca.y IS NOT NULL THEN 'media' ELSE 'baixa' END AS confidence FROM works LEFT JOIN lb USING (doc_id) LEFT JOIN ca USING (doc_id)""",
    "cover_author": _W
    + ","
    + _COVER
    + _AUTHOR.rstrip(",")
    + " SELECT doc_id, coalesce(author, '') AS author, coalesce(n, 0) AS times FROM works LEFT JOIN au USING (doc_id) LEFT JOIN (SELECT b.doc_id, count(*) AS n FROM b JOIN au ON b.doc_id = au.doc_id AND b.norm = au.anorm GROUP BY b.doc_id) USING (doc_id)",
    "cover_title": _W
    + ","
    + _COVER
    + _AUTHOR
    + rf"""st AS (SELECT doc_id, coalesce(au.at, -1) AS at FROM works LEFT JOIN au USING (doc_id)), en AS (SELECT cv.doc_id, min(i) AS at FROM cv JOIN st USING (doc_id) WHERE i > st.at AND ({_LOCATION} OR {_IS_YEAR}) GROUP BY cv.doc_id),
      x AS (SELECT cv.doc_id, string_agg(text, ' ' ORDER BY i) AS said FROM cv JOIN st USING (doc_id) LEFT JOIN en USING (doc_id) WHERE i > st.at AND i < coalesce(en.at, 1000000) AND NOT {_GENERIC} GROUP BY cv.doc_id)
      SELECT doc_id, coalesce({_clean("said")}, '') AS title FROM works LEFT JOIN x USING (doc_id)""",
    "label_lookup": f"WITH works AS ({_WORKS}) SELECT doc_id, {_label('autor(?:a)?|discente|aluno(?:a)?')} AS author, {_label('t[íi]tulo')} AS title, {_label('subt[íi]tulo')} AS subtitle, {_label('curso')} AS course, {_label('programa')} AS program, {_label('local|cidade')} AS location, {_label('orientador(?:a)?')} AS advisor, {_label('coorientador(?:a)?')} AS coadvisor FROM works",
    "next_line_label": _W
    + rf""", x AS (SELECT doc_id, i, text, norm, lead(text) OVER o AS nt, lead(base) OVER o AS nb FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
      y AS (SELECT doc_id, arg_min(CASE WHEN regexp_matches(norm, '^ORIENTADORA?:') THEN {_clean("substr(text, strpos(text, ':') + 1)")} ELSE {_clean("nt")} END, i) AS advisor FROM x WHERE regexp_matches(norm, '^ORIENTADORA?:') OR (norm IN ('ORIENTADOR', 'ORIENTADORA') AND nt IS NOT NULL AND nb NOT IN ('ORIENTADOR', 'ORIENTADORA')) GROUP BY doc_id)
      SELECT doc_id, coalesce(advisor, '') AS advisor FROM works LEFT JOIN y USING (doc_id)""",
    "work_type": rf"WITH works AS ({_WORKS}), x AS (SELECT doc_id, {_fold('text')} AS t FROM works) SELECT doc_id, CASE WHEN regexp_matches(t, '\bTESE\b') THEN 'tese' WHEN regexp_matches(t, '\bDISSERTACAO\b') THEN 'dissertacao' WHEN regexp_matches(t, '\bMONOGRAFIA\b|\bTCC\b') THEN 'monografia' WHEN regexp_matches(t, '\bARTIGO\b') THEN 'artigo' ELSE '' END AS work_type FROM x",
    "work_issues": _ALL_ISSUES + "SELECT doc_id, ordinal::BIGINT AS ordinal, severity, code, n FROM al",
    "blocking_works": _ALL_ISSUES + "SELECT doc_id, bool_or(severity = 'error') AS blocking, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM al GROUP BY doc_id",
    "editor_blocks": _E + " SELECT doc_id, idx, type, text FROM ed",
    "body_blocks": _E
    + rf""", hs AS (SELECT doc_id, coalesce(bool_or(type IN ('heading1', 'heading2') AND contains({_fold("text")}, 'INTRODUCAO')), false) AS opened, coalesce(bool_or(type IN ('heading1', 'heading2') AND {_base(_fold("text"))} IN ('CONCLUSAO', 'CONSIDERACOES FINAIS')), false) AS closed FROM ed GROUP BY doc_id),
      al AS (SELECT doc_id, 0 AS part, 0 AS k, 'heading1' AS type, '1 INTRODUÇÃO' AS text FROM w JOIN hs USING (doc_id) WHERE introducao <> '' AND NOT opened
        UNION ALL SELECT doc_id, 0, k, 'paragraph', trim(raw) FROM ({_LINES.format("introducao")}) JOIN hs USING (doc_id) WHERE NOT opened AND trim(raw) <> ''
        UNION ALL SELECT doc_id, 1, idx, type, text FROM ed WHERE type <> 'reference'
        UNION ALL SELECT doc_id, 2, 0, 'heading1', 'CONCLUSÃO' FROM w JOIN hs USING (doc_id) WHERE conclusao <> '' AND NOT closed
        UNION ALL SELECT doc_id, 2, k, 'paragraph', trim(raw) FROM ({_LINES.format("conclusao")}) JOIN hs USING (doc_id) WHERE NOT closed AND trim(raw) <> '')
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, k) - 1 AS idx, type, text FROM al""",
    "ref_union": _E + f", al AS (SELECT doc_id, 0 AS part, k, trim(raw) AS text FROM ({_LINES.format('referencias')}) WHERE trim(raw) <> '' UNION ALL SELECT doc_id, 1, idx, text FROM ed WHERE type = 'reference') SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, k) - 1 AS idx, text AS reference FROM al",
    "start_page": f"WITH w AS ({_RECORDS}) SELECT doc_id, true AS has_summary, (5 + (trim(dedicatoria) <> '')::INT + (trim(agradecimentos) <> '')::INT + (trim(epigrafe) <> '')::INT + (trim(indicadoresImpacto) <> '' OR work_type IN ('tese', 'dissertacao'))::INT + (trim(impactIndicators) <> '' OR work_type IN ('tese', 'dissertacao'))::INT)::BIGINT AS start_page FROM w",
    "safe_file_name": rf"WITH w AS ({_RECORDS}), x AS (SELECT doc_id, lower(regexp_replace(regexp_replace(strip_accents(title), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS n FROM w) SELECT doc_id, CASE WHEN n = '' THEN 'trabalho' ELSE n END || '.docx' AS file_name FROM x",
    "docx_blocks": _DOCX + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, m) - 1 AS block_idx, block_type, level, text, section FROM bl",
    "docx_text": _DOCX + "SELECT doc_id, string_agg(text, chr(10) ORDER BY k, m) FILTER (block_type <> 'pageBreak') AS text, doc_id % 2 = 0 AS has_numbering FROM bl GROUP BY doc_id",
}


def _style_marks(paragraph: str, run: str) -> dict[str, str]:
    """The marks that the XML inside a pPr and an rPr sets."""
    got = lambda x, pattern: f"nullif(regexp_extract({x}, '{pattern}', 1), '')"
    switch = lambda tag: f"CASE WHEN regexp_matches({run}, '<w:{tag}[ />]') THEN NOT regexp_matches({run}, '<w:{tag} w:val=\"(false|0|none)\"') END"
    return {
        "indent": f"""CAST({got(paragraph, '<w:ind [^>]*w:(?:left|start)="(-?[0-9]+)"')} AS BIGINT)""",
        "first_line": f"""coalesce(-CAST({got(paragraph, 'w:hanging="([0-9]+)"')} AS BIGINT), CAST({got(paragraph, 'w:firstLine="([0-9]+)"')} AS BIGINT))""",
        "above": f"""CAST({got(paragraph, 'w:before="([0-9]+)"')} AS BIGINT)""",
        "after": f"""CAST({got(paragraph, 'w:after="([0-9]+)"')} AS BIGINT)""",
        "line": f"""CAST({got(paragraph, 'w:line="([0-9]+)"')} AS BIGINT)""",
        "line_rule": got(paragraph, 'w:lineRule="([a-z]+)"'),
        "align": got(paragraph, '<w:jc w:val="([a-z]+)"'),
        "page_before": f"""CASE WHEN contains({paragraph}, 'pageBreakBefore') THEN NOT contains({paragraph}, 'pageBreakBefore w:val="0"') END""",
        "font": got(run, '<w:rFonts [^>]*w:(?:ascii|hAnsi)="([^"]+)"'),
        "size": f"""CAST({got(run, '<w:sz w:val="([0-9]+)"')} AS BIGINT)""",
        "bold": switch("b"),
        "italic": switch("i"),
        "underline": switch("u"),
        "color": f"""upper({got(run, '<w:color w:val="([0-9A-Za-z]+)"')})""",
    }


_MARKS = tuple(_style_marks("p", "r"))
_PLAIN_MARKS = {"indent": "0", "first_line": "0", "above": "0", "after": "0", "line": "240", "line_rule": "'auto'", "align": "'left'", "page_before": "false", "font": "'Times New Roman'", "size": "20", "bold": "false", "italic": "false", "underline": "false", "color": "'auto'"}
_OWN_MARKS = ", ".join(f"{sql} AS {m}" for m, sql in _style_marks("p", "r").items())
_ELEMENTS = r"regexp_extract_all(regexp_extract(document_xml, '(?s)<w:body>(.*?)</w:body>', 1), '(?s)<w:p>.*?</w:p>|<w:tbl>.*?</w:tbl>')"


def _looks(values: str, at: str) -> str:
    """Each mark of a style from the nearest that sets it, up the chain."""
    return ", ".join(f"arg_min(a.{m}, {at}) FILTER (a.{m} IS NOT NULL) AS {m}" for m in _MARKS)


#: Style chains walked up by recursion; a style met again ends its chain.
_STYLED = rf"""
WITH RECURSIVE w AS ({inputs.duckdb(inputs.STYLED_FILES)}),
sheets AS (SELECT DISTINCT md5(styles_xml) AS sheet, styles_xml FROM w),
tags AS (SELECT sheet, unnest(regexp_extract_all(styles_xml, '(?s)<w:style .*?</w:style>')) AS x, unnest(range(len(regexp_extract_all(styles_xml, '(?s)<w:style .*?</w:style>')))) AS k FROM sheets),
named AS (SELECT sheet, k, regexp_extract(x, 'w:styleId="([^"]+)"', 1) AS id, regexp_extract(x, '<w:name w:val="([^"]+)"', 1) AS name, nullif(regexp_extract(x, '<w:basedOn w:val="([^"]+)"', 1), '') AS up, contains(x, 'w:default="1"') AS standard,
  regexp_extract(x, '(?s)<w:pPr>(.*?)</w:pPr>', 1) AS p, regexp_extract(x, '(?s)<w:rPr>(.*?)</w:rPr>', 1) AS r FROM tags),
st AS (SELECT sheet, id, name, up, standard, {_OWN_MARKS} FROM named QUALIFY row_number() OVER (PARTITION BY sheet, id ORDER BY k DESC) = 1),
chain AS (SELECT sheet, id, id AS above, up, 0 AS far, [id] AS path FROM st
  UNION ALL SELECT c.sheet, c.id, s.id, s.up, c.far + 1, list_append(c.path, s.id) FROM chain c JOIN st s ON s.sheet = c.sheet AND s.id = c.up WHERE NOT list_contains(c.path, s.id)),
eff AS (SELECT c.sheet, c.id, any_value(a.name) FILTER (c.far = 0) AS name, bool_or(a.standard) FILTER (c.far = 0) AS standard, {_looks("a", "c.far")} FROM chain c JOIN st a ON a.sheet = c.sheet AND a.id = c.above GROUP BY c.sheet, c.id),
base AS (SELECT sheet, {_OWN_MARKS} FROM (SELECT sheet, regexp_extract(styles_xml, '(?s)<w:pPrDefault><w:pPr>(.*?)</w:pPr>', 1) AS p, regexp_extract(styles_xml, '(?s)<w:rPrDefault><w:rPr>(.*?)</w:rPr>', 1) AS r FROM sheets)),
els AS (SELECT doc_id, md5(styles_xml) AS sheet, unnest({_ELEMENTS}) AS xml, unnest(range(len({_ELEMENTS}))) AS idx FROM w),
par AS (SELECT doc_id, sheet, idx, xml, nullif(regexp_extract(xml, '<w:pStyle w:val="([^"]+)"', 1), '') AS asked, regexp_replace(regexp_extract(xml, '(?s)<w:pPr>(.*?)</w:pPr>', 1), '(?s)<w:rPr>.*?</w:rPr>', '') AS p, '' AS r FROM els WHERE NOT starts_with(xml, '<w:tbl')),
own AS (SELECT *, {_OWN_MARKS} FROM par),
pf AS (SELECT o.doc_id, o.sheet, o.idx, o.xml, o.asked, coalesce(e.id, d.id) AS style_id, coalesce(e.name, d.name) AS style_name, {", ".join(f"coalesce(o.{m}, CASE WHEN e.id IS NOT NULL THEN e.{m} ELSE d.{m} END, b.{m}, {plain}) AS {m}" for m, plain in _PLAIN_MARKS.items())}
  FROM own o JOIN base b USING (sheet) LEFT JOIN eff e ON e.sheet = o.sheet AND e.id = o.asked LEFT JOIN eff d ON d.sheet = o.sheet AND d.standard),
rx AS (SELECT *, regexp_extract_all(regexp_replace(xml, '(?s)<w:pPr>.*?</w:pPr>', ''), '(?s)<w:r>.*?</w:r>') AS rs FROM pf),
rr AS (SELECT doc_id, sheet, idx, unnest(rs) AS x, unnest(range(len(rs))) AS run_idx, {", ".join(f"{m} AS under_{m}" for m in ("font", "size", "bold", "italic", "underline", "color"))} FROM rx),
rt AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x, '<w:tab/>', ' ', 'g'), '(?s)<w:rPr>.*?</w:rPr>', ''), '<[^>]+>', '', 'g') AS text, nullif(regexp_extract(x, '<w:rStyle w:val="([^"]+)"', 1), '') AS char_style, '' AS p, regexp_extract(x, '(?s)<w:rPr>(.*?)</w:rPr>', 1) AS r FROM rr),
ro AS (SELECT *, {_OWN_MARKS} FROM rt WHERE text <> ''),
rf AS (SELECT o.doc_id, o.idx, o.run_idx, coalesce(sum(length(o.text)) OVER (PARTITION BY o.doc_id, o.idx ORDER BY o.run_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, o.text,
  {", ".join(f"coalesce(o.{m}, e.{m}, o.under_{m}) AS {m}" for m in ("font", "size", "bold", "italic", "underline", "color"))} FROM ro o LEFT JOIN eff e ON e.sheet = o.sheet AND e.id = o.char_style),
lk AS (SELECT doc_id, idx, list_sort(list_distinct(list(font))) AS fonts, list_sort(list_distinct(list(size))) AS sizes, list_sort(list_distinct(list(color))) AS colors, bool_and(bold) AS all_bold, {_trim("string_agg(text, '' ORDER BY run_idx)")} AS text FROM rf GROUP BY doc_id, idx),
fo AS (SELECT pf.* EXCLUDE (bold), lk.* EXCLUDE (doc_id, idx), {_fold("text")} AS norm, {_fold("concat(coalesce(asked, pf.style_id, ''), ' ', coalesce(style_name, ''))")} AS style FROM pf JOIN lk USING (doc_id, idx) WHERE lk.text <> ''),
le AS (SELECT *, CASE WHEN regexp_matches(style, '\b(HEADING|TITULO) ?1\b') OR regexp_matches(norm, '^\d+\s+\S+') OR norm IN ('RESUMO', 'REFERENCIAS') THEN 1 END AS level,
  regexp_matches(style, 'CITACAO|QUOTE') OR coalesce(try_cast(regexp_extract(xml, '<w:ind w:left="(\d+)"', 1) AS BIGINT), 0) >= 2200 OR (length(text) > 450 AND regexp_matches(text, '\([A-Z][^)]*,\s*(19|20)\d\d')) AS quote FROM fo),
ki AS (SELECT *, CASE WHEN level IS NOT NULL THEN 'heading' WHEN quote THEN 'longQuote' ELSE 'paragraph' END AS kind,
  coalesce(last_value(CASE WHEN level IS NOT NULL THEN regexp_replace(norm, '^\d+(\.\d+)*\s+', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING), '') AS part FROM le),
ju AS (SELECT *, CASE WHEN line_rule = 'auto' THEN line ELSE -line END AS spacing, part IN ('RESUMO', 'ABSTRACT', 'REFERENCIAS') AS single,
  array_to_string(list_filter(fonts, lambda f: lower(f) NOT IN ({", ".join(f"'{f.lower()}'" for f in V.SERIF_FONTS)})), ' ') AS odd_fonts,
  array_to_string(list_filter(sizes, lambda z: z <> 22), ' ') AS not_11, array_to_string(list_filter(sizes, lambda z: z <> 24), ' ') AS not_12, array_to_string(list_filter(colors, lambda c: c NOT IN ('auto', '000000')), ' ') AS odd_colors FROM ki)
"""

ORACLE |= {
    "style_sheets": _STYLED + f"SELECT sheet, id AS style_id, name AS style_name, {', '.join(_MARKS)} FROM eff",
    "run_formats": _STYLED + "SELECT * FROM rf",
    "imported_marks": _STYLED
    + """, mk AS (SELECT rf.doc_id, rf.idx, rf.run_idx, rf.text, CASE WHEN trim(rf.text) = '' THEN '' WHEN rf.bold AND NOT pf.bold THEN '**' WHEN rf.italic AND NOT pf.italic THEN '*' ELSE '' END AS mark FROM rf JOIN pf USING (doc_id, idx)),
      gp AS (SELECT *, count(*) FILTER (mark <> before) OVER (PARTITION BY doc_id, idx ORDER BY run_idx) AS g FROM (SELECT *, lag(mark, 1, mark) OVER (PARTITION BY doc_id, idx ORDER BY run_idx) AS before FROM mk)),
      sg AS (SELECT doc_id, idx, g, mark, string_agg(text, '' ORDER BY run_idx) AS text FROM gp GROUP BY doc_id, idx, g, mark)
      SELECT doc_id, idx, string_agg(CASE mark WHEN '' THEN text ELSE regexp_extract(text, '^( *)', 1) || mark || trim(text) || mark || regexp_extract(text, '( *)$', 1) END, '' ORDER BY g) AS marked, coalesce(string_agg(trim(text), '|' ORDER BY g) FILTER (mark <> ''), '') AS marks_read FROM sg GROUP BY doc_id, idx""",
    "paragraph_formats": _STYLED
    + "SELECT doc_id, idx, style_id, kind, part, indent, first_line, line, line_rule, align, page_before, all_bold AS bold, array_to_string(fonts, ' ') AS fonts, array_to_string(sizes, ' ') AS sizes, array_to_string(colors, ' ') AS colors FROM ki",
    "format_breaches": _STYLED
    + r""", told AS (SELECT doc_id, idx, unnest([CASE WHEN kind = 'longQuote' AND indent < 2200 THEN {'rule': 29, 'found': indent::VARCHAR} END, CASE WHEN kind = 'longQuote' AND not_11 <> '' THEN {'rule': 30, 'found': not_11} END,
      CASE WHEN kind = 'longQuote' AND spacing <> 240 THEN {'rule': 31, 'found': spacing::VARCHAR} END, CASE WHEN kind = 'paragraph' AND NOT single AND spacing <> 360 THEN {'rule': 32, 'found': spacing::VARCHAR} END,
      CASE WHEN kind = 'paragraph' AND single AND spacing <> 240 THEN {'rule': 33, 'found': spacing::VARCHAR} END, CASE WHEN kind = 'heading' AND NOT all_bold THEN {'rule': 35, 'found': 'false'} END,
      CASE WHEN level = 1 AND NOT page_before AND idx > 0 THEN {'rule': 36, 'found': 'false'} END, CASE WHEN odd_colors <> '' THEN {'rule': 46, 'found': odd_colors} END, CASE WHEN odd_fonts <> '' THEN {'rule': 48, 'found': odd_fonts} END,
      CASE WHEN kind <> 'longQuote' AND not_12 <> '' THEN {'rule': 49, 'found': not_12} END]) AS t FROM ju)
    SELECT doc_id, idx, t.rule::BIGINT AS rule, t.found AS found FROM told WHERE t IS NOT NULL
    UNION ALL SELECT doc_id, 0, 47, concat_ws(',', t, l, b, r) FROM (SELECT doc_id, regexp_extract(document_xml, 'w:top="(\d+)"', 1)::BIGINT AS t, regexp_extract(document_xml, 'w:left="(\d+)"/></w:sectPr>', 1)::BIGINT AS l, 1134 AS b, 1134 AS r FROM w) WHERE abs(t - 1701) > 6 OR abs(l - 1701) > 6""",
}


def _values(rows: list[tuple], names: str) -> str:
    """A literal table."""
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names}))"


def _ref_models() -> str:
    """Cues, weights and fields as tables: texts joined to the cues they hold, weights summed, the first of a ranking taken."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    held = ", ".join(f"CASE WHEN regexp_matches(folded, {quoted(p)}) THEN '{c}' END" for c, p in V.MODEL_CUES.items())
    weights = _values([(k, m, c, w) for k, (m, ws) in enumerate(V.MODEL_WEIGHTS.items()) for c, w in ws.items()], "place, model, cue, weight")
    models = _values([(k, m) for k, m in enumerate(V.MODEL_WEIGHTS)], "place, model")
    needs = _values([(m, f) for m, fs in V.MODEL_NEEDS.items() for f in fs], "model, field")
    names = list(V.MODEL_FIELDS)

    def read(text: str, of: str, fields: list[str]) -> str:
        one = lambda f, k, w, p, ms: f"{{'field': '{f}', 'rank': {w * 100 - k}, 'value': {'CASE WHEN model IN (' + ', '.join(map(quoted, ms)) + ') THEN ' if ms else ''}nullif({_trim(f'regexp_extract({text}, {quoted(p)}, 1)')}, ''){' END' if ms else ''}}}"
        alternatives = ", ".join(one(f, k, w, p, ms) for f in fields for k, (w, p, ms) in enumerate(V.MODEL_FIELDS[f]))
        return f"SELECT ref_key, x.field AS field, arg_max(x.value, x.rank) AS value FROM (SELECT ref_key, unnest([{alternatives}]) AS x FROM {of}) WHERE x.value IS NOT NULL GROUP BY ref_key, x.field"

    return rf"""
WITH refs AS ({inputs.duckdb(inputs.MODEL_REFERENCES)}), weights AS {weights}, models AS {models}, needs AS {needs},
tx AS (SELECT doc_id, ref_key, {_clean("replace(original, '*', '')")} AS text FROM refs),
held AS (SELECT ref_key, unnest([{held}]) AS cue FROM (SELECT ref_key, lower(strip_accents(text)) AS folded FROM tx)),
hits AS (SELECT ref_key, place, sum(weight) AS score FROM held JOIN weights USING (cue) GROUP BY ref_key, place),
sums AS (SELECT ref_key, m.model, m.place, coalesce(h.score, 0)::BIGINT AS score FROM tx CROSS JOIN models m LEFT JOIN hits h USING (ref_key, place)),
ranked AS (SELECT *, row_number() OVER o AS r, score - lead(score) OVER o AS ahead FROM sums WINDOW o AS (PARTITION BY ref_key ORDER BY score DESC, place)),
first AS (SELECT tx.*, score, ahead, CASE WHEN score >= {V.LEAST_MODEL_SCORE} THEN model ELSE 'desconhecido' END AS model FROM tx JOIN ranked USING (ref_key) WHERE r = 1),
authors AS ({read("text", "first", ["author"])}),
best AS (SELECT f.*, a.value AS author, {_trim(r"regexp_replace(substring(text, length(coalesce(a.value, '')) + 1), '^\.', '')")} AS rest FROM first f LEFT JOIN authors a USING (ref_key)),
found AS (SELECT * FROM authors UNION ALL {read("rest", "best", [f for f in names if f != "author"])}),
told AS (SELECT ref_key, 'missing-' || field AS w FROM best JOIN needs USING (model) ANTI JOIN found USING (ref_key, field) UNION ALL SELECT ref_key, 'model-unknown' FROM best WHERE model = 'desconhecido' UNION ALL SELECT ref_key, 'model-unsure' FROM best WHERE model <> 'desconhecido' AND ahead = 0),
wide AS (SELECT ref_key, {", ".join(f"any_value(value) FILTER (field = '{f}') AS {f}" for f in names)} FROM found GROUP BY ref_key),
warned AS (SELECT ref_key, string_agg(w, ' ' ORDER BY w) AS model_warnings FROM told GROUP BY ref_key)
SELECT doc_id, ref_key, text, model, greatest(score, 0) AS score, ahead AS lead, {", ".join(f"wide.{f}" for f in names)}, coalesce(model_warnings, '') AS model_warnings
FROM best LEFT JOIN wide USING (ref_key) LEFT JOIN warned USING (ref_key)"""


ORACLE["ref_models"] = _ref_models()


_ENTRY = r"'^(.*?\S)\s*(?:\.{3,}|…|\t|\s{2,})\s*(\d{1,4})$'"
#: The longest increasing run of headings' places is grown entry by entry by recursion.
_CHOICE = "list_sort([{{'length': c.length, 'spot': -c.spot, 'path': c.path}} for c in {chains} if {able}], 'DESC')[1]"
ORACLE["summary_findings"] = rf"""
WITH RECURSIVE w AS ({inputs.duckdb(inputs.SUMMARY_WORKS)}),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w),
ln AS (SELECT doc_id, i, {_trim("line")} AS text, {_fold("line")} AS norm, {_base(_fold("line"))} AS base FROM raw WHERE {_trim("line")} <> ''),
st AS (SELECT doc_id, min(i) AS at FROM ln WHERE base = 'SUMARIO' GROUP BY doc_id),
sp AS (SELECT l.doc_id, min(i) AS at FROM ln l JOIN st USING (doc_id) WHERE i > st.at AND NOT regexp_matches(text, {_ENTRY}) GROUP BY l.doc_id),
e0 AS (SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY i) - 1 AS k, {_trim(f"regexp_extract(text, {_ENTRY}, 1)")} AS text, regexp_extract(text, {_ENTRY}, 2)::INT AS page FROM ln l JOIN st USING (doc_id) LEFT JOIN sp USING (doc_id) WHERE i > st.at AND i < coalesce(sp.at, 1000000)),
h0 AS (SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY i) - 1 AS k, text, norm FROM ln l LEFT JOIN sp USING (doc_id) WHERE (sp.at IS NULL OR i >= sp.at) AND (regexp_matches(norm, '^\d+(\.\d+)*\s+\S+') OR base IN ('RESUMO', 'ABSTRACT', 'REFERENCIAS', 'ANEXOS', 'APENDICES', 'INTRODUCAO', 'CONCLUSAO', 'CONSIDERACOES FINAIS'))),
e AS (SELECT *, {_fold("text")} AS key, row_number() OVER (PARTITION BY doc_id, {_fold("text")} ORDER BY k) AS nth, lag(page) OVER (PARTITION BY doc_id ORDER BY k) AS above FROM e0),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY k) AS nth FROM h0),
m AS (SELECT e.doc_id, e.k, h.k AS place FROM e JOIN h ON h.doc_id = e.doc_id AND h.norm = e.key AND h.nth = e.nth),
sq AS (SELECT doc_id, list(place ORDER BY k) AS places, list(k ORDER BY k) AS ks FROM m GROUP BY doc_id),
grown AS (SELECT doc_id, 0 AS i, CAST([] AS STRUCT(length BIGINT, place BIGINT, spot BIGINT, path BIGINT[])[]) AS chains FROM sq
  UNION ALL SELECT g.doc_id, g.i + 1, list_append(g.chains, {{'length': coalesce(x.b.length, 0) + 1, 'place': x.next, 'spot': g.i::BIGINT, 'path': list_append(coalesce(x.b.path, []), g.i::BIGINT)}})
  FROM grown g JOIN sq ON sq.doc_id = g.doc_id, LATERAL (SELECT sq.places[g.i + 1] AS next, {_CHOICE.format(chains="g.chains", able="c.place < sq.places[g.i + 1]")} AS b) x WHERE g.i < len(sq.places)),
kept AS (SELECT g.doc_id, unnest({_CHOICE.format(chains="g.chains", able="true")}.path) AS i FROM grown g JOIN sq USING (doc_id) WHERE g.i = len(sq.places)),
ok AS (SELECT kept.doc_id, sq.ks[kept.i + 1] AS k FROM kept JOIN sq USING (doc_id))
SELECT doc_id, 'absent' AS kind, NULL::BIGINT AS place, '' AS text FROM w ANTI JOIN st USING (doc_id)
UNION ALL SELECT doc_id, 'pretextual', k, text FROM e WHERE {_base("key")} IN ({", ".join(f"'{x}'" for x in V.PRE_TEXTUAL_HEADINGS)})
UNION ALL SELECT doc_id, 'no-references', NULL, '' FROM st WHERE doc_id NOT IN (SELECT doc_id FROM e WHERE {_base("key")} = 'REFERENCIAS')
UNION ALL SELECT doc_id, 'missing', k, text FROM h SEMI JOIN st USING (doc_id) ANTI JOIN (SELECT doc_id, place AS k FROM m) USING (doc_id, k)
UNION ALL SELECT doc_id, 'extra', k, text FROM e ANTI JOIN m USING (doc_id, k)
UNION ALL SELECT doc_id, 'misplaced', k, text FROM e SEMI JOIN m USING (doc_id, k) ANTI JOIN ok USING (doc_id, k)
UNION ALL SELECT doc_id, 'page', k, text FROM e WHERE page < above"""


#: Objects meet the event before and after them by as-of joins.
_CAPTIONS = rf"""
WITH w AS ({inputs.duckdb(inputs.CAPTION_FILES)}),
el AS (SELECT doc_id, unnest({_ELEMENTS}) AS xml, unnest(range(len({_ELEMENTS}))) AS k FROM w),
bl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, CASE WHEN starts_with(xml, '<w:tbl') THEN 'table' WHEN contains(xml, 'r:embed') THEN 'image' ELSE 'text' END AS type, regexp_replace(xml, '<[^>]+>', '', 'g') AS text FROM el),
ev AS (SELECT doc_id, i, text, {_fold("text")} AS norm, CASE WHEN type <> 'text' THEN type WHEN regexp_matches({_fold("text")}, '^({"|".join(V.CAPTION_LABELS)})\s+\d') THEN 'caption' WHEN regexp_matches({_fold("text")}, '^FONTES? ?:') THEN 'source'
  WHEN regexp_matches({_fold("text")}, '^\d+ \S') OR {_fold("text")} = 'REFERENCIAS' THEN 'heading' END AS event FROM bl),
co AS (SELECT *, regexp_extract(norm, '^(\w+)\s+(\d+(\.\d+)*)', 1) AS label, regexp_extract(norm, '^(\w+)\s+(\d+(\.\d+)*)', 2) AS number FROM ev WHERE event IN ('caption', 'image', 'table', 'heading')),
ob AS (SELECT * FROM co WHERE event IN ('image', 'table')),
up AS (SELECT o.doc_id, o.i, c.text, c.label, c.number FROM ob o ASOF JOIN co c ON c.doc_id = o.doc_id AND c.i < o.i WHERE c.event = 'caption' AND (c.label = 'QUADRO' OR (c.label = 'TABELA') = (o.event = 'table'))),
nx AS (SELECT c.doc_id, c.i, c.event, c.text, c.label, c.number, n.event AS next FROM co c ASOF LEFT JOIN co n ON n.doc_id = c.doc_id AND n.i > c.i),
dn AS (SELECT o.doc_id, o.i, c.text, c.label, c.number FROM ob o ASOF JOIN nx c ON c.doc_id = o.doc_id AND c.i > o.i WHERE c.event = 'caption' AND (c.label = 'QUADRO' OR (c.label = 'TABELA') = (o.event = 'table'))
  AND NOT coalesce(c.next IN ('image', 'table') AND (c.label = 'QUADRO' OR (c.label = 'TABELA') = (c.next = 'table')), false)),
so AS (SELECT o.doc_id, o.i, arg_min(s.text, s.i) AS source FROM ev s ASOF JOIN (SELECT * FROM co WHERE event <> 'caption') o ON o.doc_id = s.doc_id AND o.i < s.i WHERE s.event = 'source' AND o.event <> 'heading' GROUP BY o.doc_id, o.i),
ca AS (SELECT o.doc_id, o.i AS block_idx, o.event AS object, coalesce(up.text, dn.text) AS caption, coalesce(up.label, dn.label) AS label, coalesce(up.number, dn.number) AS number, CASE WHEN up.i IS NOT NULL THEN 'above' WHEN dn.i IS NOT NULL THEN 'below' END AS place, source
  FROM ob o LEFT JOIN up USING (doc_id, i) LEFT JOIN dn USING (doc_id, i) LEFT JOIN so USING (doc_id, i))
"""
ORACLE["captions"] = _CAPTIONS + "SELECT * FROM ca"
ORACLE["caption_breaches"] = _CAPTIONS + "SELECT doc_id, block_idx, CASE object WHEN 'table' THEN 42 ELSE 40 END::BIGINT AS rule FROM ca WHERE caption IS NULL UNION ALL SELECT doc_id, block_idx, CASE object WHEN 'table' THEN 43 ELSE 41 END FROM ca WHERE source IS NULL"


def _rows(order: int, part: str, style: str, text: str, where: str = "true", before: int | None = None) -> str:
    """One layout row of each record."""
    return f"SELECT doc_id, {order} AS p, 0 AS k, '{part}' AS part, '{style}' AS style, {before or 'NULL'}::BIGINT AS before, {text} AS text FROM w WHERE {where}"


def _lines_of(order: int, part: str, style: str, text: str, where: str = "true") -> str:
    """One layout row for each non-blank line of a text."""
    lines = rf"SELECT doc_id, unnest(string_split_regex({text}, '\n+')) AS raw, generate_subscripts(string_split_regex({text}, '\n+'), 1) AS k FROM w WHERE {where}"
    return f"SELECT doc_id, {order}, k, '{part}', '{style}', NULL::BIGINT, trim(raw) FROM ({lines}) WHERE trim(raw) <> ''"


def _layout() -> str:
    quoted = lambda x: f"'{x}'"
    rows: list[str] = []
    one = lambda *a, **kw: rows.append(_rows(len(rows), "front", *a, **kw))
    many = lambda text, where="true": rows.append(_lines_of(len(rows), "front", "simple", text, where))

    def page(title: str, where: str = "true", style: str = "sectionTitle") -> None:
        one("pageBreak", "''", where)
        one(style, quoted(title.upper()), where)

    def names(lead: int, gap: int) -> None:
        one("cover", f"coalesce(nullif(author, ''), '{V.DEFAULT_AUTHOR}')")
        one("space", "''", before=lead)
        one("coverBold", f"upper(coalesce(nullif(title, ''), '{V.DEFAULT_TITLE}'))")
        one("coverBold", "upper(subtitle)", "subtitle <> ''")
        one("space", "''", before=gap)

    def place() -> None:
        one("cover", f"coalesce(nullif(location, ''), '{V.DEFAULT_LOCATION}')")
        one("cover", "coalesce(nullif(year, ''), '2026')")

    one("coverBold", quoted(V.INSTITUTION))
    one("space", "''", before=1200)
    names(1800, 2200)
    place()
    one("pageBreak", "''")
    names(1500, 900)
    one("nature", f"coalesce(nullif(workNature, ''), '{V.DEFAULT_NATURE}')")
    for field, label in (("course", "Curso: "), ("program", "Programa: "), ("advisor", "Orientador(a): "), ("coadvisor", "Coorientador(a): ")):
        one("simple", f"'{label}' || {field}", f"{field} <> ''")
    one("space", "''", before=1500)
    place()
    page("Ficha catalográfica")
    one("simple", quoted(V.CATALOGUE_CARD))
    for title, field in (("Dedicatória", "dedicatoria"), ("Agradecimentos", "agradecimentos"), ("Epígrafe", "epigrafe")):
        page(title, f"trim({field}) <> ''")
        many(field)
    for title, field, words, label in (("Resumo", "resumo", "palavrasChave", "Palavras-chave: "), ("Abstract", "abstractText", "keywords", "Keywords: ")):
        page(title)
        one("simple", f"coalesce(nullif({field}, ''), ' ')")
        one("simple", f"'{label}' || {words}", f"{words} <> ''")
    for title, field, filler in (("Indicadores de impacto", "indicadoresImpacto", V.IMPACT_PLACE), ("Impact indicators", "impactIndicators", V.IMPACT_PLACE_ENGLISH)):
        said = f"CASE WHEN {field} <> '' THEN {field} WHEN work_type IN ('tese', 'dissertacao') THEN '{filler}' ELSE '' END"
        page(title, f"trim({said}) <> ''")
        many(said)
    # every record has a heading in its editor text, so every one has a summary
    page("Sumário", style="title")
    one("toc", r"'TOC \f \h \z'")
    one("note", quoted(V.SUMMARY_NOTE))
    heads = "SELECT doc_id, 1000 + idx AS p, 0 AS k, 'body' AS part, 'pageBreak' AS style, NULL::BIGINT AS before, '' AS text FROM bb WHERE type = 'heading1' AND idx > 0"
    rows.append(heads)
    rows.append("SELECT doc_id, 1000 + idx, 1, 'body', type, NULL::BIGINT, CASE WHEN type = 'heading1' THEN upper(text) ELSE text END FROM bb")
    for order, title, where in ((2000, "REFERÊNCIAS", "true"), (4000, "ANEXOS", "anexos <> ''"), (5000, "APÊNDICES", "apendices <> ''")):
        rows.append(_rows(order, "body", "pageBreak", "''", where))
        rows.append(_rows(order + 1, "body", "sectionTitle", quoted(title), where))
    rows.append("SELECT doc_id, 3000, idx, 'body', 'reference', NULL::BIGINT, reference FROM ru")
    rows.append(_lines_of(4002, "body", "simple", "anexos"))
    rows.append(_lines_of(5002, "body", "simple", "apendices"))
    return f"""WITH w AS ({_RECORDS}), bb AS ({ORACLE["body_blocks"]}), ru AS ({ORACLE["ref_union"]}), sp AS ({ORACLE["start_page"]}), al AS ({" UNION ALL ".join(rows)})
      SELECT doc_id, start_page, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS seq, part, style, before, text FROM al JOIN sp USING (doc_id)"""


_MEDIA_ROWS = f"SELECT doc_id, target, encode(said) AS data, CASE target WHEN 'media/a.png' THEN 'rId1' WHEN 'media/b.png' THEN 'rId2' END AS rel_id FROM ({inputs.duckdb(inputs.PACKAGE_MEDIA)})"
ORACLE["package_media"] = f"SELECT doc_id, rel_id, target, CASE WHEN ends_with(target, 'png') THEN 'image/png' ELSE 'application/octet-stream' END AS mime_type, octet_length(data)::BIGINT AS n_bytes, md5(data) AS digest, doc_id % 2 = 0 AS has_numbering FROM ({_MEDIA_ROWS})"
ORACLE["package_roundtrip"] = f"SELECT doc_id, rel_id, md5(data) AS digest, doc_id::VARCHAR AS cells, count(DISTINCT data || encode(split_part(target, '.', 2))) OVER (PARTITION BY doc_id)::BIGINT AS n_parts FROM ({_MEDIA_ROWS})"


def _list_numbers() -> str:
    """Counters by joining every paragraph of a list to those before it: how many of a level stand behind its last reset."""
    count = lambda k: f"count(*) FILTER (b.ilvl = {k} AND b.idx > coalesce((SELECT max(z.idx) FROM p z WHERE z.doc_id = a.doc_id AND z.num_id = a.num_id AND z.idx <= a.idx AND z.ilvl < {k}), -1))"
    got = lambda x, p: f"nullif(regexp_extract({x}, '{p}', 1), '')"
    letters = "repeat(chr(96 + ((v - 1) % 26 + 1)::INT), ((v - 1) // 26 + 1)::INT)"
    roman = "concat(['', 'X', 'XX', 'XXX'][v // 10 + 1], ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][v % 10 + 1])"
    show = lambda v, f: f"CASE {f} WHEN 'lowerLetter' THEN {letters} WHEN 'upperLetter' THEN upper({letters}) WHEN 'lowerRoman' THEN lower({roman}) WHEN 'upperRoman' THEN {roman} ELSE v::VARCHAR END".replace("v::", f"({v})::").replace("(v ", f"(({v}) ").replace("[v ", f"[({v}) ")
    start = lambda k: f"CASE WHEN c{k} > 0 THEN s{k} + c{k} - 1 ELSE s{k} END::BIGINT"
    return rf"""
WITH w AS ({inputs.duckdb(inputs.NUMBERED_FILES)}),
el AS (SELECT doc_id, unnest({_ELEMENTS}) AS xml, unnest(range(len({_ELEMENTS}))) AS idx FROM w),
p AS (SELECT doc_id, idx, {got("xml", '<w:numId w:val="([0-9]+)"')}::BIGINT AS num_id, {got("xml", '<w:ilvl w:val="([0-9]+)"')}::BIGINT AS ilvl, regexp_replace(xml, '<[^>]+>', '', 'g') AS text FROM el WHERE {got("xml", '<w:numId w:val="([0-9]+)"')} <> '0'),
ct AS (SELECT a.doc_id, a.idx, a.num_id, a.ilvl, a.text, {", ".join(f"{count(k)} AS c{k}" for k in range(3))} FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.num_id = a.num_id AND b.idx <= a.idx GROUP BY ALL),
kd AS (SELECT doc_id, unnest(regexp_extract_all(numbering_xml, '(?s)<w:abstractNum .*?</w:abstractNum>')) AS x FROM w),
lv AS (SELECT doc_id, regexp_extract(x, 'abstractNumId="(\d+)"', 1) AS kind, unnest(regexp_extract_all(x, '(?s)<w:lvl .*?</w:lvl>')) AS y FROM kd),
df AS (SELECT doc_id, kind, {", ".join(f"max({value}) FILTER (contains(y, 'ilvl=\"{k}\"')) AS {n}{k}" for k in range(3) for n, value in (("s", "regexp_extract(y, 'start w:val=\"([0-9]+)\"', 1)::BIGINT"), ("f", "regexp_extract(y, 'numFmt w:val=\"([A-Za-z]+)\"', 1)"), ("t", "regexp_extract(y, 'lvlText w:val=\"([^\"]+)\"', 1)")))} FROM lv GROUP BY doc_id, kind),
nm AS (SELECT doc_id, unnest(regexp_extract_all(numbering_xml, '(?s)<w:num .*?</w:num>')) AS x FROM w),
ls AS (SELECT doc_id, regexp_extract(x, 'numId="(\d+)"', 1)::BIGINT AS num_id, regexp_extract(x, 'abstractNumId w:val="(\d+)"', 1) AS kind, {got("x", 'startOverride w:val="([0-9]+)"')}::BIGINT AS own FROM nm),
al AS (SELECT ct.*, coalesce(own, s0) AS s0, s1, s2, f0, f1, f2, CASE ilvl WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END AS t FROM ct LEFT JOIN ls USING (doc_id, num_id) LEFT JOIN df USING (doc_id, kind)),
sh AS (SELECT doc_id, idx, num_id, ilvl, text, replace(replace(replace(t, '%1', coalesce({show(start(0), "f0")}, '')), '%2', coalesce({show(start(1), "f1")}, '')), '%3', coalesce({show(start(2), "f2")}, '')) AS shown FROM al)
SELECT *, CASE WHEN regexp_matches(shown, '^\d+(\.\d+)*\.?$') THEN len(string_split(regexp_replace(shown, '\.$', ''), '.')) END::BIGINT AS level FROM sh"""


ORACLE["list_numbers"] = _list_numbers()


_CITED = r"\(\p{Lu}[^()]*,\s*(?:19|20)\d{2}[^()]*\)|\p{Lu}\p{Ll}+(?: (?:e|et al\.) ?\p{L}*)? \((?:19|20)\d{2}[^()]*\)"
#: Quotes one by one by recursion, with the stack as a string; citations placed by what stands before each of them.
ORACLE["citations"] = rf"""
WITH RECURSIVE w AS ({inputs.duckdb(inputs.CITED_BLOCKS)}),
tx AS (SELECT * FROM w WHERE block_type <> 'heading' AND regexp_matches(text, '{_CITED}')),
ch AS (SELECT doc_id, p, substring(text, p, 1) AS m FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS p FROM tx) WHERE substring(text, p, 1) IN ('"', '“', '”', '«', '»')),
tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM ch),
sc AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS p, '' AS stack, 0::BIGINT AS first, 0::BIGINT AS start, 0::BIGINT AS stop FROM tx
  UNION ALL SELECT s.doc_id, t.i, t.p, CASE WHEN x.closes THEN left(s.stack, length(s.stack) - 1) WHEN t.m IN ('”', '»') THEN s.stack ELSE s.stack || t.m END,
    CASE WHEN s.stack = '' AND NOT x.closes AND t.m NOT IN ('”', '»') THEN t.p ELSE s.first END, CASE WHEN x.closes AND length(s.stack) = 1 THEN s.first ELSE 0 END, CASE WHEN x.closes AND length(s.stack) = 1 THEN t.p ELSE 0 END
  FROM sc s JOIN tk t ON t.doc_id = s.doc_id AND t.i = s.i + 1, LATERAL (SELECT (t.m = '"' AND right(s.stack, 1) = '"') OR (t.m = '”' AND right(s.stack, 1) = '“') OR (t.m = '»' AND right(s.stack, 1) = '«') AS closes) x),
sp AS (SELECT doc_id, start, stop FROM sc WHERE stop > 0),
pc AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CITED}')) AS citation, unnest(range(len(regexp_extract_all(text, '{_CITED}')))) AS nth, unnest(list_slice(string_split_regex(text, '{_CITED}'), 1, -2)) AS ahead FROM tx),
ct AS (SELECT *, (sum(length(ahead) + length(citation)) OVER (PARTITION BY doc_id ORDER BY nth))::BIGINT AS stop FROM pc),
cs AS (SELECT *, stop - length(citation) + 1 AS start, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY nth), 0) AS behind FROM ct),
qu AS (SELECT c.doc_id, c.nth, max(s.start) AS a, max(s.stop) AS b FROM cs c JOIN sp s ON s.doc_id = c.doc_id AND s.stop < c.start AND s.start > c.behind GROUP BY c.doc_id, c.nth),
ro AS (SELECT t.doc_id, t.block_idx, c.nth, c.start, c.citation, nullif(regexp_extract(c.citation, '\bp\.\s*(\d+(?:-\d+)?)', 1), '') AS page, q.a IS NOT NULL AS quoted, t.block_type = 'longQuote' AS block,
  CASE WHEN t.block_type = 'longQuote' THEN {_trim("substring(t.text, 1, c.start - 1)")} WHEN q.a IS NOT NULL THEN substring(t.text, q.a + 1, q.b - q.a - 1) END AS quote FROM cs c JOIN tx t USING (doc_id) LEFT JOIN qu q USING (doc_id, nth))
SELECT doc_id, block_idx::BIGINT AS block_idx, nth, start, citation, page, quote, CASE WHEN length(quote) > {V.THREE_LINES} THEN 'long' WHEN quote IS NOT NULL THEN 'short' END AS length_class,
  CASE WHEN block THEN 'indent' WHEN quoted THEN 'quotes' ELSE 'none' END AS mark, CASE WHEN block AND quoted THEN 28 WHEN NOT block AND NOT quoted AND page IS NOT NULL THEN 27 END::BIGINT AS rule FROM ro"""


#: Relationships from the XML met in full with the media that every file of that input is said to hold.
_ASSETS = rf"""
WITH w AS ({inputs.duckdb(inputs.WORD_FILES)}),
tg AS (SELECT doc_id, unnest(regexp_extract_all(rels_xml, '<Relationship [^>]*>')) AS x FROM w),
rl AS (SELECT doc_id, regexp_extract(x, 'Id="([^"]+)"', 1) AS rel_id, regexp_extract(x, 'Target="([^"]+)"', 1) AS target FROM tg WHERE contains(x, 'Target="media/')),
nm AS (SELECT doc_id, target, min(rel_id) AS rel_id FROM rl GROUP BY doc_id, target),
md AS (SELECT doc_id, unnest(['media/a.png', 'media/c.webp']) AS target FROM w),
av AS (SELECT doc_id, target, rel_id, split_part(target, '/', -1) AS file_name, lower(regexp_extract(target, '\.([^./]+)$', 1)) AS extension FROM nm FULL JOIN md USING (doc_id, target)),
us AS (SELECT doc_id, unnest(regexp_extract_all(document_xml, 'r:embed="([^"]+)"', 1)) AS rel_id, generate_subscripts(regexp_extract_all(document_xml, 'r:embed="([^"]+)"', 1), 1) AS k FROM w),
fi AS (SELECT us.doc_id, arg_min(target, k) AS target FROM us JOIN rl USING (doc_id, rel_id) GROUP BY us.doc_id)
"""
ORACLE["image_asset_merge"] = _ASSETS + "SELECT doc_id, rel_id, target, file_name, extension, CASE extension WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'image/' || extension END AS mime_type FROM av"
ORACLE["first_images"] = _ASSETS + "SELECT a.doc_id, coalesce(any_value(fi.target), min(a.target)) AS target FROM av a LEFT JOIN fi ON fi.doc_id = a.doc_id GROUP BY a.doc_id"


def _pages() -> dict[str, str]:
    """Pages by running sums, and lists whose entries are laid out once without and once with their pages."""
    from lexmill.operators.layout import STYLES

    styles = _values([(k, v[0], v[3], v[4], v[5], v[6], v[7]) for k, v in STYLES.items()], "style, size, line, above, after, indent, first")
    # text width 9071 and height 14003 twips; a character is 45, a line 115 hundredths of the size
    long = f"""SELECT doc_id, start_page, seq, part, CASE WHEN style = 'longQuote' THEN 'paragraph' ELSE style END AS style, before, CASE WHEN style = 'longQuote' THEN 'Tabela ' || doc_id || ' - Valores'
      WHEN style = 'paragraph' AND NOT starts_with(text, 'Figura') THEN repeat(text || ' ', doc_id % 97 + 1) ELSE text END AS text FROM ({ORACLE["layout_rows"]})"""

    def paged(rows: str, tag: str) -> str:
        """CTEs that end in pg_<tag>: the rows with a page."""
        return f"""ht_{tag} AS (SELECT r.*, coalesce(r.before, s.above) AS up, s.size * s.line * 1150 // 24000 AS one, CASE WHEN r.style = 'pageBreak' THEN 0 ELSE coalesce(r.before, s.above) + s.after + (s.size * s.line * 1150 // 24000) *
            list_sum(list_transform(string_split(r.text, chr(10)), lambda x, k: greatest(ceil((length(x) + CASE WHEN r.style = 'toc' THEN 5 ELSE 0 END + CASE WHEN k = 1 THEN s.first * 100 // (s.size * 450) ELSE 0 END) / ((9071 - s.indent) * 100 // (s.size * 450))), 1)))::BIGINT END AS height FROM {rows} r JOIN {styles} s ON s.style = r.style),
          sg_{tag} AS (SELECT *, count(*) FILTER (style = 'pageBreak') OVER (PARTITION BY doc_id, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS segment FROM ht_{tag}),
          tl_{tag} AS (SELECT doc_id, part, segment, greatest(ceil(sum(height) / 14003), 1) AS pages FROM sg_{tag} GROUP BY ALL),
          er_{tag} AS (SELECT doc_id, part, segment, coalesce(sum(pages) OVER (PARTITION BY doc_id, part ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM tl_{tag}),
          in_{tag} AS (SELECT s.*, earlier, coalesce(sum(height) OVER (PARTITION BY doc_id, part, segment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM sg_{tag} s JOIN er_{tag} USING (doc_id, part, segment)),
          pg_{tag} AS (SELECT * EXCLUDE (up, one, height, segment, earlier, ahead), (CASE WHEN part = 'body' THEN start_page ELSE 1 END + earlier + floor(CASE WHEN style = 'pageBreak' THEN greatest(ahead - 1, 0) ELSE ahead + up + one - 1 END / 14003))::BIGINT AS page FROM in_{tag})"""

    label = f"regexp_extract({_fold('text')}, '^({'|'.join(V.CAPTION_LABELS)})\\s+\\d', 1)"
    plain = f"WITH lr AS ({long}), {paged('lr', 'a')}"
    lists = f"""WITH lr AS ({long}), cp AS (SELECT doc_id, seq AS own, text, ({label} = 'TABELA')::INT AS tables, row_number() OVER (PARTITION BY doc_id, {label} = 'TABELA' ORDER BY seq) AS nth FROM lr WHERE part = 'body' AND style IN ('paragraph', 'simple') AND {label} <> ''),
      mk AS (SELECT doc_id, start_page, seq - 1 AS spot FROM lr WHERE part = 'front' AND style = 'title'),
      nw AS (SELECT doc_id, start_page, spot, tables, nth, 'toc' AS style, text, own FROM cp JOIN mk USING (doc_id) UNION ALL SELECT doc_id, start_page, spot, tables, 0, 'sectionTitle', ['LISTA DE ILUSTRAÇÕES', 'LISTA DE TABELAS'][tables + 1], NULL FROM cp JOIN mk USING (doc_id) WHERE nth = 1
        UNION ALL SELECT doc_id, start_page, spot, tables, -1, 'pageBreak', '', NULL FROM cp JOIN mk USING (doc_id) WHERE nth = 1),
      al AS (SELECT doc_id, start_page, part, style, before, text, seq AS k1, 1 AS k2, 0 AS k3, 0 AS k4, NULL AS own FROM lr UNION ALL SELECT doc_id, start_page, 'front', style, NULL, text, spot, 0, tables, nth, own FROM nw),
      nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2, k3, k4) - 1 AS seq FROM al), {paged('nb', 'a')},
      ad AS (SELECT doc_id, count(DISTINCT page) AS added FROM pg_a WHERE k2 = 0 AND style <> 'pageBreak' GROUP BY doc_id),
      mv AS (SELECT p.doc_id, p.start_page + coalesce(added, 0) AS start_page, part, style, before, text, seq, own, k1 FROM pg_a p LEFT JOIN ad USING (doc_id)), {paged('mv', 'b')}
      SELECT m.doc_id, m.seq, m.start_page, m.style, md5(m.text || coalesce(chr(9) || c.page, '')) AS said, m.page FROM pg_b m LEFT JOIN (SELECT doc_id, k1, page FROM pg_b WHERE part = 'body') c ON c.doc_id = m.doc_id AND c.k1 = m.own"""
    level = "CASE style WHEN 'sectionTitle' THEN 1 WHEN 'heading1' THEN 1 WHEN 'heading2' THEN 2 WHEN 'heading3' THEN 3 END"
    return {
        "page_rows": f"{plain} SELECT doc_id, seq, part, style, page FROM pg_a",
        "contents_pages": f"{plain} SELECT doc_id, seq, {level}::BIGINT AS level, text, page FROM pg_a WHERE part = 'body' AND {level} IS NOT NULL AND trim(text) <> ''",
        "illustration_lists": lists,
    }


def _rendered() -> dict[str, str]:
    """What the paragraphs of rendered files must look like, in the rules' units: points, lines, centimetres."""
    looks = [
        ("cover", 12, "center", 1.0, 0, 12, 0.0, 0.0), ("coverBold", 12, "center", 1.0, 0, 12, 0.0, 0.0), ("title", 12, "center", 1.5, 12, 12, 0.0, 0.0), ("sectionTitle", 12, "center", 1.5, 12, 12, 0.0, 0.0),
        ("heading1", 12, "left", 1.5, 12, 9, 0.0, 0.0), ("heading2", 12, "left", 1.5, 9, 6, 0.0, 0.0), ("heading3", 12, "left", 1.5, 6, 5, 0.0, 0.0), ("paragraph", 12, "both", 1.5, 0, 6, 0.0, 1.5),
        ("simple", 12, "both", 1.0, 0, 6, 0.0, 0.0), ("nature", 12, "both", 1.0, 0, 9, 4.0, 0.0), ("longQuote", 11, "both", 1.0, 0, 6, 4.0, 0.0), ("reference", 12, "left", 1.0, 0, 6, 0.0, 0.0), ("note", 11, "center", 1.0, 6, 6, 0.0, 0.0),
    ]
    rows = ", ".join(f"('{s}', {pt}, '{a}', {line}, {up}, {dn}, {left}, {first})" for s, pt, a, line, up, dn, left, first in looks)
    twips = lambda cm: f"CAST(round({cm} * 1440 / 2.54) AS BIGINT)"
    return {
        "rendered_formats": f"""SELECT doc_id, seq + CASE WHEN part = 'body' THEN 1 ELSE 0 END AS idx, {twips("left_cm")} AS indent, {twips("first_cm")} AS first_line, coalesce(before, up * 20) AS above, (dn * 20)::BIGINT AS after, CAST(240 * line AS BIGINT) AS line, align, 'Times New Roman' AS fonts, CAST(2 * pt AS VARCHAR) AS sizes
          FROM ({ORACLE["layout_rows"]}) JOIN (VALUES {rows}) AS v(style, pt, align, line, up, dn, left_cm, first_cm) USING (style) WHERE trim(regexp_replace(text, '[*]', '', 'g')) <> ''""",
        "rendered_properties": f"""SELECT doc_id, start_page::BIGINT AS start_page, CASE WHEN title = '' THEN 'Trabalho acadêmico' ELSE title END AS title, 'Times New Roman' AS number_font, 22::BIGINT AS number_size, 'right' AS number_align, 2::BIGINT AS sections FROM ({ORACLE["start_page"]}) JOIN (SELECT doc_id, title FROM ({_RECORDS})) USING (doc_id)""",
    }


def _detected() -> str:
    """All fields of the texts, put together from their parts."""
    other = ORACLE["next_line_label"].replace("ORIENTADOR", "COORIENTADOR")
    spans = {"agradecimentos": "AGRADECIMENTOS", "indicadoresImpacto": "INDICADORES DE IMPACTO", "impactIndicators": "IMPACT INDICATORS"}
    values = {
        "author": "author", "title": "title", "subtitle": "lab.subtitle", "workNature": "coalesce(wn.nature, '')", "course": "lab.course",
        "program": "coalesce(nullif(lab.program, ''), trim(regexp_extract(wn.nature, '(?i)programa de p[óo]s-gradua[cç][aã]o em ([^,]+)', 1)), '')",
        "advisor": "coalesce(nullif(lab.advisor, ''), nl.advisor)", "coadvisor": "coalesce(nullif(lab.coadvisor, ''), nc.advisor)",
        "location": "coalesce(nullif(lab.location, ''), lo.place, '')", "year": "cy.year", "resumo": "rs.resumo", "palavrasChave": "rs.keywords",
        "abstractText": "ab.abstract", "keywords": "ab.keywords", "introducao": "it.introduction", "conclusao": "cc.conclusion", "referencias": "rf.reference_list",
        "anexos": "ax.annexes", "apendices": "ax.appendices", **{k: f"{k}.{k}" for k in spans},
    }
    sure = {k: "'alta'" for k in ("subtitle", "course", "resumo", "abstractText", "introducao", "referencias")} | {k: f"CASE WHEN lab.{k} <> '' THEN 'alta' ELSE 'media' END" for k in ("program", "location")}
    sure |= {k: f"CASE WHEN lab.{k} <> '' OR {k}_times > 1 THEN 'alta' ELSE 'media' END" for k in ("author", "title")} | {"year": "cy.confidence"}
    rows = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, f_{k} AS value, CASE WHEN f_{k} = '' THEN 'nao-identificado' ELSE s_{k} END AS confidence FROM wide" for k in values)
    empty = " UNION ALL ".join(f"SELECT doc_id, '{k}', '', 'nao-identificado' FROM wide" for k in V.FIELD_KEYS if k not in values)
    columns = ", ".join(f"{x} AS f_{k}, {sure.get(k, repr('media'))} AS s_{k}" for k, x in values.items())
    parts = {
        "lab": "label_lookup", "cy": "cover_year", "ca": "cover_author", "nl": "next_line_label", "rs": "section_span_resumo", "ab": "section_span_abstract",
        "it": "section_span_intro", "cc": "section_span_conclusion", "rf": "section_span_refs", "ax": "annex_after_refs",
    }
    tables = ", ".join(f"{k} AS ({ORACLE[name]})" for k, name in parts.items())
    tables += f", nc AS ({other}), " + ", ".join(f"{k} AS ({_W}, {_span(k, f'base = {name!r}', f'{_PRIMARY} AND base <> {name!r}')})" for k, name in spans.items())
    joins = " ".join(f"JOIN {k} USING (doc_id)" for k in [*list(parts), "nc", *spans] if k not in ("lab", "ca"))
    return f"""{_W}, {_COVER.strip().rstrip(",")}, {tables},
      wn AS (SELECT doc_id, arg_min(text, i) AS nature FROM b WHERE regexp_matches(text, '(?i){V.WORK_NATURE}') GROUP BY doc_id),
      lo AS (SELECT doc_id, arg_min(text, i) AS place FROM cv WHERE {_LOCATION} GROUP BY doc_id),
      an AS (SELECT doc_id, coalesce(nullif(lab.author, ''), ca.author) AS author FROM lab JOIN ca USING (doc_id)),
      st AS (SELECT an.doc_id, coalesce(min(cv.i), -1) AS at FROM an LEFT JOIN cv ON cv.doc_id = an.doc_id AND cv.norm = {_fold("an.author")} AND an.author <> '' GROUP BY an.doc_id),
      en AS (SELECT cv.doc_id, min(i) AS at FROM cv JOIN st USING (doc_id) WHERE i > st.at AND ({_LOCATION} OR {_IS_YEAR}) GROUP BY cv.doc_id),
      ct AS (SELECT cv.doc_id, string_agg(text, ' ' ORDER BY i) AS said FROM cv JOIN st USING (doc_id) LEFT JOIN en USING (doc_id) WHERE i > st.at AND i < coalesce(en.at, 1000000) AND NOT {_GENERIC} GROUP BY cv.doc_id),
      tn AS (SELECT doc_id, coalesce(nullif(lab.title, ''), {_clean("said")}, '') AS title FROM lab LEFT JOIN ct USING (doc_id)),
      oa AS (SELECT an.doc_id, an.author, count(b.i) AS author_times FROM an LEFT JOIN b ON b.doc_id = an.doc_id AND b.norm = {_fold("an.author")} GROUP BY ALL),
      ot AS (SELECT tn.doc_id, tn.title, count(b.i) AS title_times FROM tn LEFT JOIN b ON b.doc_id = tn.doc_id AND b.norm = {_fold("tn.title")} GROUP BY ALL),
      wide AS (SELECT doc_id, {columns.replace("author AS f_author", "oa.author AS f_author").replace("title AS f_title", "ot.title AS f_title", 1)} FROM lab JOIN oa USING (doc_id) JOIN ot USING (doc_id) {joins} LEFT JOIN wn USING (doc_id) LEFT JOIN lo USING (doc_id))
      {rows} UNION ALL {empty}"""


def _docx_fields() -> str:
    """The Word files differ in four ways only, so their fields follow from the key."""
    image = "CASE WHEN k % 4 IN (1, 2) THEN chr(10) || '[Imagem detectada: rId' || (k % 4) || ']' ELSE '' END"
    found = {
        "author": ("'Trecho' || chr(10) || 'citado'", "media"), "title": ("'1.2 Dados'", "media"), "year": ("'2026'", "baixa"), "referencias": ("'Item'", "alta"),
        "resumo": (f"CASE WHEN k % 2 = 0 THEN concat_ws(chr(10), 'Nome & ' || s_name || ' fim é', 'Trecho citado', '1.2 Dados', 'a ' || k) || {image} ELSE '' END", "alta"),
        "imageWarnings": ("CASE WHEN k % 4 IN (1, 2) THEN '1 imagem(ns) no original; revise posição e legenda.' ELSE '' END", "media"),
    }
    one = lambda k: found.get(k, ("''", ""))
    return "WITH w AS (SELECT s_suppkey AS k, s_name FROM supplier), x AS (" + " UNION ALL ".join(f"SELECT k AS doc_id, '{k}' AS field, {one(k)[0]} AS value, '{one(k)[1]}' AS sure FROM w" for k in V.FIELD_KEYS) + ") SELECT doc_id, field, value, CASE WHEN value = '' THEN 'nao-identificado' ELSE sure END AS confidence FROM x"


_GIVEN = _RECORDS.split("FROM customer", maxsplit=1)[0]


def _field_or_empty(k: str) -> str:
    return k if f" AS {k}" in _GIVEN else "''"


def _merged() -> str:
    now = {"title": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE title END", "author": "CASE WHEN doc_id % 3 = 1 THEN '' ELSE author END"}
    new = {"title": "'novo ' || title", "author": "'Novo Autor'", "advisor": "'Nova Orientadora'", "resumo": "''"}
    sure = "CASE WHEN doc_id % 5 = 0 OR doc_id % 2 = 0 THEN 'alta' ELSE 'nao-identificado' END"
    rows = [f"SELECT doc_id, '{k}' AS field, coalesce(nullif({now.get(k, _field_or_empty(k))}, ''), {new.get(k, _field_or_empty(k))}) AS value, {sure} AS confidence FROM w" for k in V.FIELD_KEYS]
    return f"WITH w AS ({_RECORDS}) {' UNION ALL '.join(rows)} UNION ALL SELECT doc_id, 'work_type', coalesce(nullif(work_type, ''), 'tese'), '-' FROM w"


def _edited() -> str:
    rest = {"epigrafe": 0, "title": 1, "advisor": 2}
    value = lambda k: f"CASE WHEN doc_id % 3 = {rest[k]} THEN 'editado ' || doc_id ELSE {_field_or_empty(k)} END" if k in rest else _field_or_empty(k)
    sure = lambda k: f"WHEN doc_id % 3 = {rest[k]} THEN 'baixa'" if k in rest else ""
    return f"WITH w AS ({_RECORDS}) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, {value(k)} AS value, CASE WHEN doc_id % 2 = 0 THEN 'alta' {sure(k)} ELSE 'nao-identificado' END AS confidence FROM w" for k in V.FIELD_KEYS)


_BARE = r"regexp_replace(regexp_replace(regexp_replace(x, '^#{1,2}\s+', ''), '^>\s+', ''), '(?i)^\[REF\]\s+', '')"
_PLAIN = rf"regexp_replace(regexp_replace({_BARE}, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g')"
_CHANGED = "array_to_string(list_transform(string_split(t, chr(10)), lambda x, i: CASE WHEN i - 1 BETWEEN l0 AND l1 THEN {0} ELSE x END), chr(10))"

ORACLE |= {
    "layout_rows": _layout(),
    "rendered_files": rf"""SELECT doc_id, count(*) + 1 AS paragraphs, count(*) FILTER (style = 'pageBreak') AS page_breaks, count(*) FILTER (part = 'body' AND style IN ('sectionTitle', 'heading1', 'heading2', 'heading3')) AS entries,
      md5(replace(string_agg(regexp_replace(regexp_replace(text, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '' ORDER BY seq) FILTER (style <> 'toc'), chr(10), '')) AS said FROM ({_layout()}) GROUP BY doc_id""",
    "detected_fields": _detected(),
    "docx_fields": _docx_fields(),
    "import_merge": _merged(),
    "manual_edits": _edited(),
    "issue_messages": _ALL_ISSUES + "SELECT doc_id, ordinal::BIGINT AS ordinal, code, replace(CASE code " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in MESSAGES.items()) + " END, '{n}', coalesce(n::VARCHAR, '')) AS message FROM al",
    "editor_seed": f"WITH w AS ({_RECORDS}) SELECT doc_id, CASE WHEN doc_id % 3 = 2 AND trim(editor_text) <> '' THEN editor_text WHEN doc_id % 2 = 1 THEN 'importado ' || doc_id WHEN introducao <> '' THEN introducao ELSE title END AS editor_text FROM w",
    "selection_edits": rf"""WITH w AS ({_RECORDS}), s AS (SELECT doc_id, editor_text AS t, doc_id % 7 AS s0, doc_id % 7 + doc_id % 40 AS s1 FROM w),
      l AS (SELECT *, length(left(t, s0)) - length(replace(left(t, s0), chr(10), '')) AS l0, length(left(t, s1)) - length(replace(left(t, s1), chr(10), '')) AS l1 FROM s)
      SELECT doc_id, {_CHANGED.format(f"CASE WHEN trim({_BARE}) <> '' THEN '> ' || {_BARE} ELSE {_BARE} END")} AS quoted,
        {_CHANGED.format(_PLAIN)} AS cleared,
        left(t, s0) || '**' || substr(t, s0 + 1, s1 - s0) || '**' || substr(t, s1 + 1) AS bold FROM l""",
    "file_kinds": f"""WITH {_blocks('documents')}, n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id)
      SELECT d.doc_id, ['txt', 'md', 'docx', 'pdf'][d.doc_id % 4 + 1] AS kind, ['text', 'text', 'unreadable archive: BadZipFile', 'unsupported format'][d.doc_id % 4 + 1] AS outcome, CASE WHEN d.doc_id % 4 < 2 THEN coalesce(n.n, 0) END AS n_blocks FROM documents d LEFT JOIN n USING (doc_id)""",
}
ORACLE |= _pages()
ORACLE |= _rendered()
