"""Inputs for the queries, built from the driver's tables by SQL that Spark and DuckDB both run.

The tables hold no academic documents, so references, works and Word XML are composed from their columns, one
variant for every branch of the operators.
"""

REFERENCES = """
SELECT o_custkey AS doc_id, o_orderkey AS ref_key,
  CASE o_orderkey % 14
    WHEN 0 THEN concat('SILVA, Ana. Solos do cerrado ', o_orderkey, ': manejo. ', r_name, ': Editora Sol, ', year(o_orderdate), '.')
    WHEN 1 THEN concat('COSTA, Bia. Rios urbanos ', o_orderkey, '. Revista Aquática, ', r_name, ', v. 3, n. 1, p. 4-9, ', year(o_orderdate), '.')
    WHEN 2 THEN concat('LIMA, Caio. Ventos do litoral ', o_orderkey, '. ', year(o_orderdate), '. 90 p. Tese (Doutorado em Física) - Universidade X, ', r_name, ', ', year(o_orderdate), '.')
    WHEN 3 THEN concat('BRASIL. Lei nº ', o_orderkey, ', de 2 de março. Dispõe sobre exemplos. Brasília, DF, ', year(o_orderdate), '.')
    WHEN 4 THEN concat('COSTA, Bia. Portal de dados ', o_orderkey, '. ', r_name, ': Rede, ', year(o_orderdate), '. Disponível em: https://ex.test. Acesso em: 1 jan. 2020.')
    WHEN 5 THEN concat('ROCHA, D. **Marcado à mão ', o_orderkey, '**. ', r_name, ': Sol, ', year(o_orderdate), '.')
    WHEN 6 THEN concat('ROCHA, D. *Periódico à mão ', o_orderkey, '*. ', r_name, ': Sol, ', year(o_orderdate), '.')
    WHEN 7 THEN concat('ROCHA, D. et al. Obra coletiva ', o_orderkey, '. ', r_name, ': Sol, ', year(o_orderdate), '.')
    WHEN 8 THEN concat('TEXTO SEM ESTRUTURA RECONHECIVEL ', o_orderkey)
    WHEN 9 THEN concat('INSTITUTO X, Setor Y. Guia geral ', o_orderkey, '. ', r_name, ': Sol, ', year(o_orderdate), '.')
    WHEN 10 THEN concat('NETO, A. Nota ', o_orderkey % 97)
    WHEN 11 THEN concat('DIAS, E. Mapa ', o_orderkey, '. Disponível em: https://ex.test/', o_orderkey)
    WHEN 12 THEN concat('MELO, F. Memória da tese ', o_orderkey, ', ', year(o_orderdate), '.')
    ELSE concat('FUNDAÇÃO Z, Setor W. Sem local, ', year(o_orderdate), '.')
  END AS original
FROM {orders} JOIN {region} ON r_regionkey = o_orderkey % 5
"""

WORKS = """
SELECT c_custkey AS doc_id, concat_ws(chr(10),
  CASE c_custkey % 4 WHEN 0 THEN concat('Autor: Maria ', CASE c_custkey % 3 WHEN 0 THEN 'Silva' WHEN 1 THEN 'Souza' ELSE 'Costa Lima' END)
    WHEN 1 THEN 'UNIVERSIDADE FEDERAL DE LAVRAS' WHEN 2 THEN concat('Autor:', chr(10), 'Pedro Alves') ELSE NULL END,
  CASE WHEN c_custkey % 4 IN (1, 3) THEN concat('Maria ', CASE c_custkey % 3 WHEN 0 THEN 'Silva' WHEN 1 THEN 'Souza' ELSE 'Costa Lima' END) ELSE NULL END,
  CASE c_custkey % 4 WHEN 0 THEN concat('Título: Estudo ', c_custkey, ' da água') WHEN 1 THEN 'Estudo do solo em Minas' WHEN 3 THEN c_mktsegment ELSE NULL END,
  CASE WHEN c_custkey % 5 = 0 THEN concat('Curso: ', c_mktsegment) ELSE NULL END,
  CASE WHEN c_custkey % 3 = 0 THEN 'Lavras - MG' ELSE 'Cidade: Lavras' END,
  CASE c_custkey % 3 WHEN 0 THEN concat('Ano: ', 2000 + c_custkey % 20) WHEN 1 THEN concat('', 1990 + c_custkey % 30) ELSE NULL END,
  CASE c_custkey % 5 WHEN 0 THEN 'Tese apresentada à Universidade, Programa de Pós-Graduação em Ecologia, para obtenção do título de doutor'
    WHEN 1 THEN concat('Dissertação de ', 1980 + c_custkey % 40, ' para o curso') WHEN 2 THEN 'Monografia de curso' WHEN 3 THEN 'Artigo de revista' ELSE NULL END,
  CASE c_custkey % 3 WHEN 0 THEN concat('Orientador', chr(10), 'João Lima') WHEN 1 THEN 'Orientadora: Eva Reis' ELSE NULL END,
  CASE WHEN c_custkey % 4 = 3 THEN concat('Maria ', CASE c_custkey % 3 WHEN 0 THEN 'Silva' WHEN 1 THEN 'Souza' ELSE 'Costa Lima' END) ELSE NULL END,
  CASE c_custkey % 5 WHEN 2 THEN 'Coorientador: Rui Dias' WHEN 3 THEN concat('Coorientadora', chr(10), 'Ana Dias') ELSE NULL END,
  CASE WHEN c_custkey % 7 = 0 THEN 'APÊNDICES' ELSE NULL END,
  CASE WHEN c_custkey % 4 = 2 THEN concat_ws(chr(10), 'AGRADECIMENTOS', 'Aos meus pais', 'e amigos.') ELSE NULL END,
  CASE WHEN c_custkey % 6 = 1 THEN concat_ws(chr(10), 'INDICADORES DE IMPACTO', 'Muito impacto.', 'CONCLUSÃO') ELSE NULL END,
  CASE WHEN c_custkey % 9 = 3 THEN concat_ws(chr(10), 'IMPACT INDICATORS', 'Much impact.') ELSE NULL END,
  CASE WHEN c_custkey % 6 <> 5 THEN concat_ws(chr(10), 'RESUMO', concat('Resumo de ', c_name, '.'), CASE WHEN c_custkey % 2 = 0 THEN '  Segunda   linha. ' ELSE NULL END,
    CASE WHEN c_custkey % 3 <> 0 THEN concat('Palavras-chave: solo; ', c_mktsegment, '.') ELSE NULL END) ELSE NULL END,
  CASE WHEN c_custkey % 5 <> 4 THEN concat_ws(chr(10), 'ABSTRACT', concat('About ', c_name, '.'), CASE WHEN c_custkey % 2 = 0 THEN 'Keywords: soil.' ELSE NULL END) ELSE NULL END,
  concat_ws(chr(10), '1 INTRODUÇÃO', concat('Texto de ', c_name), '1.1 Dados', concat('Saldo do segmento ', c_mktsegment), '2 MÉTODOS', 'Passos', '2.1.1 Detalhe', 'Mais passos'),
  CASE c_custkey % 3 WHEN 0 THEN concat('CONCLUSÃO', chr(10), 'Fim da obra.') WHEN 1 THEN concat('3 CONSIDERAÇÕES FINAIS', chr(10), 'Fim.') ELSE NULL END,
  CASE WHEN c_custkey % 8 <> 7 THEN concat_ws(chr(10), 'REFERÊNCIAS', concat('SILVA, A. Obra ', c_custkey, '. Natal: Sol, 2010.'), 'BRASIL. Lei nº 1, de 2001.', 'NETO, A. Nota') ELSE NULL END,
  CASE WHEN c_custkey % 4 = 1 THEN concat_ws(chr(10), 'ANEXO A', 'Tabela do anexo') ELSE NULL END,
  CASE WHEN c_custkey % 4 IN (1, 2) THEN concat_ws(chr(10), 'APÊNDICE A', 'Roteiro') ELSE NULL END) AS text
FROM {customer}
"""

#: Wide work records for validation and layout.
RECORDS = """
SELECT c_custkey AS doc_id,
  CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'tese' WHEN 2 THEN 'dissertacao' WHEN 3 THEN 'artigo' WHEN 4 THEN 'monografia' ELSE 'outro' END AS work_type,
  CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE concat('Título nº ', c_custkey, ' -- É bom') END AS title,
  CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Instituto de Física' WHEN 2 THEN 'Ana MG Souza' ELSE 'Ana Souza' END AS author,
  CASE WHEN c_custkey % 3 = 0 THEN 'João Lima' ELSE '' END AS advisor,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('Resumo', chr(10), 'em *duas* linhas') END AS resumo,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Abstract' END AS abstractText,
  CASE WHEN c_custkey % 6 = 5 THEN '' ELSE concat('Intro', chr(10), 'dois') END AS introducao,
  CASE WHEN c_custkey % 4 = 2 THEN 'Fim' ELSE '' END AS conclusao,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('SILVA, A. Obra ', c_custkey, '. Natal: Sol, 2010.', chr(10), chr(10), 'BRASIL. Lei nº 1, de 2001.') ELSE concat('NETO, A. Nota', chr(10), 'DIAS, E. Mapa de ', c_custkey, '. Disponível em: https://ex.test') END AS referencias,
  CASE WHEN c_custkey % 9 = 0 THEN '[Imagem detectada: rId4]' ELSE '' END AS anexos,
  CASE WHEN c_custkey % 10 = 0 THEN concat('Lista', chr(10), '[Imagem detectada: rId5]') ELSE '' END AS apendices,
  CASE WHEN c_custkey % 13 = 0 THEN 'Para mim' ELSE '' END AS dedicatoria,
  CASE WHEN c_custkey % 2 = 0 THEN 'Obrigado' ELSE '' END AS agradecimentos,
  CASE WHEN c_custkey % 17 = 0 THEN 'Verso' ELSE '' END AS epigrafe,
  CASE WHEN c_custkey % 5 = 1 THEN 'Impacto' ELSE '' END AS indicadoresImpacto,
  '' AS impactIndicators,
  CASE WHEN c_custkey % 12 = 0 THEN '2 imagens' ELSE '' END AS imageWarnings,
  CASE WHEN c_custkey % 5 = 0 THEN concat('Um subtítulo ', c_custkey) ELSE '' END AS subtitle,
  CASE WHEN c_custkey % 3 = 0 THEN 'Tese de teste' ELSE '' END AS workNature,
  CASE WHEN c_custkey % 4 = 1 THEN 'Agronomia' ELSE '' END AS course,
  CASE WHEN c_custkey % 6 = 2 THEN 'Ecologia' ELSE '' END AS program,
  CASE WHEN c_custkey % 8 = 3 THEN 'Eva Reis' ELSE '' END AS coadvisor,
  CASE WHEN c_custkey % 2 = 0 THEN 'Natal' ELSE '' END AS location,
  CASE WHEN c_custkey % 3 = 1 THEN '2020' ELSE '' END AS year,
  CASE WHEN c_custkey % 4 = 3 THEN 'solo; rio' ELSE '' END AS palavrasChave,
  CASE WHEN c_custkey % 5 = 2 THEN 'soil' ELSE '' END AS keywords,
  concat_ws(chr(10), CASE WHEN c_custkey % 3 = 0 THEN '# 1 Introdução' ELSE NULL END, 'Parágrafo com **negrito**', '', '## Dados', '> Citação longa', '### Nota', '  [ref] NETO, A. Extra. Natal: Sol, 2011.',
    CASE WHEN c_custkey % 4 = 0 THEN '![fig](x.png)' ELSE NULL END, CASE WHEN c_custkey % 8 = 0 THEN 'Figura 1 - Mapa' ELSE NULL END,
    CASE WHEN c_custkey % 5 = 0 THEN concat(chr(10), repeat('palavra ', 60), '(SILVA, 2010)', chr(10)) ELSE NULL END,
    CASE WHEN c_custkey % 7 = 0 THEN '# Conclusão' ELSE NULL END) AS editor_text
FROM {customer}
"""

#: The XML parts of Word files.
WORD_FILES = """
SELECT s_suppkey AS doc_id, concat('<w:document><w:body>',
  '<w:p><w:pPr><w:pStyle w:val="Ttulo1"/></w:pPr><w:r><w:t>', CASE WHEN s_suppkey % 2 = 0 THEN 'RESUMO' ELSE 'Obra' END, '</w:t></w:r></w:p>',
  '<w:p><w:r><w:t xml:space="preserve">Nome &amp; ', s_name, '</w:t><w:tab/><w:t>fim &#233;</w:t></w:r></w:p>',
  '<w:p><w:pPr><w:ind w:left="', CASE WHEN s_suppkey % 3 = 0 THEN '2268' ELSE '700' END, '"/></w:pPr><w:r><w:t>Trecho</w:t><w:br/><w:t>citado</w:t></w:r></w:p>',
  '<w:p><w:r><w:t>1.2 Dados</w:t></w:r><w:r><w:br w:type="page"/></w:r></w:p>',
  '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>', s_suppkey, '</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p></w:p></w:tc></w:tr></w:tbl>',
  '<w:p><w:r><w:drawing r:embed="rId', s_suppkey % 4, '"/></w:r></w:p>',
  '<w:p><w:r><w:t>REFERÊNCIAS</w:t></w:r></w:p><w:p><w:r><w:t>Item</w:t></w:r></w:p></w:body></w:document>') AS document_xml,
  '<w:styles><w:style w:styleId="Ttulo1"><w:name w:val="heading 1"/></w:style></w:styles>' AS styles_xml,
  concat('<Relationships><Relationship Id="rId1" Target="media/a.png"/>', CASE WHEN s_suppkey % 5 = 0 THEN '<Relationship Id="rId09" Target="media/a.png"/>' ELSE '' END, '<Relationship Id="rId2" Target="media/b.', CASE s_suppkey % 3 WHEN 0 THEN 'gif' WHEN 1 THEN 'jpeg' ELSE 'JPG' END, '"/><Relationship Id="rId3" Target="styles.xml"/></Relationships>') AS rels_xml,
  s_suppkey % 2 = 0 AS has_numbering
FROM {supplier}
"""

#: Word files whose looks come from direct marks, character and paragraph styles, chains of styles (one a circle in some
#: sheets), a default style or none, and defaults or none.
STYLED_FILES = """
SELECT c_custkey AS doc_id, concat('<w:document><w:body>',
  '<w:p><w:pPr><w:pStyle w:val="', CASE c_custkey % 3 WHEN 0 THEN 'Titulo1' WHEN 1 THEN 'Heading1' ELSE 'Nada' END, '"/></w:pPr><w:r><w:t>RESUMO</w:t></w:r></w:p>',
  '<w:p><w:pPr><w:pStyle w:val="Corpo"/>', CASE WHEN c_custkey % 4 = 0 THEN '<w:spacing w:before="0" w:line="240" w:lineRule="auto"/>' WHEN c_custkey % 4 = 1 THEN '<w:spacing w:line="300" w:lineRule="exact"/>' ELSE '' END,
  '<w:rPr><w:b/><w:color w:val="00FF00"/></w:rPr></w:pPr><w:r><w:t>Resumo de ', c_name, '.</w:t></w:r></w:p>',
  '<w:p><w:pPr><w:pStyle w:val="Titulo1"/>', CASE WHEN c_custkey % 2 = 0 THEN '<w:pageBreakBefore/>' ELSE '<w:pageBreakBefore w:val="0"/>' END, '</w:pPr><w:r><w:t xml:space="preserve">1 </w:t></w:r><w:r>',
  CASE WHEN c_custkey % 5 = 0 THEN '<w:rPr><w:b w:val="false"/></w:rPr>' ELSE '' END, '<w:t>INTRODUÇÃO</w:t></w:r></w:p>',
  '<w:p>', CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN '<w:pPr><w:pStyle w:val="Corpo"/></w:pPr>' WHEN 2 THEN '<w:pPr><w:pStyle w:val="Roda"/></w:pPr>' WHEN 3 THEN '<w:pPr><w:pStyle w:val="Nada"/><w:jc w:val="center"/></w:pPr>'
    WHEN 4 THEN '<w:pPr><w:pStyle w:val="Texto"/><w:ind w:firstLine="709" w:left="-10"/></w:pPr>' WHEN 5 THEN '<w:pPr><w:ind w:hanging="360" w:start="360"/></w:pPr>' ELSE '<w:pPr><w:pStyle w:val="Dobra"/></w:pPr>' END,
  '<w:r><w:rPr><w:rStyle w:val="', CASE c_custkey % 3 WHEN 0 THEN 'Realce' WHEN 1 THEN 'Forte' ELSE 'Falta' END, '"/></w:rPr><w:t xml:space="preserve">Texto </w:t></w:r><w:r>',
  CASE c_custkey % 6 WHEN 0 THEN '<w:rPr><w:rFonts w:ascii="Arial" w:hAnsi="Arial"/><w:sz w:val="20"/></w:rPr>' WHEN 1 THEN '<w:rPr><w:color w:val="0000ff"/><w:u w:val="single"/></w:rPr>' WHEN 2 THEN '<w:rPr><w:i/><w:u w:val="none"/></w:rPr>' ELSE '' END, '<w:t>de ', c_mktsegment, '</w:t><w:tab/></w:r><w:r><w:t></w:t></w:r></w:p>',
  '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>celula</w:t></w:r></w:p></w:tc></w:tr></w:tbl>',
  '<w:p><w:pPr><w:pStyle w:val="', CASE WHEN c_custkey % 2 = 0 THEN 'CitacaoLonga' ELSE 'Citacao' END, '"/>', CASE WHEN c_custkey % 3 = 0 THEN '<w:ind w:left="2268"/>' ELSE '' END, '</w:pPr><w:r><w:t>Trecho citado (SILVA, 2010)</w:t></w:r></w:p>',
  '<w:p><w:pPr><w:pStyle w:val="Corpo"/></w:pPr><w:r><w:t>', CASE WHEN c_custkey % 8 = 0 THEN concat(repeat('palavra ', 60), '(SOUZA, 2011)') ELSE 'curto' END, '</w:t></w:r></w:p>',
  '<w:p><w:pPr><w:pStyle w:val="Titulo1"/></w:pPr><w:r><w:t>REFERÊNCIAS</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Lista"/></w:pPr><w:r><w:t>SILVA, A. Obra.</w:t></w:r></w:p>',
  '<w:sectPr><w:pgSz w:w="11906"/><w:pgMar w:top="', CASE WHEN c_custkey % 5 = 0 THEN '1417' ELSE '1701' END, '" w:right="1134" w:bottom="1134" w:left="', CASE WHEN c_custkey % 7 = 0 THEN '1134' ELSE '1700' END, '"/></w:sectPr></w:body></w:document>') AS document_xml,
  concat('<w:styles>', CASE WHEN c_custkey % 4 <> 3 THEN '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Calibri" w:hAnsi="Calibri"/><w:sz w:val="22"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:line="259" w:lineRule="auto"/></w:pPr></w:pPrDefault></w:docDefaults>' ELSE '' END,
  CASE WHEN c_custkey % 10 <> 9 THEN '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:rPr><w:rFonts w:ascii="Times New Roman"/><w:sz w:val="24"/></w:rPr></w:style>' ELSE '' END,
  '<w:style w:type="paragraph" w:styleId="Texto"><w:name w:val="Texto base"/><w:basedOn w:val="Normal"/><w:pPr><w:spacing w:line="360" w:lineRule="auto"/><w:jc w:val="both"/></w:pPr></w:style>',
  '<w:style w:type="paragraph" w:styleId="Corpo"><w:name w:val="Corpo"/><w:basedOn w:val="Texto"/><w:pPr><w:ind w:firstLine="709"/></w:pPr></w:style>',
  '<w:style w:type="paragraph" w:styleId="Citacao"><w:name w:val="Citacao direta"/><w:basedOn w:val="Corpo"/><w:pPr><w:ind w:left="1134" w:firstLine="0"/></w:pPr><w:rPr><w:sz w:val="22"/></w:rPr></w:style>',
  '<w:style w:type="paragraph" w:styleId="CitacaoLonga"><w:name w:val="Citacao longa"/><w:basedOn w:val="Citacao"/><w:pPr><w:spacing w:line="240"/><w:ind w:left="2268"/></w:pPr></w:style>',
  '<w:style w:type="paragraph" w:styleId="Titulo1"><w:name w:val="heading 1"/><w:basedOn w:val="Texto"/><w:rPr><w:b/><w:sz w:val="', CASE WHEN c_custkey % 3 = 0 THEN '28' ELSE '24' END, '"/></w:rPr></w:style>',
  '<w:style w:type="paragraph" w:styleId="Lista"><w:name w:val="Lista"/><w:basedOn w:val="', CASE WHEN c_custkey % 2 = 0 THEN 'Corpo' ELSE 'Sumiu' END, '"/></w:style>',
  '<w:style w:type="paragraph" w:styleId="Roda"><w:name w:val="Roda"/><w:basedOn w:val="Gira"/><w:rPr><w:sz w:val="26"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Gira"><w:name w:val="Gira"/><w:basedOn w:val="', CASE WHEN c_custkey % 2 = 0 THEN 'Roda' ELSE 'Corpo' END, '"/><w:rPr><w:color w:val="0070C0"/></w:rPr></w:style>',
  '<w:style w:type="paragraph" w:styleId="Dobra"><w:name w:val="Velha"/><w:rPr><w:sz w:val="30"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Dobra"><w:name w:val="Nova"/><w:basedOn w:val="Corpo"/></w:style>',
  '<w:style w:type="character" w:styleId="Realce"><w:name w:val="Realce"/><w:rPr><w:i/><w:color w:val="FF0000"/></w:rPr></w:style>',
  '<w:style w:type="character" w:styleId="Forte"><w:name w:val="Forte"/><w:basedOn w:val="Realce"/><w:rPr><w:b w:val="1"/><w:rFonts w:hAnsi="Droid Serif"/></w:rPr></w:style></w:styles>') AS styles_xml
FROM {customer}
"""

#: References of every model, some short of a field, some of none.
MODEL_REFERENCES = """
SELECT o_custkey AS doc_id, o_orderkey AS ref_key,
  CASE o_orderkey % 26
    WHEN 0 THEN concat('PEREIRA, Ana. Solos do ', r_name, ': manejo ', o_orderkey, '. ', 1 + o_orderkey % 7, '. ed. Recife: Editora Sol, ', year(o_orderdate), '.')
    WHEN 1 THEN concat('ROCHA, D. B.; LIMA, E. Obra ', o_orderkey, '. Natal: Sol, ', year(o_orderdate), '.')
    WHEN 2 THEN concat('LIMA, Eva. Rios. ', 'Belém: Foz, ', year(o_orderdate), '. Disponível em: https://ex.test/', o_orderkey, '. Acesso em: ', 1 + o_orderkey % 28, ' jan. 2020.')
    WHEN 3 THEN concat('DIAS, Rui. Raízes ', o_orderkey, '. In: SOUZA, A. (org.). Plantas do ', r_name, '. Natal: Sol, ', year(o_orderdate), '. p. ', o_orderkey % 90, '-', o_orderkey % 90 + 9, '.')
    WHEN 4 THEN concat('LIMA, Caio. Ventos ', o_orderkey, '. ', year(o_orderdate), '. 90 p. Tese (Doutorado em Física) - Universidade ', r_name, ', Natal, ', year(o_orderdate), '.')
    WHEN 5 THEN concat('SILVA, Bia. [Carta]. Destinatário: Ana ', o_orderkey, '. Lavras, 3 mar. ', year(o_orderdate), '. 1 carta.')
    WHEN 6 THEN concat('REVISTA ', r_name, '. Brasília: Instituto Terra, ', year(o_orderdate), '- . ISSN 0034-', 1000 + o_orderkey % 9000, '. Trimestral.')
    WHEN 7 THEN concat('COSTA, Bia. Rios ', o_orderkey, '. Revista ', r_name, ', Belém, v. ', o_orderkey % 40, ', n. 1, p. 4-9, ', year(o_orderdate), '.')
    WHEN 8 THEN concat('COSTA, Bia. Rios ', o_orderkey, '. Revista Aquática, Belém, v. 3, n. ', o_orderkey % 12, ', ', year(o_orderdate), '. Disponível em: https://doi.org/10.1234/', o_orderkey, '. Acesso em: 2 fev. 2021.')
    WHEN 9 THEN concat('MELO, F. Seca ', o_orderkey, '. Folha de ', r_name, ', Lavras, 12 maio ', year(o_orderdate), '. Caderno 2, p. 3.')
    WHEN 10 THEN concat('REIS, Ana. Adubos. In: CONGRESSO DE SOLOS, 10., ', year(o_orderdate), ', Natal. Anais [...]. Natal: SBCS, ', year(o_orderdate), '. p. 30-31.')
    WHEN 11 THEN concat('NETO, A. Bomba ', o_orderkey, '. Depositante: Empresa Z. BR n. PI', o_orderkey, '. Depósito: 3 jan. ', year(o_orderdate), '.')
    WHEN 12 THEN concat('BRASIL. Lei nº ', o_orderkey, ', de 19 de março de ', year(o_orderdate), '. Dispõe. Brasília, DF, ', year(o_orderdate), '.')
    WHEN 13 THEN concat('BAGÉ em cena ', o_orderkey, '. Direção: Ana Reis. Bagé: Sul, ', year(o_orderdate), '. 1 DVD (90 min).')
    WHEN 14 THEN concat('CANTOS do rio. Intérprete: Eva Sol. ', r_name, ': Foz Discos, ', year(o_orderdate), '. 1 CD-áudio, faixa 2.')
    WHEN 15 THEN concat('VILLA, H. Coros ', o_orderkey, '. Rio: Casa, ', year(o_orderdate), '. 1 partitura (23 p.).')
    WHEN 16 THEN concat('KOB, K. Doenças ', o_orderkey, '. ', year(o_orderdate), '. 1 fotografia, color., 16 cm x 56 cm.')
    WHEN 17 THEN concat('INSTITUTO GEO. Regiões de ', r_name, '. Lavras: IG, ', year(o_orderdate), '. 1 atlas. Escala 1:2.000.')
    WHEN 18 THEN concat('DUCH, M. Vaso ', o_orderkey, '. ', year(o_orderdate), '. 1 escultura variável.')
    WHEN 19 THEN concat('NUVEM. Agenda: software de ', r_name, '. Disponível em: https://ex.test/', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '.' ELSE '. Acesso em: 5 jun. 2022.' END)
    WHEN 20 THEN concat('SOUZA, Ana. Chuvas ', o_orderkey, '. Zenodo, ', year(o_orderdate), '. Conjunto de dados. Disponível em: https://ex.test/z', o_orderkey, '.')
    WHEN 21 THEN concat('TEXTO SEM ESTRUTURA ', o_orderkey)
    WHEN 22 THEN concat('COSTA, Bia. Rios sem ano. Revista ', r_name, ', v. 3, n. 1, p. 4-9.')
    WHEN 23 THEN concat('  *ROCHA, D.* **Marcado ', o_orderkey, '**.   Natal: Sol, ', year(o_orderdate), '. ')
    WHEN 24 THEN ''
    ELSE concat('O estado das coisas em ', r_name, ', ', year(o_orderdate))
  END AS original
FROM {orders} JOIN {region} ON r_regionkey = o_orderkey % 5
"""

#: Texts with a table of contents that lacks, repeats, swaps or invents entries, or none.
SUMMARY_WORKS = """
SELECT c_custkey AS doc_id, concat_ws(chr(10), concat('Obra ', c_name), 'RESUMO', 'Resumo.',
  CASE WHEN c_custkey % 9 = 8 THEN NULL ELSE concat_ws(chr(10), CASE WHEN c_custkey % 2 = 0 THEN 'SUMÁRIO' ELSE '  Sumário ' END,
    CASE WHEN c_custkey % 5 = 2 THEN 'RESUMO ...... 2' ELSE NULL END, concat('1 INTRODUÇÃO ', repeat('.', 30), ' ', 9 + c_custkey % 3),
    CASE c_custkey % 4 WHEN 1 THEN concat('3 DADOS', chr(9), '14', chr(10), '2 MÉTODOS', chr(9), '12') WHEN 2 THEN '2 MÉTODOS    12' ELSE concat('2 Métodos ... 12', chr(10), '3 Dados … 14') END,
    CASE WHEN c_custkey % 7 = 3 THEN '3.1 Nada     15' ELSE NULL END, CASE WHEN c_custkey % 6 = 1 THEN concat('CONCLUSÃO ..... 20', chr(10), 'CONCLUSÃO ..... 21') ELSE 'CONCLUSÃO ..... 20' END,
    CASE WHEN c_custkey % 8 = 5 THEN concat('ANEXOS.....30', chr(10), 'REFERÊNCIAS.....22') WHEN c_custkey % 3 = 0 THEN 'REFERÊNCIAS .... 22' ELSE NULL END) END,
  '1 INTRODUÇÃO', 'Texto da obra.', '2 MÉTODOS', concat('Passos de ', c_mktsegment), '3 DADOS', CASE WHEN c_custkey % 10 = 4 THEN concat('3.1 Tabelas', chr(10), 'Linha ... 7') ELSE NULL END,
  'CONCLUSÃO', 'Fim.', 'REFERÊNCIAS', 'SILVA, A. Obra.', CASE WHEN c_custkey % 4 <> 3 THEN 'ANEXOS' ELSE NULL END) AS text
FROM {customer}
"""

#: Word files with images and tables: titles above, below, missing, of the wrong kind, shared or far; sources or none.
CAPTION_FILES = """
SELECT c_custkey AS doc_id, concat('<w:document><w:body><w:p><w:r><w:t>1 INTRODUÇÃO</w:t></w:r></w:p>',
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '<w:p><w:r><w:t>Tabela 1 – Dados</w:t></w:r></w:p>' WHEN 2 THEN '<w:p><w:r><w:t>Quadro 1 - Partes</w:t></w:r></w:p>' ELSE concat('<w:p><w:r><w:t>Figura ', c_custkey, ' – Mapa de ', c_mktsegment, '</w:t></w:r></w:p>') END,
  CASE WHEN c_custkey % 2 = 0 THEN '<w:p><w:r><w:t>Texto entre os dois.</w:t></w:r></w:p>' ELSE '' END,
  '<w:p><w:r><w:drawing r:embed="rId', 1 + c_custkey % 2, '"/></w:r></w:p>',
  CASE WHEN c_custkey % 3 = 0 THEN '<w:p><w:r><w:t>Fonte: Do autor (2020).</w:t></w:r></w:p>' ELSE '' END,
  CASE WHEN c_custkey % 4 = 0 THEN '<w:p><w:r><w:drawing r:embed="rId2"/></w:r></w:p>' WHEN c_custkey % 4 = 1 THEN '<w:p><w:r><w:t>GRÁFICO 2.1: Chuvas</w:t></w:r></w:p>' ELSE '' END,
  CASE WHEN c_custkey % 7 = 0 THEN '<w:p><w:r><w:t>2 DADOS</w:t></w:r></w:p>' ELSE '' END,
  CASE WHEN c_custkey % 3 = 1 THEN '<w:p><w:r><w:t>Tabela 2.3 - Valores</w:t></w:r></w:p>' WHEN c_custkey % 3 = 2 THEN '<w:p><w:r><w:t>Fontes: IBGE.</w:t></w:r></w:p>' ELSE '' END,
  '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>', c_custkey, '</w:t></w:r></w:p></w:tc></w:tr></w:tbl>',
  CASE c_custkey % 6 WHEN 0 THEN '<w:p><w:r><w:t>Tabela 9 - Abaixo</w:t></w:r></w:p><w:p><w:r><w:t>Fonte: Livro.</w:t></w:r></w:p>' WHEN 1 THEN '<w:p><w:r><w:t>Fonte: A.</w:t></w:r></w:p><w:p><w:r><w:t>Fonte: B.</w:t></w:r></w:p>' ELSE '<w:p><w:r><w:t>Fim.</w:t></w:r></w:p>' END,
  '<w:p><w:r><w:t>REFERÊNCIAS</w:t></w:r></w:p><w:p><w:r><w:t>Fonte: fora.</w:t></w:r></w:p></w:body></w:document>') AS document_xml,
  '' AS styles_xml, '<Relationships><Relationship Id="rId1" Target="media/a.png"/><Relationship Id="rId2" Target="media/b.png"/></Relationships>' AS rels_xml, false AS has_numbering
FROM {customer}
"""

#: What the media files of CAPTION_FILES hold: two with relationships, equal in some documents, and one without.
PACKAGE_MEDIA = """
SELECT c_custkey AS doc_id, 'media/a.png' AS target, concat('picture ', c_custkey % 7) AS said FROM {customer}
UNION ALL SELECT c_custkey, 'media/b.png', CASE WHEN c_custkey % 3 = 0 THEN concat('picture ', c_custkey % 7) ELSE concat('other ', c_custkey) END FROM {customer}
UNION ALL SELECT c_custkey, 'media/c.bin', c_name FROM {customer} WHERE c_custkey % 4 = 0
"""

#: Thirty paragraphs, the list and level of each from the document's number and its own place.
_LINES = ", ".join(
    f"""concat('<w:p><w:pPr><w:numPr><w:ilvl w:val="', (c_custkey * {x} + {x * x}) % 3, '"/><w:numId w:val="{2 if x % 7 == 3 else 3 if x % 11 == 5 else 0 if x % 13 == 6 else 1}"/></w:numPr></w:pPr><w:r><w:t>Item {x}</w:t></w:r></w:p>')"""
    for x in range(30)
)
#: Word files with two lists: levels passed over, overridden starts, several formats, a list without a definition.
NUMBERED_FILES = f"""
SELECT c_custkey AS doc_id, concat('<w:document><w:body>', {_LINES}, '</w:body></w:document>') AS document_xml,
  concat('<w:numbering><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1"/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="', 1 + c_custkey % 3, '"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1.%2"/></w:lvl>',
  '<w:lvl w:ilvl="2"><w:start w:val="1"/><w:numFmt w:val="', CASE c_custkey % 3 WHEN 0 THEN 'decimal' WHEN 1 THEN 'lowerLetter' ELSE 'upperRoman' END, '"/><w:lvlText w:val="%1.%2.%3."/></w:lvl></w:abstractNum>',
  '<w:abstractNum w:abstractNumId="8"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="', CASE c_custkey % 2 WHEN 0 THEN 'upperLetter' ELSE 'lowerRoman' END, '"/><w:lvlText w:val="(%1)"/></w:lvl></w:abstractNum>',
  '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/>', CASE WHEN c_custkey % 5 = 0 THEN '<w:lvlOverride w:ilvl="0"><w:startOverride w:val="25"/></w:lvlOverride>' ELSE '' END, '</w:num></w:numbering>') AS numbering_xml
FROM {{customer}}
"""

#: Paragraphs with citations: in quotes of either kind, nested, unclosed, over sentences, none, several a paragraph, in blocks.
CITED_BLOCKS = """
SELECT c_custkey AS doc_id, c_custkey % 5 AS block_idx, CASE WHEN c_custkey % 7 = 0 THEN 'longQuote' WHEN c_custkey % 11 = 0 THEN 'heading' ELSE 'paragraph' END AS block_type,
  concat(CASE c_custkey % 9 WHEN 0 THEN 'Diz-se "o rio corre" ' WHEN 1 THEN 'Para ele, “a ''terra'' é "boa" e fértil. Sempre.” ' WHEN 2 THEN 'Sem marcas no texto ' WHEN 3 THEN 'Aspas “abertas sem fim ' WHEN 4 THEN 'Fecha” sem abrir «mas cita» '
    WHEN 5 THEN concat('“', repeat('muitas palavras ', 20), '” ') WHEN 6 THEN '"dentro “fora” de" novo ' WHEN 7 THEN concat('Antes. «', c_name, '» ') ELSE '""vazio"" ' END,
  CASE c_custkey % 4 WHEN 0 THEN concat('(SILVA, ', 1980 + c_custkey % 40, ', p. ', c_custkey % 90, ')') WHEN 1 THEN '(SOUZA; LIMA, 2001)' WHEN 2 THEN 'Costa e Reis (2010, p. 3-4)' ELSE 'sem fonte' END,
  CASE c_custkey % 6 WHEN 0 THEN ' e "outra" frase (BRASIL, 1998, p. 7).' WHEN 1 THEN ' (SILVA, 1999) repete (SILVA, 1999).' ELSE '.' END) AS text
FROM {customer}
"""


def duckdb(sql: str) -> str:
    """The SQL over DuckDB's views."""
    return sql.format(orders="orders", region="region", customer="customer", supplier="supplier")


#: The key of each table that grows, and how many of its rows make a task. A row of these tables has few bytes but is composed
#: to a whole text or Word file, so scans cut by bytes would put millions of documents into one task.
TASKS = {"customer": ("c_custkey", 2_000), "supplier": ("s_suppkey", 2_000), "orders": ("o_orderkey", 20_000)}


def tasks(spark, sf_dir: str, name: str) -> int:
    """How many tasks a table's documents make; its rows are counted from the files' footers."""
    return -(-spark.read.parquet(f"{sf_dir}/{name}.parquet").count() // TASKS[name][1]) or 1


def _table(spark, sf_dir: str, name: str):
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.repartition(tasks(spark, sf_dir, name), TASKS[name][0]) if name in TASKS else table


def spark_frame(spark, sf_dir: str, sql: str):
    """The SQL over Spark's tables, dealt by their key: a task's share of documents is the same at every size."""
    names = [n for n in ("orders", "region", "customer", "supplier") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: _table(spark, sf_dir, n) for n in names})
