"""Queries over the router, field rules and XML. Documents are rendered from orders; each layout has a number."""

from pyspark.sql import functions as F

from ..functions import money, xml
from ..operators import fields, router, vendors
from ..sources.tables import spread, table

#: Layouts with the extractor and type they must reach. {k}: order key, {v}: amount, {d}: day.
LAYOUTS = (
    ("repromaq", "BOLETO", "REPROMAQ LOCACAO BRADESCO valor {v}"),
    ("gox", "BOLETO", "GOX INTERNET goxinternet.com.br boleto {v}"),
    ("emc", "OUTRO", "EMC TECNOLOGIA FATURA DE LOCAÇÃO {k} TOTAL R$ {v}"),
    ("net_center", "BOLETO", "NET CENTER UNAI vencimento {d} {v}"),
    ("tim", "UTILITY_BILL", "TIM S.A. FATURA: {k} vencimento {d} total {v}"),
    ("montes_claros", "NFSE", "Prefeitura de MONTES CLAROS NFS-e {k} valor {v}"),
    ("vila_velha", "NFSE", "PREFEITURA DE VILA VELHA nota {k}"),
    ("comprovante", "OUTRO", "COMPROVANTE DE TRANSFERENCIA valor {v} data {d}"),
    ("utility", "UTILITY_BILL", "CONTA DE LUZ consumo 120 KWH {v}"),
    ("telcables", "NFSE", "TELCABLES BRASIL LTDA NOTA FISCAL FATURA: {k}"),
    ("nfcom", "DANFE", "DOC. AUXILIAR DA NOTA FISCAL FATURA DE SERVIÇOS DE COMUNICAÇÃO {k}"),
    ("acimoc", "BOLETO", "ACIMOC RECIBO DO SACADO valor {v} vencimento {d}"),
    ("mugo", "NFSE", "MUGO TELECOM fatura {k}"),
    ("pro_painel", "BOLETO", "PRÓ - PAINEL LTDA {v}"),
    ("tunna", "OUTRO", "TUNNA ENTRETENIMENTO FAT/{k}"),
    ("ufinet", "OUTRO", "UFINET BRASIL S.A. FATURA No. {k}"),
    ("csc", "OUTRO", "NOTA DÉBITO / RECIBO FATURA CSC GESTAO {k}"),
    ("admin", "OUTRO", "DISTRATO de contrato {k}"),
    ("danfe", "DANFE", "DANFE {k} emissao {d}"),
    ("boleto", "BOLETO", "Beneficiário X Cedente Nosso numero {k} Vencimento {d} Valor do Documento {v}"),
    ("sicoob", "BOLETO", "SICOOB beneficio {k}"),
    ("aditivo", "OUTRO", "TERMO ADITIVO AO CONTRATO entre as PARTES {k}"),
    ("outros", "OUTRO", "LOCAWEB servicos mensais {k}"),
    ("nfse", "NFSE", "NOTA FISCAL DE SERVICO prestador tomador {k} valor {v}"),
    (None, None, "carta comum {k}"),
)


def _fill(layout: str):
    """The layout with order key, amount and day in place."""
    parts, rest = [], layout
    for piece in layout.replace("{", "\x00{").replace("}", "}\x00").split("\x00"):
        if piece == "{k}":
            parts.append(F.col("o_orderkey").cast("string"))
        elif piece == "{v}":
            parts.append(money.render_br(F.round("o_totalprice", 2)))
        elif piece == "{d}":
            parts.append(F.date_format("o_orderdate", "dd/MM/yyyy"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def rendered(spark, d):
    o = spread(table(spark, d, "orders")).select("o_orderkey", "o_totalprice", "o_orderdate")
    text = F.element_at(F.array(*[_fill(x[2]) for x in LAYOUTS]), (F.col("o_orderkey") % len(LAYOUTS) + 1).cast("int"))
    return o.select("o_orderkey", "o_totalprice", "o_orderdate", text.alias("text"))


def router_rules(spark, d):
    return router.routed(rendered(spark, d)).select("o_orderkey", "extractor", "doc_type")


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def slip_document(spark, d):
    o = spread(table(spark, d, "orders"))
    line = F.concat(F.lit("00190000090281390700000000000000"), F.lit("1"), F.lpad((F.col("o_orderkey") % 8999 + 1000).cast("string"), 4, "0"), F.lpad(F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"), 10, "0"))
    labelled = F.col("o_orderkey") % 2 == 0
    text = F.concat(F.lit("Beneficiário: FORNECEDOR ALFA LTDA CNPJ 12.345.678/0001-90\nNosso número: "), F.col("o_orderkey").cast("string"), F.lit("\nData do documento: 01/02/1999\n"),
                    F.when(labelled, F.concat(F.lit("Vencimento: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nValor do documento R$ "), money.render_br(F.round("o_totalprice", 2)), F.lit("\n"))).otherwise(F.lit("")), line)
    out = fields.slip_fields(o.select("o_orderkey", text.alias("text")))
    return out.select("o_orderkey", "linha_digitavel", F.round("valor", 2).alias("valor"), "vencimento", "numero", "cnpj", "fornecedor_nome", "data_emissao")


SLIP_SQL = """WITH x AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 8999 + 1000 AS INTEGER) AS f FROM orders),
y AS (SELECT *, DATE '1997-10-07' + f AS d0 FROM x)
SELECT o_orderkey, '00190000090281390700000000000000' || '1' || lpad(CAST(f AS VARCHAR), 4, '0') || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 10, '0') AS linha_digitavel,
  round(o_totalprice, 2) AS valor, CASE WHEN o_orderkey % 2 = 0 THEN day WHEN year(d0) < 2020 AND year(d0 + 10000) > 2045 THEN DATE '1999-02-01' ELSE CAST(CASE WHEN year(d0) < 2020 THEN d0 + 10000 ELSE d0 END AS DATE) END AS vencimento, CAST(o_orderkey AS VARCHAR) AS numero,
  '12.345.678/0001-90' AS cnpj, 'FORNECEDOR ALFA LTDA' AS fornecedor_nome, DATE '1999-02-01' AS data_emissao FROM y"""


def note_document(spark, d):
    o = spread(table(spark, d, "orders"))
    text = F.concat(F.lit("Prefeitura\nNúmero da Nota: 000"), (F.col("o_orderkey") + 1).cast("string"), F.lit("\nEmissão: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nRazão Social: BETA SERVICOS S.A.\nCNPJ 98.765.432/0001-10\nISS 1,50 INSS 2,00\n"),
                    F.when(F.col("o_orderkey") % 3 == 0, F.lit("Valor dos serviços R$ ")).when(F.col("o_orderkey") % 3 == 1, F.lit("TOTAL: R$ ")).otherwise(F.lit("Importância devida ")), money.render_br(F.round("o_totalprice", 2)), F.lit("\nVencimento\n\n"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nPedido: 77"))
    out = fields.note_fields(o.select("o_orderkey", text.alias("text")))
    return out.select("o_orderkey", F.round("valor", 2).alias("valor"), "numero", "vencimento", "data_emissao", "cnpj", "fornecedor_nome", "valor_iss", "valor_inss", "valor_csll", "numero_pedido")


NOTE_SQL = """SELECT o_orderkey, round(o_totalprice, 2) AS valor, CAST(o_orderkey + 1 AS VARCHAR) AS numero, CAST(o_orderdate AS DATE) AS vencimento, CAST(o_orderdate AS DATE) AS data_emissao, '98.765.432/0001-10' AS cnpj, 'BETA SERVICOS S.A.' AS fornecedor_nome,
  1.5 AS valor_iss, 2.0 AS valor_inss, 0.0 AS valor_csll, '77' AS numero_pedido FROM orders"""


def xml_document(spark, d):
    o = table(spark, d, "orders")
    k, v, day = F.col("o_orderkey").cast("string"), F.format_string("%.2f", F.col("o_totalprice")), F.date_format("o_orderdate", "yyyy-MM-dd")
    nfe = F.concat(F.lit('<?xml version="1.0"?><nfeProc xmlns="http://x"><NFe><infNFe Id="NFe'), F.lpad(k, 44, "3"), F.lit('"><ide><nNF>'), k, F.lit("</nNF><dhEmi>"), day, F.lit("T08:00:00-03:00</dhEmi></ide><emit><CNPJ>12345678000190</CNPJ><xNome>ALFA</xNome></emit><total><ICMSTot><vNF>"), v, F.lit("</vNF></ICMSTot></total><cobr><dup><dVenc>2001-01-31</dVenc></dup></cobr></infNFe></NFe></nfeProc>"))
    abrasf = F.concat(F.lit('<ns2:CompNfse xmlns:ns2="u"><ns2:Nfse><ns2:InfNfse><ns2:Numero>'), k, F.lit("</ns2:Numero><ns2:DataEmissao>"), day, F.lit("T10:00:00</ns2:DataEmissao><ns2:ValoresNfse><ns2:ValorLiquidoNfse>"), v, F.lit("</ns2:ValorLiquidoNfse></ns2:ValoresNfse><ns2:PrestadorServico><ns2:Cnpj>98765432000110</ns2:Cnpj><ns2:RazaoSocial>BETA</ns2:RazaoSocial></ns2:PrestadorServico></ns2:InfNfse></ns2:Nfse></ns2:CompNfse>"))
    broken = F.concat(F.lit("<nfeProc><NFe>"), k)
    m = F.col("o_orderkey") % 3
    out = xml.fields(spread(o).select("o_orderkey", F.when(m == 0, nfe).when(m == 1, abrasf).otherwise(broken).alias("xml")))
    return out.drop("xml", "numero_pedido")


def xml_dialects(spark, d):
    """Communication notes, national and municipal service notes."""
    k, v, day = F.col("o_orderkey").cast("string"), F.format_string("%.2f", F.col("o_totalprice")), F.date_format("o_orderdate", "yyyy-MM-dd")
    m = F.col("o_orderkey") % 4
    first = F.when(F.col("o_orderkey") % 8 == 0, F.lit("0.00")).otherwise(v)
    comm = F.concat(F.lit('<nfcomProc xmlns="http://www.portalfiscal.inf.br/nfcom"><NFCom><infNFCom Id="NFCom'), F.lpad(k, 44, "5"), F.lit('"><ide><mod>62</mod><nNF>'), k, F.lit("</nNF><dhEmi>"), day, F.lit("T10:00:00-03:00</dhEmi></ide><emit><CNPJ>11222333000144</CNPJ><xFant>FIBRA</xFant></emit><total><vProd>"), v,
                    F.lit("</vProd><vNF>"), first, F.lit("</vNF></total><gFat><dVencFat>2001-03-05</dVencFat></gFat></infNFCom></NFCom></nfcomProc>"))
    sped = F.concat(F.lit('<NFSe xmlns="http://www.sped.fazenda.gov.br/nfse"><infNFSe Id="x"><nNFSe>'), k, F.lit("</nNFSe><dhProc>"), day, F.lit("T09:00:00</dhProc><emit><CNPJ>55666777000188</CNPJ><xNome>GAMA</xNome></emit>"), F.when(F.col("o_orderkey") % 8 == 1, F.concat(F.lit("<valores><vLiq>"), v, F.lit("</vLiq></valores>"))).otherwise(F.lit("")),
                    F.lit('<DPS v="1"><infDPS Id="y"><toma><CNPJ>1</CNPJ></toma><serv><cServ><xDescServ>Pedido '), k, F.lit(" vencimento: 05/04/2001</xDescServ></cServ></serv><valores><vServPrest><vServ>"), v, F.lit("</vServ></vServPrest></valores></infDPS></DPS></infNFSe></NFSe>"))
    city = F.concat(F.lit("<NFe><Prefeitura>Marilia</Prefeitura><ChaveNFe><NumeroNFe>"), k, F.lit("</NumeroNFe><DataEmissaoNFe>"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("</DataEmissaoNFe></ChaveNFe><CPFCNPJPrestador><CPF>12345678909</CPF></CPFCNPJPrestador><RazaoSocialPrestador>DELTA &amp; CIA</RazaoSocialPrestador><StatusNFe>N</StatusNFe><ValorServicos>"), v, F.lit("</ValorServicos></NFe>"))
    other = F.concat(F.lit("<nota><numero>"), k, F.lit("</numero></nota>"))
    out = xml.fields(spread(table(spark, d, "orders")).select("o_orderkey", F.when(m == 0, comm).when(m == 1, sped).when(m == 2, city).otherwise(other).alias("xml")))
    return out.drop("xml")


XML_SQL = """SELECT o_orderkey, o_orderkey % 3 < 2 AS ok, ['NFE', 'ABRASF', NULL][o_orderkey % 3 + 1] AS dialect, ['DANFE', 'NFSE', NULL][o_orderkey % 3 + 1] AS doc_type, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey AS VARCHAR) END AS numero,
  ['12345678000190', '98765432000110', NULL][o_orderkey % 3 + 1] AS cnpj, ['ALFA', 'BETA', NULL][o_orderkey % 3 + 1] AS fornecedor_nome, CASE WHEN o_orderkey % 3 < 2 THEN CAST(printf('%.2f', o_totalprice) AS DOUBLE) ELSE 0 END AS valor,
  CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS data_emissao, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2001-01-31' END AS vencimento, CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 44, '3') END AS chave_acesso FROM orders"""


_OF = "[{}][o_orderkey % 4 + 1]"
DIALECTS_SQL = f"""SELECT o_orderkey, true AS ok, {_OF.format("'NFCOM', 'SPED', 'SIGISS', NULL")} AS dialect, {_OF.format("'DANFE', 'NFSE', 'NFSE', NULL")} AS doc_type, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey AS VARCHAR) END AS numero, {_OF.format("'11222333000144', '55666777000188', '12345678909', NULL")} AS cnpj,
  {_OF.format("'FIBRA', 'GAMA', 'DELTA & CIA', NULL")} AS fornecedor_nome, CASE WHEN o_orderkey % 4 < 3 THEN CAST(printf('%.2f', o_totalprice) AS DOUBLE) ELSE 0 END AS valor, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS data_emissao, {_OF.format("DATE '2001-03-05', DATE '2001-04-05', NULL, NULL")} AS vencimento,
  CASE WHEN o_orderkey % 4 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 44, '5') END AS chave_acesso, CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey AS VARCHAR) END AS numero_pedido FROM orders"""


#: Layouts of vendors: extractor, text, supplier, number ({k} or None).
VENDOR_LAYOUTS = (
    ("gox", "GOX goxinternet.com.br receber_{k}\nTotal a pagar: R$ {v}\n{d}", "GOX S.A.", "{k}"),
    ("emc", "EMC TECNOLOGIA FATURA DE LOCAÇÃO Nº {k}\nTOTAL R$ {v}\nVencimento: {d}", "EMC TECNOLOGIA LTDA", "{k}"),
    ("tunna", "TUNNA ENTRETENIMENTO FAT/{k}\nvalor {v}\nVencimento: {d}", "TUNNA ENTRETENIMENTO E AUDIOVISUAL LTDA", "{k}"),
    ("ufinet", "UFINET BRASIL FATURA No. {k}\nTotal (BRL): {v}\nVencimento: {d}", "UFINET BRASIL S.A.", "{k}"),
    ("telcables", "TELCABLES BRASIL LTDA\nNOTA FISCAL FATURA: {k}\nTOTAL A PAGAR: R$ {v}\nVencimento: {d}", "TELCABLES BRASIL LTDA FILIAL SAO PAULO", "{k}"),
)


def vendor_documents(spark, d):
    o = spread(table(spark, d, "orders")).select((F.col("o_orderkey") + 100_000).alias("o_orderkey"), "o_totalprice", "o_orderdate")
    text = F.element_at(F.array(*[_fill(x[1]) for x in VENDOR_LAYOUTS]), (F.col("o_orderkey") % len(VENDOR_LAYOUTS) + 1).cast("int"))
    out = vendors.with_vendor_fields(router.routed(o.select("o_orderkey", text.alias("text"))))
    return out.select("o_orderkey", "extractor", "fornecedor_nome", "numero", F.round("valor", 2).alias("valor"), "vencimento")


def xml_notes(spark, d):
    """All fields of a note in each of the five dialects: taxes, client, payment, items and instalments."""
    o = spread(table(spark, d, "orders"))
    k, v, day = F.col("o_orderkey").cast("string"), F.format_string("%.2f", F.col("o_totalprice")), F.date_format("o_orderdate", "yyyy-MM-dd")
    n = (F.col("o_orderkey") % 3 + 1).cast("int")
    item = lambda i: F.concat(F.lit('<det nItem="'), i.cast("string"), F.lit('"><prod><cProd>C'), i.cast("string"), F.lit("</cProd><xProd>peça &lt;"), i.cast("string"), F.lit("&gt;</xProd><qCom>2.0000</qCom><vUnCom>1.50</vUnCom><vProd>3.00</vProd></prod><imposto><ICMS/></imposto></det>"))
    part = lambda i: F.concat(F.lit("<dup><nDup>00"), i.cast("string"), F.lit("</nDup><dVenc>2001-0"), i.cast("string"), F.lit("-15</dVenc><vDup>10."), i.cast("string"), F.lit("0</vDup></dup>"))
    many = lambda f: F.array_join(F.transform(F.sequence(F.lit(1), n), f), "")
    nfe = F.concat(F.lit('<nfeProc xmlns="http://www.portalfiscal.inf.br/nfe"><NFe><infNFe versao="4.00" Id="NFe'), F.lpad(k, 44, "3"), F.lit('"><ide><natOp>VENDA</natOp><serie>7</serie><nNF>'), k, F.lit("</nNF><dhEmi>"), day,
                   F.lit("T08:00:00-03:00</dhEmi></ide><emit><CNPJ>12345678000190</CNPJ><xNome>ALFA</xNome></emit><dest><CNPJ>99888777000166</CNPJ><xNome>CLIENTE</xNome></dest>"), many(item), F.lit("<total><ICMSTot><vBC>100.00</vBC><vICMS>18.00</vICMS><vNF>"), v, F.lit("</vNF></ICMSTot></total><cobr><fat><nFat>F9</nFat></fat>"), F.when(n > 1, many(part)).otherwise(F.lit("")),
                   F.lit("</cobr><pag><detPag><tPag>"), F.element_at(F.array(F.lit("17"), F.lit("15"), F.lit("88")), n), F.lit("</tPag><vPag>"), v, F.lit("</vPag></detPag></pag><infAdic><infCpl>Pedido: 12"), k, F.lit("34</infCpl></infAdic></infNFe></NFe></nfeProc>"))
    comm = F.concat(F.lit('<NFCom xmlns="http://www.portalfiscal.inf.br/nfcom"><infNFCom Id="NFCom'), F.lpad(k, 44, "5"), F.lit('"><ide><mod>62</mod><serie>1</serie><nNF>'), k, F.lit("</nNF><dhEmi>"), day, F.lit("</dhEmi></ide><emit><CNPJ>11.222.333/0001-44</CNPJ><xNome>FIBRA SA</xNome><xFant>F</xFant></emit><total><vNF>"), v, F.lit("</vNF></total></infNFCom></NFCom>"))
    sped = F.concat(F.lit('<NFSe xmlns="http://www.sped.fazenda.gov.br/nfse"><infNFSe Id="x"><nDFSe>'), k, F.lit('</nDFSe><emit><CNPJ>55666777000188</CNPJ><xNome>GAMA</xNome></emit><DPS v="1"><infDPS><dCompet>'), day, F.lit("</dCompet><toma><CNPJ>44555666000177</CNPJ><xNome>TOMA</xNome></toma><serv><cServ><xDescServ>Vencimento 05/04/2001</xDescServ></cServ></serv><valores><vServPrest><vServ>"), v, F.lit("</vServ></vServPrest></valores></infDPS></DPS></infNFSe></NFSe>"))
    city = F.concat(F.lit("<NFe><Prefeitura>Marilia</Prefeitura><ChaveNFe><SerieNFe>E</SerieNFe><CodigoVerificacao>AB-1</CodigoVerificacao><NumeroNFe>"), k, F.lit("</NumeroNFe><DataEmissaoNFe>"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("</DataEmissaoNFe></ChaveNFe><CPFCNPJPrestador><CNPJ>12345678000190</CNPJ></CPFCNPJPrestador><RazaoSocialPrestador>DELTA &amp; CIA</RazaoSocialPrestador><StatusNFe>N</StatusNFe><ValorServicos>"), v,
                    F.lit("</ValorServicos><ValorBase>90.00</ValorBase><ValorISS>4,50</ValorISS><ValorIR>1.50</ValorIR><ValorINSS>1.234,56</ValorINSS><ValorPIS>0.65</ValorPIS><ValorCOFINS>3.00</ValorCOFINS><ValorCSLL>1.00</ValorCSLL><AliquotaServicos>0.05</AliquotaServicos><CPFCNPJTomador><CPF>12345678909</CPF></CPFCNPJTomador><RazaoSocialTomador>PESSOA</RazaoSocialTomador><Discriminacao>OC 98765 mensal</Discriminacao></NFe>"))
    abrasf = F.concat(F.lit('<ns2:CompNfse xmlns:ns2="http://www.abrasf.org.br/nfse.xsd"><ns2:Nfse><ns2:InfNfse Id="1"><ns2:Numero>'), k, F.lit("</ns2:Numero><ns2:CodigoVerificacao>ZX</ns2:CodigoVerificacao><ns2:DataEmissao>"), day,
                      F.lit("T10:00:00</ns2:DataEmissao><ns2:Servico><ns2:Valores><ns2:ValorServicos>"), v, F.lit("</ns2:ValorServicos><ns2:ValorIss>5.00</ns2:ValorIss><ns2:ValorIr>1.50</ns2:ValorIr><ns2:ValorInss>11.00</ns2:ValorInss><ns2:ValorCsll>1.00</ns2:ValorCsll></ns2:Valores>"), F.when(n == 2, F.lit("<ns2:ValorLiquidoNfse>77.70</ns2:ValorLiquidoNfse>")).otherwise(F.lit("")),
                      F.lit("<ns2:Discriminacao>ref 4321 x</ns2:Discriminacao></ns2:Servico><ns2:PrestadorServico><ns2:IdentificacaoPrestador><ns2:CpfCnpj><ns2:Cnpj>98765432000110</ns2:Cnpj></ns2:CpfCnpj></ns2:IdentificacaoPrestador><ns2:RazaoSocial>BETA</ns2:RazaoSocial></ns2:PrestadorServico><ns2:TomadorServico><ns2:IdentificacaoTomador><ns2:CpfCnpj><ns2:Cnpj>44555666000177</ns2:Cnpj></ns2:CpfCnpj></ns2:IdentificacaoTomador><ns2:RazaoSocial>TOMA</ns2:RazaoSocial></ns2:TomadorServico></ns2:InfNfse></ns2:Nfse></ns2:CompNfse>"))
    m = F.col("o_orderkey") % 5
    x = xml.document(o.select("o_orderkey", F.when(m == 0, nfe).when(m == 1, comm).when(m == 2, sped).when(m == 3, city).otherwise(abrasf).alias("xml")))
    lists = {"n_itens": F.size("itens"), "item": F.concat_ws("|", *[F.element_at("itens", -1)[c] for c in ("codigo", "descricao", "quantidade", "valor_unitario", "valor")]), "n_parcelas": F.size("parcelas"), "parcela": F.concat_ws("|", *[F.element_at("parcelas", -1)[c] for c in ("numero", "vencimento", "valor")])}
    return x.withColumns(lists).drop("xml", "itens", "parcelas", "pagamentos", "ok", "info_complementar")


def _five(*values: str) -> str:
    return f"[{', '.join(values)}][o_orderkey % 5 + 1]"


_N = "(o_orderkey % 3 + 1)"
NOTES_SQL = f"""SELECT o_orderkey, {_five("'NFE'", "'NFCOM'", "'SPED'", "'SIGISS'", "'ABRASF'")} AS dialect, {_five("'DANFE'", "'DANFE'", "'NFSE'", "'NFSE'", "'NFSE'")} AS doc_type, CAST(o_orderkey AS VARCHAR) AS numero, {_five("'7'", "'1'", "NULL", "'E'", "NULL")} AS serie,
  {_five("'12345678000190'", "'11.222.333/0001-44'", "'55666777000188'", "'12345678000190'", "'98765432000110'")} AS cnpj, {_five("'ALFA'", "'FIBRA SA'", "'GAMA'", "'DELTA & CIA'", "'BETA'")} AS fornecedor_nome, {_five("'VENDA'", *["NULL"] * 4)} AS natureza_operacao, {_five("NULL", "NULL", "NULL", "'AB-1'", "'ZX'")} AS codigo_verificacao,
  {_five("NULL", "NULL", "NULL", "'N'", "NULL")} AS status, {_five("NULL", "NULL", "NULL", "'Marilia'", "NULL")} AS prefeitura, {_five("'99888777000166'", "NULL", "'44555666000177'", "'12345678909'", "'44555666000177'")} AS cnpj_tomador, {_five("'CLIENTE'", "NULL", "'TOMA'", "'PESSOA'", "'TOMA'")} AS tomador_nome,
  {_five("18.0", *["NULL"] * 4)} AS valor_icms, {_five("100.0", *["NULL"] * 4)} AS base_calculo_icms, {_five("NULL", "NULL", "NULL", "90.0", "NULL")} AS valor_base, {_five("NULL", "NULL", "NULL", "4.5", "5.0")} AS valor_iss, {_five("NULL", "NULL", "NULL", "1.5", "1.5")} AS valor_ir, {_five("NULL", "NULL", "NULL", "1234.56", "11.0")} AS valor_inss,
  {_five("NULL", "NULL", "NULL", "0.65", "NULL")} AS valor_pis, {_five("NULL", "NULL", "NULL", "3.0", "NULL")} AS valor_cofins, {_five("NULL", "NULL", "NULL", "1.0", "1.0")} AS valor_csll, {_five("NULL", "NULL", "NULL", "0.05", "NULL")} AS aliquota,
  CASE WHEN o_orderkey % 5 = 4 AND {_N} = 2 THEN 77.7 ELSE CAST(printf('%.2f', o_totalprice) AS DOUBLE) END AS valor, CAST(o_orderdate AS DATE) AS data_emissao, CASE WHEN o_orderkey % 5 = 0 AND {_N} > 1 THEN DATE '2001-01-15' WHEN o_orderkey % 5 = 2 THEN DATE '2001-04-05' END AS vencimento,
  CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN {_N} > 1 THEN '001' ELSE 'F9' END END AS numero_fatura, CASE WHEN o_orderkey % 5 = 0 THEN ['PIX', 'BOLETO', 'CODIGO_88'][{_N}] END AS forma_pagamento, CASE o_orderkey % 5 WHEN 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 44, '3') WHEN 1 THEN lpad(CAST(o_orderkey AS VARCHAR), 44, '5') END AS chave_acesso,
  CASE o_orderkey % 5 WHEN 0 THEN '12' || o_orderkey || '34' WHEN 3 THEN '98765' WHEN 4 THEN '4321' END AS numero_pedido, CASE WHEN o_orderkey % 5 = 0 THEN {_N} END AS n_itens, CASE WHEN o_orderkey % 5 = 0 THEN 'C' || {_N} || '|peça <' || {_N} || '>|2.0000|1.50|3.00' ELSE '' END AS item,
  CASE WHEN o_orderkey % 5 = 0 AND {_N} > 1 THEN {_N} END AS n_parcelas, CASE WHEN o_orderkey % 5 = 0 AND {_N} > 1 THEN '00' || {_N} || '|2001-0' || {_N} || '-15|10.' || {_N} || '0' ELSE '' END AS parcela FROM orders"""


def instalment_list(spark, d):
    o = table(spark, d, "orders")
    text = F.concat(F.lit("2/12 10/02/2001 "), money.render_br(F.round("o_totalprice", 2)), F.lit("\n10/12 05/10/2001 R$ 1,00"))
    x = o.select("o_orderkey", fields.instalments(text).alias("i"))
    return x.select("o_orderkey", F.size("i").alias("n"), F.array_min("i")["parcela"].alias("first"), F.round(F.aggregate("i", F.lit(0.0), lambda a, r: a + r["valor"]), 2).alias("total"))


QUERIES = {f.__name__: f for f in (router_rules, slip_document, note_document, vendor_documents, xml_document, xml_dialects, xml_notes, instalment_list)}
SQL = {
    "router_rules": f"SELECT o_orderkey, {_list(x[0] for x in LAYOUTS)}[o_orderkey % {len(LAYOUTS)} + 1] AS extractor, {_list(x[1] for x in LAYOUTS)}[o_orderkey % {len(LAYOUTS)} + 1] AS doc_type FROM orders",
    "vendor_documents": f"SELECT o_orderkey + 100000 AS o_orderkey, {_list(x[0] for x in VENDOR_LAYOUTS)}[(o_orderkey + 100000) % 5 + 1] AS extractor, {_list(x[2] for x in VENDOR_LAYOUTS)}[(o_orderkey + 100000) % 5 + 1] AS fornecedor_nome, CAST(o_orderkey + 100000 AS VARCHAR) AS numero, round(o_totalprice, 2) AS valor, CAST(o_orderdate AS DATE) AS vencimento FROM orders",
    "slip_document": SLIP_SQL, "note_document": NOTE_SQL, "xml_document": XML_SQL, "xml_dialects": DIALECTS_SQL, "xml_notes": NOTES_SQL,
    "instalment_list": "SELECT o_orderkey, 2 AS n, '10/12' AS first, round(round(o_totalprice, 2) + 1, 2) AS total FROM orders",
}
