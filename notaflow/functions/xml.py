"""Fiscal XML: namespaces taken off, the dialect found by its marks, one parse of the document into the dialect's fields.

What a dialect keeps where is data: paths of elements (`@name` an attribute, `name[]` a repeated element). All paths of a
dialect make one schema, the document's information element is parsed once by it, and fields are look-ups in the result.
Element names that differ only in case stay apart: the parser gets them as they are, and the result is renamed by place.
Documents that are no well-formed XML give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dates, ids, money
from .phrases import hits
from .text import let


def text_of(content: Column) -> Column:
    """Text of a file's bytes: UTF-8 where it is that, else Latin-1; no byte order mark."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def bare(xml: Column) -> Column:
    """No declaration, comments, namespaces or prefixes."""
    out = F.regexp_replace(xml, r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", "")
    out = F.regexp_replace(out, r"""\s+[\w:]*xmlns(:\w+)?\s*=\s*("[^"]*"|'[^']*')""", "")
    return F.regexp_replace(out, r"(</?)[A-Za-z_][\w.-]*:", "$1")


def sound(xml: Column) -> Column:
    """Whether a document is well-formed: the parser keeps no faulty record."""
    return F.coalesce(F.from_xml(F.nullif(F.trim(xml), F.lit("")), "_corrupt_record string")["_corrupt_record"].isNull() & (F.trim(xml) != ""), F.lit(False))


# Marks of the dialects, in the order in which they are asked for, and how many of them make one.
MARKS = (
    ("NFCOM", 1, ("<nfcomProc", "<NFCom>", "<infNFCom", "portalfiscal.inf.br/nfcom", "<mod>62</mod>")),
    ("SPED", 2, ("sped.fazenda.gov.br/nfse", "<infNFSe ", "<nNFSe>", "<nDFSe>", "<DPS ", "<infDPS ", "<toma>", "<prest>")),
    ("SIGISS", 3, ("<NumeroNFe>", "<InscricaoPrestador>", "<CPFCNPJPrestador>", "<TributacaoNFe>", "<StatusNFe>", "<ChaveNFe>", "<RazaoSocialPrestador>")),
    ("NFE", 1, ("<nfeProc", "<infNFe", "portalfiscal.inf.br/nfe", "<mod>55</mod>")),
    ("ABRASF", 1, ("<CompNfse", "<Nfse>", "<InfNfse", "<ListaNfse", "<ConsultarNfseResposta", "abrasf.org.br", "<Rps>", "<InfRps", "nfse.xsd", "<NumeroNfse", "<PrestadorServico", "<TomadorServico")),
)
def dialect(xml: Column, without: Column) -> Column:
    """Which fiscal format a document is in; null if none. Case, and prefixes of element names, don't matter. without: xml, bare."""
    marks = {name: [m.lower() for m in of] for name, _, of in MARKS}
    addresses = [m for of in marks.values() for m in of if not m.startswith("<")]  # not in the bare document any more
    tags = [m for of in marks.values() for m in of if m.startswith("<")]

    def pick(at: Column) -> Column:
        found = F.concat(hits(F.lower(F.translate(without, "\t\r\n", "   ")), tags), F.array_compact(F.array(*[F.when(F.contains(at, F.lit(a)), F.lit(a)) for a in addresses])))
        return let(found, chosen)

    def chosen(found: Column) -> Column:
        return F.coalesce(*[F.when(F.size(F.array_intersect(found, F.array(*map(F.lit, marks[name])))) >= least, F.lit(name)) for name, least, _ in MARKS])

    return let(F.lower(xml), pick)


#: The element that holds a note, the first of which is there.
HOLDERS = {"NFCOM": ("infNFCom", "NFCom"), "NFE": ("infNFe", "InfNFe"), "SIGISS": ("NFe",), "SPED": ("infNFSe", "NFSe"), "ABRASF": ("InfNfse", "infNfse", "InfRps", "infRps", "CompNfse", "Nfse")}
# Where each dialect keeps what; the first path that has a text counts.
_PARTY = ("Cnpj", "CNPJ", "cnpj", "{}/Cnpj", "{}/CpfCnpj/Cnpj", "CpfCnpj/Cnpj", "CpfCnpj/Cpf", "{}/CpfCnpj/Cpf")
_PROVIDERS, _CLIENTS, _SERVICES = ("PrestadorServico", "Prestador", "prestadorServico", "DadosPrestador"), ("TomadorServico", "Tomador", "tomadorServico", "DadosTomador"), ("Servico", "servico", "ValoresServico", "DadosServico")


def _each(outer: tuple[str, ...], inner: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"{o}/{i}" for o in outer for i in inner)


def _in_service(*names: str) -> tuple[str, ...]:
    """In the service's element or its values."""
    return tuple(f"{s}/{deep}{n}" for n in names for s in _SERVICES for deep in ("", "Valores/"))


PATHS = {
    "NFE": {
        "chave": ("@Id",), "numero": ("ide/nNF",), "serie": ("ide/serie",), "emissao": ("ide/dhEmi", "ide/dEmi"), "natureza_operacao": ("ide/natOp",), "cnpj": ("emit/CNPJ",), "fornecedor_nome": ("emit/xNome",),
        "valor": ("total/ICMSTot/vNF",), "valor_icms": ("total/ICMSTot/vICMS",), "base_calculo_icms": ("total/ICMSTot/vBC",), "fatura": ("cobr/fat/nFat",), "info_complementar": ("infAdic/infCpl",), "cnpj_tomador": ("dest/CNPJ", "dest/CPF"), "tomador_nome": ("dest/xNome",),
    },
    "NFCOM": {
        "chave": ("@Id", "infNFCom/@Id"), "numero": ("ide/nNF", "infNFCom/ide/nNF"), "serie": ("ide/serie",), "emissao": ("ide/dhEmi",), "cnpj": ("emit/CNPJ",), "fornecedor_nome": ("emit/xNome", "emit/xFant"), "valor": ("total/vNF", "total/vProd"), "vencimento": ("gFat/dVencFat",),
    },
    "SPED": {
        "numero": ("nNFSe", "nDFSe", "Numero"), "emissao": ("dhProc", "dhEmi", "DPS/infDPS/dhEmi", "DPS/infDPS/dCompet"), "cnpj": ("emit/CNPJ",), "fornecedor_nome": ("emit/xNome",),
        "valor": ("valores/vLiq", "valores/vServ", "valores/vTotServ", "DPS/infDPS/valores/vServPrest/vServ"), "cnpj_tomador": ("DPS/infDPS/toma/CNPJ",), "tomador_nome": ("DPS/infDPS/toma/xNome",), "info_complementar": ("DPS/infDPS/serv/cServ/xDescServ",),
    },
    "SIGISS": {
        "numero": ("ChaveNFe/NumeroNFe",), "serie": ("ChaveNFe/SerieNFe",), "codigo_verificacao": ("ChaveNFe/CodigoVerificacao",), "emissao": ("ChaveNFe/DataEmissaoNFe",), "cnpj": ("CPFCNPJPrestador/CNPJ", "CPFCNPJPrestador/CPF"), "fornecedor_nome": ("RazaoSocialPrestador",),
        "valor": ("ValorServicos",), "valor_base": ("ValorBase",), "valor_iss": ("ValorISS",), "valor_ir": ("ValorIR",), "valor_inss": ("ValorINSS",), "valor_pis": ("ValorPIS",), "valor_cofins": ("ValorCOFINS",), "valor_csll": ("ValorCSLL",), "aliquota": ("AliquotaServicos",),
        "status": ("StatusNFe",), "prefeitura": ("Prefeitura",), "cnpj_tomador": ("CPFCNPJTomador/CNPJ", "CPFCNPJTomador/CPF"), "tomador_nome": ("RazaoSocialTomador",), "info_complementar": ("Discriminacao",),
    },
    "ABRASF": {
        "numero": ("Numero", "NumeroNfse", "numero", "numeroNfse", "IdentificacaoNfse/Numero", "IdentificacaoRps/Numero"), "codigo_verificacao": ("CodigoVerificacao", "codigoVerificacao", "CodVerificacao"),
        "emissao": ("DataEmissao", "dataEmissao", "DataEmissaoNfse", "dtEmissao", "DtEmissao", "DataHoraEmissao"), "cnpj": _each(_PROVIDERS, tuple(x.format("IdentificacaoPrestador") for x in _PARTY)),
        "fornecedor_nome": _each(_PROVIDERS, ("RazaoSocial", "razaoSocial", "Nome", "nome", "NomeFantasia", "xNome")), "liquido": _in_service("ValorLiquidoNfse", "ValorLiquido", "valorLiquido"),
        "valor": (*_in_service("ValorServicos", "valorServicos", "ValorLiquidoNfse", "ValorNfse", "vServ"), "ValorServicos", "ValoresNfse/ValorServicos", "ValorNfse", "ValoresNfse/ValorNfse", "ValorLiquidoNfse", "ValoresNfse/ValorLiquidoNfse", "Valores/ValorServicos"),
        "valor_iss": _in_service("ValorIss", "valorIss", "ValorISSQN", "vISS"), "valor_ir": _in_service("ValorIr", "valorIr", "ValorIRRF", "vIR"), "valor_inss": _in_service("ValorInss", "valorInss", "ValorINSS", "vINSS"), "valor_csll": _in_service("ValorCsll", "valorCsll", "ValorCSLL", "vCSLL"),
        "cnpj_tomador": _each(_CLIENTS, tuple(x.format("IdentificacaoTomador") for x in _PARTY)), "tomador_nome": _each(_CLIENTS, ("RazaoSocial", "razaoSocial", "Nome", "nome")),
        "info_complementar": ("OutrasInformacoes", "InformacoesComplementares", "Observacao", "Discriminacao", "Servico/Discriminacao", "servico/Discriminacao"),
    },
}
#: Repeated parts: dialect, the element, and its fields.
LISTS = {
    "parcelas": ("NFE", "cobr/dup[]", {"numero": "nDup", "vencimento": "dVenc", "valor": "vDup"}),
    "pagamentos": ("NFE", "pag/detPag[]", {"forma": "tPag", "valor": "vPag"}),
    "itens": ("NFE", "det[]", {"codigo": "prod/cProd", "descricao": "prod/xProd", "quantidade": "prod/qCom", "valor_unitario": "prod/vUnCom", "valor": "prod/vProd"}),
}
# Forms of payment.
PAYMENTS = {
    "01": "DINHEIRO", "02": "CHEQUE", "03": "CARTÃO DE CRÉDITO", "04": "CARTÃO DE DÉBITO", "05": "CRÉDITO LOJA", "10": "VALE ALIMENTAÇÃO", "11": "VALE REFEIÇÃO", "12": "VALE PRESENTE", "13": "VALE COMBUSTÍVEL",
    "14": "DUPLICATA MERCANTIL", "15": "BOLETO", "16": "DEPÓSITO BANCÁRIO", "17": "PIX", "18": "TRANSFERÊNCIA BANCÁRIA", "19": "PROGRAMA DE FIDELIDADE", "90": "SEM PAGAMENTO", "99": "OUTROS",
}
AMOUNTS = ("valor", "liquido", "valor_icms", "base_calculo_icms", "valor_base", "valor_iss", "valor_ir", "valor_inss", "valor_pis", "valor_cofins", "valor_csll", "aliquota")


class Layout:
    """A dialect's paths as one schema: what the parser is given, the same with fields renamed by place, and where each path lies."""

    def __init__(self, paths):
        self.tree: dict = {}
        for p in paths:
            node = self.tree
            for step in p.split("/"):
                node = node.setdefault(step, {})

    def _ddl(self, node: dict, renamed: bool) -> str:
        kinds = []
        for i, (step, below) in enumerate(node.items()):
            kind = self._ddl(below, renamed) if below else "string"
            kind = f"array<{kind}>" if step.endswith("[]") else kind
            kinds.append((f"f{i}" if renamed else "`" + step.removesuffix("[]").replace("@", "_") + "`") + ":" + kind)
        return f"struct<{','.join(kinds)}>"

    def parsed(self, xml: Column) -> Column:
        return F.from_xml(xml, self._ddl(self.tree, False)).cast(self._ddl(self.tree, True))

    def at(self, parsed: Column, path: str, node: dict | None = None) -> Column:
        node = self.tree if node is None else node
        for step in path.split("/"):
            parsed, node = parsed[f"f{list(node).index(step)}"], node[step]
        return parsed

    def below(self, path: str) -> dict:
        node = self.tree
        for step in path.split("/"):
            node = node[step]
        return node


def _layout(name: str) -> Layout:
    listed = [f"{at}/{p}" for of, at, fields in LISTS.values() if of == name for p in fields.values()]
    return Layout([p for paths in PATHS[name].values() for p in paths] + listed)


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _note(name: str, xml: Column) -> Column:
    """Texts of a document of this dialect, as found; amounts are numbers, the first that is more than nothing for the total."""
    layout, every = _layout(name), sorted({f for paths in PATHS.values() for f in paths})
    holder = F.coalesce(*[ids.found(xml, rf"(?s)<{h}(?=[\s>]).*?</{h}>") for h in HOLDERS[name]])

    def read(r: Column) -> Column:
        out = []
        for f in every:
            found = [_text(layout.at(r, p)) for p in PATHS[name].get(f, ())]
            if f in AMOUNTS and found:
                numbers = F.transform(F.filter(F.array(*found), lambda x: x.isNotNull()), money.xml_number)
                above = F.get(F.filter(numbers, lambda v: v > 0), F.lit(0)) if f == "valor" else F.lit(None)
                out.append(F.coalesce(above, F.get(F.filter(numbers, lambda v: v.isNotNull()), F.lit(0))).alias(f))
            elif f in AMOUNTS:
                out.append(F.lit(None).cast("double").alias(f))
            else:
                out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(f))
        for f, (of, at, fields) in LISTS.items():
            kind = "array<struct<" + ",".join(f"{k}:string" for k in fields) + ">>"
            out.append((_rows(layout, layout.at(r, at), fields, layout.below(at)) if of == name else F.lit(None).cast(kind)).alias(f))
        return F.struct(*out)

    return let(layout.parsed(holder), read)


def _rows(layout: Layout, rows: Column, fields: dict, node: dict) -> Column:
    return F.transform(rows, lambda x: F.struct(*[_text(layout.at(x, p, node)).alias(k) for k, p in fields.items()]))


def _order(text: Column) -> Column:
    """Number of an order named in a note's text."""
    return F.coalesce(ids.found(text, r"(?iu)(?:pedido|ped|ordem|oc|pc)[:\s]*[nº#]*\s*(\d{4,})", 1), ids.found(text, r"(?i)(?:ref|referencia|ordem de compra)[:\s]*(\d{4,})", 1), ids.order_number(text))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that what follows can't be merged with: each is computed once a row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def document(df: DataFrame, xml: str = "xml") -> DataFrame:
    """df with ok, dialect, doc_type and all fields of its note: numero, serie, cnpj (digits), fornecedor_nome, valor, dates, taxes, client,
    parcelas, pagamentos, itens. Dates and numbers that can't be read are null; valor is 0 without any."""
    d = _once(df, _x=bare(F.col(xml)))
    d = _once(d, ok=sound(F.col("_x")), _d=F.coalesce(dialect(F.col(xml), F.col("_x")), F.lit("")))
    d = d.withColumn("dialect", F.when(F.col("ok"), F.nullif("_d", F.lit(""))))
    d = _once(d, _n=F.coalesce(*[F.when(F.col("dialect") == name, _note(name, F.col("_x"))) for name in PATHS]))
    n = {f: F.col("_n")[f] for f in sorted({f for paths in PATHS.values() for f in paths}) + list(LISTS)}
    first_due = F.get(n["parcelas"], F.lit(0))
    told = F.nullif(F.regexp_extract(n["info_complementar"], r"(?i)vencimento[:\s]+(\d{2}[/\-]\d{2}[/\-]\d{4})", 1), F.lit(""))
    key = F.when(F.col("dialect") == "NFE", F.nullif(F.regexp_extract(n["chave"], r"(\d{44})$", 1), F.lit(""))).when((F.col("dialect") == "NFCOM") & (F.length(n["chave"]) >= 44), F.regexp_replace(n["chave"], "^NFCom", ""))
    forms = F.create_map(*[F.lit(x) for pair in PAYMENTS.items() for x in pair])
    paid = F.get(n["pagamentos"], F.lit(0))["forma"]
    out = {f: n[f] for f in ("numero", "serie", "cnpj", "fornecedor_nome", "natureza_operacao", "codigo_verificacao", "info_complementar", "status", "prefeitura", "cnpj_tomador", "tomador_nome", *AMOUNTS[2:], "itens", "pagamentos", "parcelas")}
    return d.withColumns(out | {
        "doc_type": F.when(F.col("dialect").isin("NFE", "NFCOM"), F.lit("DANFE")).when(F.col("dialect").isNotNull(), F.lit("NFSE")),
        "valor": F.coalesce(F.when(n["liquido"] > 0, n["liquido"]), n["valor"], F.lit(0.0)), "data_emissao": dates.xml_date(n["emissao"]),
        "vencimento": F.coalesce(dates.xml_date(n["vencimento"]), dates.xml_date(first_due["vencimento"]), F.when(F.col("dialect") == "SPED", dates.parse_br(told))),
        "numero_fatura": F.coalesce(first_due["numero"], n["fatura"]), "forma_pagamento": F.when(paid.isNotNull(), F.coalesce(F.try_element_at(forms, paid), F.concat(F.lit("CODIGO_"), paid))),
        "chave_acesso": key, "numero_pedido": F.when(~F.col("dialect").isin("NFCOM"), _order(n["info_complementar"]))}).drop("_x", "_d", "_n")


def fields(df: DataFrame, xml: str = "xml") -> DataFrame:
    """df with ok, dialect, doc_type, numero, cnpj, fornecedor_nome, valor, data_emissao, vencimento, chave_acesso, numero_pedido."""
    return document(df, xml).select(*df.columns, "ok", "dialect", "doc_type", "numero", "cnpj", "fornecedor_nome", "valor", "data_emissao", "vencimento", "chave_acesso", "numero_pedido")
