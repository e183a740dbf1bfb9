"""The document router: ordered acceptance rules over a few forms of the text, first match wins.

A rule is data: a name, the document type it leads to, and an expression over the text's forms ("*": the subtype is found). The forms are computed
once a row (upper case, upper case without accents, letters and digits only, digits only, and the heads of these); the
router is one CASE over them, evaluated lazily in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.phrases import folded
from ..functions.text import compact, strip_accents
from . import admin

TEXT, UPPER, BARE, FOLDED, TIGHT, DIGITS = "_text", "_upper", "_bare", "_folded", "_tight", "_digits"


def forms(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(text, F.lit(""))
    return df.withColumns({TEXT: t, UPPER: F.upper(t), BARE: strip_accents(F.upper(t)), FOLDED: folded(t), TIGHT: compact(t), DIGITS: F.regexp_replace(t, r"\D", "")})


def _or(parts):
    return reduce(lambda a, b: a | b, parts)


def has(*words: str, form: str = TIGHT) -> Column:
    """Any of the words occurs."""
    return _or([F.contains(F.col(form), F.lit(w)) for w in words])


def every(*words: str, form: str = TIGHT) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(F.col(form), F.lit(w)) for w in words])


def count(*words: str, form: str = TIGHT) -> Column:
    return sum([F.contains(F.col(form), F.lit(w)).cast("int") for w in words], F.lit(0))


def like(pattern: str, form: str = BARE) -> Column:
    return F.col(form).rlike(pattern)


def count_like(*patterns: str, form: str = BARE) -> Column:
    return sum([F.col(form).rlike(p).cast("int") for p in patterns], F.lit(0))


def head(n: int) -> Column:
    """The compact form of the first n characters."""
    return F.regexp_replace(F.left(F.col(BARE), F.lit(n)), "[^A-Z0-9]+", "")


def head_has(n: int, *words: str) -> Column:
    return _or([F.contains(head(n), F.lit(w)) for w in words])


def slip_line() -> Column:
    """A slip's digit line, unless the text is a fiscal document or the digits are an access key."""
    fiscal = has("DANFE", "DANFSE", "DOCUMENTOAUXILIAR", "NFSE", "NFCOM")
    spaced = like(r"\d{5}[.\s]?\d{5}\s+\d{5}[.\s]?\d{6}\s+\d{5}[.\s]?\d{6}\s+\d\s+\d{14}")
    run = like(r"(?:^|\D)\d{47,48}(?:\D|$)") & ~like(r"(?s)(CHAVE|ACESSO).{0,50}\d{47,48}")
    return ~fiscal & (spaced | run)


# Words that mark each kind of document, as the rules below use them.
SLIP_WORDS = ("LINHADIGITAVEL", "BENEFICI", "VENCIMENTO", "VALORDODOCUMENTO", "CODIGODEBARRAS")
SLIP_KEYS = ("LINHADIGITAVEL", "BENEFICI", "BENEFICIARIO", "VENCIMENTO", "VALORDODOCUMENTO", "NOSSO", "NOSSONUMERO", "CODIGODEBARRAS", "AGENCIACODIGO", "CEDENTE", "RECIBODOPAGADOR", "RECIBODOSACADO")
SERVICE_KEYS = ("NFSE", "NOTAFISCALDESERVICOELETRONICA", "PREFEITURA", "DANFE", "DOCUMENTOAUXILIARDANOTAFISCAL", "DOCUMENTOAUXILIARDANFS", "DANFSE")
COMM_HEAD = ("DOCAUXILIARDANOTAFISCALFATURA", "DOCUMENTOAUXILIARDANOTAFISCALFATURA", "NOTAFISCALFATURADESERVICOSDE")
ENERGY = ("DISTRIB DE ENERGIA", "DISTRIBUIDORA DE ENERGIA", "ENERGIA ELETRICA", "CONSUMO", "KWH", "INSTALACAO", "BANDEIRA TARIFARIA", "FATURA DE ENERGIA", "CONTA DE LUZ")
WATER = ("COMPANHIA DE SANEAMENTO", "COPASA", "SABESP", "SANEPAR", "FATURA DE SERVICOS", "CONTA DE AGUA", "ESGOTO", "MATRICULA", "CONTA-COPASA")
UTILITIES = ("CEMIG", "EDP", "ENEL", "CPFL", "COPEL", "LIGHT", "NEOENERGIA", "EQUATORIAL")
OCR_DAMAGE = (r"RECEHEMOS", r"NOTA\s+FI5CAL", r"ELETR0NICA", r"D0CUMENTO", r"CHAVE\s+DE\s+ACES5O", r"\bN0\b")
TELECOM_BILL = ("FATURA DE PAGAMENTO", "FATURA:", "VENCIMENTO", "DÉBITO AUTOMÁTICO", "TIM BLACK")
TELECOM_MARKS = (r"TIM\s*S\.?\s*A\.?", r"FATURA\s+DE\s+PAGAMENTO[:\s]*\d+", r"CNPJ\s+DA\s+MATRIZ[:\s]*02\.421\.421", r"CONTATIM@FATURADATIM\.COM\.BR", r"TIM\s+BLACK\s+EMPRESA", r"\*144\s+DO\s+SEU\s+TIM", r"WWW\.TIM\.COM\.BR", r"MEU\s+TIM")


@dataclass(frozen=True)
class Rule:
    name: str
    doc_type: str
    accepts: "Column"
    subtype: str = ""


def rules() -> list[Rule]:
    """The rules in order of priority: vendors before kinds, kinds before the fallback."""
    rental = has("FATURADELOCACAO") | every("FATURA", "LOCACAO")
    spaced_line = like(r"\d{5}[.\s]\d{5}\s+\d{5}[.\s]\d{6}\s+\d{5}[.\s]\d{6}")
    comm = has("COMUNICACAO")
    not_slip_start = ~head_has(200, "RECIBODOPAGADOR", "RECIBODOSACADO", "BENEFICIARIO", "CEDENTE", "NFSE", "NOTAFISCALDESERVICO", "PREFEITURA", "CODIGODEVERIFICACAO", "LINHADIGITAVEL")
    key = F.length(DIGITS) >= 44
    no_receipt = count_like(*fixed.NO_RECEIPT, form=UPPER) > 0
    receipt = (count_like(*fixed.RECEIPT_STRONG, form=UPPER) >= 1) | ((count_like(*fixed.RECEIPT_WEAK, form=UPPER) >= 2) & (count_like(*fixed.RECEIPT_BANKS, form=UPPER) >= 1))
    danfse = has("DANFSE", "DOCUMENTOAUXILIARDANFS", "CHAVEDEACESSODANFS") | every("DOCUMENTOAUXILIAR", "NFS") | (has("CHAVEDEACESSO") & has("NFSE", "NOTAFISCALDESERVICO"))
    comm_head = head_has(500, *COMM_HEAD) | (head_has(500, "NOTAFISCAL") & head_has(500, "COMUNICACAO") & head_has(500, "RAZAOSOCIAL"))
    debit_note = like(r"NOTA\s*(DE\s+)?DEBITO\s*/?\s*RECIBO|RECIBO\s+FATURA")
    not_debit = like(r"DANFE|DOCUMENTO\s+AUXILIAR\s+DA\s+NF|NFS-?E\s+(N[ºO°]|NUMERO)|NOTA\s+FISCAL\s+(ELETRONICA|DE\s+SERVICO)|CHAVE\s+DE\s+ACESSO|LINHA\s+DIGITAVEL|CODIGO\s+DE\s+BARRAS|RECIBO\s+DO\s+SACADO|FICHA\s+DE\s+COMPENSACAO")
    acimoc_no = like(r"CHAVE\s+DE\s+ACESSO|DANFSE|DOCUMENTO\s+AUXILIAR|NOTA\s+FISCAL|NFS-?E|GUIA\s+[-–]\s+PROCESSO|DISTRATO|RESCISORIO|ENCERRAMENTO\s+DE\s+CONTRATO")
    service = has("NFSE", "NOTAFISCALDESERVICOELETRONICA", "NOTAFISCALELETRONICADESERVICO", "CODIGODEVERIFICACAO", "PREFEITURAMUNICIPAL")
    goods = has("DANFE", "DOCUMENTOAUXILIAR", "CHAVEDEACESSO", "NFE")
    taxes = count("ISSQN", "PIS", "COFINS", "CSLL", "IRRF", "INSS")
    return [
        Rule("repromaq", "BOLETO", has("REPROMAQ", "REPROMAO") & has("BRADESCO")),
        Rule("gox", "BOLETO", has("GOX") & (has("07543400000192", form=DIGITS) | has("GOXINTERNETCOM"))),
        Rule("emc", "OUTRO", has("EMCTECNOLOGIA") & (rental | (has("NOTEBOOK", "COMPUTADOR", "MONITOR", "SERVIDOR") & has("DELL", "LENOVO"))), "FATURA_LOCACAO_EMC"),
        Rule("net_center", "BOLETO", (has("NETCENTER") | every("UNAI", "NET", "CENTER", form=BARE)) & ((count(*SLIP_WORDS) >= 1) | spaced_line)),
        Rule("tim", "UTILITY_BILL", like(r"02\.?421\.?421[/\-]?\d{4}-?\d{2}", form=UPPER) | (like(TELECOM_MARKS[0], form=UPPER) & has(*TELECOM_BILL, form=UPPER)) | (count_like(*TELECOM_MARKS, form=UPPER) >= 2), "TELECOM"),
        Rule("montes_claros", "NFSE", has("MONTESCLAROS") & ~slip_line() & has("NFSE", "NOTAFISCALDESERVICO", "CODIGODEVERIFICACAO")),
        Rule("vila_velha", "NFSE", every("VILAVELHA", "PREFEITURA")),
        Rule("comprovante", "OUTRO", ~no_receipt & receipt, "COMPROVANTE_BANCARIO"),
        Rule("utility", "UTILITY_BILL", (count(*ENERGY, form=UPPER) >= 2) | ((count(*WATER, form=UPPER) >= 1) & has("NOTAFISCAL", "FATURA")) | (has(*UTILITIES, form=UPPER) & (has("NOTAFISCAL", "FATURA") | (count(*ENERGY, form=UPPER) >= 1))), "WATER|ENERGY"),
        Rule("telcables", "NFSE", has("20609743000413", form=DIGITS) | (has("TELCABLESBRASIL") & has("DOCUMENTOAUXILIAR", "CHAVEDEACESSO", "NOTAFISCAL"))),
        Rule("nfcom", "DANFE", (head_has(500, *COMM_HEAD) & comm) | (not_slip_start & head_has(500, "RAZAOSOCIAL") & has("COMUNICACAOELETRONICA") & key)),
        Rule("acimoc", "BOLETO", has("ACIMOC", "RECIBODOSACADO", "ASSOCIACAOCOMERCIALINDUSTRIALEDESERVICOSDEMONTESCLAROS") & ~acimoc_no & (count("VALOR", "VENCIMENTO", "DOCUMENTO", "CEDENTE", "SACADO", "PAGADOR") >= 2)),
        Rule("mugo", "NFSE", has("MUGOTELECOM")),
        Rule("pro_painel", "BOLETO", has("PROPAINEL") & ~has("MUGOTELECOM", "ACIMOC", "REPROMAQ", "EMCTECNOLOGIA", "NETCENTER")),
        Rule("tunna", "OUTRO", has("TUNNAENTRETENIMENTO", "FISHTV") & (has("FAT/", form=BARE) | has("FATURAN", "DEMONSTRATIVO", "FATURARUA") | like(r"N[º°]?\s*[:.]\s*\d{3}\.\d{3}\.\d{3}")), "FATURA"),
        Rule("ufinet", "OUTRO", has("UFINET") & like(r"UFINET\s*BRASIL|FATURA\s*(NO\.?|N[º°]?|NUMERO)?\s*:?\s*\d+"), "FATURA_UFINET"),
        Rule("csc", "OUTRO", debit_note & (has("CSCGESTAO") | has("38323227000140", form=DIGITS)) & ~not_debit, "NOTA_DEBITO"),
        Rule("admin", "OUTRO", admin.accepts(F.col(TEXT), F.col(BARE), F.col(FOLDED)), "*"),
        Rule("ocr_danfe", "DANFE", has("DANFE", "RECEBEMOS", "RECEHEMOS", "DOCUMENTOAUXILIAR") & (count_like(*OCR_DAMAGE) >= 2)),
        Rule("danfe", "DANFE", has("DANFE") & ~has("DANFSE") | every("DOCUMENTOAUXILIAR", "NOTAFISCAL", "ELETR") | F.col(DIGITS).rlike(r"^\d{44}$") | (has("CHAVEDEACESSO") & has("NFE"))),
        Rule("boleto", "BOLETO", ~danfse & ~comm_head & ((count(*SLIP_KEYS) >= 3) | slip_line()) & (count(*SERVICE_KEYS) < 3)),
        Rule("sicoob", "BOLETO", ~has("DANFSE", "NFCOM", "NOTAFISCALFATURA", "SERVICOSDECOMUNICACAO") & (has("SICOOB", "BANCOOB", "7560") | every("756", "LINHADIGITAVEL")) & (count(*SLIP_WORDS) >= 1)),
        Rule("aditivo", "OUTRO", like(r"(TERMO\s+)?ADITIVO\s+(AO|DE|DO)?\s*(CONTRATO|CONTRATUAL)?") & (like(r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}") | like(r"CONTRATANTE|CONTRATADA|PARTES|CLAUSULA")), "ADITIVO_CONTRATO"),
        Rule("outros", "OUTRO", ~service & ~goods & ~key & ((taxes < 2) | rental) & (rental | has("LOCACAO", "FATURA", "LOCAWEB")), "LOCACAO|FATURA"),
        Rule("nfse", "NFSE", (service & ~slip_line()) | (~has("DANFE", "DOCUMENTOAUXILIAR") & ~slip_line() & has("NOTAFISCAL", "SERVICO", "PRESTADOR", "TOMADOR"))),
    ]


def routed(df: DataFrame, text: str = "text", more: tuple[Rule, ...] = ()) -> DataFrame:
    """df with extractor, doc_type and subtype; null where no rule accepts. `more` are rules of the user's own, tried first."""
    ordered = [*more, *rules()]
    pick = F.coalesce(*[F.when(r.accepts, F.lit(r.name)) for r in ordered])
    kind = F.create_map(*[F.lit(x) for r in ordered for x in (r.name, r.doc_type)])
    # Two kinds of bill have two subtypes: water or energy, rental or another.
    either = {"utility": has(*WATER, form=UPPER), "outros": has("LOCACAO", "ALUGUEL")}
    plain = F.create_map(*[F.lit(x) for r in ordered if r.subtype and r.subtype != "*" and r.name not in either for x in (r.name, r.subtype)])
    of_admin = F.when(F.col("extractor") == "admin", admin.subtype(F.col(BARE)))
    subtype = F.coalesce(of_admin, *[F.when((F.col("extractor") == r.name) & either[r.name], F.lit(r.subtype.split("|")[0])).when(F.col("extractor") == r.name, F.lit(r.subtype.split("|")[1])) for r in ordered if r.name in either], F.try_element_at(plain, "extractor"))
    # A generator of one row: what follows can't be merged into it, so each form and the pick are computed once.
    out = forms(df, text).select("*", F.inline(F.array(F.struct(pick.alias("extractor")))))
    return out.withColumn("doc_type", F.try_element_at(kind, "extractor")).withColumn("subtype", subtype).drop(TEXT, UPPER, BARE, FOLDED, TIGHT, DIGITS)
