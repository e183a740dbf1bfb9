"""Cascades, administrative documents, phrase tables and fiscal XML on texts of their own."""

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notaflow.functions import fixed, names, phrases, text, xml
from notaflow.operators import admin, cascades, router


def values(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    return [r.v for r in df.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_phrases_against_plain_search(spark):
    words = ["CEDENTE", "SACADO", "RECIBO DO SACADO", "BOX", "BOX BRAZIL", "(=)", "AB", "ABC", "B.C"]
    texts = ["RECIBO DO SACADO", "BOX BRAZIL", "BOX", "ABC", "XABX(=)", "BXC", "", None, "CEDENTE SACADO CEDENTE"]
    got = values(spark, texts, lambda t: phrases.hits(t, words))
    assert [None if g is None else sorted(g) for g in got] == [None if t is None else sorted(w for w in words if w in t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("AB(. ", min_size=1, max_size=5), min_size=1, max_size=8), st.text("AB(. ", max_size=20))
def test_tree_pattern(words, text):
    pattern = re.compile(phrases.tree_pattern(words))
    assert bool(pattern.search(text)) == any(w in text for w in words)
    for i in range(len(text)):
        longest = max((w for w in words if text.startswith(w, i)), key=len, default=None)
        m = pattern.match(text, i)
        assert (m and m.group()) == longest


def test_label_words(spark):
    names = ["PADARIA CENTRAL LTDA", "Joana Prado", "Delta Comércio SA", "METALURGICA ALFA"]
    labels = ["Vencimento", "Nosso Número 1", "nosso numero", "Agencia / Código", "agência", "Rua das Flores", "x (=) y", "MG CNPJ", "BeneficiárioALFA", "Belo Horizonte/MG)", "Centro / SP", "cod 0F6C63A2D ok", "joao@gmail.com", "", None]
    assert values(spark, names + labels, cascades.label_like) == [False] * len(names) + [True] * len(labels)


SLIPS = [
    # a heading under the label is no name, nor is the payer's own line
    ("Beneficiário\nVencimento\nPagador\nALFA SERVICOS LTDA", None),
    ("Cedente\nAutenticação mecânica\n001-9\nNosso número\n\n\n\n\nALFA LONGE LTDA", None),
    ("Total da CSC - CNPJ 38.323.227/0001-40", None),
    ("Beneficiário Agência\nRua X 12\nAV. Y\nALFA TELECOMUNICACOES", "ALFA TELECOMUNICACOES"),
    ("Pagador CSC\nVALOR R$ 10,00", None),
    ("Cedente\nGIGA FIBRA S.A.\n", "GIGA FIBRA S.A."),
    ("Beneficiário\nEmpresas Reunidas de Minas 12.345.678/0001-90", "Empresas Reunidas de Minas"),
    ("", None), (None, None), ("\n\n\n", None),
]


def test_slip_suppliers_with_negatives(spark):
    got = values(spark, [t for t, _ in SLIPS], cascades.slip_supplier)
    assert [g and g.name for g in got] == [n for _, n in SLIPS]


def test_long_slips_take_time_in_proportion(spark):
    import time

    took = []
    for n in (2_000, 8_000):
        text = "linha comum de texto\n" * n + "Beneficiário\nALFA COMERCIO SA"
        began = time.perf_counter()
        assert values(spark, [text], cascades.slip_supplier)[0].name == "ALFA COMERCIO SA"
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 5


def test_note_suppliers_are_never_own(spark):
    own = F.array(F.lit("GRUPO PROPRIO PARTICIPACOES S/A (MATRIZ)"), F.lit("X"))
    texts = ["GRUPO PROPRIO PARTICIPACOES LTDA CNPJ: 11.222.333/0001-44", "PROPRIO PARTICIPACOES LTDA CNPJ 1\nNome fantasia: LOJA\n;", "Razão Social: GRUPO PROPRIO PARTICIPACOES DO SUL\n", "Prestador: Oficina Boa\n", "TOMADOR CNPJ: 11.222.333/0001-44", None]
    assert [g and g.name for g in values(spark, texts, lambda t: cascades.note_supplier(t, own))] == [None, "LOJA", None, "Oficina Boa", None, None]


def test_admin_documents(spark):
    texts = ["Lembrete gentil: contrato", "Aviso de parada", "Aviso: R$ 10,00", "Contrato de locação\nChave de acesso 1", "DISTRATO\nCedente\nSacado", "Ordem de serviço 1-22333\nEquinix\nVencimento\n01/02/2024 R$ 1.500,00", "orçamento\nPagador Vencimento valor a pagar", "fatura comum", "", None]
    df = router.forms(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    got = [r.a for r in df.select("i", admin.accepts(*[F.col(c) for c in (router.TEXT, router.BARE, router.FOLDED)]).alias("a")).orderBy("i").collect()]
    assert got == [True, True, False, False, False, True, False, False, False, False]


def test_admin_fields(spark):
    text = "De: FORNECEDORA DE REDES\nOrdem de serviço Nº 1-255425159203\nCNPJ 12.345.678/0001-90\nemitida 03/01/2024\nVencimento\nPago\n01/02/2024\nTotal: R$ 1.500,00\nR$ 9,00\nDocumento : 1234567"
    df = admin.admin_fields(spark.createDataFrame([(text,), ("contato de Alfa",), (None,)], "text string"))
    r, plain, none = df.collect()
    assert (r.subtype, r.admin_type, r.fornecedor_nome, r.cnpj, r.valor, r.vencimento) == ("ORDEM_SERVICO", "Ordem de serviço/agendamento", "FORNECEDORA DE REDES", "12.345.678/0001-90", 1500.0, dt.date(2024, 2, 1))
    assert r.admin_kinds == ["Ordem de serviço/agendamento", "Notificação automática"] and r.numero == "1234567"
    assert (plain.subtype, plain.valor, plain.vencimento, plain.admin_kinds) == ("ADMINISTRATIVO", 0.0, None, []) and none.subtype == "ADMINISTRATIVO"
    assert len({n for n, *_ in fixed.ADMIN_SUBTYPES}) == 15


def test_xml_encodings_and_faults(spark):
    body = "<nfeProc><NFe><infNFe Id='NFe1'><emit><xNome>Café</xNome></emit></infNFe></NFe></nfeProc>"
    rows = [body.encode(), body.encode("latin-1"), b"\xef\xbb\xbf" + body.encode(), b"", None, b"<a>"]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(rows)], "i int, b binary")
    got = xml.document(df.select("i", xml.text_of(F.col("b")).alias("xml"))).orderBy("i").collect()
    assert [r.fornecedor_nome for r in got] == ["Café"] * 3 + [None] * 3
    assert [r.ok for r in got] == [True] * 3 + [False] * 3 and [r.dialect for r in got] == ["NFE"] * 3 + [None] * 3
    assert {r.valor for r in got} == {0.0}


def test_xml_variants(spark):
    docs = [
        "<ConsultarNfseResposta><ListaNfse><CompNfse><Nfse><InfNfse><numero>5</numero><dtEmissao>02/03/2024</dtEmissao><Prestador><cnpj>1</cnpj><nome>A</nome></Prestador><servico><valorServicos>1.234,50</valorServicos><vISS>2</vISS></servico></InfNfse></Nfse></CompNfse></ListaNfse></ConsultarNfseResposta>",
        "<Rps><InfRps><IdentificacaoRps><Numero>9</Numero></IdentificacaoRps><DataEmissao>2024-03-02T01:02:03</DataEmissao><Prestador><Cnpj>2</Cnpj></Prestador><Servico><Valores><ValorServicos>0</ValorServicos><ValorLiquidoNfse>8.5</ValorLiquidoNfse></Valores></Servico></InfRps></Rps>",
        "<x:NFCom xmlns:x='u'><x:infNFCom><x:ide><x:mod>62</x:mod><x:nNF>3</x:nNF></x:ide><x:total><x:vNF>0.00</x:vNF><x:vProd>7.25</x:vProd></x:total></x:infNFCom></x:NFCom>",
        "<NFe><infNFe Id='NFe123'><ide><nNF>4</nNF></ide><total><ICMSTot><vNF>abc</vNF></ICMSTot></total></infNFe></NFe>",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "i int, xml string")
    a, b, c, d = xml.document(df).orderBy("i").collect()
    assert (a.numero, a.cnpj, a.fornecedor_nome, a.valor, a.valor_iss, a.data_emissao) == ("5", "1", "A", 1234.5, 2.0, dt.date(2024, 3, 2))
    assert (b.numero, b.cnpj, b.valor, b.data_emissao) == ("9", "2", 8.5, dt.date(2024, 3, 2))
    assert (c.dialect, c.numero, c.valor) == ("NFCOM", "3", 7.25)
    assert (d.dialect, d.numero, d.valor, d.chave_acesso, d.itens, d.parcelas) == ("NFE", "4", 0.0, None, None, None)


def test_split_names_longest_first(spark):
    texts = ["ZZABCDEFGHIJKLMNO", "RSMBRASILAUDITORIAECONSULTORIALTDA", "CURTALTDA", "COM ESPACO TECNOLOGIALTDA", "tecnologiadigitalxyz", "QWERTYUIOPASDFGH", "GESTÃOESERVIÇOSS/A", None]
    got = values(spark, texts[:1], lambda t: names.split_name(t, ("ABCD", "CDEFGH")))
    assert got == ["ZZAB CDEFGH IJKLMNO"]
    want = ["RSM BRASIL AUDITORIA E CONSULTORIA LTDA", "CURTALTDA", "COM ESPACO TECNOLOGIALTDA", "TECNOLOGIA DIGITAL XYZ", "QWERTYUIOPASDFGH", "GESTÃO E SERVIÇOS S/A", None]
    assert values(spark, texts[1:], names.split_name) == want


def test_entity_names_by_kind_of_tail(spark):
    cases = {
        "ALFA LTDA | CNPJ - CNPJ": "ALFA LTDA", "BETA SA, inscrita no CNPJ sob o n. 2": "BETA SA", "GAMA LTDA CPF ou CNPJ": "GAMA LTDA", "DELTA SA - Endereço Rua X": "DELTA SA", "ECO ME 3 ANDAR sala 2": "ECO ME", "ALFA LTDA - Belo Horizonte/MG": "ALFA LTDA",
        "ALFA SA fin@alfa.com": "ALFA SA", "ALFA SA contato@alfa.com": "ALFA SA", "ALFA LTDA joaozinho": "ALFA LTDA", "ALFA LTDA ana.souza": "ALFA LTDA", "Rede de Postos comercial": "Rede de Postos", "ALFA LTDA / -1 1 ( ) Mudou-se": "ALFA LTDA", "GAMA SA Cod. de Autenticidade 2": "GAMA SA",
        "ALFA LTDA Nome Fantasia LOJA": "ALFA LTDA", "ALFA LTDA Florida33134USA": "ALFA LTDA", "ALFA LTDA 12/3": "ALFA LTDA", "ALFA LTDA www.alfa.com.br financeiro 393": "ALFA LTDA", "E-mail Beneficiário ALFA LTDA": "ALFA LTDA", "CNPJ: ALFA LTDA": "ALFA LTDA", "Casa do João": "Casa do João",
        "Número do documento espécie": "", "Valor da causa": "", "( ) Não existe": "", "loja.com.br": "", "CEP 30": "", "USA": "", "": "",
    }
    assert dict(zip(cases, values(spark, list(cases), names.entity_name), strict=True)) == cases


def test_accents_of_other_alphabets(spark):
    texts = ["Nguyễn Thị Hồng Đào", "Łódź Żółć Gęś", "Şişli Ğ İ", "Ação", "éâ", None]
    assert values(spark, texts, text.strip_accents) == ["Nguyen Thi Hong Đao", "Łodz Zołc Ges", "Sisli G I", "Acao", "ea", None]


def test_pairs_take_numbers_from_files_and_force_orphans(spark):
    from notaflow.operators import pairing

    rows = [("a", 1, "NFSE", "NF 2025.77.pdf", None, 10.0, "N", None, "77"), ("a", 2, "BOLETO", "BOLETO NF 77.pdf", "5", 12.0, "S", "c", "9"), ("a", 3, "BOLETO", "x.pdf", None, 3.0, None, None, "0088"), ("a", 4, "NFSE", "y.pdf", "88", 4.0, None, "d", None)]
    df = spark.createDataFrame(rows, "batch_id string, doc_seq int, doc_type string, arquivo_origem string, numero string, valor double, fornecedor_nome string, cnpj string, referencia_nfse string").withColumn("linha_digitavel", F.lit(None).cast("string"))
    got = {(r.note_number, r.note_value, r.slip_value, r.fornecedor_nome, r.cnpj) for r in pairing.pair_documents(df.withColumn("fornecedor_nome", F.concat("fornecedor_nome", F.lit("OME LTDA")))).collect()}
    assert got == {("77", 10.0, 12.0, "NOME LTDA", "c"), ("88", 4.0, 3.0, None, "d")}
    doc = lambda kind, file, value: {"doc_type": kind, "key": "", "valor": value, "arquivo_origem": file, "linha_digitavel": None}
    # Every slip has a pair of its own, so a note without an amount beside others is never forced on one.
    assert [p["pair_status"] for p in pairing.pair_batch([doc("NFSE", "z", 0.0), doc("NFSE", "n", 5.0), doc("BOLETO", "b", 9.0)])] == ["CONFERIR", "CONFERIR"]
    assert [p["pair_status"] for p in pairing.pair_batch([doc("NFSE", "z", 0.0), doc("BOLETO", "b", 9.0)])] == ["PAREADO_FORCADO"]


def test_chunks_leave_from_executors_once(spark, tmp_path):
    import os

    from notaflow.operators import sinks

    class FileTarget:
        """A folder of one file a key; some calls fail at first, or all of one key."""

        def __init__(self, folder, bad=""):
            self.folder, self.bad = str(folder), bad

        def send(self, key, rows):
            import os

            if key == self.bad:
                raise ConnectionError(key)
            if key.endswith("1") and not os.path.exists(f"{self.folder}/tried-{key}"):
                open(f"{self.folder}/tried-{key}", "w").close()
                raise ConnectionError("once")
            with open(f"{self.folder}/{key}", "a") as f:
                f.write("\n".join(f"{i},{t}" for i, t in rows) + "\n")

        def commit(self, keys):
            with open(f"{self.folder}/DONE", "w") as f:
                f.write(" ".join(keys))

        def abort(self, keys):
            open(f"{self.folder}/ABORTED", "w").close()

    df = spark.range(95).select((F.lit(94) - F.col("id")).alias("id"), F.lit("x").alias("t")).repartition(5)
    sinks.send_from_executors(df, ["id"], FileTarget(tmp_path), "job", 10, wait_s=0.0)
    keys = sorted(f"job-{i}" for i in range(10))
    assert open(tmp_path / "DONE").read().split() == keys and sorted(f for f in os.listdir(tmp_path) if f.startswith("job")) == keys
    for i in range(10):
        assert open(tmp_path / f"job-{i}").read().split() == [f"{j},x" for j in range(10 * i, min(95, 10 * i + 10))]
    (tmp_path / "b").mkdir()
    with pytest.raises(Exception, match="bad-3"):
        sinks.send_from_executors(df, ["id"], FileTarget(tmp_path / "b", "bad-3"), "bad", 10, attempts=2, wait_s=0.0)
    assert os.path.exists(tmp_path / "b/ABORTED") and not os.path.exists(tmp_path / "b/DONE")
    (tmp_path / "c").mkdir()
    sinks.send_from_executors(df.limit(0), ["id"], FileTarget(tmp_path / "c"), "none", 10)
    assert open(tmp_path / "c/DONE").read() == ""


def test_documents_are_routed_once_for_their_fields(spark):
    from notaflow.plans import documents

    plan = documents.vendor_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1


def test_tails_stop_where_a_round_finds_none(spark):
    """The same as all rounds in a row, on names with tails and without; rounds that can't find any are not run."""
    from notaflow.functions import names

    tail = "(?iU)(?:" + "|".join(f"(?:{t})" for t in names.TAILS.values()) + r")\s*$"
    texts = ["ALFA LTDA", "ALFA LTDA | CNPJ - CNPJ 1", "BETA SA, inscrita no CNPJ sob o n. 2", "DELTA SA - Endereço Rua X 12", "ALFA LTDA - CE - FORTALEZA", "ALFA SA www.alfa.com financeiro 393", "ALFA LTDA joaozinho", "GAMA /12 ( ) mudou-se x",
             "BETA LTDA F50C0E532 Inscrição Municipal 1", "ALFA LTDA ****/**** CPF", "ALFA cnpj", "X(Mudou-se)", "ALFA LTDA CNPJ: 1", "ALFA SA |cnl.", "ALFA Florida 33134 USA", "", None]

    def every(name):
        for _ in range(names.ROUNDS):
            name = F.regexp_replace(name, tail, "")
        return name

    assert values(spark, texts, names._without_tails) == values(spark, texts, every)
    assert "CASE WHEN" in spark.range(1).select(names._without_tails(F.col("id").cast("string")).alias("n"))._jdf.queryExecution().analyzed().toString()
