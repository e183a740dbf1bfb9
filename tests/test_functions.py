"""Scalar functions on literal cases."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notaflow.functions import dates, ids, money, names, text, workdays


def evaluate(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_money(spark):
    assert evaluate(spark, ["1.234,56", "352,08", "", "x"], money.parse_br) == [1234.56, 352.08, 0.0, 0.0]
    assert evaluate(spark, ["R$ 2 2.396,17", "Total: 1 2 3 4,56", "R$ 1 . 2 3 4 , 5 6", "0,00 0,00 22,16"], money.repair_ocr) == ["R$ 22.396,17", "Total: 1234,56", "R$ 1.234,56", "0,00 0,00 22,16"]
    assert evaluate(spark, ["Total: R$ 1.234,56 + R$ 100,00", "1234,56"], money.amounts) == [[1234.56, 100.0], []]
    assert evaluate(spark, ["0,00 0,00 4.800,00", "nada"], money.largest) == [4800.0, 0.0]
    assert evaluate(spark, ["1.234,5", "1234.5", "12,5", "x"], money.xml_number) == [1234.5, 1234.5, 12.5, None]
    assert evaluate(spark, ["11690000625000"], money.of_slip_line) == [6250.0]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=30))
def test_money_round_trip(spark, cents):
    values = [c / 100 for c in cents]
    assert evaluate(spark, values, lambda c: money.parse_br(money.render_br(c)), "double") == values


def test_dates(spark):
    d = dt.date
    assert evaluate(spark, ["24/03/2025", "24-03-25", "24.3.1975", "24/03/75", "invalid", "31/02/2025", None], dates.parse_br) == [d(2025, 3, 24), d(2025, 3, 24), d(1975, 3, 24), d(1975, 3, 24), None, None, None]
    assert evaluate(spark, ["Emitido em 24/03/2025 com vencimento 24/04/2025", "nada"], dates.first_br) == [d(2025, 3, 24), None]
    assert evaluate(spark, ["15/01/2025", "2025-01-15", "x"], dates.iso_or_same) == ["2025-01-15", "2025-01-15", "x"]
    assert evaluate(spark, [1169, 0], dates.due_from_factor, "int") == [d(2028, 5, 6), None]
    assert evaluate(spark, [1169], lambda c: dates.due_from_factor(c, "febraban"), "int") == [d(2025, 8, 10)]
    today = F.lit("2025-06-15").cast("date")
    assert evaluate(spark, ["10/05", "10/07", "10/07/50", "10/07/51"], lambda c: dates.body_date(c, today)) == [d(2026, 5, 10), d(2025, 7, 10), d(2050, 7, 10), d(1951, 7, 10)]
    assert evaluate(spark, ["1/2/30", "1/2/31"], dates.metadata_date) == ["01/02/2030", "01/02/1931"]
    assert evaluate(spark, ["Mon, 3 Feb 2025 10:00:00 -0300", "2025-02-03T10:00:00", "03/02/2025"], dates.header_date) == [d(2025, 2, 3)] * 3
    assert evaluate(spark, ["", "00/00/0000", "abc", "01/01/1999", "01/01/2025"], dates.due_faults) == [["VAZIO"], ["ZERADO", "ANO_ZERO"], ["FORMATO"], ["FORA_DO_INTERVALO"], []]


def test_identifiers(spark):
    assert evaluate(spark, ["CNPJ 12345678000190", "12.345.678/0001-90", "1234567800019012"], ids.flexible_cnpj) == ["12.345.678/0001-90", "12.345.678/0001-90", None]
    assert evaluate(spark, ["202500000000119", "2025/119", "2025-119", "2025.119", "00119", "NF 119", "000", ""], ids.invoice_number) == ["119"] * 6 + ["0", None]
    assert evaluate(spark, ["02_NF 2025.119.pdf", "NF_2025/119.pdf", "nfse_202500000000119.xml", "documento.pdf"], ids.number_of_file) == ["2025.119", "2025/119", "202500000000119", None]
    assert evaluate(spark, ["0119", "202500000000119", "120"], lambda c: ids.same_number(F.lit("119"), c)) == [True, True, False]
    assert evaluate(spark, ["12.345.678/0001-90", "12"], ids.format_cnpj) == ["12.345.678/0001-90", "12"]
    assert evaluate(spark, ["a@x.com.br e http://www.y.com/z"], ids.domains) == [["x.com.br", "y.com"]]


def test_zeros_in_front_make_no_year(spark):
    assert evaluate(spark, ["000202511", "NF 002025119", "2025" + "2025119".rjust(11, "0"), "NF 00202500000000119"], ids.invoice_number) == ["202511", "2025119", "2025119", "119"]


def test_text(spark):
    assert evaluate(spark, ["Código Eletrônico"], text.strip_accents) == ["Codigo Eletronico"]
    assert evaluate(spark, ["Nome    da   Empresa"], text.one_space) == ["Nome da Empresa"]
    assert evaluate(spark, ["EMPRESA XYZ LTDA   12.345.678/0001-90  ", "LLOOCCAALLIIZZAA RREENNTT AA CCAARR", "CORREIOS E TELEGRAFOS Aeee [dede", "DOCUMENTO(S)", "Florida 33134 USA", "Rede Mulher de Televisao Ltda CNPJ: -8"], names.entity_name) == ["EMPRESA XYZ LTDA", "LOCALIZA RENT A CAR", "CORREIOS E TELEGRAFOS", "", "", "Rede Mulher de Televisao Ltda"]
    assert evaluate(spark, ["a b c d e f"], lambda c: text.chunks(c, 3, 1)) == [["a b c", "c d e", "e f"]]
    assert evaluate(spark, ["x\n# Um\n", "nada"], text.title) == ["Um", "Sem título"]
    assert evaluate(spark, ["<p>a &amp; b</p><script>x</script>"], text.html_text) == ["a & b"]


@pytest.fixture(scope="session")
def calendar(spark):
    return {r.d: (r.is_working_day, r.cum_wd) for r in workdays.calendar(spark, 2024, 2026).collect()}


def test_calendar(calendar):
    closed = [dt.date(2025, 1, 25), dt.date(2025, 3, 3), dt.date(2025, 3, 4), dt.date(2025, 4, 18), dt.date(2025, 6, 19), dt.date(2025, 11, 20), dt.date(2025, 12, 25)]
    assert not any(calendar[d][0] for d in closed)
    assert calendar[dt.date(2025, 3, 5)][0]
    assert calendar[dt.date(2025, 1, 30)][1] - calendar[dt.date(2025, 1, 3)][1] >= 4
    a, b, c = dt.date(2024, 2, 1), dt.date(2025, 5, 9), dt.date(2026, 7, 1)
    assert (calendar[c][1] - calendar[b][1]) + (calendar[b][1] - calendar[a][1]) == calendar[c][1] - calendar[a][1]
