"""Normalisation, validators, numbers, dates and anonymisation against worked examples."""

from datetime import date

from pyspark.sql import functions as F

from sparkveil.functions import anonymize as A
from sparkveil.functions import misc as M
from sparkveil.functions import numbers as N
from sparkveil.functions import text as T
from sparkveil.functions import validators as V


def apply(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.x for r in df.select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_numbers_in_both_styles(spark):
    given = ["$ 1.250.000", "1.250,50", "1,250.50", "15%", "1250.5", "1.250", "abc", "-", "", None, "12,5", "1,250,000", "-3.5", "..", "u$s 20"]
    assert apply(spark, given, N.parse_number) == [1250000, 1250.5, 1250.5, 15, 1250.5, 1250, None, None, None, None, 12.5, 1250000, -3.5, None, 20]


def test_dates(spark):
    given = ["2025-03-15", "15/03/2025", "15/3/25", "31/02/2025", "2025-03-15T10:00", "3-4-1850", "x", None]
    day = date(2025, 3, 15)
    assert apply(spark, given, N.parse_date) == [day, day, day, None, day, None, None, None]


def test_formats(spark):
    given = ["1234567.8", "3.456", "10", "123.45", "-0.5", "7"]
    assert apply(spark, given, lambda s: N.format_value(s.cast("double"))) == ["1.234.568", "3,46", "10", "123,5", "-0,5", "7"]
    assert apply(spark, ["1250000"], lambda s: N.format_value(s.cast("double"), money=True)) == ["$ 1.250.000"]
    assert apply(spark, ["2.5", "-2.5"], lambda s: N.round_half_up(s.cast("double"))) == [3, -2]


def test_validators(spark):
    good = {
        "EMAIL": "a.b@mail.com", "CREDENCIAL": "AKIA" + "A" * 16, "CUIT_CUIL": "20-12345678-6", "CBU_CVU": "2850590940090418135201",
        "TARJETA": "4111 1111 1111 1111", "DNI": "32.456.789", "TELEFONO": "+54 11 4567-8901", "IP": "192.168.1.1", "PASAPORTE": "AAA123456", "PATENTE": "AB 123 CD",
    }
    bad = {
        "EMAIL": " a@b.com", "CREDENCIAL": "AKIA", "CUIT_CUIL": "20-12345678-5", "CBU_CVU": "1" * 22, "TARJETA": "4111111111111112", "DNI": "999.999",
        "TELEFONO": "0001-00012345", "IP": "256.1.1.1", "PASAPORTE": "AA123456", "PATENTE": "A123",
    }
    for kind, test in V.VALUE_MATCHERS.items():
        assert apply(spark, [good[kind], bad[kind], None, ""], test) == [True, False, False, False], kind


def test_anonymized_values(spark):
    cases = [
        ("EMAIL", "juan@x.com", "***@x.com"), ("EMAIL", "@x", "[EMAIL]"), ("TARJETA", "4111-1111-1111-1234", "**** 1234"), ("EDAD", "45 años", "40-49 años"), ("EDAD", "0", "[EDAD]"),
        ("SALARIO", "$ 853.200", "$ 800.000 – 900.000"), ("SALARIO", "1.250.000", "$ 1.200.000 – 1.300.000"), ("SALARIO", "x", "[SALARIO]"),
        ("FECHA_NACIMIENTO", "12/03/1985", "1985"), ("DNI", "1", "[DNI]"), ("DATO_SENSIBLE", "x", "[DATO SENSIBLE]"),
    ]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, k string, v string")
    assert [r.x for r in df.select("i", A.anonymize(F.col("k"), F.col("v")).alias("x")).orderBy("i").collect()] == [c[2] for c in cases]


def test_texts(spark):
    assert apply(spark, ["Pérez S.A.", "a_b-c/d", "  ÁÉ  ", None], T.normalize_text) == ["perez sa", "a b c d", "ae", None]
    assert apply(spark, ["20-12345678-6", "abc", "juan@mail.com", "12345678"], T.mask) == ["20•••••••••-6", "•••", "j•••@m•••", "1••••••8"]
    protected = ["Persona_01", "Sra. Persona_02", "[DATO SENSIBLE]", "***@gmail.com", "**** 1234", "Persona_01 y Empresa_3."]
    assert apply(spark, protected, T.is_protected) == [True] * len(protected)
    assert apply(spark, ["Persona_01 y Juan", "de la", "", None, "Persona 1"], T.is_protected) == [False] * 5
    assert apply(spark, ["Total de Monto por Año (2025)"], T.slug) == ["total-de-monto-por-ano-2025"]


def test_small_helpers(spark):
    assert apply(spark, ["https://www.Chat.example.com/x", "no url", None], lambda s: M.site_of(s, ("chat.example.com",))) == ["chat.example.com", None, None]
    assert apply(spark, ["a.JSON", "b.pdf", "c"], M.output_extension) == ["json", "txt", "txt"]
    assert apply(spark, ["1234", "2500000", "12"], lambda s: M.compact_number(s.cast("double"))) == ["1k", "2,5M", "12"]
    assert apply(spark, ["12.5", "-3.2", "0"], lambda s: M.signed_percent(s.cast("double"))) == ["+13 %", "-3 %", "0 %"]


def test_equivalence_keys(spark):
    df = spark.createDataFrame([("CUIT_CUIL", "20-12345678-6"), ("CBU_CVU", "perro.casa.sol"), ("PATENTE", "ab 123-cd"), ("RAZON_SOCIAL", "PÉREZ S.A.")], "k string, v string")
    assert [r.x for r in df.select(T.equivalence_key(F.col("k"), F.col("v")).alias("x")).collect()] == ["20123456786", "perrocasasol", "AB123CD", "perez sa"]
