"""The scanner, the protection of documents and its summary on sentences made from order keys, one rule each, with SQL
that knows by construction what must be found where, and what must stand there afterwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validators import ACCOUNT_WEIGHTS, CUIT_WEIGHTS
from ..operators import documents as D
from ..operators.scan import scan, spread
from ..storage import materialize
from .base import Query, register, table

SENTENCES: dict[str, Query] = {}


@dataclass(frozen=True)
class Value:
    """A part of a sentence that a rule must find: its type, its text and what protection writes in its place. Texts are
    expressions over the key ``k`` that Spark and the checking engine read alike; ``after`` is of the latter only."""

    type: str
    text: str
    after: str
    confidence: str = "alta"


def _digits(text: str, start: int, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"cast(substring({text}, {start + i}, 1) as int) * {w}" for i, w in enumerate(weights)) + ")"


def _pad(n: str, width: int) -> str:
    return f"lpad(concat({n}, ''), {width}, '0')"


def _letters(n: str = "k") -> str:
    return f"translate(concat({n}, ''), '0123456789', 'abcdefghij')"


def _account() -> str:
    account = _pad("k", 13)
    return f"concat('28505909', {account}, concat((10 - {_digits(account, 1, ACCOUNT_WEIGHTS)} % 10) % 10, ''))"


def _card() -> str:
    body = f"concat('4', {_pad('k', 14)})"
    doubled = [f"(CASE WHEN cast(substring({body}, {i}, 1) as int) > 4 THEN cast(substring({body}, {i}, 1) as int) * 2 - 9 ELSE cast(substring({body}, {i}, 1) as int) * 2 END)" for i in range(1, 16, 2)]
    plain = [f"cast(substring({body}, {i}, 1) as int)" for i in range(2, 15, 2)]
    return f"concat({body}, concat((10 - ({' + '.join([*doubled, *plain])}) % 10) % 10, ''))"


def _tax() -> str:
    """A tax number for each key; where its check digit would be 10, the one of the key before, which differs."""
    body = lambda n: f"concat('20', {_pad(f'(10000000 + {n})', 8)})"
    rest = lambda n: f"(11 - {_digits(body(n), 1, CUIT_WEIGHTS)} % 11) % 11"
    full = lambda n: f"concat({body(n)}, concat({rest(n)}, ''))"
    return f"(CASE WHEN {rest('k')} <> 10 THEN {full('k')} ELSE {full('(k - 1)')} END)"


def _dots(x: str) -> str:
    return f"replace(format('{{:,}}', {x}), ',', '.')"


def _band(n: str) -> str:
    """Of six digits."""
    low = f"(({n}) // 100000 * 100000)"
    return f"'$ ' || {_dots(low)} || ' – ' || {_dots(f'{low} + 100000')}"


_NAME = f"concat('Silvia B', {_letters()})"
_YEAR = "concat(1950 + k % 50, '')"
#: One sentence a line: literal parts and values.
TEMPLATES: list[list[str | Value]] = [
    ["Escribir a ", Value("EMAIL", "concat('u', k, '@mail.example.com')", "'***@mail.example.com'"), " hoy"],
    ["La llave es ", Value("CREDENCIAL", f"concat('AKIA', {_pad('k', 16)})", "'[CREDENCIAL]'"), " por ahora"],
    ["postgres://admin:", Value("CREDENCIAL", "concat('Secreta', k)", "'[CREDENCIAL]'"), "@db.host/x"],
    ['password = "', Value("CREDENCIAL", f"concat('abcd', {_pad('k', 8)})", "'[CREDENCIAL]'", "media"), '"'],
    ["CBU ", Value("CBU_CVU", _account(), "'[CBU]'"), " del banco"],
    ["alias ", Value("CBU_CVU", "concat('casa.sol.', k)", "'[CBU]'", "media"), " hoy"],
    ["tarjeta ", Value("TARJETA", _card(), f"'**** ' || right({_card()}, 4)"), " vence pronto"],
    ["CUIT ", Value("CUIT_CUIL", _tax(), "'CUIT_01'"), " inscripto"],
    ["servidor ", Value("IP", "concat('10.', k % 256, '.', k * 7 % 256, '.', k * 13 % 256)", "'[IP]'"), " caído"],
    ["DNI ", Value("DNI", f"concat('3', k % 10, '.', {_pad('k % 1000', 3)}, '.', {_pad('k * 7 % 1000', 3)})", "'DNI_01'"), " en regla"],
    ["presenta ", Value("DNI", "concat(20000000 + k, '')", "'DNI_01'", "baja"), " en mesa"],
    ["nacido el ", Value("FECHA_NACIMIENTO", f"concat({_pad('k % 28 + 1', 2)}, '/', {_pad('k % 12 + 1', 2)}, '/', {_YEAR})", _YEAR), " aquí"],
    ["pasaporte ", Value("PASAPORTE", f"concat('AAB', {_pad('k % 1000000', 6)})", "'[PASAPORTE]'"), " vigente"],
    ["tel ", Value("TELEFONO", f"concat('11 4', {_pad('k % 1000', 3)}, '-', {_pad('k * 7 % 10000', 4)})", "'[TEL]'"), " por la tarde"],
    ["sueldo de ", Value("SALARIO", "concat('$ ', 100000 + k % 800000)", _band("100000 + k % 800000"), "media"), " al mes"],
    ["gana ", Value("SALARIO", "concat(150000 + k % 800000, '')", _band("150000 + k % 800000"), "media"), " por mes"],
    ["edad: ", Value("EDAD", "concat(k % 100 + 1, '')", "((k % 100 + 1) // 10 * 10)::VARCHAR || '-' || ((k % 100 + 1) // 10 * 10 + 9)::VARCHAR"), " cumplidos"],
    ["patente ", Value("PATENTE", f"concat('AB', {_pad('k % 1000', 3)}, 'CD')", "'Patente_01'"), " del auto"],
    ["vive en ", Value("DIRECCION", "concat('Av. Corrientes ', k % 9000 + 100)", "'[DIRECCION]'", "media"), " hace mucho"],
    ["compra a ", Value("RAZON_SOCIAL", f"concat('Casa B', {_letters()}, ' S.R.L.')", "'Empresa_01'"), " siempre"],
    ["la Sra. ", Value("NOMBRE_PERSONA", _NAME, "'Persona_01'"), " llama luego"],
    ["tiene ", Value("DATO_SENSIBLE", "concat('diabetes', '')", "'[DATO SENSIBLE]'", "media"), " desde hace tiempo"],
    [Value("NOMBRE_PERSONA", "concat('Lucía', '')", "'Persona_01'", "baja"), " vino ayer"],
    [
        Value("NOMBRE_PERSONA", "concat('Milagros', '')", "'Persona_01'", "baja"), ", ", Value("SALARIO", "concat('$ ', 200000 + k % 700000)", _band("200000 + k % 700000"), "baja"), ", ",
        Value("EMAIL", "concat('m', k, '@mail.example.com')", "'***@mail.example.com'"),
    ],
    # Where a word before or behind, a digit or a name forbids what the shape allows.
    ["factura 12345678 por un total de ", "12345678 pesos, modelo AB123CD y versión 1.2.3.4"],
    ["el remito 4111111111111111 no se paga"],
    ["tarjeta 4111111111111112 sin dígito válido"],
    ["CUIT 20-12345678-9 mal escrito"],
    ["CBU 2850590940090418135202 con error"],
    ["versión 10.0.0.254 publicada"],
    ["son 12.345.678 unidades y presenta 23456789 pesos"],
    ["expediente 12345678 del año 2024"],
    ["la reunión es el 3 de mayo de 2024 o el 15/08/2025"],
    ["nacido el 45/13/1785 según dice"],
    ["el código AAB123456 no existe"],
    ["el pedido 11 4321-8765 sale hoy"],
    ["tel 4321 interno"],
    ["total de $ 950.000 con impuestos"],
    ["sueldo 2025 en discusión"],
    ["gana 1500 empleados por año"],
    ["hace 34 años que existe y la edad: 240"],
    ["por Avenida Libertador sin número"],
    ["la sociedad SA cerró"],
    ["password = changeme"],
    ["no usa alias conocido hoy"],
    ["https://host/a@b sin correo"],
    ["Afiliación sindical: no consta"],
    ["Milagros que pasan en diciembre"],
    ["la calle San Martín y la plaza Santa Rosa"],
    ["soy contador, no soy de acá"],
    ["viene desde Rosario hasta Mercedes"],
    ["el colegio Ricardo abre"],
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _part(p: str | Value, after: bool = False) -> str:
    return _quoted(p) if isinstance(p, str) else p.after if after else p.text


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """One sentence per order, of the templates in turn."""
    k, n = F.col("o_orderkey").alias("k"), len(TEMPLATES)
    text = F.coalesce(*[F.when(F.col("k") % n == i, F.expr(f"concat({', '.join(map(_part, t))})")) for i, t in enumerate(TEMPLATES)])
    # written once: the scanner would repeat the expression in each of its rules
    return materialize(table(spark, sf, "orders").select(k).select(F.col("k").alias("doc_id"), F.lit(0).alias("seg_id"), text.alias("text")))


_KEYS = "WITH o AS (SELECT o_orderkey AS k FROM orders) "


def _found_sql() -> str:
    rows = []
    for i, t in enumerate(TEMPLATES):
        for at, p in enumerate(t):
            if isinstance(p, Value):
                before = f"length(concat('', {', '.join(map(_part, t[:at]))}))" if at else "0"
                rows.append(f"SELECT k AS doc_id, '{p.type}' AS type, ({before})::INTEGER AS start, {p.text} AS value, '{p.confidence}' AS confidence FROM o WHERE k % {len(TEMPLATES)} = {i}")
    return _KEYS + " UNION ALL ".join(rows)


def _protected_sql() -> str:
    return _KEYS + " UNION ALL ".join(f"SELECT k AS doc_id, concat({', '.join(_part(p, True) for p in t)}) AS protected FROM o WHERE k % {len(TEMPLATES)} = {i}" for i, t in enumerate(TEMPLATES))


@register(SENTENCES, _found_sql())
def scan_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """What the scanner finds: every rule, with places and confidence."""
    # written once: Spark infers a filter of rows with spans, and would push all of the scanner into it
    found = materialize(scan(spread(sentences(spark, sf))).select("doc_id", "spans")).select("doc_id", F.explode("spans").alias("s"))
    return found.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in ("type", "start", "value", "confidence")])


@register(SENTENCES, _protected_sql())
def protect_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The same sentences protected by the default actions."""
    return D.protect(D.analyze(sentences(spark, sf))).segments.select("doc_id", "protected")


@register(SENTENCES, f"""
SELECT type, count(*) AS count, count(DISTINCT value) AS distinct, count(*) FILTER (confidence = 'baja') AS review FROM ({_found_sql()}) GROUP BY type""")
def summarize_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return D.summarize(D.analyze(sentences(spark, sf))).select("type", "count", "distinct", "review")
