"""What the header of a column, or the key of a JSON value, says about its values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import normalize_str, normalize_text

# Header words that results are compared by; the first type in this order wins.
HEADER_HINTS = {
    "CREDENCIAL": ("password", "contrasena", "clave", "pass", "pwd", "token", "api key", "apikey", "secret", "secreto", "access key"),
    "CUIT_CUIL": ("cuit", "cuil"),
    "CBU_CVU": ("cbu", "cvu", "alias", "alias cbu"),
    "IP": ("ip", "direccion ip", "ip address", "host"),
    "PASAPORTE": ("pasaporte", "passport"),
    "SALARIO": ("sueldo", "salario", "remuneracion", "haberes", "honorarios", "salary", "aguinaldo"),
    "EDAD": ("edad", "age"),
    "DATO_SENSIBLE": (
        "diagnostico", "enfermedad", "patologia", "religion", "afiliacion sindical", "sindicato", "gremio", "orientacion sexual",
        "etnia", "origen etnico", "discapacidad", "licencia medica", "antecedentes penales", "grupo sanguineo", "alergias",
        "medicacion", "afiliacion politica", "partido politico",
    ),
    "EMAIL": ("email", "e mail", "mail", "correo", "correo electronico"),
    "TELEFONO": ("tel", "telefono", "celular", "cel", "movil", "whatsapp", "phone", "mobile"),
    "DNI": ("dni", "documento", "nro doc", "num doc", "numero de documento", "doc"),
    "TARJETA": ("tarjeta", "nro tarjeta", "card", "numero de tarjeta"),
    "PATENTE": ("patente", "dominio"),
    "FECHA_NACIMIENTO": ("fecha de nacimiento", "fecha nacimiento", "nacimiento", "fecha nac", "f nac", "fnac", "birthdate", "birth date", "date of birth", "dob"),
    "DIRECCION": ("direccion", "domicilio", "calle", "address"),
    "RAZON_SOCIAL": ("razon social", "empresa", "cliente", "proveedor", "compania", "company", "customer", "supplier", "vendor"),
    "NOMBRE_PERSONA": (
        "nombre", "apellido", "nombre y apellido", "apellido y nombre", "titular", "empleado", "contacto", "responsable", "vendedor", "paciente", "alumno",
        "name", "first name", "last name", "full name", "firstname", "lastname", "fullname", "surname",
    ),
}
NOT_PERSONAL = (
    "producto", "articulo", "item", "sucursal", "categoria", "archivo", "campana", "plan", "servicio", "rubro", "marca", "modelo", "banco", "ciudad", "provincia", "pais", "localidad",
    "product", "category", "file", "service", "brand", "model", "bank", "city", "country", "state", "branch",
)
ID_WORDS = ("id", "codigo", "cod", "nro cliente", "numero de cliente", "code")
NEGATIVE_WORDS = (
    "codigo", "cod", "factura", "pedido", "orden", "remito", "ticket", "comprobante", "monto", "importe", "precio", "total",
    "cantidad", "id", "sku", "legajo", "nro", "numero", "serie", "lote", "stock", "unidades", "subtotal", "iva", "cp",
)
#: Without a format of their own: known by the header only.
HEADER_ONLY = ("NOMBRE_PERSONA", "RAZON_SOCIAL", "DIRECCION", "FECHA_NACIMIENTO", "EDAD", "SALARIO", "DATO_SENSIBLE")


def _pattern(words: tuple[str, ...]) -> str:
    return rf"(?:^|\s)(?:{'|'.join(words)})(?:\s|$)"


def header_hint(header: Column) -> Column:
    """Type announced by a header, or null."""
    h = normalize_text(header)
    veto = h.rlike(_pattern(NOT_PERSONAL)) | h.rlike(_pattern(ID_WORDS))
    out = F.lit(None).cast("string")
    for kind, words in reversed(HEADER_HINTS.items()):
        says = h.rlike(_pattern(words))
        out = F.when(says & ~veto if kind in ("NOMBRE_PERSONA", "RAZON_SOCIAL") else says, F.lit(kind)).otherwise(out)
    return out


def header_hint_of(header: str) -> str | None:
    """The same of one header, on the driver."""
    h = normalize_str(header)
    says = lambda words: re.search(_pattern(words), h) is not None
    veto = says(NOT_PERSONAL) or says(ID_WORDS)
    return next((k for k, words in HEADER_HINTS.items() if says(words) and not (veto and k in ("NOMBRE_PERSONA", "RAZON_SOCIAL"))), None)


def is_negative_header(header: str) -> bool:
    """A business number: its values are not taken for personal ones by their looks."""
    return re.search(_pattern(NEGATIVE_WORDS), normalize_str(header)) is not None
