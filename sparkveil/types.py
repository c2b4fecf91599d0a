"""Detection types, their pseudonym prefixes, default actions and tokens."""

from __future__ import annotations

from pyspark.sql import types as T

# The type codes, prefixes, actions and tokens that results are compared by.
PREFIXES = {
    "EMAIL": "Email",
    "TELEFONO": "Tel",
    "DNI": "DNI",
    "CUIT_CUIL": "CUIT",
    "CBU_CVU": "CBU",
    "TARJETA": "Tarjeta",
    "PATENTE": "Patente",
    "NOMBRE_PERSONA": "Persona",
    "RAZON_SOCIAL": "Empresa",
    "DIRECCION": "Direccion",
    "FECHA_NACIMIENTO": "Fecha",
    "EDAD": "Edad",
    "PASAPORTE": "Pasaporte",
    "SALARIO": "Salario",
    "DATO_SENSIBLE": "DatoSensible",
    "CREDENCIAL": "Credencial",
    "IP": "IP",
}
TOKENS = {
    "EMAIL": "[EMAIL]",
    "TELEFONO": "[TEL]",
    "DNI": "[DNI]",
    "CUIT_CUIL": "[CUIT]",
    "CBU_CVU": "[CBU]",
    "TARJETA": "[TARJETA]",
    "PATENTE": "[PATENTE]",
    "NOMBRE_PERSONA": "[NOMBRE]",
    "RAZON_SOCIAL": "[EMPRESA]",
    "DIRECCION": "[DIRECCION]",
    "FECHA_NACIMIENTO": "[FECHA]",
    "EDAD": "[EDAD]",
    "PASAPORTE": "[PASAPORTE]",
    "SALARIO": "[SALARIO]",
    "DATO_SENSIBLE": "[DATO SENSIBLE]",
    "CREDENCIAL": "[CREDENCIAL]",
    "IP": "[IP]",
}
DROP, ANONYMIZE, PSEUDONYMIZE, KEEP = "eliminar", "anonimizar", "seudonimizar", "mantener"
ACTIONS = (DROP, ANONYMIZE, PSEUDONYMIZE, KEEP)
TYPES = tuple(PREFIXES)
#: Suggested action for a column of a table.
TABLE_ACTIONS = {
    "EMAIL": ANONYMIZE,
    "TELEFONO": DROP,
    "DNI": PSEUDONYMIZE,
    "CUIT_CUIL": PSEUDONYMIZE,
    "CBU_CVU": DROP,
    "TARJETA": DROP,
    "PATENTE": PSEUDONYMIZE,
    "NOMBRE_PERSONA": PSEUDONYMIZE,
    "RAZON_SOCIAL": PSEUDONYMIZE,
    "DIRECCION": DROP,
    "FECHA_NACIMIENTO": ANONYMIZE,
    "EDAD": ANONYMIZE,
    "PASAPORTE": PSEUDONYMIZE,
    "SALARIO": ANONYMIZE,
    "DATO_SENSIBLE": DROP,
    "CREDENCIAL": DROP,
    "IP": ANONYMIZE,
}
#: In documents nothing is dropped, and passports are anonymised.
DOCUMENT_ACTIONS = {t: ANONYMIZE if a == DROP or t == "PASAPORTE" else a for t, a in TABLE_ACTIONS.items()}
CONFIDENCE_RANK = {"alta": 3, "media": 2, "baja": 1}
#: Types whose values, once known, are searched in free text.
PROPAGATED = ("NOMBRE_PERSONA", "RAZON_SOCIAL", "DIRECCION")
#: Types that are compared by their digits.
DIGIT_TYPES = ("DNI", "CUIT_CUIL", "CBU_CVU", "TARJETA", "TELEFONO")

#: Offsets count code points from 0; ``end`` is exclusive.
SPAN = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
SPANS = T.ArrayType(SPAN)
