"""Marked sentences of our own: those that the rules were made with, and unseen ones that only measure them."""

MORE = [
    "Firmó la Lic. [[NOMBRE_PERSONA|Carolina Vega]] ayer",
    "el titular [[NOMBRE_PERSONA|Pedro Salinas]] autorizó la compra",
    "autorizado por [[NOMBRE_PERSONA|Marta Quiroga]] el lunes",
    "[[NOMBRE_PERSONA|RICARDO SOSA]] presentó la nota",
    "enviar copia a [[EMAIL|compras+2024@empresa-x.com.ar]] y a [[EMAIL|a_b.c@x.org]]",
    "https://ejemplo.com/a@b no es un correo",
    "celular [[TELEFONO|+54 9 11 5555-1234]]",
    "llamar al [[TELEFONO|(0351) 455-6677]] por la mañana",
    "expediente 12345678 del año 2024",
    "pedido 30123456 entregado",
    "el documento [[DNI|28.111.222]] figura en el padrón",
    "documento: [[DNI|31222333]]",
    "vendimos 12.345.678 unidades",
    "precio 25000000 por todo",
    "CUIL [[CUIT_CUIL|27-11111111-7]]",
    "CUIT 20-12345678-9 está mal escrito",
    "tarjeta visa [[TARJETA|4111-1111-1111-1111]] vencida",
    "número 4111111111111112 sin dígito válido",
    "IP [[IP|10.0.0.254]] bloqueada",
    "versión 10.0.0.254 publicada",
    "nació el [[FECHA_NACIMIENTO|3 de mayo de 1990]] en Salta",
    "la reunión es el 3 de mayo de 2024",
    "nacida el [[FECHA_NACIMIENTO|1988-07-21]]",
    "pasaporte [[PASAPORTE|ARG654321]] emitido",
    "el código ARG654321 no existe",
    "dominio [[PATENTE|ABC 123]] y patente [[PATENTE|AC456EF]]",
    "cobra [[SALARIO|$ 950.000]] en mano",
    "sueldo neto: [[SALARIO|1200000]]",
    "total $ 950.000 con impuestos",
    "edad: [[EDAD|34]]",
    "tiene [[EDAD|34 años]] de edad",
    "hace 34 años que existe",
    "domicilio en [[DIRECCION|Calle San Martín 1250]]",
    "por Avenida Libertador sin número",
    "[[RAZON_SOCIAL|Transportes Andinos SRL]] facturó",
    "contrato con La [[RAZON_SOCIAL|Buena Mesa S.A.]]",
    "la empresa cerró",
    "padece [[DATO_SENSIBLE|epilepsia]] desde niño",
    "es [[DATO_SENSIBLE|afiliado al sindicato]] hace años",
    "religión: ninguna",
    "api_key=[[CREDENCIAL|Zx81kq99]]",
    "token: xxxx",
    "llamar al [[TELEFONO|11 4567-8901]] 2 veces o al [[TELEFONO|+54 9 (351) 455-6677]].",
    "[[NOMBRE_PERSONA|Juan]] vive en [[DIRECCION|Calle San Martín 455]] o cerca",
    "interno +54 (0351) 15 455-6677 88 es demasiado largo",
    "tel [[TELEFONO|4567-8901]] y cel [[TELEFONO|4567 8902]]",
    "remuneración: [[SALARIO|2.300.000 pesos]] o [[SALARIO|USD 2.500,50]]",
    "sueldo de 1.23.456 mal escrito",
    "vive en [[DIRECCION|Pje. de los Andes N° 12]] y [[DIRECCION|Calle 9 de Julio 455]].",
    "Avenida larga y sin nombres 455",
    "para la empresa [[RAZON_SOCIAL|Hijos de Pedro e Hijas S. A.]] y para [[RAZON_SOCIAL|Uno Dos Tres Cuatro Cinco SRL]]",
    "nació el [[FECHA_NACIMIENTO|01-02-1999]] o el [[FECHA_NACIMIENTO|1 de Febrero del 1999]]",
    "presenta [[DNI|23.456.789]] y 2.34.567.89 y 23456789,50",
]

UNSEEN = [
    "Nos escribió el Ing. [[NOMBRE_PERSONA|Hugo Ferreyra]] desde [[EMAIL|hferreyra@obras.net]]",
    "contacto: [[NOMBRE_PERSONA|Natalia Ruiz]], tel [[TELEFONO|11 4321-8765]]",
    "soy [[NOMBRE_PERSONA|Gabriel]] de soporte",
    "el paciente [[NOMBRE_PERSONA|Oscar Molina]] tiene [[DATO_SENSIBLE|asma]]",
    "DNI [[DNI|25.678.901]] y CUIL [[CUIT_CUIL|20-12345678-6]]",
    "remito 25678901 sin observaciones",
    "presupuesto por 3.500.000 pesos",
    "gana [[SALARIO|$ 780.000]] por mes",
    "los haberes son [[SALARIO|650000]]",
    "nacimiento: [[FECHA_NACIMIENTO|15/08/1979]]",
    "entrega 15/08/2025 en depósito",
    "edad [[EDAD|52]]",
    "whatsapp [[TELEFONO|15-6789-0123]]",
    "servidor [[IP|172.16.5.4]] caído",
    "tarjeta de crédito [[TARJETA|5500 0000 0000 0004]]",
    "CBU [[CBU_CVU|2850590940090418135201]]",
    "alias [[CBU_CVU|luna.mar.rio]]",
    "pasaporte [[PASAPORTE|BRA112233]]",
    "patente [[PATENTE|AE987ZX]] del camión",
    "vive en [[DIRECCION|Av. Belgrano 456]]",
    "[[RAZON_SOCIAL|Metalúrgica Norte S.A.S.]] presentó quiebra",
    "[[NOMBRE_PERSONA|Teresa Aguirre]] renunció",
    "password: [[CREDENCIAL|hunter2024]]",
    "la puerta azul da a la calle y no hay nadie",
]
