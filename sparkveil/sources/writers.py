"""Writing results: delimited files, JSON, text, equivalences in the clear or encrypted."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the key derivation. A fixed value.
ITERATIONS = 600_000


def write_csv(df: DataFrame, path: str, delimiter: str = ",", drop: tuple[str, ...] = ("_row",)) -> None:
    """Cells as text, dates as days, null as nothing. Row order is that of ``_row`` if there is one."""
    if "_row" in df.columns:
        df = df.orderBy("_row")
    kinds = dict(df.dtypes)
    days = [F.date_format(f"`{c}`", "yyyy-MM-dd").alias(c) if kinds[c] in ("date", "timestamp") else F.col(f"`{c}`").cast("string") for c in df.columns if c not in drop]
    df.select(*days).write.csv(path, sep=delimiter, header=True, nullValue="", emptyValue="", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_rows(df: DataFrame, drop: tuple[str, ...] = ("_row",)) -> DataFrame:
    """One JSON object per row; a missing value is written as null."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in drop]), {"ignoreNullFields": "false"}).alias("value"))


def write_texts(df: DataFrame, path: str, text: str = "protected") -> None:
    df.select(F.coalesce(F.col(text), F.lit("")).alias("value")).write.text(path)


def rebuild_json(documents: DataFrame, leaves: DataFrame, key: str, column: str = "json", text: str = "protected") -> DataFrame:
    """``documents`` with the changed leaves (key, path, text) put back at their paths. A changed number becomes text."""
    lists = leaves.groupBy(key).agg(F.collect_list(F.struct("path", F.col(text).alias("text"))).alias("sv_leaves"))
    joined = documents.join(lists, key, "left")
    kind = documents.schema[key].dataType.simpleString()

    def put(root, path, value):
        if not path:
            return value
        node = root
        for p in path[:-1]:
            node = node[p]
        old = node[path[-1]]
        if (old if isinstance(old, str) else str(old)) != value:
            node[path[-1]] = value
        return root

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw, own in zip(batch["json"], batch["leaves"], strict=True):
                if own is None or raw is None:
                    out.append(raw)
                    continue
                root = json.loads(raw)
                for leaf in own:
                    root = put(root, json.loads(leaf["path"]), leaf["text"])
                out.append(json.dumps(root, ensure_ascii=False))
            yield pd.DataFrame({"key": batch["key"], "json": out})

    return joined.select(F.col(key).alias("key"), F.col(column).alias("json"), F.col("sv_leaves").alias("leaves")).mapInPandas(run, f"key {kind}, json string").withColumnRenamed("key", key)


def write_equivalences(table: DataFrame, path: str) -> None:
    """Columns seudonimo, valor_original, grupo."""
    table.select(F.col("pseudonym").alias("seudonimo"), F.col("original").alias("valor_original"), F.col("prefix").alias("grupo")).write.csv(path, header=True)


def _key(password: str, salt: bytes, iterations: int) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32)


def encrypt_rows(table: DataFrame, password: str, salt: bytes | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """Every row as one AES-256-GCM message with a random nonce, beside what is needed to derive the key again.

    Rows are encrypted where they are, so a table of any size never passes through the driver; only the derived key is
    part of the plan, which is why the plan of a run must not be kept in a shared log.
    """
    salt = salt or os.urandom(16)
    key = F.lit(_key(password, salt, iterations))
    data = F.base64(F.aes_encrypt(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), key, F.lit("GCM")))
    return table.select(F.lit(1).alias("version"), F.lit(iterations).alias("iterations"), F.lit(salt.hex()).alias("salt"), data.alias("data"))


def decrypt_rows(encrypted: DataFrame, password: str, schema: str) -> DataFrame:
    """The table again. A wrong password or a changed row raises an error when the rows are read."""
    head = encrypted.select("salt", "iterations").first()
    if head is None:
        return encrypted.sparkSession.createDataFrame([], schema)
    key: Column = F.lit(_key(password, bytes.fromhex(head["salt"]), head["iterations"]))
    plain = F.aes_decrypt(F.unbase64("data"), key, F.lit("GCM")).cast("string")
    return encrypted.select(F.from_json(plain, schema).alias("x")).select("x.*")


#: Rows of an envelope, at most: it is one message, made by one task.
ENVELOPE_ROWS = 100_000


def write_envelope(table: DataFrame, path: str, password: str, format_name: str, iterations: int = ITERATIONS) -> None:
    """A small table (seudonimo, original, grupo) as one encrypted JSON envelope, which ``read_envelope`` reads; larger ones
    go by ``encrypt_rows``."""
    if table.limit(ENVELOPE_ROWS + 1).count() > ENVELOPE_ROWS:
        raise ValueError(f"over {ENVELOPE_ROWS} rows: use encrypt_rows")
    salt, iv = os.urandom(16), os.urandom(12)
    rows = table.agg(F.to_json(F.collect_list(F.struct("*")), {"ignoreNullFields": "false"}).alias("rows"))
    sealed = F.aes_encrypt("rows", F.lit(_key(password, salt, iterations)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(iv))
    text = lambda x: F.lit(x)
    b64 = lambda x: F.base64(F.lit(x))
    kdf = F.struct(text("PBKDF2").alias("nombre"), text("SHA-256").alias("hash"), F.lit(iterations).alias("iteraciones"), b64(salt).alias("sal"))
    cipher = F.struct(text("AES-GCM").alias("nombre"), b64(iv).alias("iv"))
    data = F.base64(F.substring(sealed, 13, 1 << 30))  # behind the nonce
    file = F.struct(text(format_name).alias("formato"), F.lit(1).alias("version"), kdf.alias("kdf"), cipher.alias("cifrado"), data.alias("datos"))
    rows.select(F.regexp_replace(F.to_json(file), r"\\\\[rn]+", "").alias("value")).coalesce(1).write.text(path)


def training_examples(cases: DataFrame, labels: list[str], text: str = "text", gold: str = "gold") -> DataFrame:
    """Annotated cases as JSON rows for training an entity model: tokenized_text, ner (first word, last word, label),
    ner_labels. Words are runs of letters and digits, or single other characters; a span covers the words it touches."""
    word = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
    from ..operators.spans import clean, matches

    found = cases.withColumn("sv_words", matches(clean(F.col(text)), word))
    touched = lambda s: F.filter(F.transform("sv_words", lambda w, i: F.when((w["at"] < s["end"]) & (s["start"] < w["at"] + F.length(w["m"])), i)), lambda i: i.isNotNull())
    ner = F.transform(F.filter(gold, lambda s: F.size(touched(s)) > 0), lambda s: F.struct(F.array_min(touched(s)).alias("first"), F.array_max(touched(s)).alias("last"), s["type"].alias("label")))
    out = F.struct(F.transform("sv_words", lambda w: w["m"]).alias("tokenized_text"), ner.alias("ner"), F.array(*map(F.lit, labels)).alias("ner_labels"))
    return found.select(F.to_json(out).alias("value"))
