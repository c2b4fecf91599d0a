"""Documents as segments: analysis, protection, restoring.

A document is a set of rows (doc, seg, text, hint, context); ``hint`` and ``context`` are the keys above a JSON value or
the header of a table cell, else null. Pseudonyms are consistent within a document; pass another ``scope`` for a
conversation or a whole corpus.

Defined cases: a null text has no spans and stays null; a document without spans comes back unchanged; repeated
(doc, seg) pairs must not occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.anonymize import anonymize
from ..functions.text import MARKS, fold, let, mask, strip_accents
from ..storage import among, marked, materialize
from ..types import ANONYMIZE, DOCUMENT_ACTIONS, DROP, KEEP, PREFIXES, PROPAGATED, PSEUDONYMIZE, SPANS
from . import words as W
from .headers import HEADER_ONLY, header_hint
from .pseudonyms import assign
from .scan import scan, spread
from .spans import find_listed, find_terms, merge_spans, replace_spans
from .values import looks_like_person

NOT_NUMERIC = ("NOMBRE_PERSONA", "RAZON_SOCIAL", "DIRECCION", "DATO_SENSIBLE")


def whole_value_type(text: Column, hint: Column, context: Column) -> Column:
    """Type of a value whose key announces it and whose look does not deny it; else null."""
    value = F.trim(text)
    joint = F.when(context.isNotNull(), F.concat(context, F.lit(" "), hint)).otherwise(hint)

    def decide(kind: Column) -> Column:
        by_look = F.when(V.looks_like_company(value), "RAZON_SOCIAL").when(looks_like_person(value), "NOMBRE_PERSONA").otherwise(kind)
        header_only = F.when(V.is_numeric_like(value) & kind.isin(*NOT_NUMERIC), None).when(kind.isin("NOMBRE_PERSONA", "RAZON_SOCIAL"), by_look).otherwise(kind)
        out = F.when(kind.isin(*HEADER_ONLY, "CREDENCIAL"), header_only)
        for name, test in V.VALUE_MATCHERS.items():
            if name != "CREDENCIAL":
                out = out.when((kind == name) & test(value), name)
        return out

    return F.when(hint.isNotNull() & (F.coalesce(value, F.lit("")) != "") & header_hint(hint).isNotNull(), let(header_hint(joint), decide))


def folded_term(value: Column) -> Column:
    return F.lower(F.translate(strip_accents(F.trim(value)), MARKS, ""))


#: Terms that are copied to every task and looked up in every text, at most.
FEW_TERMS = 64


def term_spans(texts: DataFrame, terms: DataFrame, keys: list[str], scope: list[str] = [], text: str = "text") -> DataFrame:
    """Dictionary search as a join: (keys..., sv_terms) of the rows that may hold a term (value, type, ord; scope... if any).

    Each term is filed under its word that fewest terms share; a text's distinct words meet the terms filed under them,
    and only these are searched in it. Up to ``FEW_TERMS`` terms without a scope are one expression, which shuffles nothing and
    reads a text once. Otherwise words that no term is filed under are left out by a bitmap of fixed size before the
    others are shuffled, and so is a text that holds none.
    """
    needle = terms.select(*scope, "value", "type", "ord", folded_term(F.col("value")).alias("needle")).where(F.length("needle") >= 2)
    parts = needle.select("*", F.explode(F.array_distinct(F.regexp_extract_all("needle", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    shared = parts.groupBy(*scope, "word").agg(F.count("*").alias("sv_k"))
    first = parts.join(shared, [*scope, "word"]).groupBy(*scope, "value", "type", "ord").agg(F.min(F.struct("sv_k", "word")).alias("w")).select(*scope, "value", "type", "ord", F.col("w.word").alias("word"))
    first = materialize(first)
    words_of = lambda c: F.array_distinct(F.split(F.lower(strip_accents(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+"))
    if not scope and first.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        in_order = needle.select("ord", "needle", "type").orderBy("ord", "needle", "type").collect()  # of a checked number
        listed = [(k, r["needle"], r["type"]) for k, r in enumerate(in_order)]
        # written first: a filter, or what Spark infers from an explode, would search every text once more
        found = materialize(spread(texts.select(*keys, F.col(text).alias("sv_text"))).select(*keys, find_listed(F.col("sv_text"), listed).alias("sv_terms")))
        return found.where(F.size("sv_terms") > 0)
    carried = list(dict.fromkeys([*keys, *scope]))
    tokens = among(texts.select(*carried, F.explode(words_of(F.col(text))).alias("word")), first, "word")
    met = materialize(tokens.join(first, [*scope, "word"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "value", "type"))).alias("sv_some")))
    return texts.select(*keys, F.col(text).alias("sv_text")).join(met, keys).select(*keys, find_terms(F.col("sv_text"), F.col("sv_some")).alias("sv_terms"))


def analyze(segments: DataFrame, custom_terms: DataFrame | None = None, ignored: list[str] = [], doc: str = "doc_id", seg: str = "seg_id", first_names: tuple[str, ...] = W.FIRST_NAMES) -> DataFrame:
    """``segments`` with ``spans`` and ``ignored_spans``; custom terms (value, type, ord) win over what is detected, and
    names learned from keys are searched in the other segments of their document. The result is written and read back."""
    frame = spread(segments)
    for c in ("hint", "context"):
        if c not in frame.columns:
            frame = frame.withColumn(c, F.lit(None).cast("string"))
    frame = frame.withColumn("sv_whole", whole_value_type(F.col("text"), F.col("hint"), F.col("context")))
    none = F.array().cast(SPANS)
    scanned = scan(frame.withColumn("sv_scan", F.when(F.col("sv_whole").isNull(), F.col("text"))), "sv_scan", "sv_found", first_names=first_names)
    keys = [doc, seg]
    learned = frame.where(F.col("sv_whole").isin(*PROPAGATED)).groupBy(doc, F.trim("text").alias("value")).agg(F.min(F.struct(seg, F.col("sv_whole").alias("type"))).alias("x"))
    learned = learned.select(doc, "value", F.col("x.type").alias("type"), F.col(f"x.{seg}").cast("long").alias("ord"))
    own = term_spans(frame.where("sv_whole is null"), learned, keys, [doc]).withColumnRenamed("sv_terms", "sv_learned")
    step = scanned.join(own, keys, "left")
    if custom_terms is not None:
        step = step.join(term_spans(frame, custom_terms, keys).withColumnRenamed("sv_terms", "sv_custom"), keys, "left")
    else:
        step = step.withColumn("sv_custom", none)
    lead = F.length("text") - F.length(F.ltrim("text"))
    value = F.trim("text")
    whole = F.array(F.struct(F.col("sv_whole").alias("type"), lead.alias("start"), (lead + F.length(value)).alias("end"), value.alias("value"), F.lit("alta").alias("confidence"), F.lit("clave").alias("source"))).cast(SPANS)
    custom, found = F.coalesce("sv_custom", none), F.coalesce("sv_found", none)
    spans = F.when(F.col("sv_whole").isNotNull(), merge_spans(custom, whole)).otherwise(merge_spans(F.concat(custom, F.coalesce("sv_learned", none)), found))
    step = step.withColumn("sv_spans", spans)
    skip = F.array(*[F.lit(x) for x in ignored]).cast("array<string>")
    skips = lambda s: F.exists(skip, lambda x: fold(x) == fold(s["value"])) if ignored else F.lit(False)
    step = step.withColumn("spans", F.filter("sv_spans", lambda s: ~skips(s))).withColumn("ignored_spans", F.filter("sv_spans", skips))
    return materialize(step.drop("sv_whole", "sv_scan", "sv_found", "sv_learned", "sv_custom", "sv_spans"))


def summarize(analyzed: DataFrame, doc: str = "doc_id", seg: str = "seg_id") -> DataFrame:
    """type, count, distinct values, those to review, the first three values as masked examples; most frequent first."""
    one = analyzed.select(F.struct(doc, seg).alias("at"), F.explode("spans").alias("s")).select("at", "s.*")
    by = one.groupBy("type", "value").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "baja").alias("low"), F.min(F.struct("at", "start")).alias("first"))
    totals = by.groupBy("type").agg(F.sum("n").alias("count"), F.count("*").alias("distinct"), F.sum("low").alias("review"))
    # Three times the least of what is left: sums by type, so a type of very many values is in no one task.
    firsts, left = None, by.select("type", "value", "first")
    for k in range(EXAMPLES):
        best = left.groupBy("type").agg(F.min(F.struct("first", "value")).alias("b")).select("type", F.lit(k).alias("k"), F.col("b.first").alias("sv_first"), F.col("b.value").alias("example"))
        firsts = best if firsts is None else firsts.unionByName(best)
        left = left.join(F.broadcast(best.select("type", "sv_first")), "type").where(F.col("first") > F.col("sv_first")).drop("sv_first")  # one row a type
    shown = firsts.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", mask(F.col("example")).alias("m")))), lambda x: x["m"]).alias("examples"))
    return totals.join(F.broadcast(shown), "type").select("type", "count", "distinct", "review", "examples").orderBy(F.desc("count"), "type")


#: Masked examples of a type.
EXAMPLES = 3


def action_of(policy: dict[str, str] | None = None) -> dict[str, str]:
    """Company policy before the default; dropping a column does not exist in documents and means anonymising."""
    chosen = DOCUMENT_ACTIONS | (policy or {})
    return {t: ANONYMIZE if a == DROP else a for t, a in chosen.items()}


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


@dataclass(frozen=True)
class Protected:
    segments: DataFrame
    equivalences: DataFrame
    counts: DataFrame


def protect(analyzed: DataFrame, policy: dict[str, str] | None = None, scope: list[str] | None = None, doc: str = "doc_id", seg: str = "seg_id", prefixes: dict[str, str] = PREFIXES) -> Protected:
    """Texts with every span replaced by its type's action. ``scope`` are the columns within which pseudonyms agree."""
    scope = [doc] if scope is None else scope
    actions = action_of(policy)
    active = [t for t, a in actions.items() if a != KEEP]
    keys = [doc, seg]
    carried = list(dict.fromkeys([*scope, *keys]))
    found = analyzed.select(*carried, F.explode(F.filter("spans", lambda s: s["type"].isin(*active))).alias("s"))
    flat = found.select(*carried, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.type").alias("type"), F.col("s.value").alias("raw"), _literal_map(prefixes)[F.col("s.type")].alias("prefix"))
    reversible = [t for t in active if actions[t] == PSEUDONYMIZE]
    order = [c for c in [*keys, "start"] if c not in scope]
    named, table = assign(flat.where(F.col("type").isin(*reversible)), order, scope)
    fixed = flat.where(~F.col("type").isin(*reversible)).withColumn("pseudonym", anonymize(F.col("type"), F.col("raw")))
    all_ = named.select(*keys, "start", "end", "type", "pseudonym").unionByName(fixed.select(*keys, "start", "end", "type", "pseudonym"))
    lists = all_.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "pseudonym"))).alias("sv_repl"))
    out = analyzed.join(lists, keys, "left")
    text = F.when(F.col("sv_repl").isNull(), F.col("text")).otherwise(replace_spans(F.col("text"), F.col("sv_repl"), lambda s: s["pseudonym"]))
    return Protected(out.withColumn("protected", text).drop("sv_repl"), table, flat.groupBy("type").agg(F.count("*").alias("count")))


#: Places of a table's cell in one number, which orders them.
_ROWS, _COLUMNS = 1_000_000_000, 10_000


def table_segments(tables: DataFrame, key: str) -> DataFrame:
    """Rows (key, table_id, row_id, cells) of tables, the first one of a table its header -> segments (key, seg_id, text,
    hint): every other cell with its column's header as the hint."""
    heads = tables.groupBy(key, "table_id").agg(F.min_by("cells", "row_id").alias("head"), F.min("row_id").alias("first"))
    body = tables.join(heads, [key, "table_id"]).where("row_id > first")
    cells = body.select(key, "table_id", "row_id", "head", F.posexplode("cells").alias("c", "text"))
    place = (F.col("table_id").cast("long") * _ROWS + F.col("row_id")) * _COLUMNS + F.col("c")
    return cells.select(key, place.alias("seg_id"), "text", F.get("head", F.col("c")).alias("hint"))


def rebuild_tables(segments: DataFrame, key: str, text: str = "protected") -> DataFrame:
    """Segments of ``table_segments`` -> (key, table_id, row_id, cells) without the header rows."""
    place = F.floor(F.col("seg_id") / _COLUMNS)
    rows = segments.select(key, F.floor(place / _ROWS).cast("int").alias("table_id"), (place % _ROWS).cast("int").alias("row_id"), (F.col("seg_id") % _COLUMNS).cast("int").alias("c"), F.col(text).alias("t"))
    return rows.groupBy(key, "table_id", "row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "t"))), lambda x: x["t"]).alias("cells"))


def usage_events(analyzed: DataFrame, actions: dict[str, str], doc: str = "doc_id") -> DataFrame:
    """Metadata about a run, without any text: event_id, type, action, amount; types that are kept count too."""
    found = analyzed.select(F.col(doc).alias("event_id"), F.explode("spans").alias("s")).groupBy("event_id", "s.type").agg(F.count("*").alias("amount"))
    return found.select("event_id", "type", _literal_map(actions)[F.col("type")].alias("action"), "amount")


def originals(analyzed: DataFrame, policy: dict[str, str] | None = None, scope: list[str] = []) -> DataFrame:
    """(scope..., type, original) of every value that ``protect`` takes out, whether it can be restored or not."""
    active = [t for t, a in action_of(policy).items() if a != KEEP]
    found = analyzed.select(*scope, F.explode(F.filter("spans", lambda s: s["type"].isin(*active))).alias("s"))
    return found.select(*scope, F.col("s.type").alias("type"), F.col("s.value").alias("original")).distinct()


#: Code points of the pieces by which secrets are filed.
_PIECE = 4
#: Values of a scope that its texts are given directly, at most.
_FEW_SECRETS = 64


def leaks(cleaned: DataFrame, secrets: DataFrame, keys: list[str], scope: list[str] = [], text: str = "protected", secret: str = "original") -> DataFrame:
    """Rows of ``cleaned`` that contain an original value (of their scope) of four or more characters, letter for letter,
    also within a word: ``keys``, and ``leaked``, the values.

    The texts of a scope of up to ``_FEW_SECRETS`` values meet these by the scope alone. Otherwise a value is filed under that
    of its pieces of four characters which fewest values share. Texts meet the values filed under the pieces they hold
    (pieces that no value is filed under are left out by a bitmap of fixed size), and only these are looked for.
    """
    if not scope:
        return _leaks_by_piece(cleaned, secrets, keys, scope, text, secret)
    wanted = materialize(secrets.where(F.length(secret) >= _PIECE).select(*scope, F.col(secret).alias("sv_secret"), F.xxhash64(*scope).alias("sv_scope")))
    many = materialize(wanted.groupBy("sv_scope").agg(F.count("*").alias("n")).where(F.col("n") > _FEW_SECRETS).select("sv_scope"))
    large = not many.isEmpty()
    if large:  # both ways read the texts
        cleaned = materialize(cleaned.select(*dict.fromkeys([*keys, *scope, text]), F.xxhash64(*scope).alias("sv_scope")))
        wanted, cleaned = marked(wanted, many, "sv_scope", "sv_many"), marked(cleaned, many, "sv_scope", "sv_many")
    few, texts = (wanted.where("not sv_many"), cleaned.where("not sv_many")) if large else (wanted, cleaned)
    own = few.groupBy(*scope).agg(F.collect_set("sv_secret").alias("sv_some"))
    found = _leaked(texts.join(own, scope), keys, text)
    if large:
        found = found.unionByName(_leaks_by_piece(cleaned.where("sv_many"), wanted.where("sv_many"), keys, scope, text, "sv_secret"))
    return found


def _leaked(met: DataFrame, keys: list[str], text: str) -> DataFrame:
    found = met.withColumn("leaked", F.array_sort(F.filter("sv_some", lambda x: F.col(text).contains(x))))
    return found.where(F.size("leaked") > 0).select(*keys, "leaked")


def _leaks_by_piece(cleaned: DataFrame, secrets: DataFrame, keys: list[str], scope: list[str], text: str, secret: str) -> DataFrame:
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (_PIECE - 1)), lambda i: F.substring(c, i, F.lit(_PIECE))))
    wanted = secrets.where(F.length(secret) >= _PIECE).select(*scope, F.col(secret).alias("sv_secret")).distinct()
    parts = wanted.select("*", F.explode(pieces(F.col("sv_secret"))).alias("sv_piece"))
    shared = parts.groupBy("sv_piece").agg(F.count("*").alias("sv_n"))
    filed = parts.join(shared, "sv_piece").groupBy(*scope, "sv_secret").agg(F.min(F.struct("sv_n", "sv_piece")).alias("w")).select(*scope, "sv_secret", F.col("w.sv_piece").alias("sv_piece"))
    filed = materialize(filed)
    carried = list(dict.fromkeys([*keys, *scope]))
    held = cleaned.where(F.length(text) >= _PIECE).select(*carried, F.explode(pieces(F.col(text))).alias("sv_piece"))
    met = among(held, filed, "sv_piece").join(filed, [*scope, "sv_piece"]).groupBy(*carried).agg(F.collect_set("sv_secret").alias("sv_some"))
    return _leaked(cleaned.join(met, carried), keys, text)
