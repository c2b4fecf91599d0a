"""Tables: which columns hold sensitive data, and protecting them.

Classification looks at the header and at the first 500 filled cells of each column (the sample size is a fixed value
of the method); counts are exact, over all rows. What reaches the driver is one row per column. Protecting joins cells
with their pseudonyms once, by row, whatever the number of columns.

Defined cases: empty cells and cells that are already protected stay; a column without filled cells is not sensitive;
the ``row`` column gives the order and must be unique.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.anonymize import anonymize, birth_year, salary_range
from ..functions.text import cell_text, fold, is_protected, mask
from ..storage import materialize
from ..types import ANONYMIZE, DROP, KEEP, PREFIXES, PROPAGATED, PSEUDONYMIZE, SPANS, TABLE_ACTIONS
from .documents import term_spans
from .headers import HEADER_ONLY, header_hint_of, is_negative_header
from .pseudonyms import assign
from .scan import scan, spread
from .spans import merge_spans, replace_spans
from .values import is_person_name, looks_like_person, mentions_sensitive

# The sample and the numbers of examples.
SAMPLE, EXAMPLES = 500, 3
COLUMN, TEXT, NONE = "columna", "texto", "ninguno"


@dataclass(frozen=True)
class Finding:
    index: int
    header: str
    kind: str
    type: str | None = None
    confidence: str | None = None
    ratio: float = 0.0
    count: int = 0
    text_counts: dict[str, int] = field(default_factory=dict)
    examples: tuple[str, ...] = ()
    action: str = KEEP
    #: Which step of the ladder decided.
    reason: str = "nothing"


@dataclass(frozen=True)
class Decision:
    action: str
    type: str | None = None
    kind: str = COLUMN
    prefix: str | None = None


def cell(df: DataFrame, column: str) -> Column:
    return cell_text(F.col(f"`{column}`"), df.schema[column].dataType.simpleString())


def cells(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """Long form of the filled cells: idx, row, v."""
    made = [F.struct(F.lit(i).alias("idx"), F.col(row).alias("row"), cell(df, c).alias("v")) for i, c in enumerate(columns)]
    return df.select(F.explode(F.array(*made)).alias("c")).select("c.*").where("v <> ''")


def sample_stats(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """Per column, ratios of every test over the sample. Each sample is a top-k by row, which needs no full sort."""
    out = None
    for i, c in enumerate(columns):
        one = df.select(F.lit(i).alias("idx"), F.col(row).alias("row"), cell(df, c).alias("v")).where("v <> ''").orderBy("row").limit(SAMPLE)
        out = one if out is None else out.unionByName(one)
    v = F.col("v")
    share = lambda c: F.avg(c.cast("int"))
    tests = {f"m_{k}": t(v) for k, t in V.VALUE_MATCHERS.items()}
    tests |= {
        "numeric": V.is_numeric_like(v),
        "people": looks_like_person(v),
        "companies": V.looks_like_company(v),
        "dictionary": is_person_name(v),
        "ages": v.rlike(r"^\d{1,3}$") & (v.try_cast("int") < 120),
        "amounts": v.rlike(r"^\$?\s?[\d.,]+$"),
        "sensitive": mentions_sensitive(v),
        "spaced": v.contains(" "),
    }
    return out.groupBy("idx").agg(
        F.count("*").alias("n"),
        *[share(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()],
        F.avg(F.length("v")).alias("avg_length"),
        F.avg(F.size(F.split("v", r"\s+"))).alias("avg_words"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("row", "v"))), 1, EXAMPLES), lambda x: mask(x["v"])).alias("examples"),
    )


def verdict(header: str, s: dict) -> tuple[str, str, float, str] | None:
    """(type, confidence, ratio, reason) of one column by its header and sample ratios; the first step that fits."""
    hint = header_hint_of(header)
    best = max(V.VALUE_MATCHERS, key=lambda k: s[f"m_{k}"])  # the first of equal ones
    r = s[f"m_{best}"]
    if r >= 0.8 and best in V.STRONG_TYPES:
        return best, "alta", r, "strong_format"
    if hint and hint not in HEADER_ONLY:
        own = s.get(f"m_{hint}", 0.0)
        return hint, "alta" if own >= 0.5 else "media", own, "header_and_values" if own >= 0.5 else "header"
    if hint in ("NOMBRE_PERSONA", "RAZON_SOCIAL"):
        if s["numeric"] >= 0.8:
            return hint, "baja", 0.0, "header_but_numbers"
        if s["companies"] >= 0.3 and s["companies"] >= s["people"]:
            return "RAZON_SOCIAL", "alta", s["companies"], "header_and_company_form"
        if s["people"] >= 0.6:
            return "NOMBRE_PERSONA", "alta", s["people"], "header_and_name_form"
    if hint in ("EDAD", "SALARIO"):
        own = s["ages" if hint == "EDAD" else "amounts"]
        return hint, "alta" if own >= 0.8 else "baja", own, "header_and_values" if own >= 0.8 else "header_but_values"
    if hint:
        return hint, "media", 0.0, "header"
    if not is_negative_header(header) and r >= 0.9 and best in ("TELEFONO", "DNI", "PATENTE", "IP", "PASAPORTE"):
        return best, "baja", r, "values_only"
    for key, least, kind, confidence in (("companies", 0.5, "RAZON_SOCIAL", "media"), ("dictionary", 0.6, "NOMBRE_PERSONA", "media"), ("people", 0.8, "NOMBRE_PERSONA", "baja"), ("sensitive", 0.5, "DATO_SENSIBLE", "media")):
        if s[key] >= least:
            return kind, confidence, s[key], key
    return None


def is_free_text(s: dict) -> bool:
    return s["avg_length"] >= 20 and s["spaced"] >= 0.5


def classify(df: DataFrame, row: str, columns: list[str] | None = None) -> list[Finding]:
    """One finding per column, in order."""
    columns = columns or [c for c in df.columns if c != row]
    stats = {r["idx"]: r.asDict() for r in sample_stats(df, columns, row).collect()}
    decided = {i: verdict(columns[i], s) for i, s in stats.items()}
    test = F.lit(True)
    for i, d in decided.items():
        if d and d[2] > 0 and d[0] in V.VALUE_MATCHERS:
            test = F.when(F.col("idx") == i, V.VALUE_MATCHERS[d[0]](F.col("v"))).otherwise(test)
    named = [columns[i] for i, d in decided.items() if d]
    counts = {r["idx"]: r["n"] for r in cells(df, columns, row).groupBy("idx").agg(F.count_if(test).alias("n")).collect()} if named else {}
    texts = [i for i, d in decided.items() if d is None and is_free_text(stats[i])]
    inside: dict[int, list] = {}
    if texts:
        some = cells(df, columns, row).where(F.col("idx").isin(texts))
        spans = materialize(scan(spread(some), "v").select("idx", "row", F.explode_outer("spans").alias("s")).where("s is not null"))
        first = spans.groupBy("idx", "s.type").agg(F.count("*").alias("n"), F.min(F.struct("row", "s.start", "s.value")).alias("f"))
        for r in first.select("idx", "type", "n", mask(F.col("f.value")).alias("example")).collect():
            inside.setdefault(r["idx"], []).append(r)
    out = []
    for i, c in enumerate(columns):
        d = decided.get(i)
        if d:
            kind, confidence, ratio, reason = d
            action = PSEUDONYMIZE if confidence == "baja" else TABLE_ACTIONS[kind]
            out.append(Finding(i, c, COLUMN, kind, confidence, ratio, counts.get(i, 0), {}, tuple(stats[i]["examples"]), action, reason))
        elif found := inside.get(i):
            by = {r["type"]: r["n"] for r in sorted(found, key=lambda r: (-r["n"], r["type"]))}
            out.append(Finding(i, c, TEXT, None, "media", 0.0, sum(by.values()), by, tuple(r["example"] for r in found[:EXAMPLES]), PSEUDONYMIZE, "free_text"))
        else:
            out.append(Finding(i, c, NONE))
    return out


def summarize_findings(findings: list[Finding]) -> dict[str, int]:
    """Totals by type; columns of low confidence are left out."""
    out: dict[str, int] = {}
    for f in findings:
        own = {f.type: f.count} if f.kind == COLUMN and f.confidence != "baja" else f.text_counts if f.kind == TEXT else {}
        for k, n in own.items():
            out[k] = out.get(k, 0) + n
    return out


def suggested(findings: list[Finding], policy: dict[str, str] | None = None) -> dict[str, Decision]:
    """A decision per column; the company's policy by type comes first."""
    return {f.header: Decision((policy or {}).get(f.type, f.action), f.type, f.kind) for f in findings if f.kind != NONE}


@dataclass(frozen=True)
class ProtectedTable:
    table: DataFrame
    equivalences: DataFrame
    counts: DataFrame


def _anonymized(df: DataFrame, column: str, kind: str) -> Column:
    """Dates and numbers of a typed column keep their own readings."""
    dtype, c = df.schema[column].dataType.simpleString(), F.col(f"`{column}`")
    if kind == "FECHA_NACIMIENTO" and dtype in ("date", "timestamp"):
        return F.date_format(c, "yyyy")
    if kind == "FECHA_NACIMIENTO" and dtype in ("double", "int", "bigint"):
        return birth_year(c, serial=True)
    if kind == "SALARIO" and dtype in ("double", "int", "bigint"):
        return salary_range(F.format_string("%.2f", c.cast("double")))
    return anonymize(F.lit(kind), cell(df, column))


def _cells_of(idx: int) -> Column:
    """The replacements of one column, in reading order."""
    mine = F.filter("sv_cells", lambda x: x["idx"] == idx)
    return F.array_sort(F.transform(mine, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["pseudonym"].alias("pseudonym"))))


def apply_decisions(df: DataFrame, decisions: dict[str, Decision], row: str, cell_spans: DataFrame | None = None) -> ProtectedTable:
    """Carries out one decision per column. ``cell_spans`` (row, column, spans) are a model's findings in free text."""
    columns = [c for c in df.columns if c != row]
    at = {c: i for i, c in enumerate(columns)}
    active = {c: d for c, d in decisions.items() if d.action != KEEP}
    texts = [c for c, d in active.items() if d.kind == TEXT and d.action != DROP]
    single = {c: d for c, d in active.items() if d.kind == COLUMN and d.type and d.action != DROP}
    prefix_of = lambda d: (d.prefix or "").strip() or PREFIXES[d.type]
    spark = df.sparkSession

    occurrences = None
    for c, d in single.items():
        if d.action == PSEUDONYMIZE:
            one = df.select(F.col(row).alias("row"), F.lit(at[c]).alias("idx"), F.lit(0).alias("start"), F.lit(-1).alias("end"), F.lit(d.type).alias("type"), cell(df, c).alias("raw"), F.lit(prefix_of(d)).alias("prefix")).where((F.col("raw") != "") & ~is_protected(F.col("raw")))
            occurrences = one if occurrences is None else occurrences.unionByName(one)
    fixed = None
    if texts:
        long = cells(df, columns, row).where(F.col("idx").isin([at[c] for c in texts]))
        found = materialize(scan(spread(long), "v"))
        learned = _learned(df, {c: d for c, d in single.items() if d.type in PROPAGATED}, at, row, prefix_of)
        if learned is not None:
            learned = materialize(learned)
            found = found.join(term_spans(found, learned, ["row", "idx"], [], "v"), ["row", "idx"], "left")
        else:
            found = found.withColumn("sv_terms", F.array().cast(SPANS))
        rules = F.coalesce("spans", F.array().cast(SPANS))
        if cell_spans is not None:
            from .model import combine_spans

            model = cell_spans.select(F.col("row"), F.element_at(F.create_map(*[F.lit(x) for c in texts for x in (c, at[c])]), F.col("column")).alias("idx"), F.col("spans").alias("sv_model"))
            found = found.join(model, ["row", "idx"], "left")
            rules = combine_spans(F.col("v"), rules, F.coalesce("sv_model", F.array().cast(SPANS)))
        merged = found.select("row", "idx", F.explode_outer(merge_spans(F.coalesce("sv_terms", F.array().cast(SPANS)), rules)).alias("s")).where("s is not null")
        flat = merged.select("row", "idx", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.type").alias("type"), F.col("s.value").alias("raw"))
        defaults = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
        flat = flat.withColumn("prefix", defaults[F.col("type")])
        if learned is not None:
            own = learned.select(F.col("fold").alias("sv_fold"), F.col("prefix").alias("sv_prefix"))
            flat = flat.withColumn("sv_fold", fold(F.col("raw"))).join(own, "sv_fold", "left").withColumn("prefix", F.coalesce("sv_prefix", "prefix")).drop("sv_fold", "sv_prefix")
        named = [at[c] for c in texts if active[c].action == PSEUDONYMIZE]
        mine = flat.where(F.col("idx").isin(named))
        occurrences = mine if occurrences is None else occurrences.unionByName(mine)
        fixed = flat.where(~F.col("idx").isin(named)).withColumn("pseudonym", anonymize(F.col("type"), F.col("raw")))
    empty = spark.createDataFrame([], "prefix string, number long, pseudonym string, original string")
    parts = [] if fixed is None else [fixed.select("row", "idx", "start", "end", "type", "pseudonym")]
    table = empty
    if occurrences is not None:
        done, table = assign(occurrences, ["row", "idx", "start"])
        parts.append(done.select("row", "idx", "start", "end", "type", "pseudonym"))
    out = df
    replaced = None
    if parts:
        replaced = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        replaced = materialize(replaced)
        by_cell = F.struct("idx", "start", "end", "pseudonym")
        lists = replaced.groupBy("row").agg(F.collect_list(by_cell).alias("sv_cells")).withColumnRenamed("row", "sv_row")
        out = df.join(lists, F.col(row) == F.col("sv_row"), "left").drop("sv_row")
        for c in {*texts, *(c for c, d in single.items() if d.action == PSEUDONYMIZE)}:
            own = _cells_of(at[c])
            new = replace_spans(cell(df, c), own, lambda s: s["pseudonym"]) if c in texts else own[0]["pseudonym"]
            out = out.withColumn(c, F.when(F.size(own) > 0, new).otherwise(F.col(f"`{c}`").cast("string")))
        out = out.drop("sv_cells")
    for c, d in single.items():
        if d.action == ANONYMIZE:
            s = cell(df, c)
            out = out.withColumn(c, F.when((s == "") | is_protected(s), F.col(f"`{c}`").cast("string")).otherwise(_anonymized(df, c, d.type)))
    out = out.select(*[F.col(f"`{c}`") for c in df.columns if not (c in active and active[c].action == DROP)])
    counted = None if replaced is None else replaced.groupBy("type").agg(F.count("*").alias("count"))
    for c, d in active.items():
        if d.type and (d.action == DROP or (d.kind == COLUMN and d.action == ANONYMIZE)):
            s = cell(df, c)
            fine = (s != "") if d.action == DROP else (s != "") & ~is_protected(s)
            one = df.agg(F.count_if(fine).alias("count")).select(F.lit(d.type).alias("type"), "count")
            counted = one if counted is None else counted.unionByName(one)
    counts = spark.createDataFrame([], "type string, count long") if counted is None else counted.groupBy("type").agg(F.sum("count").alias("count")).where("count > 0")
    return ProtectedTable(out, table, counts)


def _learned(df: DataFrame, columns: dict[str, Decision], at: dict[str, int], row: str, prefix_of) -> DataFrame | None:
    """value, type, prefix, fold, ord of names, companies and addresses in their columns, ordered by column, then row."""
    out = None
    for c, d in columns.items():
        v = cell(df, c)
        one = df.select(v.alias("value"), F.col(row).alias("row"), F.lit(at[c]).alias("idx"), F.lit(d.type).alias("type"), F.lit(prefix_of(d)).alias("prefix")).where(F.length("value") >= 3)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    firsts = out.groupBy(fold(F.col("value")).alias("fold")).agg(F.min(F.struct("idx", "row", "value", "type", "prefix")).alias("f"))
    return firsts.select("fold", "f.*").select("value", "type", "prefix", "fold", F.struct("idx", "row").alias("ord"))
