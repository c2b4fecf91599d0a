"""Around an entity-recognition model: which cells it reads, running it by Arrow batches, and joining its findings.

The model is a parameter: a factory that each Python worker calls once. Texts are cut into windows of whole sentences,
scored in batches, decoded per window, and mapped back. Without a model everything else works by rules alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, is_protected, let
from ..types import CONFIDENCE_RANK, SPANS
from . import words as W
from .spans import by_start, overlaps

# Labels, calibrated thresholds and sizes that results are compared by.
LABELS = {"person": "NOMBRE_PERSONA", "organization": "RAZON_SOCIAL", "address": "DIRECCION", "medical condition": "DATO_SENSIBLE"}
THRESHOLDS = {"person": 0.45, "organization": 0.6, "address": 0.5, "medical condition": 0.5}
STRUCTURED = ("EMAIL", "TELEFONO", "DNI", "CUIT_CUIL", "CBU_CVU", "TARJETA", "PATENTE", "PASAPORTE", "IP", "CREDENCIAL", "FECHA_NACIMIENTO", "EDAD", "SALARIO", "DATO_SENSIBLE")
ABBREVIATIONS = "av avda dr dra sr sra srta lic ing arq prof pje bv nro dpto depto tel cel gral cnel pres ltda cia".split()
SENTENCE_END = (".", "!", "?", ";", "…")
STREET_START = r"(?iu)^(?:calle|av(?:da)?\.?|avenida|pasaje|pje\.?|ruta|bv\.?|boulevard|bulevar|diagonal|diag\.?)\s"
SOCIETY_WORD = r"(?i)^(?:s\.?a\.?u?|s\.?r\.?l|s\.?a\.?s|s\.?h|cv|de|del|y|e|la|el|los|las)\.?$"
STREET_NUMBER = r"\p{L}{2,}\.?\s+(?:n(?:ro|°|º)\.?\s*)?\d{1,5}\b"
NOT_ADDRESS_START = r"(?iu)^(?:legajo|cp|c\.p\.|c[oó]digo|sala|piso|oficina|of\.|lote|expediente|art[ií]culo|ruta)\b"
PLACES = (
    "argentina buenos aires caba capital federal catamarca chaco chubut cordoba corrientes entre rios formosa jujuy "
    "la pampa rioja mendoza misiones neuquen rio negro salta san juan luis santa cruz fe santiago del estero "
    "tierra fuego tucuman rosario mar plata bahia blanca parana resistencia posadas ushuaia"
).split()
DETERMINERS = "el la los las un una del al este esta nuestro nuestra su mi".split()
PRONOUNS = "le les lo se me te nos yo vos tu el ella ellos ellas usted ustedes nosotros quien que".split()
ROLES = (
    "empleado empleada trabajador trabajadora operario operaria usuario usuaria admin administrador administradora cliente clienta "
    "paciente senor senora sr sra jefe jefa gerente encargado encargada responsable titular firmante aclaracion firma "
    "doctor doctora dr dra lic licenciado licenciada ingeniero ingeniera contador contadora abogado abogada proveedor proveedora "
    "bearer token root invitado invitada equipo personal"
).split()
UNITS = (
    "compras ventas finanzas administracion contabilidad tesoreria logistica comercial marketing "
    "sistemas legales legal rrhh recursos humanos direccion gerencia area departamento sector sucursal planta "
    "deposito oficina equipo tablero directorio comite mesa ayuda soporte atencion cliente clientes de y e la el "
    "los las del general central regional"
).split()
PUBLIC_ORGS = (
    "google", "google drive", "gmail", "microsoft", "excel", "word", "outlook", "teams", "slack", "whatsapp", "zoom", "notion", "jira",
    "chatgpt", "openai", "claude", "anthropic", "copilot", "gemini", "stripe", "paypal", "visa", "mastercard", "american express", "amex",
    "mercado libre", "mercado pago", "tienda nube", "amazon", "apple", "meta", "facebook", "instagram", "linkedin", "afip", "arca", "anses",
    "osde", "swiss medical", "galeno", "pami", "banco nacion", "banco central", "bcra",
)
COLUMN_TYPES = ("NOMBRE_PERSONA", "RAZON_SOCIAL", "DIRECCION", "DATO_SENSIBLE")
SAMPLE_CELLS, MAX_TEXT_CELLS, COLUMN_RATIO, COVERED = 40, 2000, 0.6, 0.7


def implausible(s: Column, first_names: tuple[str, ...] = W.FIRST_NAMES) -> Column:
    """What a model marks although it is plainly no personal data: streets, places, roles, units, public bodies."""
    kind, value = s["type"], s["value"]
    society = lambda w: w.rlike(SOCIETY_WORD)
    low = lambda w: F.regexp_replace(fold(w), r"\.$", "")

    def test(all_: Column) -> Column:
        place = F.forall(all_, lambda w: low(w).isin(*PLACES) | society(w))
        rest = F.when(low(all_[0]).isin(*DETERMINERS), F.slice(all_, F.lit(2), F.size(all_))).otherwise(all_)
        roles = F.forall(rest, lambda w: low(w).isin(*ROLES, *UNITS))
        pronouns = F.forall(rest, lambda w: low(w).isin(*PRONOUNS)) | ((F.size(rest) == 1) & (F.length(rest[0]) <= 2))
        nameless = ~F.exists(rest, lambda w: w.rlike(r"^\p{Lu}") | low(w).isin(*first_names))
        public = F.regexp_replace(fold(value), "[.,]+$", "").isin(*PUBLIC_ORGS)
        generic = F.forall(all_, lambda w: low(w).isin(*DETERMINERS, *UNITS, *ROLES, *PLACES))
        both = kind.isin("NOMBRE_PERSONA", "RAZON_SOCIAL") & (value.rlike(STREET_START) | place)
        person = (kind == "NOMBRE_PERSONA") & ((F.size(rest) == 0) | roles | pronouns | nameless)
        company = (kind == "RAZON_SOCIAL") & (public | generic)
        address = (kind == "DIRECCION") & (F.trim(value).rlike(NOT_ADDRESS_START) | ~value.rlike(STREET_NUMBER))
        return both | person | company | address

    return F.coalesce(let(F.filter(F.split(value, r"[\s,/]+"), lambda w: w != ""), test), F.lit(False))


def rank(confidence: Column) -> Column:
    out = F.lit(0)
    for k, n in CONFIDENCE_RANK.items():
        out = F.when(confidence == k, n).otherwise(out)
    return out


def combine_spans(text: Column, rules: Column, model: Column) -> Column:
    """Spans of rules and model: structured types of the rules always stay; elsewhere the surer or the wider one wins."""
    plain = F.filter(model, lambda m: ~implausible(m) & ~is_protected(m["value"]))
    ordered = F.array_sort(F.transform(plain, lambda m, i: F.struct((-rank(m["confidence"])).alias("k"), i.alias("i"), m.alias("m"))))

    def step(accepted: Column, x: Column) -> Column:
        m = x["m"]
        own = F.struct(m["type"].alias("type"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["confidence"].alias("confidence"), F.lit("ia").alias("source"))

        def against(met: Column) -> Column:
            best = F.array_max(F.transform(met, lambda a: rank(a["confidence"])))
            covers = F.forall(met, lambda a: (m["start"] <= a["start"]) & (a["end"] <= m["end"]))
            wider = covers & F.exists(met, lambda a: a["end"] - a["start"] < m["end"] - m["start"])
            wins = (rank(m["confidence"]) > best) | (covers & (rank(m["confidence"]) >= best)) | wider
            blocked = F.exists(met, lambda a: a["type"].isin(*STRUCTURED))
            swapped = F.concat(F.filter(accepted, lambda a: ~overlaps(m, a)), F.array(own))
            return F.when(F.size(met) == 0, F.concat(accepted, F.array(own))).when(blocked | ~wins, accepted).otherwise(swapped)

        return let(F.filter(accepted, lambda a: overlaps(m, a)), against)

    return by_start(F.aggregate(ordered, rules.cast(SPANS), step))


class Runner(Protocol):
    """A model in a worker: tokens of a word, and scores [words, width, labels] of one window."""

    def encode_word(self, word: str) -> list[int]: ...

    def scores(self, prompt: list[list[int]], words: list[list[int]], labels: list[str], width: int) -> np.ndarray: ...


class BatchRunner(Runner, Protocol):
    """A model that scores several windows in one run; it pads them to the longest."""

    def scores_many(self, prompt: list[list[int]], windows: list[list[list[int]]], labels: list[str], width: int) -> list[np.ndarray]: ...


@dataclass(frozen=True)
class Config:
    max_tokens: int = 512
    max_words: int = 384
    max_width: int = 12
    #: Words to a window of sentences; 0: every sentence alone.
    window_words: int = 24
    overlap: int = 8
    #: Windows and padded tokens of one run, and results that a worker keeps.
    run_windows: int = 32
    run_tokens: int = 8192
    kept: int = 8192


WORD = r"[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|\S"


def _sentences(text: str, words: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    cuts = [0]
    for i in range(len(words) - 1):
        (w, start, end), (following, at, _) = words[i], words[i + 1]
        before = words[i - 1] if i else None
        short = before is not None and before[2] == start and (len(before[0]) <= 2 or before[0].lower() in ABBREVIATIONS)
        gap = text[end:at]
        if "\n" in gap or (w in SENTENCE_END and gap and following[0].isupper() and not short):
            cuts.append(i + 1)
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True) if b > a]


def windows(text: str, words: list[tuple[str, int, int]], sizes: list[int], budget: int, config: Config) -> list[tuple[int, int]]:
    """Ranges of words: sentences together up to the window, longer ones cut with an overlap."""
    limit = min(config.window_words or config.max_words, config.max_words)
    total = np.concatenate(([0], np.cumsum(sizes)))
    out: list[tuple[int, int]] = []
    for a, b in _sentences(text, words):
        joint = out and config.window_words and out[-1][1] == a and b - out[-1][0] <= limit and total[b] - total[out[-1][0]] <= budget
        if b - a <= limit and total[b] - total[a] <= budget:
            out[-1:] = [(out[-1][0], b)] if joint else [*out[-1:], (a, b)]
            continue
        while a < b:
            end = a
            while end < b and end - a < limit and total[end + 1] - total[a] <= budget:
                end += 1
            end = max(end, a + 1)
            out.append((a, end))
            if end >= b:
                break
            a = max(end - config.overlap, a + 1)
    return out


def decode(scores: np.ndarray, words: list[tuple[str, int, int]], first: int, labels: list[str], thresholds: dict[str, float]) -> list[tuple[float, int, int, str]]:
    p = 1 / (1 + np.exp(-scores))
    limit = np.array([thresholds.get(label, 0.5) for label in labels])
    n = len(scores)
    found = np.argwhere(p >= limit)
    return [(float(p[i, j, c]), words[first + i][1], words[first + i + j][2], labels[c]) for i, j, c in found if i + j < n]


def greedy(entities: list[tuple[float, int, int, str]]) -> list[tuple[float, int, int, str]]:
    out: list[tuple[float, int, int, str]] = []
    for e in sorted(entities, key=lambda e: -e[0]):
        if not any(e[1] < a[2] and a[1] < e[2] for a in out):
            out.append(e)
    return sorted(out, key=lambda e: e[1])


def confidence(score: float, threshold: float) -> str:
    return "alta" if score >= threshold + 0.3 else "media" if score >= threshold + 0.1 else "baja"


class Scores:
    """Scores of windows in a worker: equal windows are scored once, the others in runs of like length, whatever rows they
    are of. What is kept is bounded; the oldest go first."""

    def __init__(self, runner: Runner, prompt: list[list[int]], labels: list[str], config: Config) -> None:
        self.runner, self.prompt, self.labels, self.config = runner, prompt, labels, config
        self.known: dict[tuple[str, ...], np.ndarray] = {}

    def runs(self, sizes: list[int]) -> list[list[int]]:
        """Places of windows, by length, so many to a run as its windows and padded tokens allow."""
        fixed, out = sum(map(len, self.prompt)), []
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            longest = fixed + sizes[out[-1][0]] if out else 0
            if out and len(out[-1]) < self.config.run_windows and longest * (len(out[-1]) + 1) <= self.config.run_tokens:
                out[-1].append(k)
            else:
                out.append([k])
        return out

    def of(self, windows: dict[tuple[str, ...], list[list[int]]]) -> dict[tuple[str, ...], np.ndarray]:
        missing = [k for k in windows if k not in self.known]
        found = {k: self.known[k] for k in windows if k in self.known}
        many = getattr(self.runner, "scores_many", None)
        if many is None:
            found |= {k: self.runner.scores(self.prompt, windows[k], self.labels, self.config.max_width) for k in missing}
        else:
            for run in self.runs([sum(map(len, windows[k])) for k in missing]):
                some = [missing[k] for k in run]
                found |= zip(some, many(self.prompt, [windows[k] for k in some], self.labels, self.config.max_width), strict=True)
        for k in missing:
            self.known[k] = found[k]
        while len(self.known) > self.config.kept:
            del self.known[next(iter(self.known))]
        return found


def detect(df: DataFrame, factory: Callable[[], Runner], key: list[str], text: str = "text", thresholds: dict[str, float] = THRESHOLDS, config: Config = Config(), most_chars: int | None = 20_000) -> DataFrame:
    """(key..., spans) of a model. Windows of all texts of a batch are scored together: see ``Scores``. Texts over ``most_chars`` are left to the rules (null: no limit)."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key) + ", spans array<struct<type:string,start:int,end:int,value:string,confidence:string,source:string>>"
    labels = list(LABELS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        runner, split = factory(), regex.compile(WORD)
        prompt = [runner.encode_word(w) for label in labels for w in ("<<ENT>>", label)] + [runner.encode_word("<<SEP>>")]
        budget = config.max_tokens - sum(map(len, prompt)) - 2
        scores = Scores(runner, prompt, labels, config)
        for batch in batches:
            rows, wanted = [], {}
            for value in batch["sv_text"]:
                words = [(m.group(), m.start(), m.end()) for m in split.finditer(value)]
                ids = [runner.encode_word(w) for w, _, _ in words]
                cuts = list(windows(value, words, list(map(len, ids)), budget, config)) if words else []
                rows.append((value, words, [(a, tuple(w for w, _, _ in words[a:b])) for a, b in cuts]))
                wanted |= {name: ids[a : a + len(name)] for a, name in rows[-1][2]}
            scored, out = scores.of(wanted), []
            for value, words, cuts in rows:
                found = [x for a, name in cuts for x in decode(scored[name], words, a, labels, thresholds)]
                out.append([(LABELS[label], s, e, value[s:e], confidence(p, thresholds.get(label, 0.5)), "ia") for p, s, e, label in greedy(found)])
            yield batch[key].assign(spans=[[dict(zip(("type", "start", "end", "value", "confidence", "source"), x, strict=True)) for x in spans] for spans in out])

    fine = df.where(F.col(text).isNotNull() & (F.trim(text) != ""))
    if most_chars:
        fine = fine.where(F.length(text) <= most_chars)
    return fine.select(*key, F.col(text).alias("sv_text")).mapInPandas(run, schema)


def plan_columns(findings: list, stats: dict[int, dict], letters: dict[int, float]) -> dict[str, str]:
    """Column -> 'texto' (every cell is read) or 'muestra' (a sample decides its type); others are not read."""
    out = {}
    for f in findings:
        s = stats.get(f.index)
        if not s:
            continue
        free = s["avg_length"] >= 20 and s["spaced"] >= 0.5
        if f.kind != "columna" and s["avg_words"] >= 5 and (f.kind == "texto" or free):
            out[f.header] = "texto"
        elif (f.kind == "columna" and f.confidence == "baja" and f.type in COLUMN_TYPES) or (f.kind != "columna" and letters.get(f.index, 0) >= COLUMN_RATIO):
            out[f.header] = "muestra"
    return out


def sample_votes(sampled: DataFrame) -> DataFrame:
    """(column, value, spans) of a sample -> column, type, ratio: the type whose spans cover 70 % of a value in 60 %."""
    covered = sampled.select("column", "value", F.explode_outer(F.filter("spans", lambda s: s["type"].isin(*COLUMN_TYPES))).alias("s"))
    chars = covered.groupBy("column", "value", F.col("s.type").alias("type")).agg(F.sum(F.col("s.end") - F.col("s.start")).alias("n"))
    votes = chars.where(F.col("n") >= F.length(F.trim("value")) * COVERED).groupBy("column", "type").agg(F.count("*").alias("votes"))
    totals = sampled.groupBy("column").agg(F.count("*").alias("total"))
    best = votes.groupBy("column").agg(F.max_by(F.struct("type", "votes"), F.struct("votes", "type")).alias("b")).join(totals, "column")
    return best.select("column", F.col("b.type").alias("type"), (F.col("b.votes") / F.col("total")).alias("ratio")).where(F.col("ratio") >= COLUMN_RATIO)


def apply_verdicts(findings: list, plan: dict[str, str], votes: DataFrame, combined: DataFrame, filled: dict[str, int]) -> list:
    """``findings`` after the model has read what ``plan_columns`` chose.

    ``votes`` (column, type, ratio) come from ``sample_votes``: a column whose type was in doubt takes the model's, one
    that was taken for nothing becomes a typed column of all its ``filled`` cells. ``combined`` (column, row, spans) are
    the cells of text columns in which the model found something, with the rules' spans merged in: such a column is free
    text with these counts. What reaches the driver is a row per column and type.
    """
    from dataclasses import replace

    from ..functions.text import mask
    from ..types import PSEUDONYMIZE, TABLE_ACTIONS

    voted = {r["column"]: (r["type"], r["ratio"]) for r in votes.collect()}
    spans = combined.select("column", "row", F.explode("spans").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("row", F.col("s.start").alias("start"), mask(F.col("s.value")).alias("m"))))
    near = spans.groupBy("column").agg(F.min("row").alias("at")).join(spans, "column").where(F.col("row") <= F.col("at") + 100)  # not every span of a column
    firsts = near.groupBy("column").agg(F.transform(F.slice(ordered, 1, 3), lambda x: x["m"]).alias("examples"))
    examples = {r["column"]: tuple(r["examples"]) for r in firsts.collect()}
    counts: dict[str, dict[str, int]] = {}
    for r in spans.groupBy("column", "s.type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").collect():
        counts.setdefault(r["column"], {})[r["type"]] = r["n"]
    out = []
    for f in findings:
        mode, column = plan.get(f.header), f.header
        if mode == "texto" and column in counts:
            own = counts[column]
            f = replace(f, kind="texto", type=None, confidence="media", count=sum(own.values()), text_counts=own, examples=examples[column], action=PSEUDONYMIZE, reason="model_in_text")
        elif mode == "muestra" and column in voted:
            kind, ratio = voted[column]
            count = f.count if f.kind == "columna" else filled.get(column, 0)
            f = replace(f, kind="columna", type=kind, confidence="media", ratio=ratio, count=count, action=TABLE_ACTIONS[kind], reason="model_confirms" if f.kind == "columna" else "model")
        out.append(f)
    return out
