"""Stateful operators: a conversation's pseudonyms, rate limits anchored at the first hit, replay guards.

State is kept per key by Spark and checkpointed with the query; a lost executor resumes from it. The same functions run
on a static DataFrame through ``applyInPandas``, which is how batch results are compared.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()


class Registry:
    """One conversation's numbering; ``rows`` is all its state: [prefix, key, pseudonym, words]."""

    def __init__(self, rows: list | None = None):
        self.rows, self.by_key, self.by_word, self.sizes = [], {}, {}, {}
        for r in rows or []:
            self._add(r)

    def _add(self, row: list) -> None:
        prefix, key, pseudonym, words = row
        self.rows.append(row)
        self.by_key.setdefault((prefix, key), pseudonym)
        self.sizes[prefix] = self.sizes.get(prefix, 0) + 1
        if len(words) > 1:
            for w in set(words):
                self.by_word.setdefault((prefix, w), []).append(pseudonym)

    @staticmethod
    def key(kind: str, raw: str) -> str:
        digits = re.sub("[^0-9]", "", raw)
        if kind in ("DNI", "CUIT_CUIL", "CBU_CVU", "TARJETA", "TELEFONO") and len(digits) >= 6:
            return digits
        if kind in ("PATENTE", "PASAPORTE"):
            return re.sub(r"[\s-]", "", raw).upper()
        return " ".join(re.sub(r"[_\-/]+", " ", re.sub(r"[.,;:'\"()]", "", _fold(raw))).split())

    def name(self, prefix: str, kind: str, raw: str) -> str:
        key = self.key(kind, raw)
        found = self.by_key.get((prefix, key))
        words = re.findall(r"[^\W\d_]+", _fold(raw)) if kind == "NOMBRE_PERSONA" else []
        if found is None and len(words) == 1 and len(words[0]) >= 4:
            full = self.by_word.get((prefix, words[0]), [])
            found = full[0] if len(full) == 1 else None
        if found is None:
            found = f"{prefix}_{self.sizes.get(prefix, 0) + 1:02d}"
            self._add([prefix, key, found, words])
        return found


def _replace(text: str, spans: list, registry: Registry) -> str:
    out, pos = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        new = registry.name(s["prefix"], s["type"], s["value"]) if s["prefix"] else s["token"]
        out += [text[pos : s["start"]], new]
        pos = s["end"]
    return "".join([*out, text[pos:]])


CHAT_SCHEMA = "conv_id long, turn long, protected string"


def _timeout(idle_seconds: float | None) -> str:
    """State is kept for ever, or until a key was idle. A stream that drains its input and ends can't wait for idle keys."""
    return GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout


def protect_chat(turns: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """A stream (conv_id, turn, text, spans) -> (conv_id, turn, protected) with one registry per conversation.

    ``spans`` hold start, end, type, value, prefix and token. Rows of one micro-batch are taken in the order of turns; a
    turn that comes in a later batch is numbered after what came before.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        registry = Registry(json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("turn")
        out = [(key[0], r.turn, None if r.text is None else _replace(r.text, r.spans, registry)) for r in rows.itertuples()]
        state.update((json.dumps(registry.rows),))
        if idle_seconds:
            state.setTimeoutDuration(int(idle_seconds * 1000))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "protected"])

    return turns.groupBy("conv_id").applyInPandasWithState(run, CHAT_SCHEMA, "registry string", "append", _timeout(idle_seconds))


def allow_hits(hits: pd.DataFrame, start: float | None, used: int, most: int, width: float) -> tuple[list[bool], float | None, int]:
    """Times in order -> which are allowed. A window begins with the first hit after the last one ended."""
    out = []
    for t in hits["ts"].astype("datetime64[us]").astype("int64") / 1e6:
        if start is None or t >= start + width:
            start, used = t, 0
        used += 1
        out.append(used <= most)
    return out, start, used


def rate_limit(hits: DataFrame, most: int, seconds: float, idle_seconds: float | None = None) -> DataFrame:
    """A stream (key, ts) -> (key, ts, allowed)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        allowed, start, used = allow_hits(rows, start, used, most, seconds)
        state.update((start, used))
        if idle_seconds:
            state.setTimeoutDuration(int(idle_seconds * 1000))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "allowed": allowed})

    kind = hits.schema["key"].dataType.simpleString()
    return hits.groupBy("key").applyInPandasWithState(run, f"key {kind}, ts timestamp, allowed boolean", "start double, used int", "append", _timeout(idle_seconds))


def replay_guard(steps: DataFrame) -> DataFrame:
    """A stream (key, step) -> (key, step, accepted): only steps greater than the last accepted one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows, out = pd.concat(list(batches)), []
        for step in rows["step"]:
            out.append(last is None or step > last)
            last = step if out[-1] else last
        state.update((last,))
        yield pd.DataFrame({"key": key[0], "step": rows["step"].to_numpy(), "accepted": out})

    kind = steps.schema["key"].dataType.simpleString()
    return steps.groupBy("key").applyInPandasWithState(run, f"key {kind}, step long, accepted boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def rate_limit_bounded(hits: DataFrame, most: int, seconds: float, most_keys: int = 10_000, shards: int = 8) -> DataFrame:
    """A stream (key, ts) -> (key, ts, allowed) with a bounded state: keys are dealt into shards, each of which holds its
    part of ``most_keys``. Windows that have ended are swept; a new key that finds its shard full is refused."""
    room = max(1, most_keys // shards)

    def run(shard: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (a, n) for k, a, n in json.loads(state.get[0])} if state.exists else {}
        rows, out = pd.concat(list(batches)).sort_values("ts"), []
        for key, t in zip(rows["key"], rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, strict=True):
            if key not in held and len(held) >= room:
                held = {k: (a, n) for k, (a, n) in held.items() if t < a + seconds}
            if key not in held and len(held) >= room:
                out.append(False)
                continue
            start, used = held.get(key, (t, 0))
            if t >= start + seconds:
                start, used = t, 0
            held[key] = (start, used + 1)
            out.append(used + 1 <= most)
        state.update((json.dumps([[k, a, n] for k, (a, n) in held.items()]),))
        yield pd.DataFrame({"key": rows["key"].to_numpy(), "ts": rows["ts"].to_numpy(), "allowed": out})

    kind = hits.schema["key"].dataType.simpleString()
    dealt = hits.withColumn("sv_shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("sv_shard").applyInPandasWithState(run, f"key {kind}, ts timestamp, allowed boolean", "held string", "append", GroupStateTimeout.NoTimeout)


def revoked_tokens(events: DataFrame, ttl_seconds: float) -> DataFrame:
    """A stream (token, ts, revoke: boolean) -> (token, ts, valid) of the uses: a token is refused from its revocation on,
    until it would have ended anyway; then its state goes."""

    def run(token: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        rows, out = pd.concat(list(batches)).sort_values("ts"), []
        for ts, t, revoke in zip(rows["ts"], rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, rows["revoke"], strict=True):
            if since is not None and t >= since + ttl_seconds:
                since = None
            if revoke:
                since = t if since is None else since
            else:
                out.append((token[0], ts, since is None))
        if since is not None:
            state.update((since,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["token", "ts", "valid"])

    kind = events.schema["token"].dataType.simpleString()
    return events.groupBy("token").applyInPandasWithState(run, f"token {kind}, ts timestamp, valid boolean", "since double", "append", GroupStateTimeout.NoTimeout)
