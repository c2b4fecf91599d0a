"""Packing texts into training sequences: vector bin packing with the dot-product heuristic.

A text of more than one sequence gives full pieces, as far as the limit of loss-bearing tokens allows; its rest is an item with three demands: tokens, one segment, and
loss-bearing tokens. Items are dealt into buckets by a hash of their key, a bounded number to each; in a bucket the
open sequence takes the item that fits and whose demand has the largest dot product with the room that is left,
weighed by each resource's share of all demand. When no item fits, the largest is cut to fill the room.

Defined cases: a null text is empty and gives one piece, the end mark; rows with equal ids are separate texts; ties go
to the earlier key, then the longer item; an empty table gives no rows; extra columns are ignored. Without a column of
loss-bearing tokens every token bears loss; a null in it counts as all, and more than a text has as all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import word_tokenizer


@dataclass(frozen=True)
class Limits:
    """Room of one sequence."""

    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096


#: Items to a bucket, on average.
BUCKET_ITEMS = 2048


def place(tokens: np.ndarray, loss: np.ndarray, limits: Limits = Limits()) -> list[list[tuple[int, int, int]]]:
    """Items in a fixed order -> sequences of pieces (item, first token, tokens). An item's loss-bearing tokens are its
    last ones, so a cut piece carries those that lie in it."""
    room_of = np.array([limits.tokens, limits.segments, limits.loss], float)
    start, left = np.zeros(len(tokens), np.int64), tokens.astype(np.int64).copy()
    quiet = left - loss  # leading tokens without loss
    bearing = lambda s, n: np.maximum(0, s + n - np.maximum(s, quiet))
    share = np.array([tokens.sum() / room_of[0], len(tokens) / room_of[1], loss.sum() / room_of[2]])
    share = share / max(share.sum(), 1e-9)
    open_, out = left > 0, []
    while open_.any():
        room, seq = room_of.copy(), []
        while room[0] > 0 and room[1] > 0:
            live = np.flatnonzero(open_)
            if not len(live):
                break
            need = np.stack([left[live], np.ones(len(live), np.int64), bearing(start, left)[live]])
            fits = (need <= room[:, None]).all(0)
            if fits.any():
                score = (share * room / room_of / room_of) @ need
                k = int(live[np.argmax(np.where(fits, score, -1.0))])
                n = int(left[k])
            else:  # cut the largest: as much of it as tokens and loss allow
                k = int(live[np.argmax(left[live])])
                n = int(min(left[k], room[0], room[2] + max(0, quiet[k] - start[k])))
                if n == 0:
                    break
            seq.append((k, int(start[k]), n))
            room -= (n, 1, int(max(0, start[k] + n - max(start[k], quiet[k]))))
            start[k] += n
            left[k] -= n
            open_[k] = left[k] > 0
        out.append(seq)
    return out


def _encode(end_id: int, limits: Limits, name: str, path: str | None):
    size = limits.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(name, path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, crcs, rests, losses = [], [], [], []
                for text, loss in zip(part.column(2), part.column(3), strict=True):
                    ids = np.append(tok.encode(text.as_py()), np.uint32(end_id)).astype("<u4", copy=False)
                    bears = len(ids) if loss.as_py() is None else max(0, min(loss.as_py(), len(ids)))
                    # a full piece of tokens that bear loss must not exceed that limit; ``place`` cuts what would
                    full = (len(ids) if limits.loss >= size else len(ids) - bears) // size
                    counts.append(len(ids))
                    losses.append(bears)
                    crcs.append([zlib.crc32(ids[k * size : (k + 1) * size].tobytes()) for k in range(full)])
                    rest = ids[full * size :]
                    rests.append((rest.astype("<u2") if tok.size <= 1 << 16 else rest).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary()), pa.array(losses, pa.int64())], names=["bucket", "key", "n", "crcs", "rest", "loss"])

    return run


def _pack(limits: Limits, wide: bool):
    def run(table: pa.Table) -> pa.Table:
        key_type = table.schema.field("key").type
        # a fixed order, so reruns agree
        rows = sorted(zip(table["bucket"].to_pylist(), table["key"].to_pylist(), table["n"].to_pylist(), table["crcs"].to_pylist(), table["rest"].to_pylist(), table["loss"].to_pylist(), strict=True), key=lambda r: (r[1] is None, r[1] if r[1] is not None else 0, *r[2:]))
        base, out = rows[0][0] << 32, []
        bearing = lambda start, n, total, loss: max(0, start + n - max(start, total - loss))
        for _, key, n, crcs, _rest, loss in rows:
            for k, crc in enumerate(crcs):
                out.append((key, k * limits.tokens, limits.tokens, crc, n, base, 0, bearing(k * limits.tokens, limits.tokens, n, loss)))
                base += 1
        items = [(key, n, len(crcs) * limits.tokens, np.frombuffer(rest, "<u4" if wide else "<u2").astype("<u4"), loss) for _, key, n, crcs, rest, loss in rows]
        sizes = np.array([len(x[3]) for x in items], np.int64)
        for seq in place(sizes, np.minimum(sizes, np.array([x[4] for x in items], np.int64)), limits):
            offset = 0
            for k, first, n in seq:
                key, total, start, ids, loss = items[k]
                out.append((key, start + first, n, zlib.crc32(ids[first : first + n].tobytes()), total, base, offset, bearing(start + first, n, total, loss)))
                offset += n
            base += 1
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_length"])

    return run


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits(), end_id: int = 2, name: str = "word_bpe_49k.json", path: str | None = None, loss: str | None = None,
) -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_length (tokens of the piece that bear
    loss). ``loss`` names a column with the number of a text's last tokens, the end mark included, that bear loss: in
    instruction data those of the answer. Tokens travel as two bytes each, full pieces only as their checksum. Every
    sequence keeps all three limits, whatever a text's length."""
    kind = docs.schema[key].dataType.simpleString()
    buckets = max(1, -(-docs.count() // BUCKET_ITEMS))
    bearing = F.col(loss).cast("long") if loss else F.lit(None).cast("long")
    dealt = docs.select(F.pmod(F.xxhash64(F.col(key), F.xxhash64(F.col(text))), F.lit(buckets)).alias("bucket"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"), bearing.alias("loss"))
    items = dealt.mapInArrow(_encode(end_id, limits, name, path), f"bucket long, key {kind}, n long, crcs array<long>, rest binary, loss long")
    wide = word_tokenizer(name, path).size > 1 << 16
    return items.groupBy("bucket").applyInArrow(_pack(limits, wide), f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_length long")
