"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum over all
its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The probabilities are
learnt from labelled texts by expectation maximisation over the same segmentations. Words are scored in batches of one
length, each distinct word once per Python worker.

Training takes at most about ``max_docs`` labelled documents, chosen by a hash of their text: that bound is a documented
parameter; repeated texts count once, and words over ``LONGEST`` characters are learnt from in parts. Scoring reads every
whole text and sums over all segmentations of every word, however long: short words by batches of one length, the others,
such as texts in scripts without spaces, one by one with sums that are scaled as they grow.

Defined cases: a null text or one without a letter is ``und`` with score 0; without labelled rows every text is; repeated
rows are scored alike; an empty table gives no rows; ties go to the language first in code point order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize
from .tokens import public_path

VOCABULARY = "piece_bpe_32k.model"
#: Characters of the longest words that are scored by batches, with the mark of their start.
LONGEST = 32
MAX_DOCS, ROUNDS, SMOOTHING = 6000, 3, 0.05
#: Languages whose shares travel to every task.
MOST_LANGUAGES = 10_000
#: Probability of a character that no piece covers, in every language; a power that keeps products in range.
UNKNOWN, LIFT = 1e-7, 40.0
MARK = "▁"
_LETTER = re.compile(r"[^\W\d_]")


def words_of(text: str) -> Counter:
    """Counts of a text's lower-case words."""
    return Counter(text.lower().split())


def parts_of(text: str) -> Counter:
    """The same with long words in parts."""
    counts = words_of(text)
    for w in [w for w in counts if len(w) > LONGEST - 1]:
        n = counts.pop(w)
        for k in range(0, len(w), LONGEST - 1):
            counts[w[k : k + LONGEST - 1]] += n
    return counts


class Lattice:
    """Finds the pieces of words by a rolling hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.size = len(pieces)
        usable = {p: i for i, p in enumerate(pieces) if p and not (p.startswith("<") and p.endswith(">")) and MARK not in p[1:]}
        self.pieces, self.longest = usable, max(map(len, usable))
        self.factor = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.array([1, *[self.factor] * (max(LONGEST, self.longest) + 1)], np.uint64), dtype=np.uint64)
            hashes = np.array([self._prefix(self._codes([p]))[0, -1] for p in usable], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(usable.values()), np.int32)[order]

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)

    def _prefix(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * self.factor + codes[:, j]
        return out

    def edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """Words of one length, with the mark -> (start, end, piece id of each word or -1; ``size`` for a lone character
        that is no piece)."""
        with np.errstate(over="ignore"):
            prefix = self._prefix(self._codes(words))
            for j in range(1, prefix.shape[1]):
                for i in range(max(0, j - self.longest), j):
                    h = prefix[:, j] - prefix[:, i] * self.powers[j - i]
                    at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                    yield i, j, np.where(self.hashes[at] == h, self.ids[at], self.size if j - i == 1 else -1)

    def forward(self, words: list[str], probs: np.ndarray) -> tuple[np.ndarray, list]:
        """probs: (pieces + 2, languages), the last row zero, lifted by LIFT a character. -> alpha (length + 1, words, languages)."""
        n, k = len(words[0]), probs.shape[1]
        alpha = np.zeros((n + 1, len(words), k))
        alpha[0] = 1
        kept = []
        for i, j, ids in self.edges(words):
            alpha[j] += alpha[i] * (probs[ids] * LIFT ** (j - i))
            kept.append((i, j, ids))
        return alpha, kept

    def _long(self, word: str, probs: np.ndarray) -> np.ndarray:
        """The log-likelihoods of one word with its mark. Only the last sums are held, and brought back to one as they go."""
        sizes = range(1, self.longest + 1)
        lifted = [LIFT**n for n in range(self.longest + 1)]
        last = [np.ones(probs.shape[1])]
        logs = np.zeros(probs.shape[1])
        for j in range(1, len(word) + 1):
            now = np.zeros(probs.shape[1])
            for n in sizes:
                if n > len(last):
                    break
                piece = self.pieces.get(word[j - n : j], self.size if n == 1 else None)
                if piece is not None:
                    now = now + last[-n] * (probs[piece] * lifted[n])
            last.append(now)
            if j % 16 == 0:
                last = [x / now for x in last[-self.longest :]]
                logs += np.log(now)
        return logs + np.log(last[-1]) - len(word) * np.log(LIFT)

    def log_likelihood(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """(words, languages); words may differ in length."""
        out = np.zeros((len(words), probs.shape[1]))
        for n, some in _by_length(words).items():
            if n >= LONGEST:
                out[some] = [self._long(MARK + words[i], probs) for i in some]
                continue
            for k in range(0, len(some), 8192):
                part = some[k : k + 8192]
                alpha, _ = self.forward([MARK + words[i] for i in part], probs)
                out[part] = np.log(alpha[-1]) - (n + 1) * np.log(LIFT)
        return out

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece under one language's probabilities (pieces + 2, 1)."""
        total = np.zeros(self.size + 1)
        for _n, some in _by_length(words).items():
            for k in range(0, len(some), 8192):
                part = some[k : k + 8192]
                alpha, kept = self.forward([MARK + words[i] for i in part], probs)
                beta = np.zeros(alpha.shape[:2])
                beta[-1] = counts[part] / alpha[-1][:, 0]
                for i, j, ids in reversed(kept):
                    weight = probs[ids, 0] * LIFT ** (j - i) * beta[j]
                    beta[i] += weight
                    found = ids >= 0
                    np.add.at(total, ids[found], (alpha[i][:, 0] * weight)[found])
        return total


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


@lru_cache(maxsize=2)
def lattice(path: str | None = None) -> Lattice:
    return Lattice(path or public_path(VOCABULARY))


def _padded(probs: np.ndarray) -> np.ndarray:
    """With the row that id -1 reads."""
    return np.vstack([probs, np.zeros((1, probs.shape[1]))])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            by: dict[str, Counter] = {}
            for lang, text in zip(*(batch.column(c).slice(at, 500).to_pylist() for c in (0, 1)), strict=True):
                by.setdefault(lang, Counter()).update(parts_of(text or ""))
            rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "word", "n"])


def _expect(langs: list[str], probs: np.ndarray, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path)
        for batch in batches:
            kinds, words, counts = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float)
            for k, lang in enumerate(langs):
                mine = np.flatnonzero(kinds == lang)
                if len(mine):
                    total = lat.expected([words[i] for i in mine], counts[mine], _padded(probs[:, k : k + 1]))
                    ids = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(ids), pa.int32()), pa.array(ids, pa.int32()), pa.array(total[ids])], names=["k", "piece", "n"])

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and the probabilities (pieces + 1, languages). What reaches the driver is bounded by vocabulary times
    languages."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # The bound is shared by the languages: a rare one is learned from all its texts. A text counts once, however often it is there.
    texts = [(r[0], r[1]) for r in known.groupBy(F.col(lang)).agg(F.approx_count_distinct(F.xxhash64(text)).alias("n")).orderBy("n", lang).collect()]
    share, left = {}, max_docs
    for k, (name, n) in enumerate(texts):
        share[name] = min(1.0, left / (len(texts) - k) / max(n, 1))
        left -= min(n, left // (len(texts) - k))
    parts = known.sparkSession.createDataFrame([(name, int(x * (1 << 30))) for name, x in share.items()], "sv_lang string, sv_part long")
    drawn = F.pmod(F.xxhash64(F.lit(13), F.col(text)), F.lit(1 << 30)) < F.col("sv_part")
    if len(share) <= MOST_LANGUAGES:  # their number is checked; more are joined by a shuffle
        parts = F.broadcast(parts)
    known = known.select(F.col(lang), F.col(text)).join(parts, F.col(lang) == F.col("sv_lang")).where(drawn).select(lang, text).distinct()
    counts = materialize(known.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    lat = lattice(path)
    probs = np.full((lat.size + 1, len(langs)), 1 / lat.size)
    probs[-1] = UNKNOWN
    for _ in range(rounds if langs else 0):
        sums = np.full_like(probs, SMOOTHING)
        found = counts.mapInArrow(_expect(langs, probs, path), "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n"))
        for r in found.collect():
            sums[r.piece, r.k] += r.n
        sums[-1] = 0
        probs = sums / sums.sum(0)
        probs[-1] = UNKNOWN
    drop_materialized(counts)
    return langs, probs


class Scorer:
    """Log-likelihoods of texts by language, with a bounded cache of words."""

    def __init__(self, lat: Lattice, probs: np.ndarray, most: int = 500_000):
        self.lat, self.probs, self.most = lat, _padded(probs), most
        self.place: dict[str, int] = {}
        self.characters = 0
        self.rows = np.zeros((1024, probs.shape[1]))

    def learn(self, texts: list[Counter]) -> None:
        if len(self.place) > self.most or self.characters > 64 * self.most:
            self.place.clear()
            self.characters = 0
        fresh = list({w for c in texts for w in c if w not in self.place})
        if not fresh:
            return
        self.characters += sum(map(len, fresh))
        start = len(self.place)
        if start + len(fresh) > len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros((start + len(fresh), self.rows.shape[1]))])
        self.rows[start : start + len(fresh)] = self.lat.log_likelihood(fresh, self.probs)
        self.place.update(zip(fresh, range(start, start + len(fresh)), strict=True))

    def __call__(self, counts: Counter) -> np.ndarray:
        at = np.fromiter(map(self.place.__getitem__, counts), np.int64, len(counts))
        return np.fromiter(counts.values(), float, len(counts)) @ self.rows[at]


def _predict(langs: list[str], probs: np.ndarray, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(lattice(path), probs)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t if t and _LETTER.search(t) else None for t in part.column(1).to_pylist()]
                counts = [words_of(t) if t and langs else Counter() for t in texts]
                score.learn(counts)
                best, share = [], []
                for c in counts:
                    if not c:
                        best.append("und")
                        share.append(0.0)
                        continue
                    logs = score(c)
                    k = int(np.argmax(logs))
                    best.append(langs[k])
                    share.append(float(1 / np.exp(logs - logs[k]).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(share, pa.float64())], names=["key", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: key, lang_pred, score (the share of the likelihood that the language has)."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_predict(*model, path), f"key {kind}, lang_pred string, score double")
