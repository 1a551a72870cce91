"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of character n-grams within words (a word is padded, so its beginning and end count),
stored as ascending arrays of n-gram hashes with the interpolated log probability of each n-gram, and of context
hashes with the log weight of the next lower order. A text goes to the language with the lowest cross-entropy per
character; it is rejected if that is worse than what the language's own calibration texts of such length reach.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows

#: Characters of an n-gram; texts that train and texts that calibrate, for each language, about (chosen by a hash).
ORDER, TRAINED_ON, CALIBRATED_ON = 5, 1500, 1500
#: Share of a language's own texts that calibration lets be rejected; by what each limit is raised, and by what where
#: there are too few texts to show such a share.
REJECTED, SLACK, SLACK_OF_FEW = 0.002, 1.25, 1.7
#: Letters from which on a text is of the next length class.
LENGTHS = (40, 200, 1000)
#: How sharply the score falls with the nats a character that another language is behind.
SHARPNESS = 4.0
#: Each character has at least this probability by its own, as one of about so many.
_ALPHABET = 4096

_WORD = re.compile(r"[^\W\d_]+")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of ORDER character codes for each character of each padded word, and each word's number of rows."""
    pad = ORDER - 1
    text = np.frombuffer("".join("\1" * pad + w + "\2" for w in words).encode("utf-32-le"), np.uint32)
    size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    begin = np.cumsum(size + pad) - size - pad
    at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    return text[at[:, None] + np.arange(ORDER)], size


_TIMES = windows._mixed(np.arange(101, 101 + ORDER, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h += codes[:, k] * _TIMES[k]
    return windows._mixed(h)


class Model:
    """Kneser-Ney over counted n-grams of the full order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """grams: distinct rows of ORDER codes; counts: how often each occurs."""
        self.keys, self.logs, self.contexts, self.weights = [], [], [], []
        lower_key, lower_p = None, None
        for n in range(1, ORDER + 1):
            rows, c = self._level(grams, counts, n)
            ones, twos = int((c == 1).sum()), int((c == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context = _hashes(rows[:, :-1])
            ckeys, which, kinds = np.unique(context, return_inverse=True, return_counts=True)
            total = np.bincount(which, c)
            weight = discount * kinds / total
            if n == 1:
                below = np.full(len(rows), 1 / _ALPHABET)
            else:
                below = lower_p[np.searchsorted(lower_key, _hashes(rows[:, 1:]))]
            p = (c - discount) / total[which] + weight[which] * below
            key = _hashes(rows)
            order = np.argsort(key)
            lower_key, lower_p = key[order], p[order]
            self.keys.append(lower_key)
            self.logs.append(np.log(lower_p).astype(np.float32))
            self.contexts.append(ckeys)
            self.weights.append(np.log(weight).astype(np.float32))

    @staticmethod
    def _level(grams, counts, n):
        """Of the full order the counts; below, in how many ways each n-gram continues."""
        if n == ORDER:
            return grams, counts.astype(float)
        longer = np.unique(grams[:, ORDER - n - 1 :], axis=0)
        rows, c = np.unique(longer[:, 1:], axis=0, return_counts=True)
        return rows, c.astype(float)

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last character of each row after the others."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        for n in range(ORDER, 0, -1):
            if not len(left):
                return out
            rows = codes[left, ORDER - n :]
            h = _hashes(rows)
            at = np.minimum(np.searchsorted(self.keys[n - 1], h), len(self.keys[n - 1]) - 1)
            found = self.keys[n - 1][at] == h
            out[left[found]] += self.logs[n - 1][at[found]]
            left, rows = left[~found], rows[~found]
            h = _hashes(rows[:, :-1])
            at = np.minimum(np.searchsorted(self.contexts[n - 1], h), len(self.contexts[n - 1]) - 1)
            known = self.contexts[n - 1][at] == h
            out[left[known]] += self.weights[n - 1][at[known]]
        out[left] -= math.log(_ALPHABET)
        return out


class Identifier:
    def __init__(self, models: dict[str, Model]):
        self.langs = sorted(models)
        self.models = [models[x] for x in self.langs]
        self.limits: dict[tuple[str, int], float] = {}
        self.name = uuid.uuid4().hex


class _Scorer:
    """Scores n-grams and words once and keeps them; texts are sums over their words."""

    def __init__(self, identifier: Identifier):
        self.models = identifier.models
        self.clear()

    def clear(self):
        self.places: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.models) + 1))
        self.grams, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(self.models)))

    def _scores(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of each row by each model; those of n-grams that came before are looked up."""
        grams, first, which = np.unique(_hashes(codes), return_index=True, return_inverse=True)
        at = np.searchsorted(self.grams, grams)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == grams if len(self.grams) else np.zeros(len(grams), bool)
        if not known.all():
            new = codes[first[~known]]
            keys = np.r_[self.grams, grams[~known]]
            order = np.argsort(keys)
            self.grams, self.scores = keys[order], np.r_[self.scores, np.stack([m.log_p(new) for m in self.models], axis=1)][order]
            at = np.searchsorted(self.grams, grams)
        return self.scores[at][which]

    def add(self, words):
        if len(self.places) + len(words) > 400_000 or len(self.grams) > 1_000_000:
            self.clear()
        new = [w for w in words if w not in self.places]
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            codes, size = _codes(some)
            begin = np.cumsum(size) - size
            n = len(self.places)
            while len(self.table) < n + len(some):
                self.table = np.r_[self.table, np.zeros_like(self.table)]
            self.table[n : n + len(some), :-1] = np.add.reduceat(self._scores(codes), begin)
            self.table[n : n + len(some), -1] = size
            self.places.update(zip(some, range(n, n + len(some))))

    def ready(self, texts, together: int = 1 << 20):
        """The words of each text; the new words of about so many characters of text are scored at once."""
        held, size = [], 0
        for text in texts:
            text = text.as_py()
            held.append(Counter(_words(text)))
            size += len(text or "")
            if size >= together:
                yield from self._known(held)
                held, size = [], 0
        yield from self._known(held)

    def _known(self, held: list[Counter]):
        if self.models:
            self.add(set().union(*held))
        return held

    def sums(self, counts: Counter) -> np.ndarray:
        self.add([w for w in counts if w not in self.places])
        if len(counts) > 300_000:  # more than are kept
            out = np.zeros(len(self.models) + 1)
            items = list(counts.items())
            for i in range(0, len(items), 100_000):
                self.clear()
                self.add([w for w, _ in items[i : i + 100_000]])
                out += sum(self.table[self.places[w]] * c for w, c in items[i : i + 100_000])
            return out
        at = np.fromiter((self.places[w] for w in counts), np.int64, len(counts))
        return np.fromiter(counts.values(), np.float64, len(counts)) @ self.table[at]


def _words(text: str | None) -> list[str]:
    """Runs of letters, which are what str.isalpha says: re's word characters also hold numbers that are no digits."""
    words = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


_KEPT: dict = {}


def _scored(sent, with_text: bool):
    def scored(batches):
        identifier = sent.value
        if identifier.name not in _KEPT:
            _KEPT.clear()
            _KEPT[identifier.name] = _Scorer(identifier)
        scorer = _KEPT[identifier.name]
        for batch in batches:
            out = []
            for words in scorer.ready(batch.column("text")):
                if not words or not identifier.langs:
                    out.append(("und", 0.0, None, 0, True))
                    continue
                sums = scorer.sums(words)
                entropy = -sums[:-1] / sums[-1]
                k = int(entropy.argmin())
                score = 1 / np.exp(-SHARPNESS * (entropy - entropy[k])).sum()
                letters = int(sums[-1]) - words.total()
                limit = identifier.limits.get((identifier.langs[k], _length_class(letters)), math.inf)
                out.append((identifier.langs[k], float(score), float(entropy[k]), letters, bool(entropy[k] > limit)))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
            own = ["row", "text"] if with_text else ["row"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in own), *(pa.array(c, t) for c, t in zip(cols, kinds))], [*own, "lang_pred", "score", "entropy", "n_letters", "rejected"])

    return scored


def _length_class(letters: int) -> int:
    return sum(letters >= x for x in LENGTHS)


def _grams(batches):
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            counts.setdefault(lang, Counter()).update(_words(text.as_py()))
        for lang, words in counts.items():
            if not words:
                continue
            codes, size = _codes(list(words))
            weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), size)
            grams, which = np.unique(codes, axis=0, return_inverse=True)
            n = np.bincount(which.ravel(), weight).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(n)], ["lang", "gram", "n"])


def _apply(rows: DataFrame, sent, with_text: bool = False) -> DataFrame:
    common.bounded_batches(rows.sparkSession)
    kind = rows.schema["row"].dataType.simpleString() + ", text string" * with_text
    return rows.mapInArrow(_scored(sent, with_text), f"row {kind}, lang_pred string, score double, entropy double, n_letters long, rejected boolean")


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang"):
    """A sent identifier, learned from the rows of labelled with a lang.

    Of each language about TRAINED_ON texts (whole, chosen by a hash of the key) are counted on the executors and their
    n-grams are fitted here, so the model is bounded by that sample; about CALIBRATED_ON others set the limits
    for rejection, by length class, as conformal quantiles. Rows with a null lang or text are left out.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(key).alias("did"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of"))
    place = F.pmod(F.xxhash64("did", F.lit("language")), F.lit(1 << 30)) / F.lit(1 << 30)
    placed = rows.join(common.small_side(sizes, 1000), "lang").withColumn("place", place * F.col("of"))
    least = F.least(F.lit(TRAINED_ON), F.ceil(F.col("of") / 2))
    sample = placed.where(F.col("place") < least).select("lang", "text")
    counted = sample.mapInArrow(_grams, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    models = {}
    langs = np.array(counted.column("lang").to_pylist(), object)
    for x in sorted(set(langs.tolist())):
        mine = counted.filter(pa.array(langs == x))
        grams = np.frombuffer(b"".join(mine.column("gram").to_pylist()), np.uint32).reshape(-1, ORDER)
        models[x] = Model(grams, mine.column("n").to_numpy())
    identifier = Identifier(models)
    first = spark.sparkContext.broadcast(identifier)
    rest = placed.where((F.col("place") >= least) & (F.col("place") < least + CALIBRATED_ON)).select(F.struct("lang").alias("row"), "text")
    held = _apply(rest, first).where("entropy is not null and lang_pred = row.lang").select("row.lang", "n_letters", "entropy").toArrow()
    groups: dict[tuple[str, int], list[float]] = {}
    for x, n, e in zip(*(c.to_pylist() for c in held.columns)):
        groups.setdefault((x, _length_class(n)), []).append(e)
    for group, e in groups.items():
        rank = math.ceil((len(e) + 1) * (1 - REJECTED))
        identifier.limits[group] = sorted(e)[rank - 1] * SLACK if rank <= len(e) else max(e) * SLACK_OF_FEW
    return spark.sparkContext.broadcast(identifier)


def identify(docs: DataFrame, sent, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of each text: a row (key, lang_pred, score, entropy, n_letters, rejected) for each row of docs.

    lang_pred is a learned language, or und (rejected, score 0) if the text is null or has no letter or nothing was
    learned; score is the model's confidence in it, 0 to 1; entropy the cross-entropy in nats a character; rejected
    whether that is above the calibrated limit. Letters are what str.isalpha says. Of languages with equal cross-entropy the
    first by name is taken. Repeated rows, null keys and very long texts are like any others; other columns are ignored;
    an empty table gives an empty result. One pass, no shuffle.
    """
    out = _apply(docs.select(F.struct(F.col(key).alias("did")).alias("row"), F.col(text).alias("text")), sent)
    return out.select(F.col("row.did").alias(key), "lang_pred", "score", "entropy", "n_letters", "rejected")


def keep_identified(docs: DataFrame, sent, text: str = "text") -> DataFrame:
    """docs, same columns, without the rows whose language is rejected."""
    return common.together(_apply(common.apart(docs, text), sent, True).where("not rejected"), docs.columns, text)
