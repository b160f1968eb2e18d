"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a seed and its code point. An n-gram of
three letters binds them: the vectors are rotated by their place and multiplied. A document bundles
(adds) its n-gram vectors; a language's prototype bundles those of all documents labelled with it, in
whole numbers, so that sums don't depend on their order. A document gets the language whose prototype has the largest cosine with it.

All labelled documents given to ``train`` are used. What comes back to the driver is one vector for
each language: ``max_languages`` x ``dim`` numbers at most, checked before it is collected.

Defined results: a text that is null or has no letter gets ``und`` and score 0; ties go to the
language first in order; null languages are not learned; with nothing learned every text is ``und``; texts of
any length are read whole; ids may be null or repeat, each input row gives one output row; an empty table gives an
empty one; extra columns are ignored, or with ``keep`` given back under their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache, enter

DIM, SEED, UNDETERMINED = 1024, 20, "und"
#: N-gram vectors a worker keeps.
KEPT = 60_000


def letter_table() -> np.ndarray:
    """By code point: the lower-case letter's code point, or 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Profiles:
    """Document vectors; holds the n-gram vectors met so far."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed, self.letters = dim, seed, letter_table()
        self.known: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dim), np.int8)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.known:
            self.known[c] = np.random.default_rng((self.seed, c)).integers(0, 2, self.dim).astype(np.int8) * 2 - 1
        return self.known[c]

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the table for n-gram codes, bound now if new."""
        rows = self.rows
        if len(rows) + len(grams) > KEPT:
            rows.clear()
            self.known.clear()
        out = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            if (r := rows.get(g, -1)) < 0:
                r = rows[g] = len(rows)
                if r >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                a, b, c = g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF
                self.table[r] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            out[i] = r
        return out

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-gram codes and the text each is of. Runs of other characters become one mark; a text begins and ends with one."""
        lengths = np.array([len(t) + 1 for t in texts])
        x = self.letters[np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        x = np.concatenate([[0, 0], x, [0, 0]]).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), lengths)
        of = np.concatenate([[0, 0], of[:-1], [len(texts) - 1] * 2])
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        x, of = x[keep], of[keep]
        middle = np.flatnonzero(x[1:-1])
        return x[middle] << 42 | x[middle + 1] << 21 | x[middle + 2], of[middle + 1]

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text: the bundle of its n-grams, zero without letters; and how many letters it has."""
        out = np.zeros((len(texts), self.dim), np.float32)
        grams, of = self.grams(texts)
        distinct, at = np.unique(grams, return_inverse=True)
        counts = np.bincount(of * len(distinct) + at, minlength=len(texts) * len(distinct)).reshape(len(texts), -1).astype(np.float32)
        for i in range(0, len(distinct), 8192):
            rows = self.places(distinct[i : i + 8192])
            out += counts[:, i : i + 8192] @ self.table[rows].astype(np.float32)
        return out, np.bincount(of, minlength=len(texts))

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim, np.int64)
        for i in range(0, len(grams), 8192):
            rows = self.places(grams[i : i + 8192])
            out += (counts[i : i + 8192] @ self.table[rows].astype(np.float64)).astype(np.int64)  # whole numbers under 2**53: exact
        return out


def chunks(texts: list[str], most: int = 64, chars: int = 300_000):
    """Slices of at most so many texts, of about so many characters or one text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < most and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


_PROFILES: dict = cache("langid")


def profiles(dim: int, seed: int) -> Profiles:
    if (dim, seed) not in _PROFILES:
        _PROFILES[dim, seed] = Profiles(dim, seed)
    return _PROFILES[dim, seed]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = SEED, max_languages: int = 1000) -> dict:
    """Prototypes {language: unit vector} from all rows of labelled that have a language and letters."""

    def run(batches):
        enter("langid")
        p = profiles(dim, seed)
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            sums: dict[str, np.ndarray] = {}
            for lang in sorted(set(langs)):
                own = [t for t, l in zip(texts, langs, strict=True) if l == lang]
                for i, j in chunks(own, 4096, 2_000_000):
                    grams, counts = np.unique(p.grams(own[i:j])[0], return_counts=True)
                    sums[lang] = sums.get(lang, 0) + p.bundle(grams, counts)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    parts = rows.mapInArrow(run, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = summed.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    found = vectors.limit(max_languages + 1).toArrow()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    out = {lang: np.array(v.values.to_numpy(), np.float64) for lang, v in zip(found["lang"].to_pylist(), found["v"], strict=True)}
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(out.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict, id_col: str = "doc_id", text_col: str = "text", dim: int = DIM, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, lang_pred, score: the cosine with the predicted language, 0 to 1; letters: how many."""
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), dim).astype(np.float32)

    def run(batches):
        enter("langid")
        p = profiles(dim, seed)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            langs, scores, letters = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for i, j in chunks(texts) if names else ():
                v, letters[i:j] = p.vectors(texts[i:j])
                norm = np.linalg.norm(v, axis=1)
                cosines = np.round(v @ matrix.T / np.where(norm, norm, 1)[:, None], 6)
                best = np.argmax(cosines, axis=1)
                for k in np.flatnonzero(norm):
                    langs[i + k], scores[i + k] = names[best[k]], min(1.0, max(0.0, float(cosines[k, best[k]])))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters)], [*b.schema.names[1:], "lang_pred", "score", "letters"])

    src = docs.select(F.col(text_col).alias("__text"), F.col(id_col).alias("doc_id"), *[c for c in keep if c != "doc_id"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, f"{fields}, lang_pred string, score double, letters long")


#: Letters from which a score tells anything, and (letters, least score) between which the least score grows. 10,000
#: documents in learned languages scored 0.10 and more from 20 letters on and 0.23 from 200 on; long texts of other
#: languages of the same script some 0.05 to 0.14.
TOO_SHORT, LEAST = 20, ((50, 0.05), (200, 0.15))


def of_known_language(docs: DataFrame, prototypes: dict) -> DataFrame:
    """docs without those that have no letters, and those long enough to tell that are unlike every learned language."""
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(docs.columns)])
    at = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    found = identify(renamed, prototypes, at["doc_id"], at["text"], keep=tuple(renamed.columns))
    (few, low), (many, high) = LEAST
    slope = low + (F.col("letters") - few) * ((high - low) / (many - few))
    least = F.when(F.col("letters") < TOO_SHORT, 0.0).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), slope)))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*[F.col(at[c]).alias(c) for c in docs.columns])
