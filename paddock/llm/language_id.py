"""Language identification by hierarchical discrimination.

A text is first given a language family, then one of the family's languages.
Both steps use linear support vector machines on hashed 1- to 4-grams of bytes
of the normalised text (relative frequencies, square-rooted, so every text is a
vector of length 1): one against the rest for families, one against one for
the languages within a family, where the most votes win.

Only text and language of the learning rows are used.  At most about
``MAX_PER_LANGUAGE`` hash-sampled texts of each language are learnt from; their
vectors (whole texts) are counted in tasks and the machines fitted on the
driver with numpy.  Prediction is a narrow pass over whole texts.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0.
NULL languages are not learnt from.  A language code that FAMILIES lacks is a
family of its own.  One known language: it is always predicted.  None: ``und``.
Ties go to the smaller name.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import remainder, unit_hash, with_computed
from paddock.llm.decontaminate import normal_bytes

MAX_PER_LANGUAGE = 800
MAX_SAMPLE = 16_000
BITS = 12
GRAMS = (1, 2, 3, 4)
ROUNDS, RIDGE = 150, 1e-4
PIECE = 1 << 20

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language.lower().split("-")[0] in members), language)


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of hashed byte n-grams of the normal form."""
    counts = np.zeros(1 << BITS, dtype=np.int64)
    raw = (text or "").replace("\0", " ").encode("utf-8", "surrogatepass")
    for at in range(0, len(raw), PIECE):
        x = normal_bytes(b" " + raw[at:at + PIECE] + b" ").astype(np.uint64)
        value = np.zeros(len(x), dtype=np.uint64)
        for n in GRAMS:
            if len(x) >= n:
                value = (value[:len(x) - n + 1] << np.uint64(8)) | x[n - 1:]
                slot = (value + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
                counts += np.bincount(slot.astype(np.int64), minlength=1 << BITS)
    return counts


def vectors(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def fit_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine for labels +1 and -1 (classes weighted
    equally), by accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = prev = np.zeros(x.shape[1] + 1)
    for t in range(ROUNDS):
        z = w + (t / (t + 3)) * (w - prev)
        slack = np.maximum(0, 1 - y * (x @ z[:-1].astype(np.float32) + z[-1]))
        pull = (weight * slack * y).astype(np.float32)
        grad = np.append(RIDGE * z[:-1] - 2 * (pull @ x), -2 * pull.sum())
        # Vectors have length 1, so the loss has curvature of at most 2 * (1 + 1).
        w, prev = z - grad / (4 + RIDGE), w
    return w[:-1], float(w[-1])


@dataclass
class LanguageModel:
    families: dict[str, list[str]]
    weights: np.ndarray                 # [n-gram slot, machine]
    offsets: np.ndarray
    family_at: dict[str, int]           # machine of a family
    pair_at: dict[tuple[str, str], int]  # machine of a pair of languages; positive: the first

    def predict(self, counts: np.ndarray) -> tuple[list[str], list[float]]:
        margin = vectors(counts) @ self.weights + self.offsets
        sure = 1 / (1 + np.exp(-2 * np.clip(margin, -15, 15)))
        names = sorted(self.families)
        if len(names) > 1:
            by_family = np.stack([margin[:, self.family_at[f]] for f in names], axis=1)
            best = by_family.argmax(axis=1)
            score = sure[:, [self.family_at[f] for f in names]][np.arange(len(counts)), best]
        else:
            best, score = np.zeros(len(counts), np.int64), np.ones(len(counts))
        out, scores = [""] * len(counts), np.array(score, dtype=float)
        for k, f in enumerate(names):
            rows = np.flatnonzero(best == k)
            members = sorted(self.families[f])
            votes, least = np.zeros((len(rows), len(members))), np.ones((len(rows), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    p = sure[rows, self.pair_at[a, members[j]]]
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
            won = votes.argmax(axis=1)
            for r, m in zip(rows, won, strict=True):
                out[r] = members[m]
            scores[rows] *= least[np.arange(len(rows)), won]
        return out, scores.tolist()


def fit(languages: list[str], counts: np.ndarray) -> LanguageModel:
    x, lang = vectors(counts), np.array(languages, dtype=object)
    families: dict[str, list[str]] = {}
    for name in sorted(set(languages)):
        families.setdefault(family_of(name), []).append(name)
    family = np.array([family_of(n) for n in languages], dtype=object)
    machines, family_at, pair_at = [], {}, {}
    for f in sorted(families) if len(families) > 1 else ():
        family_at[f] = len(machines)
        machines.append(fit_svm(x, np.where(family == f, 1.0, -1.0)))
    for members in families.values():
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                of = (lang == a) | (lang == b)
                pair_at[a, b] = len(machines)
                machines.append(fit_svm(x[of], np.where(lang[of] == a, 1.0, -1.0)))
    weights = np.stack([w for w, _ in machines], axis=1) if machines else np.zeros((counts.shape[1], 0))
    return LanguageModel(families, weights.astype(np.float32), np.array([b for _, b in machines]), family_at, pair_at)


def learn_languages(docs: DataFrame, per_language: int = MAX_PER_LANGUAGE, skip: int = 2) -> LanguageModel:
    """Machines from documents whose crc32 remainder modulo 4 is not ``skip``:
    about ``per_language`` texts of each language, ``MAX_SAMPLE`` of all together
    (16 kB each on the driver), at most twice as many where ids repeat."""
    rows = docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 4) != skip)).select("doc_id", "lang", "text")
    share = F.lit(0.0)
    known = rows.groupBy("lang").count().collect()          # one row for each language
    per_language = min(per_language, max(1, MAX_SAMPLE // max(1, len(known))))
    for r in known:
        share = F.when(F.col("lang") == r["lang"], F.lit(per_language / r["count"])).otherwise(share)
    sample = rows.where(unit_hash(F.col("doc_id"), seed=4) < share)

    def measure(texts: list[str | None]) -> list:
        return [[zlib.compress(gram_counts(t).astype("<u4").tobytes(), 1) if has_letter(t) else None for t in texts]]

    got = with_computed(sample, ["lang"], "text", measure, "grams binary").where("grams IS NOT NULL").limit(2 * MAX_SAMPLE).toPandas()
    counts = np.zeros((len(got), 1 << BITS), dtype=np.float32)
    for i, g in enumerate(got["grams"]):
        counts[i] = np.frombuffer(zlib.decompress(g), dtype="<u4")
    order = sorted(range(len(got)), key=lambda i: (got["lang"][i], bytes(got["grams"][i])))   # rows come in any order
    return fit([got["lang"][i] for i in order], counts[order])


def languages(docs: DataFrame, model: LanguageModel, skip: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""

    def predict(texts: list[str | None]) -> list:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if has_letter(t)] if model.families else []
        for at in range(0, len(todo), 256):
            part = todo[at:at + 256]
            for i, name, score in zip(part, *model.predict(np.stack([gram_counts(texts[i]) for i in part])), strict=True):
                names[i], scores[i] = name, score
        return [names, scores]

    held = docs.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == skip, F.lit(False)))
    return with_computed(held, ["doc_id", "held_out"], "text", predict, "lang_pred string, score double")
