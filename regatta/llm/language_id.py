"""Language identification in two levels: the family first, then the language within it.

Texts are counts of hashed letter n-grams. One linear support vector machine for each family against
all others picks the family; within a family one machine for every pair of languages votes, and the
language with the most votes wins (summed margins part equal votes). All machines are fitted on a
bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regatta.llm.common import crc32_of_id, uniform

UNKNOWN = "und"
# Branches of language families, by ISO 639-1 code; a language of no listed branch is its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "indic": "hi ur bn mr gu pa ne si",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz ky tk",
}
BRANCH = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

# Hash places for each n-gram length, and the lengths.
PLACES, ORDERS = 4096, (1, 2, 3)
WIDTH = PLACES * len(ORDERS)
# Labelled documents per language that the machines are fitted on, at most.
SAMPLE_PER_LANGUAGE = 300
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2
# Documents whose score is below this are rejected where languages filter. A score of 0.5 means that the
# family's own machine (or, with one family only, the likeness to its labelled texts) is as sure as this
# share of what all but a few labelled texts reach whose machines were fitted without them.
MIN_SCORE = 0.5
FLOOR_SHARE, FLOOR_QUANTILE = 0.8, 0.005
# Words of the texts that the floor is set by, and how many of them there must be for one to be set.
FLOOR_WORDS, FLOOR_TEXTS = 50, 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 12)
_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Root of the shares of hashed n-grams, of length one; ``None`` for a text without letters."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return None
    # Everything that is no letter is one blank between words, and one before and after the text.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
    code = np.concatenate([np.array([32], np.uint64), code, np.array([32], np.uint64)])
    out = np.empty(WIDTH)
    gram = code
    for n, order in enumerate(ORDERS):
        if n:
            gram = gram[:-1] * np.uint64(0x110000) + code[order - 1:]
        place = ((gram + np.uint64(order)) * _MIX >> _SHIFT).astype(np.int64)
        counts = np.bincount(place, minlength=PLACES)
        out[n * PLACES: (n + 1) * PLACES] = np.sqrt(counts / max(1, len(place)))
    return out / np.sqrt(len(ORDERS))


def fit_machine(gram: np.ndarray, sign: np.ndarray, cost: float = 10.0, sweeps: int = 40) -> np.ndarray:
    """Dual weights of a linear machine (squared hinge), by coordinate steps on the Gram matrix."""
    weight, score = np.zeros(len(sign)), np.zeros(len(sign))
    steps = 1.0 / (np.diag(gram) + 1.0 + 0.5 / cost)
    order = np.random.default_rng(5)
    for _ in range(sweeps):
        largest = 0.0
        for i in order.permutation(len(sign)):
            slope = sign[i] * score[i] - 1.0 + 0.5 / cost * weight[i]
            new = max(0.0, weight[i] - slope * steps[i])
            change = new - weight[i]
            if change:
                weight[i] = new
                # The bias is one more coordinate that is always one.
                score += change * sign[i] * (gram[i] + 1.0)
                largest = max(largest, abs(change))
        if largest < 1e-4:
            break
    return weight * sign


@dataclass
class LanguageModel:
    """Families, their languages, and a weight column with a bias for every machine."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, 0), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))
    # Mean direction of the labelled texts of every language, and the least margin of a known text.
    means: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH), np.float32))
    floor: float = -np.inf

    def family_margin(self, grams: np.ndarray, margins: list[float]) -> float:
        """How far the chosen family's machine is on its own side; with one family, the likeness to it."""
        if len(self.families) > 1:
            return max(margins[: len(self.families)])
        return float((self.means @ grams.astype(np.float32)).max())

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = gram_counts(text)
        if grams is None or not self.families:
            return UNKNOWN, 0.0
        margins = (grams.astype(np.float32) @ self.weights + self.biases).tolist()
        at = len(self.families) if len(self.families) > 1 else 0
        best = self.families[int(np.argmax(margins[:at]))] if at else self.families[0]
        sure = _logistic(self.family_margin(grams, margins) - self.floor)
        for family in self.families:
            names = self.languages[family]
            pairs = list(combinations(names, 2))
            if family == best:
                votes = dict.fromkeys(names, 0)
                sums = dict.fromkeys(names, 0.0)
                for (a, b), m in zip(pairs, margins[at:]):
                    votes[a if m >= 0 else b] += 1
                    sums[a] += m
                    sums[b] -= m
                order = sorted(names, key=lambda x: (-votes[x], -sums[x], x))
                if len(order) > 1:
                    a, b = sorted(order[:2])
                    sure = min(sure, _logistic(abs(margins[at + pairs.index((a, b))])))
                return order[0], sure
            at += len(pairs)
        return UNKNOWN, 0.0


def _logistic(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-2.0 * margin)))


def fit_model(texts: list[str], langs: list[str]) -> LanguageModel:
    rows = [(g, lang) for t, lang in zip(texts, langs) if (g := gram_counts(t)) is not None]
    if not rows:
        return LanguageModel()
    points = np.stack([g for g, _ in rows]).astype(np.float32)
    lang = np.array([x for _, x in rows], object)
    family = np.array([BRANCH.get(x, x) for x in lang], object)
    gram = (points @ points.T).astype(float)
    families = sorted(set(family))
    languages = {f: sorted(set(lang[family == f])) for f in families}
    tasks: list[tuple[np.ndarray, np.ndarray]] = []
    if len(families) > 1:
        tasks += [(np.arange(len(lang)), np.where(family == f, 1.0, -1.0)) for f in families]
    for f in families:
        for a, b in combinations(languages[f], 2):
            own = np.flatnonzero((lang == a) | (lang == b))
            tasks.append((own, np.where(lang[own] == a, 1.0, -1.0)))
    weights, biases = [], []
    for own, sign in tasks:
        dual = fit_machine(gram[np.ix_(own, own)], sign)
        weights.append(dual @ points[own])
        biases.append(dual.sum())
    columns = np.stack(weights, axis=1) if weights else np.zeros((WIDTH, 0))
    means = np.stack([points[lang == x].mean(axis=0) for x in sorted(set(lang))])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    return LanguageModel(families, languages, columns.astype(np.float32), np.array(biases), means)


def known_floor(texts: list[str], langs: list[str]) -> float:
    """The margin below which a text is in no known language; each half is judged by the other's machines."""
    reached = []
    for half in (0, 1):
        model = fit_model(texts[half::2], langs[half::2])
        for text in texts[1 - half:: 2]:
            grams = gram_counts(text)
            if grams is not None and model.families and len(text.split()) >= FLOOR_WORDS:
                margins = (grams.astype(np.float32) @ model.weights + model.biases).tolist()
                reached.append(model.family_margin(grams, margins))
    if len(reached) < FLOOR_TEXTS:
        return -np.inf
    return max(0.0, FLOOR_SHARE * float(np.quantile(reached, FLOOR_QUANTILE)))


def is_held_out(doc_id: Column) -> Column:
    """The fixed fold nobody learns from; a row without an id is not in it, nor learned from."""
    rest = F.pmod(crc32_of_id(doc_id), F.lit(HELD_OUT_MODULUS))
    return F.coalesce(rest == HELD_OUT_REMAINDER, F.lit(False))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` documents of each language, the first in hash order."""
    known = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel()
    # Twice the wanted rows by hash, so that about enough are there; then the first of them.
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items()
                            for x in (lang, min(1.0, 2.0 * per_language / n))])
    order = uniform(F.col("doc_id"), seed="language")
    sample = known.where(order < shares[F.col("lang")]).select(
        "lang", "text", "doc_id", order.alias("order")
    ).toPandas().sort_values(["lang", "order", "doc_id", "text"])
    sample = sample.groupby("lang", sort=True).head(per_language)
    texts, langs = sample["text"].tolist(), sample["lang"].tolist()
    model = fit_model(texts, langs)
    model.floor = known_floor(texts, langs)
    return model


def predictor(spark, model: LanguageModel):
    """A column function of the text; the model, of bounded size, goes to every executor once."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())
    ]))
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(map(shared.value.predict, texts), columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``docs`` with ``_llm_pred`` and ``_llm_score``; null texts and texts without a letter are ``und``.

    Repeated rows get equal answers, null ids are allowed, an empty table (or one without labels to
    learn from) gives no rows (or only ``und``). The model reads the text alone.
    """
    model = train(docs) if model is None else model
    found = predictor(docs.sparkSession, model)(F.col("text"))
    return docs.withColumn("_llm_lang", found).withColumns({
        "_llm_pred": F.col("_llm_lang")["lang_pred"], "_llm_score": F.col("_llm_lang")["score"]
    }).drop("_llm_lang")


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is told: not ``und``, and with a score of ``min_score``."""
    found = identify(docs)
    told = (F.col("_llm_pred") != UNKNOWN) & (F.col("_llm_score") >= min_score)
    return found.where(told).select(*docs.columns)
