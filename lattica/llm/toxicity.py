"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding maps look-alike letters of other scripts, accented letters, and digits or signs used
as letters onto plain letters. The lexicon (word stems) and its weights are learned from
labelled rows. Hits inside an exception phrase don't count. A document's score is a logistic
function of its weighted hits, as a sum and normalised by length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

# Letters that look like plain ones, as Unicode's data on confusable characters has them.
HOMOGLYPHS = str.maketrans({
    "а": "a", "е": "e", "ё": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ӏ": "l", "г": "r", "к": "k", "м": "m", "н": "h", "т": "t", "в": "b", "п": "n", "и": "u", "ь": "b", "ѵ": "v", "ү": "y", "ґ": "r", "ԍ": "g", "є": "e",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "β": "b", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ա": "w", "ք": "p",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "ʏ": "y", "ɪ": "i", "ʀ": "r", "ɴ": "n", "ʙ": "b", "ʜ": "h", "ʟ": "l", "ɢ": "g", "ᴀ": "a", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ᴊ": "j", "ᴋ": "k", "ᴍ": "m", "ᴏ": "o", "ᴘ": "p", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    "ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ł": "l", "ŧ": "t", "þ": "p", "ß": "b", "µ": "u", "ƒ": "f", "ɓ": "b", "ɖ": "d", "ɨ": "i", "ɵ": "o", "ʉ": "u", "ƅ": "b", "ʂ": "s", "ʐ": "z",
})
# Digits and signs written for letters.
DIGITS = str.maketrans("0134578@$!|", "oieastbasil")
#: Benign phrases with a word that may be in a lexicon; fit() learns more.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "sore loser")
SPACED = re.compile(r"[^\w@$!|]+|_+")
STEMS = range(3, 11)  # letters of the stems considered besides whole words


def fold(text: str | None) -> list[str]:
    """The text as lower-cased words of plain letters, one space before and after each; as a
    second reading, if that differs, with accents dropped as well."""
    if not text:
        return [" "]
    out = []
    for form in ("NFKC", "NFKD"):
        plain = unicodedata.normalize(form, text.lower())
        if form == "NFKD" and not plain.isascii():
            plain = "".join(c for c in plain if not unicodedata.combining(c))
        words = (w.strip("!|") for w in SPACED.split(plain.translate(HOMOGLYPHS)))
        out.append(" " + "".join((w if w.isalpha() or not any(c.isalpha() for c in w) else w.translate(DIGITS)) + " " for w in words if w))
        if text.isascii():
            break
    return out if out[0] != out[-1] else out[:1]


def _terms(readings: list[str]) -> set[str]:
    out: set[str] = set()
    for w in {w for folded in readings for w in folded.split()}:
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in STEMS if n < len(w))
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for at in batches:
        held = (Counter(), Counter())
        for text, label in zip(at["text"], at["toxic"], strict=True):
            held[int(label)].update(_terms(fold(text)))
        clean, toxic = held
        terms = list(clean | toxic)
        if terms:
            yield pd.DataFrame({"term": terms, "toxic": [toxic[x] for x in terms], "clean": [clean[x] for x in terms]})


def _count_pairs(held):
    """Two words in a row of which one is a hit of the lexicon, by label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon: Lexicon = held.value
        for at in batches:
            found = (Counter(), Counter())
            for text, label in zip(at["text"], at["toxic"], strict=True):
                pairs: set[str] = set()
                for folded in fold(text):
                    words = folded.split()
                    hit = [lexicon.has_hit(f" {w} ") for w in words]
                    pairs.update(f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y)
                found[int(label)].update(pairs)
            clean, toxic = found
            terms = list(clean | toxic)
            if terms:
                yield pd.DataFrame({"term": terms, "toxic": [toxic[x] for x in terms], "clean": [clean[x] for x in terms]})

    return run


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...], curve: np.ndarray) -> None:
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, w in self.weights.items():
                self._automaton.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
            self._automaton.make_automaton()
        return self._automaton

    def _hits(self, folded: str) -> float:
        at: dict[int, float] = {}
        spared: set[int] = set()
        for end, (size, w) in self.automaton.iter(folded) if len(self.automaton) else ():
            start = end - size + 1
            if w is None:
                spared.update(range(start, end))
            else:
                at[start] = max(w, at.get(start, 0.0))
        return sum(w for start, w in at.items() if start not in spared)

    def has_hit(self, folded: str) -> bool:
        return len(self.automaton) > 0 and any(w is not None for _, (_, w) in self.automaton.iter(folded))

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Weighted hits, weighted hits a hundred words, and whether there are any. Of the
        terms that match at one place the heaviest counts, of the readings the worst."""
        readings = fold(text)
        total = max(map(self._hits, readings))
        n_words = max(1, readings[0].count(" ") - 1)
        return np.log1p(total), np.log1p(100 * total / n_words), float(total > 0)

    def score(self, text: str | None) -> float:
        z = float(self.curve[0] + self.curve[1:] @ np.asarray(self.features(text)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at in batches:
            x = np.array([held.value.features(t) for t in at["text"]]).reshape(-1, 3)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "toxic": at["toxic"].to_numpy()})

    return run


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 1e-2
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge @ beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, g)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> Lexicon:
    """docs (doc_id, text), labels (doc_id, toxic 0/1) -> Lexicon.

    Learns from a sample: of each class the `per_class` labels of least hash of the doc_id,
    with texts that repeat taken once (toxic if any of their labels says so); so what is sent
    to the driver is bounded by the frequent terms of 2 * per_class texts and as many triples of
    numbers. A pair of words with a hit in it that is surely in clean texts becomes an exception.
    Null labels are ignored. Without rows of both classes the lexicon is empty and every score
    the share of toxic rows.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    nothing = Lexicon({}, EXCEPTIONS, np.array([np.log(share / (1 - share)), 0, 0, 0]))
    if len(sizes) < 2:
        return nothing
    one = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    sample = one(0).unionByName(one(1))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null")
    train = cut(texts.groupBy("text").agg(F.max("toxic").alias("toxic")))
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return nothing
    sums = train.mapInPandas(_count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    sure = odds - 2.0 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    # a sure lower bound of the log odds; each hit must make toxic the likelier label by itself
    rows = sums.where(F.col("t") >= max(3, 0.002 * n[1])).withColumn("sure", sure).withColumn("odds", odds).where("sure > 1.0").collect()
    weights: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):
        shorter = [weights[r["term"][:k]] for k in range(1, len(r["term"])) if r["term"][:k] in weights]
        if not shorter or r["odds"] > max(shorter) + 0.7:
            weights[r["term"]] = float(r["odds"])
    bare = spark.sparkContext.broadcast(Lexicon(weights, EXCEPTIONS, np.zeros(4)))
    pairs = train.mapInPandas(_count_pairs(bare), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    clean = odds + 2.0 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    benign = [r["term"] for r in pairs.where((F.col("c") >= max(3, 0.002 * n[0])) & (clean < -1.0)).collect()]
    exceptions = tuple(sorted({*EXCEPTIONS, *benign}))
    rough = spark.sparkContext.broadcast(Lexicon(weights, exceptions, np.zeros(4)))
    x = train.mapInPandas(_features(rough), "a double, b double, c double, toxic int").toPandas()
    y = x["toxic"].to_numpy(float)
    weight = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    curve = _logistic(x[["a", "b", "c"]].to_numpy(), y, weight * len(y) / weight.sum())
    return Lexicon(weights, exceptions, curve)


def _score(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for at in batches:
            yield pd.DataFrame({"doc_id": at["doc_id"], "score": [held.value.score(t) for t in at["text"]]})

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, score 0..1, predicted), a row for each input row.

    predicted is 1 from a score of 0.5. Null and empty texts have no hits and get the
    lexicon's base score. Null doc_ids and repeated rows pass through; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    out = docs.select("doc_id", "text").mapInPandas(_score(held), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
