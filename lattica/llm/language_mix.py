"""Language identification as a mixture: each document's language proportions by EM.

A language is a distribution over hashed letter n-grams (1 to 3 letters, words padded by a
space). A document is a mixture of languages; EM estimates the proportions, and the set of
languages is the one of least penalised likelihood  -2 log L + penalty * size * log(n): starting from
all, languages of little weight go together if that improves it, else the one of least weight alone,
until neither does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches

BUCKETS = 1 << 15  # hashed n-grams for each order
ORDERS = 3
ROUNDS = 12  # EM steps for each set of languages
CHUNK = 1 << 16  # letters hashed at once


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of a whole text's n-grams; empty without letters. Long texts are
    hashed piece by piece, so memory doesn't follow their length."""
    total: dict[int, int] | None = None
    found = [np.empty(0, np.int64), np.empty(0, np.int64)]
    for at in range(0, len(text or ""), CHUNK):
        piece = text[max(0, at - ORDERS + 1) : at + CHUNK].lower()
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate([[32], np.where(_letters()[points], points, 32), [32]]).astype(np.uint64)
        is_letter = points != 32
        if not is_letter.any():
            continue
        key, out = np.zeros(len(points), np.uint64), []
        for n in range(1, ORDERS + 1):
            key = key[: len(points) - n + 1] * np.uint64(0x110000) + points[n - 1 :]
            use = is_letter if n == 1 else is_letter[n - 2 : len(points) - 1]  # a letter before the last place
            out.append((mix(key[use]) % np.uint64(BUCKETS)).astype(np.int64) + (n - 1) * BUCKETS)
        bucket, count = np.unique(np.concatenate(out), return_counts=True)
        if total is None and not len(found[0]):
            found = [bucket, count]
        else:
            total = total or dict(zip(*(x.tolist() for x in found), strict=True))
            for b, c in zip(bucket.tolist(), count.tolist(), strict=True):
                total[b] = total.get(b, 0) + c
    if total is not None:
        found = [np.fromiter(total.keys(), np.int64), np.fromiter(total.values(), np.int64)]
    return found[0], found[1]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial n-gram counts for each language of a task's sample."""
    held: dict[str, np.ndarray] = {}
    for at in batches:
        for text, lang in zip(at["text"], at["lang"], strict=True):
            bucket, count = grams(text)
            if len(bucket):
                held.setdefault(lang, np.zeros(ORDERS * BUCKETS, np.int64))[bucket] += count
    for lang, all_counts in held.items():
        bucket = np.flatnonzero(all_counts)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": all_counts[bucket]})


class Model:
    """languages; p [ORDERS * BUCKETS, languages] float32: n-gram probabilities, over the largest
    of their row (a factor that all sets of languages share)."""

    def __init__(self, languages: list[str], p: np.ndarray) -> None:
        self.languages, self.p = languages, p


def fit(train: DataFrame, per_language: int = 3000) -> Model:
    """train (text, lang), null lang ignored -> Model.

    The fit uses a sample: of each language about `per_language` distinct texts of least hash, by a
    threshold on the hash; repeated texts count once. The model has 3 * BUCKETS rows and a column for each
    language, whatever the input's size.
    """
    train = train.select("text", "lang", F.xxhash64("text").alias("h")).where("lang is not null and text is not null")
    sizes = train.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")).alias("share"))
    sample = train.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    once = sample.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = once.select("text", "lang").mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return Model([], np.zeros((ORDERS * BUCKETS, 0), np.float32))
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((ORDERS * BUCKETS, len(languages)))
    counts[rows["bucket"].to_numpy(), np.searchsorted(languages, rows["lang"].to_numpy(str))] = rows["n"]
    by_order = counts.reshape(ORDERS, BUCKETS, -1) + 0.05
    p = (by_order / by_order.sum(axis=1, keepdims=True)).reshape(ORDERS * BUCKETS, -1)
    return Model(languages, (p / p.max(axis=1, keepdims=True)).astype(np.float32))


def proportions(weight: np.ndarray, p: np.ndarray, pi: np.ndarray, rounds: int) -> np.ndarray:
    """EM: pi after `rounds` steps from pi; p [n-grams, languages], weight of each n-gram."""
    n = weight.sum()
    for _ in range(rounds if len(pi) > 1 else 0):
        joint = p * pi
        pi = weight @ (joint / joint.sum(axis=1, keepdims=True)) / n
    return pi


def mixture(count: np.ndarray, p: np.ndarray, penalty: float) -> np.ndarray:
    """Language proportions of one document (zeros: not in the chosen set)."""
    weight = count / ORDERS  # the orders see the same letters
    n, of_size = weight.sum(), penalty * np.log(weight.sum() + 1)

    def tried(alive: np.ndarray, pi: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        q = p[:, alive]
        pi = proportions(weight, q, pi / pi.sum(), ROUNDS)
        return -2 * float(weight @ np.log(np.maximum(q @ pi, 1e-300))) + of_size * len(alive), alive, pi

    best = tried(np.arange(p.shape[1]), np.full(p.shape[1], 1.0))
    while len(best[1]) > 1:
        _, alive, pi = best
        least = np.arange(len(pi)) == pi.argmin()
        little = (pi <= 0.02) & (pi < pi.max())
        options = [~little] if little.sum() > 1 else []
        got = next((t for keep in [*options, ~least] if (t := tried(alive[keep], pi[keep]))[0] <= best[0]), None)
        if got is None:
            break
        best = got
    chosen = np.zeros(p.shape[1])
    chosen[best[1]] = best[2]
    return chosen


def _predict(model_of, penalty: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of.value
        for at in batches:
            lang, score, mixed = [], [], []
            for text in at["text"]:
                bucket, count = grams(text)
                if not len(bucket) or not model.languages:
                    lang.append("und"), score.append(0.0), mixed.append([])
                    continue
                pi = mixture(count, model.p[bucket], penalty)
                k = int(pi.argmax())
                lang.append(model.languages[k]), score.append(min(1.0, float(pi[k])))
                mixed.append([(model.languages[i], float(pi[i])) for i in np.argsort(-pi) if pi[i] > 0])
            yield pd.DataFrame({"doc_id": at["doc_id"], "lang_pred": lang, "score": score, "mixture": mixed})

    return run


def identify(docs: DataFrame, model: Model, penalty: float = 2.0) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, lang_pred, score, mixture), a row for each input row.

    lang_pred is the language of the largest proportion, score that proportion. A null text,
    one without letters, or a model without languages gives 'und', score 0 and an empty
    mixture. Null doc_ids and repeated rows pass through; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInPandas(_predict(held, penalty), "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
