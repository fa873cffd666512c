"""Operators that SQL can't express, against plain ones on small inputs; odd rows through every stage."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import components, decontam, language_mix, license_scan, passages, toxicity


def words(rnd, n, vocabulary=200):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# -- language mixtures


def plain_mixture(count, p, penalty):
    """EM over every set of languages, step by step; the best penalised likelihood."""
    weight, best = [c / language_mix.ORDERS for c in count], None
    n = sum(weight)
    for size in range(1, p.shape[1] + 1):
        for alive in itertools.combinations(range(p.shape[1]), size):
            pi = [1 / size] * size
            for _ in range(60):
                new = [0.0] * size
                for w, row in zip(weight, p, strict=True):
                    total = sum(x * row[k] for x, k in zip(pi, alive, strict=True))
                    for j, k in enumerate(alive):
                        new[j] += w * pi[j] * row[k] / total
                pi = [x / n for x in new]
            like = sum(w * math.log(sum(x * row[k] for x, k in zip(pi, alive, strict=True))) for w, row in zip(weight, p, strict=True))
            cost = -2 * like + penalty * size * math.log(n + 1)
            if best is None or cost < best[0]:
                best = cost, dict(zip(alive, pi, strict=True))
    return best[1]


def test_mixtures_equal_a_search_of_all_sets():
    rnd = np.random.default_rng(4)
    agree = 0
    for _ in range(12):
        p = rnd.dirichlet(np.full(30, 0.3), 4).T + 1e-3
        share = rnd.dirichlet([2, 2]) if rnd.random() < 0.5 else np.array([1.0, 0.0])
        which = rnd.choice(4, 2, replace=False)
        q = p[:, which] @ share
        count = rnd.multinomial(900, q / q.sum())
        got, want = language_mix.mixture(count, p, 2.0), plain_mixture(count.tolist(), p, 2.0)
        agree += set(np.flatnonzero(got)) == set(want)
        assert int(got.argmax()) == max(want, key=want.get)
        if set(np.flatnonzero(got)) == set(want):
            assert all(abs(got[k] - x) < 0.02 for k, x in want.items())
    assert agree >= 10


def test_equal_texts_dont_crowd_out_a_language(spark):
    rows = [("le chat est dans la maison", "fr")] * 400 + [(f"the cat number {i} is in the house", "en") for i in range(40)]
    model = language_mix.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=30)
    assert model.languages == ["en", "fr"]


# -- benchmark passages


def plain_distance(item, text):
    """Least edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_benchmark_passages_equal_plain_distances(spark):
    rnd = random.Random(6)
    letters = "abcdefghij klmno"
    items = ["".join(rnd.choice(letters) for _ in range(n)).strip() for n in (4, 9, 12, 20, 31, 47, 80, 120)]
    docs = []
    for _ in range(60):
        item = rnd.choice(items)
        part = list(item)
        for _ in range(rnd.randrange(0, len(item) // 8 + 2)):
            k = rnd.randrange(len(part) or 1)
            kind = rnd.randrange(3)
            if kind == 0:
                part[k : k + 1] = ["#"]
            elif kind == 1:
                part[k:k] = ["+"]
            else:
                part[k : k + 1] = []
        docs.append("".join(rnd.choice("QRSTUVWXYZ ") for _ in range(rnd.randrange(60))) + "".join(part) + "".join(rnd.choice("QRSTUVWXYZ ") for _ in range(rnd.randrange(60))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.contaminated(rows_of(spark, docs), bench).collect()}
    want = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            own = decontam.normalised(item)
            edits = plain_distance(own, decontam.normalised(text))
            if edits <= int(len(own) * 0.1):
                want[d, i] = edits
    assert got == want and len(want) > 30


def test_band_of_a_long_item_is_narrow():
    rnd = random.Random(2)
    item = "".join(rnd.choice("abcdef ") for _ in range(20000))
    text = item[:9000] + "##" + item[9003:]
    end, edits = decontam._align(item, text, -5, 5, 40)
    assert (end, edits) == (len(text), 3)


# -- licenses


def test_licenses_equal_plain_containment(spark):
    rnd = random.Random(5)
    templates = {f"t{n}": " ".join(words(rnd, n, 10**6)) for n in (6, 9, 17, 40, 150)}
    texts = []
    for i in range(80):
        own = rnd.choice(list(templates.values())).split()
        for _ in range(rnd.randrange(0, 3)):
            own[rnd.randrange(len(own))] = "other"
        texts.append(" ".join(words(rnd, rnd.randrange(0, 90), 10**6) + own + words(rnd, rnd.randrange(0, 90), 10**6)))
    got = {(r["doc_id"], r["license"]): r["containment"] for r in license_scan.scan(rows_of(spark, texts), templates).collect()}

    def runs(text):
        w = [x for x in re.split(r"[^\w]+", text.lower()) if x]
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    want = {}
    for d, text in enumerate(texts):
        every = runs(text)
        for name, template in templates.items():
            of = set(runs(template))
            c = 1
            while c < len(of):
                c *= 2
            best = max((len(of & set(every[k : k + 2 * c])) / len(of) for k in range(0, max(1, len(every)), c)), default=0)
            if best >= 0.8:
                want[d, name] = best
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 30


# -- toxicity


def test_hits_equal_a_plain_scan():
    rnd = random.Random(7)
    weights = {" bad ": 3.0, " bad": 1.0, " awf": 2.0, " rotten ": 2.5, " rot": 0.5}
    lexicon = toxicity.Lexicon(weights, ("bad luck", "rotten apple"), np.array([-2.0, 1.0, 1.0, 0.0]))
    for _ in range(200):
        folded = " " + " ".join(rnd.choice(["bad", "badly", "awful", "rotten", "rotting", "luck", "apple", "fine"]) for _ in range(12)) + " "
        spared = {k for p in lexicon.exceptions for m in re.finditer(f"(?= {p} )", folded) for k in range(m.start(), m.start() + len(p) + 1)}
        want = sum(max(w for t, w in weights.items() if folded.startswith(t, k)) for k in range(len(folded)) if k not in spared and any(folded.startswith(t, k) for t in weights))
        assert lexicon._hits(folded) == pytest.approx(want)
    assert toxicity.fold("з б") == [" з б "]  # letters without a look-alike stay


def test_equal_texts_of_both_labels_count_as_toxic(spark):
    docs = spark.createDataFrame([(i, "nasty word here" if i % 2 else f"kind words {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i in (1, 3) else 0) for i in range(40)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert 0 <= lexicon.score("") <= 1


# -- passages by row


def test_remove_with_ids_that_repeat(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, "lead " + shared + " end"), (2, "x " + shared + " y"), (2, "zz short"), (None, shared), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_spans", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("_least", F.lit(3))
    left = passages.remove(docs, passages.repeated(docs))
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect())
    assert got == [(0, shared), (1, "lead " + shared + " end"), (2, "x  y"), (2, "zz short"), (3, "")] and left.columns == docs.columns


def test_components_of_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(None, 1), (5, 5)]
    parent = list(range(60))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in got} and set(got) == {x for a, b in edges if a is not None and a != b for x in (a, b)}


# -- the pipeline on odd rows


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    import corpus_pipeline

    rnd = random.Random(3)
    shared = " ".join(f"shared{i}" for i in range(60))
    item = "the quick brown benchmark item that nobody should train on at all in any text"
    base = " ".join(f"plain words of a text number {i}" for i in range(12))
    rows = [] if empty else [(1, base, "en"), (1, base, "en"), (1, base + " and a little more", "en"), (None, base, None), (None, None, "en"), (7, "", "en"), (8, "12 34", "en"), (3, " ".join(words(rnd, 80)) + " " + shared, "en"), (4, " ".join(words(rnd, 80)) + " " + shared, "en"), (5, f"see {item} here", "en"), (6, "word " * 5000, "en")]
    docs = spark.createDataFrame([(i, t, la, "s", len(t or ""), 1, 2, 3, "x") for i, t, la in rows], "doc_id long, text string, lang string, source string, n_chars long, _id int, _spans int, _key int, gone string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)))
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_id", "_spans", "_key", "gone"]
        if k == 2 and not empty:
            text = {r["doc_id"]: r["text"] for r in docs.where("doc_id in (3, 4)").collect()}
            assert "shared5" in text[3] and "shared5" not in text[4]
    if not empty:
        # letters: all but null, empty and digits; of the four rows of base's group one stays; the benchmark row goes
        assert seen[0] == 8 and seen[1] == 5 and seen[2] == 5 and seen[3] == 4 and seen[4] == 4
        assert "ids" in docs.columns
