"""Corpus operators against brute force, exact round trips and held-out labels."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.llm import bpe, chat, decontam, html_text, language_mix, license_scan, lsh_forest, passages, queries, topk, toxicity
from lattica.llm.common import WordHash

SF = "/root/testdata/sf0.001"


def words(rnd, n, size=400):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


# -- near duplicates


def brute_components(texts, width, percent):
    cache = WordHash()
    sets = {i: set(lsh_forest.shingle_set(t, width, cache).tolist()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    base = [words(rnd, 120) for _ in range(12)]
    texts = {}
    for i in range(240):
        w = list(base[i % 3 if i < 160 else i % 12])  # three crowded groups
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10**6)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want, sizes = brute_components(texts, 3, 85)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in lsh_forest.near_duplicates(df, 3, 85).collect()}
    assert got == {i: (want[i], sizes[i], want[i] == i) for i in texts}


def test_pairs_alike_to_nothing_else_of_a_crowded_region(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", 50)
    rnd = random.Random(8)
    base = words(rnd, 200)

    def changed(w, n):
        w = list(w)
        for k in rnd.sample(range(len(w)), n):
            w[k] = f"edit{rnd.randrange(10**6)}"
        return w

    alone = [changed(base, 6) for _ in range(150)]
    texts = [changed(base, 1) for _ in range(80)] + alone + [changed(w, 4) for w in alone]
    rnd.shuffle(texts)
    texts = {i: " ".join(w) for i, w in enumerate(texts)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want, _ = brute_components(texts, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in lsh_forest.near_duplicates(df, 3, 85).collect()} == want


def test_ends_of_pairs_are_told_once(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 3), (4, 1)], "a long, b long")
    ends = lsh_forest._ends(pairs)
    assert sorted(r["node"] for r in ends.collect()) == [1, 2, 3, 4] and ends.columns == ["node"]


def test_candidates_grow_with_the_nodes_of_a_group():
    """Of one group of near copies: pairs a node don't grow with the group."""
    rnd, cache, a_node = random.Random(1), WordHash(), []
    base = words(rnd, 120, 10**6)
    for n in (300, 1200):
        sigs = [lsh_forest.signature(lsh_forest.shingle_set(" ".join([*base[:k], f"new{n}x{i}", *base[k:]]), 3, cache)).tobytes() for i in range(n) for k in [rnd.randrange(120)]]
        (at,) = lsh_forest._tree_rows([pd.DataFrame({"node": range(n), "root": range(n), "sig": sigs})])
        at = at.sort_values(lsh_forest._KEYS)
        node = at["node"].to_numpy(np.int64)
        for whole in (False, True):
            pairs = node[lsh_forest._neighbours(at[lsh_forest._KEYS[:-1]].to_numpy(np.int64), node, whole)]
            a_node.append(len(np.unique(np.sort(pairs, axis=1), axis=0)) / n)
    assert a_node[2] < 1.5 * a_node[0] and a_node[3] < 1.5 * a_node[1] and max(a_node) < 100


def test_near_duplicates_of_odd_rows(odd, none):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"], r["n_shingles"] > 0) for r in lsh_forest.near_duplicates(odd).collect())
    assert got == [(-1, None, True), (1, 1, False), (2, 2, False), (3, 3, False), (4, 4, True), (4, 4, True), (5, 5, True), (6, 5, True), (7, 7, True)]
    assert lsh_forest.near_duplicates(none).count() == 0


def test_neighbours_keep_to_regions():
    rows = np.array([[0, 1, 5, 5, 5], [0, 1, 5, 5, 6], [0, 2, 1, 1, 1]])
    assert {tuple(sorted(x)) for x in lsh_forest._neighbours(rows, np.array([4, 3, 9]), True).tolist()} == {(0, 1)}


# -- top k


@pytest.mark.parametrize("n", [7, 130])
def test_top_k_equals_brute_force(spark, n):
    rnd = np.random.default_rng(n)
    x = rnd.integers(-3, 4, (n, 9)) / 64.0 + 0.001
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(500, None, 1), (520, [1.0, None] + [0.0] * 7, 1), (540, [float("nan")] * 9, 1), (None, [0.0] * 9, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {}
    for r in topk.top_k(df, 5, 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    q = np.floor(x * 64).astype(int)
    for i in range(0, n, 10):
        s = q @ q[i]
        want = [(j, int(s[j])) for j in sorted(range(n), key=lambda j: (-s[j], j)) if j != i][:5]
        assert [got[i][k + 1] for k in range(len(want))] == want and len(got[i]) == len(want)
    assert set(got) == set(range(0, n, 10))


def test_top_k_is_exact_for_large_numbers(spark):
    df = spark.createDataFrame([(i, [float(2**28 + i), 1.0]) for i in range(0, 60, 10)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, 1, 20, scale=1).where("query_id = 0").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(50, 2**28 * (2**28 + 50) + 1)]


# -- byte BPE


def test_bpe_equals_the_library(spark, odd):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("ab \n\té字ñ12½!?'sLL😀 ") for _ in range(rnd.randrange(60)))) for i in range(120)] + [(900, None), (901, ""), (902, "a" * 3000), (None, " the")]
    rows += [(1000 + i, "".join(rnd.choice("漢字仮名交文日本語人大年中ЖшцΩλabcdefgh") for _ in range(rnd.randrange(20, 400)))) for i in range(60)]  # pieces over FOLDED bytes
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in bpe.encode_decode(df, ranks, tokenizers.PATTERN, with_ids=True).collect():
        text = dict(rows)[r["doc_id"]] or ""
        ids = coder.encode_ordinary(text)
        assert r["ids"] == ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode_decode(odd, ranks, tokenizers.PATTERN).count() == odd.count()


def test_the_rank_map_is_in_no_plan(spark, docs_of):
    tokenizers = pytest.importorskip("public_tokenizers")
    done = bpe.encode_decode(docs_of([(1, "plain words", None, None, None, None)]), bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN)
    assert done.count() == 1 and len(done._jdf.queryExecution().toString()) < 100_000


def test_a_pair_is_found_at_its_place_alone():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258, b"abb": 300}
    pairs = bpe.merge_pairs(ranks)
    own = bpe.Ranks(ranks)
    for a in ranks.values():
        for b in ranks.values():
            at = own.places[a] + b if a < len(own.places) else len(own.table)
            held = own.table[at] if at < len(own.table) else -1
            assert (held >> bpe.BITS if held & bpe.MASK == a else None) == pairs.get((a, b))
    assert bpe.Ranks({bytes([i]): i for i in range(256)}).starts([b"", b"ab"]).to_pylist() == [[(bpe.NONE << bpe.BITS) + bpe.MASK], [(bpe.NONE << bpe.BITS) + x for x in (bpe.MASK, 97, 98)]]


def test_a_step_of_the_fold_runs_no_lambda_over_its_state(spark):
    starts = [[(bpe.NONE << bpe.BITS) + bpe.MASK, (256 << bpe.BITS) + 97, (bpe.NONE << bpe.BITS) + 98]]
    row = spark.createDataFrame([([*starts, *starts], [0] * 97 + [5], [-1] * 200)], "starts array<array<bigint>>, places array<bigint>, table array<bigint>")
    folded = row.select(bpe.folded_ids().alias("ids"))
    plan = folded._jdf.queryExecution().analyzed().toString()
    assert folded.first()["ids"] == [[256], [256]] and "filter(" not in plan and "zip_with(" not in plan


def test_long_pieces_merge_like_short_ones():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258}
    assert bpe.apart(b"xababyba", bpe.side_by_side(ranks)) == [b"x", b"abab", b"y", b"ba"] and bpe.apart(b"x", bpe.side_by_side(ranks)) == [b"x"]
    assert bpe.merge_long(b"ababa", ranks) == [257, 97] and bpe.merge_long(b"", ranks) == []


# -- chat


def test_paths_and_round_trip(spark):
    rows = [(1, 1, None, 0.0, "user", "<|im_end|> \\ </s>[INST]"), (1, 2, 1, 1.0, "assistant", "a\nb"), (1, 3, 1, 5.0, "assistant", None), (1, 4, 2, 9.0, "user", "<s>"), (2, 7, 99, None, None, "x"), (3, 1, 2, 0.0, "user", "c"), (3, 2, 1, 0.0, "user", "c")]
    messages = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double, role string, text string")
    paths = chat.chosen_paths(messages, 2)
    found = {}
    for r in paths.collect():
        found.setdefault((r["conv_id"], r["leaf"], r["rank"]), []).append((r["depth"], r["node"]))
    assert {k: sorted(v) for k, v in found.items()} == {(1, 4, 1): [(0, 1), (1, 2), (2, 4)], (1, 3, 2): [(0, 1), (1, 3)], (2, 7, 1): [(0, 7)]}
    out = {r["leaf"]: r for r in chat.format_paths(paths, messages).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in out[4]["turns"]] == [("user", "<|im_end|> \\ </s>[INST]"), ("assistant", "a\nb"), ("user", "<s>")]
    (span,) = out[4]["loss_spans"]
    assert out[4]["formatted"][span["start"] - 1 : span["start"] - 1 + span["size"]] == "a\nb"
    assert "</s>" not in out[4]["formatted"]


def test_chat_query_reads_all_turns(spark):
    got = {r["conv_id"]: r for r in queries.op7_chat_formatting(spark, SF).collect()}
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(got) == set(rows) | {-7}
    for i, turns in rows.items():
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[i]["loss_chars"] == sum(len(b) for a, b in turns if a == "assistant")


# -- language, toxicity


def test_language_on_held_out_rows(spark):
    got = queries.op2_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 20 and (got["lang"] == got["lang_pred"]).mean() > 0.95


def test_language_of_odd_rows(odd, none):
    model = language_mix.fit(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in language_mix.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[5] == "en"
    assert language_mix.identify(odd, language_mix.fit(none)).where("lang_pred <> 'und'").count() == 0


def test_mixture_finds_both_languages():
    p = np.array([[0.9, 0.05, 0.5], [0.05, 0.9, 0.5]])
    pi = language_mix.mixture(np.array([900, 900]), p[:, :2], 2.0)
    assert np.allclose(pi, 0.5, atol=0.05)


def test_toxicity_ranks_held_out_rows(spark):
    got = queries.op8_toxicity(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert got[got["toxic"] == 1]["score"].mean() > got[got["toxic"] == 0]["score"].mean() + 0.3


def test_folding_and_exceptions(odd, spark):
    assert toxicity.fold("Mor0n сlоwn 2024 déjà")[-1] == " moron clown 2024 deja "
    lexicon = toxicity.Lexicon({" moron ": 5.0, " tras": 4.0}, ("trash can",), np.array([-3.0, 3.0, 0.0, 0.0]))
    assert lexicon.score("a m0r0n") > 0.5 > lexicon.score("a trash can") and lexicon.score("trash talk") > 0.5
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.fit(odd, empty))
    assert got.count() == odd.count() and got.where("score is null").isEmpty()


# -- passages, benchmark


def test_repeated_passages(spark, odd, none):
    rnd = random.Random(3)
    shared = words(rnd, 70, 10**6)
    fuzzy = [x if i % 23 else "changed" for i, x in enumerate(shared)]
    rows = [(i, " ".join(words(rnd, 90, 10**6) + (shared if i in (2, 5) else fuzzy if i == 7 else []) + words(rnd, 60, 10**6))) for i in range(9)]
    got = {r["doc_id"]: r for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {5, 7} and all(r["src_doc_id"] == 2 for r in got.values())
    assert (got[5]["start_word"], got[5]["end_word"]) == (90, 160) and got[7]["end_word"] - got[7]["start_word"] > 60
    left = {r["doc_id"]: r["text"] for r in passages.remove(spark.createDataFrame(rows, "doc_id long, text string"), passages.repeated(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert len(left[5].split()) == 150 and left[2] == dict(rows)[2]
    assert passages.repeated(odd).where("doc_id <> 6").isEmpty() and passages.repeated(odd, within=True).where("doc_id not in (5, 6)").isEmpty() and passages.repeated(none).isEmpty()


def test_second_copies_in_a_document(spark):
    rnd = random.Random(4)
    p, own = words(rnd, 60, 10**6), words(rnd, 60, 10**6)
    rows = [(1, " ".join(p)), (2, " ".join(p + words(rnd, 30, 10**6) + p + own + words(rnd, 20, 10**6) + own))]
    got = sorted((r["start_word"], r["src_doc_id"]) for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1), (90, 2)]


def covered(found, doc):
    return {w for r in found if r["doc_id"] == doc for w in range(r["start_word"], r["end_word"])}


def test_passages_of_frequent_lines_and_within_documents(spark):
    """Every word of an equal run of 40 that stands earlier, by brute force."""
    rnd = random.Random(8)
    lines = [words(rnd, 9, 10**6) for _ in range(12)]
    passage = [w for x in lines for w in x]
    pad = lambda n=30: words(rnd, n, 10**6)
    docs = [pad() + x + pad() for x in lines for _ in range(12)]  # each line's first owners
    docs += [pad() + passage + pad() for _ in range(3)]
    once = words(rnd, 60, 10**6)
    docs += [pad() + once + pad() + once + pad(), pad() + lines[0] * 20 + pad(), ["the"] * 300]
    far = words(rnd, 45, 10**6), words(rnd, 45, 10**6)
    docs += [pad() + far[0] + pad(250) + far[1] + pad(), pad() + far[0] + pad(250) + far[1] + pad()]
    seen, expected = set(), {}
    for i, own in enumerate(docs):
        expected[i] = set()
        for p in range(len(own) - 39):
            if (run := tuple(own[p : p + 40])) in seen:
                expected[i] |= set(range(p, p + 40))
            seen.add(run)
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    across = passages.repeated(df).collect()
    assert {r["doc_id"] for r in across} == {145, 146, 151} and not any(r["src_doc_id"] == r["doc_id"] for r in across)
    found = passages.repeated(df, within=True).collect()
    for i in expected:
        assert expected[i] <= covered(found, i) and len(covered(found, i) - expected[i]) <= 8
    assert all(r["src_doc_id"] < r["doc_id"] or r["src_start"] < r["start_word"] for r in found)


def test_passages_of_frequent_seeds_alone(spark):
    """An equal run of 40 words of which every seed is in many documents before, between and after its two owners;
    in the second case one more document, before them, has the run without its last two words."""
    rnd = random.Random(12)
    run = words(rnd, 40, 10**6)
    pad = lambda: words(rnd, 30, 10**6)
    parts = [run[k : k + 20] for k in range(0, 21, 5) for _ in range(10)]
    for short in ([], [run[:38]]):
        docs = [pad() + x + pad() for x in [*parts, *short, run, *parts, run, *parts]]
        found = passages.repeated(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")).collect()
        first, second = len(parts) + len(short), 2 * len(parts) + len(short) + 1
        assert set(range(30, 70)) <= covered(found, second) and {r["src_doc_id"] for r in found if r["doc_id"] == second} == {first}
        assert {r["doc_id"] for r in found} == {second}


def test_links_by_parts_equal_those_of_a_whole_bucket():
    """Seeds are linked a part at a time: no row is lost, no seed is split."""
    rnd = random.Random(13)
    shared = words(rnd, 60, 10**6)
    texts = [words(rnd, 50, 30) + (shared if i % 3 else []) + words(rnd, 50, 10**6) for i in range(40)]
    cache = WordHash()
    columns, _ = passages.seeds_of(np.arange(40), [passages.word_hashes([w.encode() for w in x], cache) for x in texts], 37)
    parts = list(passages.parts_of(columns[0], 100))
    seen = [set(columns[0][p].tolist()) for p in parts]
    assert len(parts) > 5 and sorted(np.concatenate(parts)) == list(range(len(columns[0]))) and sum(map(len, seen)) == len(set().union(*seen))
    whole = passages.links_of(*columns, 37)
    found = passages.merged(*(np.concatenate(x) for x in zip(*(passages.links_of(*(c[p] for c in columns), 37) for p in parts), strict=True)))
    assert len(whole[0]) > 20 and set(zip(*(x.tolist() for x in found), strict=True)) == set(zip(*(x.tolist() for x in whole), strict=True))
    assert [len(p) for p in passages.parts_of(np.empty(0, np.uint64), 100)] == [0]


def test_fuzzy_passages_are_recalled(spark):
    """Words substituted at random, 50-word passages: share found at 10 and 14 % changed."""
    rnd = random.Random(9)
    rows, fuzzy = [], {}
    for i in range(240):
        passage = words(rnd, 50, 10**6)
        at = set(rnd.sample(range(50), 5 if i % 2 else 7))
        changed = [f"new{i}x{k}" if k in at else w for k, w in enumerate(passage)]
        rows += [(2 * i, " ".join(words(rnd, 40, 10**6) + passage + words(rnd, 40, 10**6))), (2 * i + 1, " ".join(words(rnd, 40, 10**6) + changed + words(rnd, 40, 10**6)))]
        fuzzy[2 * i + 1] = i % 2
    found = {r["doc_id"] for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= set(fuzzy)
    recall = [sum(d in found for d in fuzzy if fuzzy[d] == k) / 120 for k in (0, 1)]
    print("recall at 14 and 10 % changed:", recall)
    assert recall[1] >= 0.95 and recall[0] >= 0.85


def test_best_chain_is_collinear():
    place, source = np.array([0, 5, 10, 12, 20]), np.array([3, 8, 500, 15, 23])
    assert passages.chains(place, source)[0] == [0, 1, 3, 4]


def test_contaminated_within_budget(spark, odd, none):
    rnd = random.Random(4)
    item = " ".join(words(rnd, 30))
    off = list(item)
    for k in (10, 50, 90):
        off[k] = "#"
    rows = [(1, "before " + item.upper() + " after"), (2, "x " + "".join(off) + " y"), (3, " ".join(words(rnd, 300))), (4, item[: len(item) // 2])]
    bench = spark.createDataFrame([(9, item), (8, "short"), (None, item), (7, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["edits"]) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: (9, 0), 2: (9, 3)}
    assert decontam.contaminated(odd, bench).isEmpty() and decontam.contaminated(none, bench.limit(0)).isEmpty()


# -- html, licenses


def test_html_layout():
    page = "<head><title>t</title></head><p>a<p>b<ul><li>x<li>y<ol><li>z</ol></ul><table><tr><th>Name<th>N<tr><td>long cell<td>2</table><div hidden>no</div><div style='display: none'>no</div><script>no</script><pre> a\n  b</pre>z<br>&amp; w"
    assert html_text.render(page) == "a\n\nb\n\n- x\n- y\n  1. z\n\nName       N\nlong cell  2\n\n a\n  b\n\nz\n& w"
    assert html_text.render(None) == html_text.render("") == html_text.render("<p hidden>x") == ""
    assert html_text.render("<div>" * 5000 + "deep" + "< 3") == "deep< 3"
    assert html_text.render("<b>" * 300 + "<i style='display:none'>no</i>" + "</b>" * 300 + "<ol><li>x</ol>") == "1. x"


def test_html_tables_lists_and_visibility():
    assert html_text.render("<table><tr><td rowspan=2>A<td>b1<td>c1<tr><td>b2<td>c2<tr><td>A3<td colspan=2>wide</table>") == "A   b1  c1\n    b2  c2\nA3  wide"
    assert html_text.render("<table><tr><td>漢字<td>x<tr><td>ab<td>y</table>") == "漢字  x\nab    y"
    assert html_text.render("<table><tr><td>a<br>b<td>x<tr><td><table><tr><td>i<td>j</table><td>y</table>") == "a     x\nb\ni  j  y"
    assert html_text.render("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</p>no</div>") == "yes"
    assert html_text.render("<svg><title>no</title><rect/><text x=1>drawn</text></svg> <math><mi>x</mi></math>") == "drawn x"
    assert html_text.render("<ol start=3><li>a<li value=7>b<li>c</ol><ol reversed><li>a<li>b</ol>") == "3. a\n7. b\n8. c\n\n2. a\n1. b"
    assert html_text.render("<input value=shown><input type=hidden value=no><input type=checkbox value=no>") == "shown"


def test_licenses(spark, odd, none):
    rows = [(1, "intro " * 40 + license_scan.TEMPLATES["GPL-3.0"] + " outro" * 40), (2, "Released under\nthe MIT   license!"), (3, "no notice here at all today"), (None, license_scan.TEMPLATES["MIT"])]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "GPL-3.0"): 1.0, (2, "MIT"): 1.0}
    assert license_scan.scan(odd).isEmpty() and license_scan.scan(none).isEmpty()


def test_every_notice_is_found(spark):
    known = [*license_scan.TEMPLATES.items(), *license_scan.NOTICES]
    rows = [(i, f"alpha beta {text} gamma delta") for i, (_, text) in enumerate(known)] + [(-1, "all rights are reserved"), (-2, "All rights reserved")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r["doc_id"], r["license"]) for r in got}
    assert {(i, name) for i, (name, _) in enumerate(known)} <= found and len(found) == len(got)
    assert [tuple(r)[1:] for r in got if r["doc_id"] == -2] == [("All-rights-reserved", 1.0, 0, 1)] and not any(r["doc_id"] == -1 for r in got)
    own = license_scan.scan(spark.createDataFrame(rows[:1], "doc_id long, text string"), {"greek": "gamma delta", "none": "..."}).collect()
    assert [(r["license"], r["containment"]) for r in own] == [("greek", 1.0)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_extra", F.lit(1))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs.count(), corpus_pipeline.cut(stage(spark, docs, SF))
        assert 0 < docs.count() <= before
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns


def test_pipeline_stages_begin_with_heaps_given_back(spark, docs_of):
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName() and b.getName() != "Copy")
    docs = docs_of([(1, "one two three four five six", "en", "s", 27, 1), (2, "seven eight nine ten eleven", "en", "s", 27, 1)])
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, SF)
        assert full() > before
