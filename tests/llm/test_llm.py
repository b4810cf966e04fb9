"""Sketches, near duplicates, top-k, tokenizer, packing and repetition against brute force and exact round trips."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reploom.llm import bpe, distinct, neardup, packing, repetition, topk


@pytest.mark.parametrize("n", [1, 3, 100, 5000, 40_000])
def test_distinct_estimates(spark, n):
    df = spark.range(n).selectExpr("id % 20 as g", "concat('v', id) as v").unionAll(spark.range(n).selectExpr("id % 20 as g", "concat('v', id) as v"))
    m = distinct.matrix(df, F.col("v"), F.col("g"))
    r = distinct.estimate(distinct.merge(m)).first()
    assert abs(r["n_estimate"] - n) <= 4 * r["std_error"] and r["std_error"] <= max(0.5, 0.0125 * n)
    again = distinct.estimate(distinct.merge(m.unionAll(m))).first()
    assert again == r  # merging is idempotent
    for g in distinct.estimate(m, "g").collect():
        exact = len(range(g["g"], n, 20))
        assert abs(g["n_estimate"] - exact) <= 5 * g["std_error"]


def test_distinct_error_bound():
    rng, m, n = np.random.default_rng(1), distinct.M, 20_000
    errors = []
    for _ in range(60):
        h = rng.integers(0, 2**63, n, dtype=np.int64)
        rank = np.minimum(np.array([(x & -x).bit_length() - 1 for x in (h >> 12).tolist()]), distinct.LEVELS - 1)
        seen = np.unique((h & (m - 1)) * 64 + rank)
        counts = np.bincount(seen % 64, minlength=distinct.LEVELS)[: distinct.LEVELS]
        est, se = distinct.likeliest(counts[None, :], m)
        errors.append((est[0] - n) / se[0])
    assert abs(np.mean(errors)) < 0.6 and 0.6 < np.std(errors) < 1.4


def test_distinct_nulls(spark):
    df = spark.createDataFrame([(None, None, "a"), (None, "x", None), (None, None, "b"), (None, "x", "a")], "run_ts timestamp, v_call string, junction_aa string")
    got = {(r["level"], r["v_call"]): round(r["n_estimate"]) for r in distinct.estimate(distinct.by_day_and_call(df), "level", "day", "v_call").collect()}
    assert got == {("day_call", None): 2, ("day_call", "x"): 1, ("day", None): 2, ("call", None): 2, ("call", "x"): 1, ("all", None): 2}
    assert distinct.by_day_and_call(df.limit(0)).count() == 0


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def mutate(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, what = rng.randrange(len(s)), rng.randrange(3)
        if what == 0:
            s[i] = rng.choice("ACGT")
        elif what == 1:
            s.insert(i, rng.choice("ACGT"))
        else:
            del s[i]
    return "".join(s)


def test_near_duplicates(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        base = "TGTGCAAGTTCC" + "".join(rng.choice("ACGT") for _ in range(rng.randrange(80, 130))) + "AACGAGAAGCTCTTCTTC"
        texts += [base, mutate(rng, base, rng.randrange(1, 13)), mutate(rng, base, rng.randrange(8, 30))]
    rows = [(i, t.lower() if i % 3 else t[:50] + "--" + t[50:]) for i, t in enumerate(texts + texts[:5])] + [(900, None), (901, ""), (902, "ACGT")]
    df = spark.createDataFrame(rows, "row_id bigint, junction string")
    long = sorted({t for t in texts if len(t) >= 90})
    want = {(a, b) for a, b in itertools.combinations(long, 2) if abs(len(a) - len(b)) * 10 <= max(len(a), len(b)) and edit(a, b) * 10 <= max(len(a), len(b))}
    assert {tuple(r) for r in neardup.found(df).collect()} == want and len(want) > 40
    groups = {r["id"]: r for r in neardup.grouped(df, "row_id", neardup.bases(F.col("junction")), 90).collect()}
    assert {i for i, t in enumerate(texts + texts[:5]) if len(t) >= 90} == set(groups)
    link = {t: sum(t in p for p in want) for t in long}
    ids = {t: i for i, t in enumerate(texts)}
    assert all(groups[i]["n_links"] == link[t] for t, i in ids.items() if t in link)
    assert all(groups[ids[a]]["group_id"] == groups[ids[b]]["group_id"] for a, b in want)
    root = {t: t for t in long}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in want:
        root[find(a)] = find(b)
    assert len({r["group_id"] for r in groups.values()}) == len({find(t) for t in long})
    assert neardup.found(df.limit(0)).count() == 0


def test_hot_lists_are_split_not_dropped(spark):
    rng = random.Random(2)
    ends = "TGTGCAAGTTCCATTGGA", "GGAACGAGAAGCTCTTCTTC"
    texts = [ends[0] + "".join(rng.choice("ACGT") for _ in range(70)) + ends[1] for _ in range(300)]
    texts += [mutate(rng, t, 5) for t in texts[:100]]
    df = spark.createDataFrame([(t,) for t in texts], "junction string")
    s = neardup.strings(df, neardup.bases(F.col("junction")), 90)
    few = neardup.pivotal(s, 8).count()
    assert few < len(texts) ** 2 / 2  # the shared ends are asked for only where a string has too few other grams
    got = {tuple(r) for r in neardup.found(df).collect()}
    assert all((min(a, b), max(a, b)) in got for a, b in zip(texts[:100], texts[300:]) if a != b and min(len(a), len(b)) >= 90)


def test_large_families_lose_no_pair(spark):
    rng = random.Random(11)
    texts = set()
    for _ in range(2):
        base = "".join(rng.choice("ACGT") for _ in range(124))
        texts |= {base, *(mutate(rng, base, rng.randrange(2, 9)) for _ in range(200))}
    even = "".join(rng.choice("ACGT") for _ in range(124))
    spaced = "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i % 10 == 5 and i < 120 else c for i, c in enumerate(even))
    df = spark.createDataFrame([(t,) for t in [*texts, even, spaced]], "junction string")
    s = neardup.strings(df, F.col("junction"), 90).select("s").cache()
    b = s.toDF("t")
    true = s.crossJoin(b).filter("s < t and levenshtein(s, t) * 10 <= greatest(length(s), length(t))")
    want = {tuple(r) for r in true.collect()}
    assert {tuple(r) for r in neardup.found(df).collect()} == want
    assert len(want) > 5000 and (min(even, spaced), max(even, spaced)) in want


def test_links_of_queried_rows(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ACGT") for _ in range(100)) for _ in range(30)]
    texts = base + [mutate(rng, t, 3) for t in base for _ in range(3)] + base[:4]
    df = spark.createDataFrame([(i * 50, t) for i, t in enumerate(texts)] + [(None, base[0]), (7, None)], "row_id bigint, junction string")
    distinct_ = sorted({t for t in texts if len(t) >= 90})
    near = {t: sum(u != t and edit(t, u) * 10 <= max(len(t), len(u)) for u in distinct_) for t in distinct_}
    got = {r["id"]: r["n_links"] for r in neardup.linked(df, "row_id", F.col("junction"), 90).collect()}
    assert got == {i * 50: near[t] for i, t in enumerate(texts) if i % 2 == 0 and len(t) >= 90}
    assert neardup.grouped(df.limit(0), "row_id", F.col("junction"), 90).count() == 0


def test_very_long_strings(spark):
    rng = random.Random(5)
    a = "".join(rng.choice("ACGT") for _ in range(33_000))
    b = a[:100] + "T" + a[100:]
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "row_id bigint, junction string")
    s = neardup.strings(df, F.col("junction"), 90, "row_id")
    assert {(r["sid"], r["n"]) for r in s.collect()} == {(1, 33_000), (2, 33_001)}
    own = neardup.pivots(s, 8, 0.001).groupBy("sid").agg(F.max("pos").alias("p"), F.count("*").alias("n")).collect()
    assert {r["n"] for r in own} == {34} and max(r["p"] for r in own) > 32_767


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1003)}}


def test_top_k(spark):
    df = spark.createDataFrame([(x,) for x in [" ca", "CA ", "b", "B", "d", None, None, "e"]], "junction_aa string")
    assert [tuple(r) for r in topk.top_k(df, topk.junction(df), 3, "junction_aa").collect()] == [("B", 2), ("CA", 2), ("D", 1)]
    assert {r[0] for r in topk.heavy(df, 0.25).collect()} == {"B", "CA"} and topk.heavy(df.limit(0)).count() == 0


TEXTS = ["", " ", "Hello  world\n\n", "don't 123,456 <|endoftext|>", "日本語のテキスト。", "żółć Привет", "a" * 5000, "x y" * 3000, "\U0001f600‍�\x00", "  lead", "tail  "]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_bpe_table(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_table(df).collect()}
    assert got == {**{i: reference(t) for i, t in enumerate(TEXTS)}, len(TEXTS): []}
    back = df.filter("text is not null").filter(bpe.decoded(bpe.ids(F.col("text"))) != F.col("text"))
    assert back.count() == 0 and bpe.encode_table(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_bpe_any_text(reference, text):
    enc = bpe.encoder(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    if not any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        assert enc.encode(text) == reference(text) and enc.decode(enc.encode(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_packing_is_whole(sizes):
    no = packing.pack(np.array(sizes, dtype=int), 100)
    fill = np.bincount(no, weights=sizes) if sizes else np.zeros(0)
    assert (fill <= 100).all() and len(no) == len(sizes)
    if sum(sizes):
        best = packing.best_fit(np.array([s for s in sizes if s]), 100)
        assert len({n for n, s in zip(no, sizes) if s}) <= len(best.fill)


def test_local_search_empties_containers():
    sizes = np.array([6, 6, 4, 4, 4, 3, 3])
    bins = packing._Bins(10)
    for group in ([0, 5], [1, 6], [2, 3], [4]):
        b = bins.open()
        bins.items[b], bins.fill[b] = list(group), int(sizes[group].sum())
    before = sum(f * f for f in bins.fill)
    packing.improve(bins, sizes)
    assert sorted(i for x in bins.items for i in x) == list(range(7)) and max(bins.fill) <= 10
    assert all(f == sizes[x].sum() for f, x in zip(bins.fill, bins.items)) and sum(f * f for f in bins.fill) > before and sum(f > 0 for f in bins.fill) == 3


def test_containers(spark):
    rows = [(i, s) for i, s in enumerate([0, None, 5, 2048, 2049, 5000, 100, 2047, 1])] + [(2, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, n int")
    got = packing.containers(df, "doc_id", "n").collect()
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(s or 0 for _, s in rows)
    assert {i: sum(r["id"] == i for r in got) for i in range(9)} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 2, 5: 3, 6: 1, 7: 1, 8: 1}
    assert packing.containers(df.limit(0), "doc_id", "n").count() == 0


def test_containers_meet_across_blocks(spark):
    rng = random.Random(6)
    sizes = [rng.randrange(1, 40) for _ in range(3000)] + [7] * 600
    df = spark.createDataFrame([(1 if s == 7 else i, s) for i, s in enumerate(sizes)], "doc_id bigint, n int")  # one id on many rows
    rows = packing.containers(df, "doc_id", "n", capacity=100, block=64).collect()
    fill = {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
    assert sorted(r["size"] for r in rows) == sorted(sizes) and max(fill.values()) <= 100
    assert len(fill) <= sum(sizes) / 100 * 1.01 + 1
    blocks = packing.containers(df, "doc_id", "n", capacity=100, block=64).groupBy("id").count().filter("id = 1").first()
    assert blocks["count"] >= 600


def test_texts_are_tokenised_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def size(x):
        seen.add(1)
        return x % 50

    packing.containers(spark.range(500).withColumn("n", size("id")), "id", "n", capacity=100, block=64).count()
    assert seen.value == 500


def repeated_by_hand(text, w=32):
    s = "".join(c for c in text.lower() if c.isalnum())
    places = {}
    for i in range(len(s) - w + 1):
        places.setdefault(s[i : i + w], []).append(i)
    hit = {p for v in places.values() if len(v) > 1 for i in v for p in range(i, i + w)}
    return len(s), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["abcdefghij", "The cat. ", "日本語", "xyz", "q"]), max_size=40))
def test_repeated_share(parts):
    text = "".join(parts)
    assert repetition.repeated(text) == repeated_by_hand(text)


def test_repetition_forest(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    plain = [" ".join(word() for _ in range(60)) for _ in range(300)]
    spam = [" ".join([" ".join(word() for _ in range(12))] * rng.randrange(3, 9)) for _ in range(25)]
    half = [p + " " + p[: int(len(p) * f)] for p in plain[:10] for f in (0.2, 0.6)]
    texts = [*plain, *spam, *half, None, "", " ", "a" * 63, "a" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stats, forest = repetition.measured(df), repetition.train(df, sample=200)
    want = {i for i, t in enumerate(texts) for n, r in [repeated_by_hand(t or "")] if n >= 64 and r * 10 >= n * 4}
    assert {r[0] for r in repetition.found(stats, forest).collect()} == want and len(texts) - 1 in want
    exact = {r["doc_id"]: (r["n_letters"], r["n_repeated"]) for r in repetition.shares(df).collect()}
    assert exact == {i: repeated_by_hand(t or "") for i, t in enumerate(texts)}
    assert repetition.scored(stats, forest).filter("suspect").count() < len(texts) / 2  # the others are never measured exactly
    empty = df.limit(0)
    assert repetition.found(repetition.measured(empty), repetition.train(empty)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_letters_of_any_text(text):
    assert repetition.letters(text) == "".join(c for c in text.lower() if c.isalnum())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["abcdefghij", "The cat. ", "日本語", "xyz", "q"]), max_size=40))
def test_bound_is_never_below_the_share(parts):
    text = "".join(parts)
    assert repetition.bound(text)[0] == repetition.repeated(text)[0] and repetition.bound(text)[1] >= repetition.repeated(text)[1]


def test_no_case_depends_on_the_sample(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(100)]
    texts += [t + " " + t[: len(t) // 2] for t in texts[:6]] + ["x x x x x x.\n" * 4]  # cases; an odder text, too short to be one
    stats = repetition.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    x = stats.select(*repetition.STATS).toPandas().to_numpy(dtype=float)
    forest = repetition.IsolationForest().fit(x).calibrate(x, np.zeros(len(x), dtype=bool))  # as a sample without a case
    assert {r[0] for r in repetition.found(stats, forest).collect()} == set(range(100, 106))


def test_pairs_do_not_follow_the_square_of_all_strings(spark):
    rng = random.Random(21)
    ends = "TGTGCAAGTTCC", "ACTCCTGGCACCCAATAC"
    texts = [ends[0] + "".join(rng.choice("ACGT") for _ in range(rng.randrange(60, 110))) + ends[1] for _ in range(1500)]
    near = [mutate(rng, t, rng.randrange(1, 8)) for t in texts[:50]]
    df = spark.createDataFrame([(t,) for t in texts + near], "junction string")
    s = neardup.strings(df, F.col("junction"), 90)
    found = {tuple(r) for r in neardup.similar(s).select("sa", "sb").collect()}
    assert {(min(p), max(p)) for p in zip(texts, near) if p[0] != p[1] and min(map(len, p)) >= 90} <= found
    assert neardup.pivotal(s, 8).count() <= 2 * len(found) + 50


def test_edits_however_spread_over_regions(spark, monkeypatch):
    monkeypatch.setattr(neardup, "gram_weights", lambda texts, q: np.ones(1 << neardup.BITS, dtype=np.float32))
    rng = random.Random(22)
    base = "".join(rng.choice("ACGT") for _ in range(124))
    df = spark.createDataFrame([(9999, base, 124)], "sid bigint, s string, n int")
    stop = [p + 7 for p in neardup.placed(df, 8, 0.1).first()["at"]][:-1] + [124]
    regions = [base[a:b] for a, b in zip([0, *stop], stop)]
    spread = [[0] + [1] * 12, [1] * 12 + [0], [0, 2] * 6 + [0], [2, 0] * 6 + [0], [0, 8, 4] + [0] * 10, [0] * 10 + [4, 8, 0], [1] * 6 + [0] + [1] * 6, [0, 0, 3] * 4 + [0]]
    spread += [[cuts.count(i) for i in range(13)] for cuts in ([rng.randrange(13) for _ in range(12)] for _ in range(150))]
    texts = set()
    for e in spread:
        for drop in (0, 0.3, 1):
            out = []
            for region, k in zip(regions, e):
                letters = list(region)
                for i in rng.sample(range(len(letters)), min(k, len(letters))):
                    letters[i] = "" if rng.random() < drop else rng.choice([c for c in "ACGT" if c != letters[i]])
                out.append("".join(letters))
            texts.add("".join(out))
    texts = sorted(texts - {base})
    every = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)] + [(9999, base, 124)], "sid bigint, s string, n int")
    got = {r["b"] for r in neardup.pivotal(every, 8).filter("a = 9999").collect()}
    assert got >= {i for i, t in enumerate(texts) if edit(base, t) <= 12} and len(got) > 400


def test_contexts_and_their_edits(spark):
    rng = random.Random(23)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 60)))
        b = mutate(rng, a, min(len(a), rng.randrange(0, 6))) if rng.random() < 0.8 else "".join(rng.choice("ACGT") for _ in range(40))
        x, y = (int(neardup._contexts(t)[-1]) for t in (a, b))
        assert x == sum("ACTG".index(c) << (2 * i) for i, c in enumerate(a[::-1][: neardup.CONTEXT]))
        sizes = [min(len(a), 31 - e, rng.randrange(4, 12) * (e + 1)) for e in range(neardup.DEPTH + 1)]
        least = [min(edit(a[::-1][:n], b[::-1][:k]) for k in range(min(len(b), n + 8) + 1)) for n in sizes]
        rows.append((x, y, sum(n << (5 * e) for e, n in enumerate(sizes)), all(k <= e for e, k in enumerate(least)), all(k <= e for e, k in enumerate(least[:2])), len(b) >= 45))
    x, y, z = (np.array([r[i] for r in rows]) for i in range(3))
    sizes = (z[:, None] >> (5 * np.arange(neardup.DEPTH + 1))) & 31
    got = neardup.fits(x, y, sizes).tolist()
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, x bigint, y bigint, sizes int")
    first = {r["i"]: r["ok"] for r in df.select("i", neardup._near(F.col("x"), F.col("y"), F.col("sizes")).alias("ok")).collect()}
    for i, (*_, true, true2, whole) in enumerate(rows):
        assert got[i] >= true and first[i] >= true2  # nothing that fits is refused
        assert not whole or (got[i] == true and first[i] == true2)  # and where y is long enough, nothing else passes
    assert 50 < sum(got) < 350
