"""Tokenisers, models, scores and exact analytics against golden vectors, closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reploom.functions import tokens as tk
from reploom.operators import algebra, analytics, genes, grammar, occupancy, scaffold, score, simulate, spectrum, structure
from reploom.plans import dp
from reploom.plans import model as md

# Sequences and genes of known scores.
SIX = ["CASSLGIRRT", "CASSLGYEQYF", "CASSLEPSGGTDTQYF", "CASSDTSGGTDTQYF", "CASSFGQGSYEQYF", "CASSQETQYF"]
MORE = ["CASRGGTVYEQYF", "CSVSTSETGDTEQYF", "CASSPPDGILGYTF", "CASSLDSRAGANYF", "CASSYTGQENVLHF", "CASSQRRDRSPQYF"]
V = ["TRBV5-1", "TRBV5-1", "TRBV12-3", "TRBV12-3", "TRBV5-1", "TRBV5-1"]
J = ["TRBJ1-1", "TRBJ2-7", "TRBJ1-1", "TRBJ1-1", "TRBJ2-7", "TRBJ2-7"]


def rep(spark, seqs, counts=None):
    return spark.createDataFrame(list(zip(seqs, counts or [1] * len(seqs))), "seq string, abundance bigint")


def lz_by_hand(s):
    toks, cur = [], ""
    for c in s:
        cur += c
        if cur not in toks:
            toks.append(cur)
            cur = ""
    return toks + [cur] if cur else toks


def peel_by_hand(s):
    s, out, n = f"@{s}$", [], 0
    while s:
        front = s[: len(s) - len(s.lstrip(s[0]))]
        inner = s[len(front) :]
        back = inner[len(inner.rstrip(inner[-1])) :] if inner else ""
        s = inner[: len(inner) - len(back)]
        out.append(f"{front}{back}_{0 if not s else len(front)}{{{n}}}")
        n += 1
    return out


def test_tokens(spark):
    words = ["A", "AA", "AB", "AABCA", "ABBA", "AABBCCDD", "AAABBBCCCDDDEEE", "FFFFFFFFF", "CASSAYFF", *SIX, "é日日é", "x y", "A" * 300, ""]
    df = rep(spark, words).select("seq", tk.lz76(F.col("seq")).alias("lz"), tk.flashback(F.col("seq")).alias("fb"), tk.flashback_reverse(tk.flashback(F.col("seq"))).alias("back"))
    for r in df.collect():
        assert r["lz"] == lz_by_hand(r["seq"])
        if r["seq"]:
            assert r["fb"] == peel_by_hand(r["seq"]) and r["back"] == r["seq"]
    got = {r["seq"]: r for r in df.collect()}
    assert got["AABCA"]["lz"] == ["A", "AB", "C", "A"] and got["FFFFFFFFF"]["lz"] == ["F", "FF", "FFF", "FFF"]
    assert got["CASSAYFF"]["fb"] == ["@$_1{0}", "CFF_1{1}", "AY_1{2}", "SSA_0{3}"]
    null = spark.createDataFrame([(None,)], "seq string").select(tk.lz76(F.col("seq")), tk.flashback(F.col("seq"))).first()
    assert null[0] is None and null[1] is None


def test_repertoire_rules(spark):
    df = spark.createDataFrame([(" CASS ", 2, "t"), ("CASS", None, "TRUE"), ("C!", 1, "t"), ("", 1, "t"), (None, 1, "t"), ("CAS", 0, "yes"), ("CAV", 5, ""), ("CAV", 5, None)], "s string, n bigint, p string")
    assert {tuple(r) for r in md.repertoire(df, "s", "n", productive="p").collect()} == {("CASS", 3), ("CAS", 1)}


def test_lz_scores(spark):
    m = md.fit(rep(spark, SIX), "aap")
    want = {"CASSDTSGGTDTQYF": -1.791759, "CASSFGQGSYEQYF": -2.890372, "CASSLEPSGGTDTQYF": -2.484907, "CASSLGIRRT": -2.197225, "CASSLGYEQYF": -2.197225, "CASSQETQYF": -2.484907}
    got = {r["seq"]: r["log_pgen"] for r in score.log_pgen(m, rep(spark, [*SIX, "CAAAAA", ""])).collect()}
    assert all(abs(got[s] - x) < 1e-5 for s, x in want.items()) and got["CAAAAA"] == got[""] == md.LOG_EPS
    with pytest.raises(md.ModelError):
        score.log_pgen(md.fit(rep(spark, SIX), "naive"), rep(spark, SIX))


def test_absorption(spark):
    m = md.fit(rep(spark, SIX + MORE), "aap")
    assert abs(simulate.absorption(m, "exact") - 47 / 48) < 1e-12
    assert abs(simulate.absorption(m, "mc") - 47 / 48) < 0.02 and simulate.absorption(m, "none") == 1.0


def test_single_path_and_coin(spark):
    one = md.fit(rep(spark, ["CASSLGIRRT"], [50]), "flashback")
    assert {round(r["hill"], 9) for r in analytics.hill_curve(one).collect()} == {1.0}
    coin = md.fit(rep(spark, ["ACDEFGHIKLM", "NPQRSTVWY"], [3, 1]), "flashback")
    h = {r["alpha"]: r["hill"] for r in analytics.hill_curve(coin, (0.0, 1.0, 2.0)).collect()}
    assert h[0.0] == pytest.approx(2) and h[2.0] == pytest.approx(1 / (0.75**2 + 0.25**2)) and math.log(h[1.0]) == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))
    assert analytics.moments(coin)["mass"] == pytest.approx(1)


def _recombining(spark):
    paths = [["@$_1{0}", "AE_1{1}", "BD_1{2}", "CK_1{3}", "M_0{4}"], ["@$_1{0}", "AE_1{1}", "YZ_1{2}", "CK_1{3}", "NN_0{4}"]]
    seqs = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "l array<string>").select(tk.flashback_reverse(F.col("l"))).collect()]
    return md.fit(rep(spark, seqs, [3, 1]), "flashback")


def test_recombining_model(spark):
    m = _recombining(spark)
    atoms = sorted(math.exp(r["log_pgen"]) for r in spectrum.atoms(m).collect())
    p = np.array([1, 3, 3, 9]) / 16
    assert atoms == pytest.approx(list(p))
    for q in (0.0, 0.5, 1.0, 2.0):
        got = dp.jets(m, [(q, 4)])[q, 4]
        assert got == pytest.approx([(p**q * np.log(p) ** j).sum() for j in range(5)])
        assert dp._frontier(m, [(q, 2)])[q, 2] == pytest.approx(got[:3])
    row = analytics.profile(m).first()
    assert row["path_count"] == 4 and row["max_log_pgen"] == pytest.approx(math.log(9 / 16)) and row["min_log_pgen"] == pytest.approx(math.log(1 / 16))
    x = np.log(p)
    assert spectrum.cumulants(m)[:2] == pytest.approx([(p * x).sum(), (p * x**2).sum() - (p * x).sum() ** 2])
    rich = {r["depth"]: r["richness"] for r in spectrum.expected_richness(spectrum.atoms(m), [5]).collect()}
    assert rich[5.0] == pytest.approx((1 - (1 - p) ** 5).sum())
    spec = {r["count"]: r["expected"] for r in spectrum.frequency_spectrum(spectrum.atoms(m), 6, 2).collect()}
    assert spec[2] == pytest.approx((15 * p**2 * (1 - p) ** 4).sum())
    assert sum(r["weight"] for r in spectrum.histogram(m, 64).collect()) == pytest.approx(1)
    top = [r["log_pgen"] for r in analytics.top_sequences(m, 2).collect()]
    assert top == pytest.approx([math.log(9 / 16), math.log(3 / 16)])
    pos = {round(math.exp(r["log_pgen"]) * 16): (r["cdf_generated"], r["cdf_counting"]) for r in spectrum.position(spectrum.atoms(m), spectrum.atoms(m)).collect()}
    assert pos[1] == pytest.approx((1 / 16, 0.25)) and pos[3] == pytest.approx((7 / 16, 0.75)) and pos[9] == pytest.approx((1, 1))
    with pytest.raises(md.ModelError):
        spectrum.atoms(m, 3)
    prof = spectrum.length_profile(m).collect()
    assert sum(r["prob"] for r in prof) == pytest.approx(1) and sum(r["n_sequences"] for r in prof) == 4


def _many(spark):
    words = [a + b + c + d for a in ("CASS", "CAS", "CSV") for b in ("LG", "PDQ", "RTG", "E") for c in ("YE", "DT", "NEK", "AF") for d in ("QYF", "LF", "TF", "HYF")]
    return md.fit(rep(spark, words, [1 + 3 * (i % 7) for i in range(len(words))]), "flashback")


def test_saddlepoint(spark):
    m = _many(spark)
    lp = np.sort([r["log_pgen"] for r in spectrum.atoms(m).collect()])
    assert len(lp) > spectrum.FEW
    xs = [lp[0] - 1, lp[0], *np.quantile(lp, [0.2, 0.5, 0.8]), lp[-1], 0.0]
    got = spectrum.saddlepoint(m, xs).collect()
    exact = [np.exp(lp[lp <= x + 1e-9]).sum() for x in xs]
    assert got[0]["cdf"] == 0 and got[1]["cdf"] == pytest.approx(exact[1]) and got[-1]["cdf"] == got[-2]["cdf"] == 1.0
    assert all(abs(g["cdf"] - e) < 0.12 for g, e in zip(got, exact)) and got[3]["pdf"] > 0 == got[0]["pdf"]
    sims = np.array([r["log_prob"] for r in simulate.simulate(m, 3000, 3).collect()])
    assert all(abs(g["cdf"] - (sims <= x).mean()) < 0.12 for g, x in zip(got[2:5], xs[2:5]))
    few = _recombining(spark)
    assert [r["cdf"] for r in spectrum.saddlepoint(few, [math.log(1 / 16), math.log(3 / 16) + 1e-6, -9.0]).collect()] == pytest.approx([1 / 16, 7 / 16, 0.0])


def test_spectrum_by_length_and_grid(spark):
    m = _recombining(spark)
    p, x = np.array([1, 3, 3, 9]) / 16, -np.log(np.array([1, 3, 3, 9]) / 16)
    one = spectrum.surprisal_moments(m).first()
    assert one["mean"] == pytest.approx((p * x).sum()) and one["k3"] == pytest.approx((p * (x - (p * x).sum()) ** 3).sum())
    assert {r["t"]: r["cgf"] for r in spectrum.cgf(m, [0.0, 0.5, -1.0]).collect()} == pytest.approx({t: math.log((p * np.exp(t * x)).sum()) for t in (0.0, 0.5, -1.0)})
    jets = dp.jets(m, [(2.0, 3)])[2.0, 3]
    by = spectrum.length_derivatives(m, 2.0, 3).groupBy("j").agg(F.sum("value").alias("v")).orderBy("j").collect()
    assert [r["v"] for r in by] == pytest.approx(jets)
    lengths = {len(r["seq"]): 0.0 for r in spectrum.atoms(m).collect()}
    for r in spectrum.atoms(m).collect():
        lengths[len(r["seq"])] += math.exp(r["log_pgen"])
    assert {r["length"]: r["prob"] for r in spectrum.length_profile(m).collect()} == pytest.approx(lengths)
    some = next(iter(lengths))
    assert sum(r["weight"] for r in spectrum.histogram(m, 64, length=some).collect()) == pytest.approx(lengths[some])
    h = spectrum.histogram(m, 512)
    curve = spectrum.histogram_curve(h, [0.0, 100.0, 1.2]).collect()
    assert curve[0]["cdf"] == 0 and curve[1]["cdf"] == 1 and abs(curve[2]["cdf"] - 9 / 16) < 0.02
    assert abs(spectrum.histogram_quantiles(h, [0.3]).first()["surprisal"] - x[3]) < 0.1
    with pytest.raises(md.ModelError):
        spectrum.histogram_quantiles(h, [2.0])


def test_distributed_passes_equal_local_ones(spark, monkeypatch):
    m = md.fit(rep(spark, SIX + MORE), "flashback")
    specs = [(1.0, 2), (0.0, 0)]
    local = [dp.jets(m, specs), dp.path_count(m), dp.extremes(m), dp.least_mass(m), dp.k_best(m, 3), dp.k_best(m, 3, False), dp.by_length(m, specs, spectrum._emitted, spectrum._emitted_col), structure.is_dag(m)]
    monkeypatch.setattr(dp.LocalGraph, "within", classmethod(lambda cls, *a, **k: None))
    far = [dp.jets(m, specs), dp.path_count(m), dp.extremes(m), dp.least_mass(m), dp.k_best(m, 3), dp.k_best(m, 3, False), dp.by_length(m, specs, spectrum._emitted, spectrum._emitted_col), structure.is_dag(m)]
    assert far[1] == local[1] and far[7] == local[7] and far[2] == pytest.approx(local[2]) and far[3] == pytest.approx(local[3])
    assert [p for _, p in far[4]] == [p for _, p in local[4]] and [p for _, p in far[5]] == [p for _, p in local[5]]
    for s in specs:
        assert far[0][s] == pytest.approx(local[0][s]) and all(far[6][n][s] == pytest.approx(local[6][n][s]) for n in local[6])
    assert set(far[6]) == set(local[6])


@pytest.mark.parametrize("variant", ["flashback", "aap"])
def test_joined_scores_equal_broadcast_ones(spark, variant):
    m = md.fit(rep(spark, [*SIX, "CAXSBX", "CXBAX"]), variant)
    q = rep(spark, [*SIX, *MORE, "CAXSBX", "CBXAX", "CXBAX", "", "Z"])
    for shared in (False, True):
        near = {r["seq"]: r["log_pgen"] for r in score.log_pgen(m, q, shared).collect()}
        assert near == pytest.approx({r["seq"]: r["log_pgen"] for r in score.log_pgen(m, q, shared, limit=0).collect()}) and len(near) == 17


def test_normalised_scores(spark):
    m = md.fit(rep(spark, SIX + MORE), "aap")
    a = simulate.absorption(m, "exact")
    raw = {r["seq"]: r["log_pgen"] for r in score.log_pgen(m, rep(spark, [*SIX, "W"])).collect()}
    own = {r["seq"]: r["log_pgen"] for r in score.log_pgen(m, rep(spark, [*SIX, "W"]), log_absorption=math.log(a)).collect()}
    assert all(own[s] == pytest.approx(raw[s] - math.log(a)) for s in SIX) and own["W"] == md.LOG_EPS


def test_leaking_model_is_an_error(spark):
    e = spark.createDataFrame([("@_1", "A_2", "A", 1, 1.0), ("A_2", "B_3", "B", 1, 1.0)], "src string, dst string, tok string, cnt bigint, w double")
    m = md.Model(e, spark.createDataFrame([(1, 1)], "length int, cnt bigint"), "aap")
    with pytest.raises(md.ConvergenceError):
        simulate.simulate(m, 5)


def test_sampled_profile_and_mixture(spark):
    m = _many(spark)
    sims = simulate.simulate(m, 6000, 3)
    p, exact = analytics.sampled_profile(sims).first(), analytics.profile(m).first()
    assert abs(p["entropy_nats"] - exact["entropy_nats"]) < 5 * p["entropy_error"] and p["path_count"] <= exact["path_count"] * 1.2
    assert exact["min_log_pgen"] - 1e-9 <= p["min_log_pgen"] <= p["max_log_pgen"] <= exact["max_log_pgen"] + 1e-9
    mix = analytics.mixture(sims).cache()
    curve = analytics.mixture_curve(mix, [-100.0, -5.0, 100.0]).collect()
    assert curve[0]["cdf"] == pytest.approx(0) and curve[2]["cdf"] == pytest.approx(1) and curve[1]["pdf"] >= 0
    draws = analytics.mixture_sample(mix, 20_000, 1)
    mean = mix.agg(F.sum(F.col("weight") * F.col("mean"))).first()[0]
    assert draws.count() == 20_000 and abs(draws.agg(F.avg("log_pgen")).first()[0] - mean) < 0.1
    assert analytics.mixture_sample(mix.limit(0), 5).count() == 0


def test_feature_stats(spark):
    m = md.fit(rep(spark, SIX), "flashback")
    r = algebra.feature_stats(m).first()
    assert list(r.asDict()) == list(algebra.STATS) and r["d1"] == pytest.approx(math.exp(r["entropy_nats"])) and r["uniformity"] == pytest.approx(r["d1"] / r["d0"])
    lz = md.fit(rep(spark, SIX), "aap")
    assert algebra.feature_stats(lz, simulate.simulate(lz, 1000, 2)).first()["n_roots"] == 1.0


def test_accessors_and_errors(spark, tmp_path):
    m = md.fit(rep(spark, SIX), "aap")
    rows = structure.adjacency(m).orderBy("node").collect()
    assert [r["first"] for r in rows] == [sum(len(x["targets"]) for x in rows[:i]) for i in range(len(rows))] and sum(len(r["targets"]) for r in rows) == m.edges.count()
    assert not structure.has_gene_data(m) and structure.successors(m, "nowhere").count() == 0
    with pytest.raises(md.UnknownNodeError):
        structure.successors(m, "nowhere", strict=True)
    with pytest.raises(md.CorruptFileError):
        md.load(spark, str(tmp_path))
    cyclic = md.Model(spark.createDataFrame([("a", "b", "b", 1, 1.0), ("b", "a", "a", 1, 1.0)], "src string, dst string, tok string, cnt bigint, w double"), None, "naive")
    assert not structure.is_dag(cyclic)
    g = grammar.fit(rep(spark, SIX))
    assert grammar.sentinel_rule_weights(g).agg(F.sum("w")).first()[0] == pytest.approx(1)
    low, high = grammar.Solver(g).extremes(30)
    assert high == pytest.approx(grammar.Solver(g).best(1)[0][1]) and low == pytest.approx(grammar.Solver(g).best(1, most=False)[0][1])


def test_backtracking_walk():
    labels = ["@_1", "A_2", "B_2", "C$_4"]
    g = dp.LocalGraph(labels, ["@", "A", "B", "C$"], np.array([0, 0, 2]), np.array([1, 2, 3]), np.ones(3), np.array([0.99, 0.01, 1.0]), np.array([False, False, False, True]), 0)
    w = simulate.Walker(g, "flashback")
    got = w.walk_within(np.random.default_rng(1), {(0, 1), (0, 2), (2, 3)})
    assert got[0] == [0, 2, 3] and got[1] == pytest.approx(math.log(0.01))
    assert w.walk_within(np.random.default_rng(1), {(0, 1)}) is None


def test_sampling_is_calibrated(spark):
    m = md.fit(rep(spark, ["ACDEFGHIKLM", "NPQRSTVWY"], [3, 1]), "flashback")
    share = simulate.simulate(m, 8000, 5).filter("seq = 'ACDEFGHIKLM'").count() / 8000
    assert abs(share - 0.75) < 0.03
    lz = md.fit(rep(spark, SIX), "aap")
    sims = simulate.simulate(lz, 3000, 1).distinct()
    log_a = math.log(simulate.absorption(lz))
    both = sims.dropDuplicates(["seq"]).join(score.log_pgen(lz, sims, log_absorption=log_a), "seq")
    assert both.filter(F.abs(F.col("log_prob") - F.col("log_pgen")) > 1e-9).count() == 0
    again = simulate.simulate(lz, 3000, 1).orderBy("i").limit(5).collect()
    assert again == simulate.simulate(lz, 3000, 1).orderBy("i").limit(5).collect()


def test_algebra(spark):
    a, b = md.fit(rep(spark, SIX), "flashback"), md.fit(rep(spark, MORE), "flashback")
    edges = lambda m: {(r["src"], r["dst"]): (r["cnt"], round(r["w"], 12)) for r in m.edges.collect()}
    assert edges(algebra.union(a, b)) == edges(md.fit(rep(spark, SIX + MORE), "flashback"))
    assert edges(algebra.without(algebra.union(a, b), rep(spark, MORE))) == edges(a)
    assert edges(algebra.difference(algebra.union(a, b), b)) == edges(a)
    inner = edges(algebra.intersection(a, b))
    assert set(inner) == set(edges(a)) & set(edges(b))
    assert algebra.jensen_shannon(a, a).first()["jsd"] == pytest.approx(0)
    strong = edges(algebra.posterior(a, rep(spark, MORE), 1e12))
    assert all(abs(strong[k][1] - w) < 1e-6 for k, (_, w) in edges(a).items())
    sums = algebra.posterior(a, rep(spark, MORE), 2.0).edges.groupBy("src").agg(F.sum("w").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    with pytest.raises(md.ModelError):
        algebra.union(a, md.fit(rep(spark, SIX), "aap"))
    with pytest.raises(md.ModelError):
        algebra.posterior(a, rep(spark, SIX), -1)
    scaled = edges(md.fit(rep(spark, SIX, [10] * 6), "flashback"))
    assert {k: w for k, (_, w) in scaled.items()} == {k: w for k, (_, w) in edges(a).items()}


def test_structure_and_store(spark, tmp_path):
    df = spark.createDataFrame(list(zip(SIX, V, J, [1] * 6)), "seq string, v_gene string, j_gene string, abundance bigint")
    m = md.fit(df, "aap", genes=True)
    assert structure.is_dag(m) and structure.summary(m).first()["n_sequences"] == 6
    assert {(r["v_gene"], r["j_gene"]): r["prob"] for r in genes.joint(m).collect()} == pytest.approx({("TRBV5-1", "TRBJ1-1"): 1 / 6, ("TRBV5-1", "TRBJ2-7"): 3 / 6, ("TRBV12-3", "TRBJ1-1"): 2 / 6})
    md.save(m, str(tmp_path / "m"))
    back = md.load(spark, str(tmp_path / "m"))
    assert sorted(back.edges.collect()) == sorted(m.edges.collect()) and back.variant == "aap" and genes.marginals(back).count() == 4
    sims = simulate.simulate_genes(m, 200, 3, v_gene="TRBV12-3").collect()
    assert {r["v_gene"] for r in sims} == {"TRBV12-3"} and {r["seq"] for r in sims} <= set(SIX[2:4]) | {r["seq"] for r in sims if r["seq"] not in SIX}
    assert genes.edges_with_gene(m, "v", "TRBV12-3").count() < m.edges.count()
    with pytest.raises(md.NoGeneDataError):
        genes.joint(md.fit(rep(spark, SIX)))


def test_empty_model(spark):
    m = md.fit(rep(spark, SIX).limit(0), "flashback")
    assert m.edges.count() == 0 and dp.jets(m, [(1.0, 1)])[1.0, 1] == [0.0, 0.0]
    assert {r["log_pgen"] for r in score.log_pgen(m, rep(spark, SIX)).collect()} == {md.LOG_EPS}
    s = structure.summary(m).first()
    assert s["n_nodes"] == 0 and s["density"] == 0.0


def test_grammar(spark, tmp_path):
    words = ["CASSYAGLDYF", "CASSLGQGAYEQYF", "CASSPGTGAYEQYF", "CASSYGYF", "CASSLGELFF", "CASRDGRANVLTF"]
    g = grammar.fit(rep(spark, words), backoff="good_turing")
    mle = {r["seq"]: r["log_pgen"] for r in grammar.log_pgen(g, rep(spark, [*words, "WWWW", ""]), "none").collect()}
    assert all(mle[w] > -690 for w in words) and mle["WWWW"] == mle[""] == md.LOG_EPS
    gt = {r["seq"]: r["log_pgen"] for r in grammar.log_pgen(g, rep(spark, words)).collect()}
    assert all(gt[w] <= mle[w] + 1e-12 for w in words)
    s = grammar.Solver(g)
    assert s.spectral_radius() < 1 and s.by_length(400).sum() == pytest.approx(1, abs=1e-6)
    sims = grammar_sims = simulate.simulate_grammar(g, 4000, 2)
    h = -sims.agg(F.avg("log_prob")).first()[0]
    assert abs(h - s.entropy()) < 0.2 and grammar_sims.filter("seq = ''").count() == 0
    best = s.best(3)
    scored = {r["seq"]: r["log_pgen"] for r in grammar.log_pgen(g, spark.createDataFrame([(b[0],) for b in best], "seq string"), "none").collect()}
    assert all(scored[w] == pytest.approx(lp) for w, lp in best)
    more = grammar.fit(rep(spark, [*words, "CASF"]))
    rules = lambda x: {tuple(r[c] for c in [*grammar.NT, *grammar.RULE]): (r["cnt"], round(r["w"], 9)) for r in x.rules.collect()}
    assert rules(grammar.without(more, rep(spark, ["CASF"]))) == rules(g)
    post = grammar.posterior(g, rep(spark, words[:2]), 5.0)
    assert all(abs(r["s"] - 1) < 1e-9 for r in post.rules.groupBy(*grammar.NT).agg(F.sum("w").alias("s")).collect())
    grammar.save(g, str(tmp_path / "g"))
    assert rules(grammar.load(spark, str(tmp_path / "g"))) == rules(g)
    with pytest.raises(md.ModelError):
        grammar.without(g, rep(spark, words))


def test_saturation_and_k_diversity(spark):
    idx = spark.createDataFrame([(i + 1, s) for i, s in enumerate(SIX)], "idx bigint, seq string")
    curve = {r["n_seqs"]: (r["n_nodes"], r["n_edges"]) for r in occupancy.saturation(idx, "aap", 2).collect()}
    for n in (2, 4, 6):
        m = md.fit(rep(spark, SIX[:n]), "aap")
        assert curve[n] == (m.nodes().count(), m.edges.count())
    full = occupancy.k_diversity(rep(spark, SIX), 6, draws=5).first()
    assert full["std"] == 0 and full["mean"] == len({t for s in SIX for t in lz_by_hand(f"@{s}$")})


def test_sharing_and_richness(spark):
    pmf = occupancy.sharing_pmf(0.01, np.array([10.0, 20.0]), 2)
    q = 1 - np.exp(-0.01 * np.array([10.0, 20.0]))
    assert pmf == pytest.approx([q[0] * (1 - q[1]) + q[1] * (1 - q[0]), q[0] * q[1]])
    m = _recombining(spark)
    curve = {r["depth"]: r["richness"] for r in occupancy.richness_curve(simulate.simulate(m, 4000, 9), [50.0]).collect()}
    p = np.array([1, 3, 3, 9]) / 16
    assert curve[50.0] == pytest.approx((1 - np.exp(-50 * p)).sum(), abs=0.05)
    assert occupancy.wynn([sum((-1) ** k / (k + 1) for k in range(n)) for n in range(1, 15)]) == pytest.approx(math.log(2), abs=1e-8)


def test_scale(spark, tmp_path):
    m = md.fit(rep(spark, SIX + MORE), "flashback")
    cal = simulate.calibrate_scale(simulate.simulate(m, 2000, 4), 50)
    simulate.save_calibration(cal, str(tmp_path / "cal"))
    assert sorted(map(str, simulate.load_calibration(spark, str(tmp_path / "cal")).collect())) == sorted(map(str, cal.collect()))
    out = {r["seq"]: r["scale"] for r in simulate.scale_scores(score.log_pgen(m, rep(spark, SIX)), cal).collect()}
    assert set(out) == set(SIX) and all(math.isfinite(v) for v in out.values())


def test_scaffold(spark):
    m = md.fit(rep(spark, SIX), "flashback")
    r = scaffold.residues(rep(spark, SIX))
    assert r.groupBy("seq").count().filter(F.col("count") != F.length("seq")).count() == 0
    own = {x["seq"]: (list(x["tokens"]), list(x["latent"])) for x in scaffold.align(m, rep(spark, SIX)).collect()}
    assert set(own) == set(SIX) and all(len(a) == len(b) for a, b in own.values())
    occ = scaffold.occupancy(m, rep(spark, SIX))
    assert occ.filter("not in_scaffold").count() == 0 and occ.agg(F.sum("n_seqs")).first()[0] == sum(map(len, SIX))


def test_diagnostics(spark):
    m = md.fit(rep(spark, SIX), "flashback")
    d = score.approximation_diagnostics(m, rep(spark, [*SIX, "WWWW"], [1, 2, 3, 4, 5, 6, 1])).first()
    assert d["n_types"] == 7 and d["coverage_types"] == pytest.approx(6 / 7) and d["kl"] == pytest.approx(d["cross_entropy"] - d["entropy"])
    p = score.repertoire_perplexity(score.log_pgen(m, rep(spark, [*SIX, "WWWW"]))).first()
    assert math.isinf(p["perplexity"]) and p["entropy_rate"] > 0


def test_joined_walks(spark, monkeypatch):
    """A model above the bound of a broadcast: every walk once, scored alike, its frequencies those of the model, the same when drawn again."""
    m = _many(spark)
    monkeypatch.setattr(simulate, "MAX_WALKER", 10)
    sims = simulate.simulate(m, 6000, 3).persist()
    rows = {r["i"]: r["seq"] for r in sims.collect()}
    assert sorted(rows) == list(range(6000)) and rows == {r["i"]: r["seq"] for r in simulate.simulate(m, 6000, 3).collect()}
    scores = {r["seq"]: r["log_pgen"] for r in score.log_pgen(m, sims).collect()}
    assert all(r["log_prob"] == pytest.approx(scores[r["seq"]]) for r in sims.collect())
    exact = {r["seq"]: math.exp(r["log_pgen"]) for r in spectrum.atoms(m).collect()}
    drawn = {s: list(rows.values()).count(s) / 6000 for s in set(rows.values())}
    assert all(abs(drawn.get(s, 0) - p) < 5 * math.sqrt(p * (1 - p) / 6000) for s, p in exact.items())
    empty = md.Model(m.edges.limit(0), m.lengths, "flashback")
    monkeypatch.setattr(simulate, "MAX_WALKER", -1)
    with pytest.raises(md.ModelError):
        simulate.simulate(empty, 5)


def _above_the_bound(spark, monkeypatch, name):
    """Rows of a query whose model is above the bound of a broadcast."""
    from reploom.plans.model_queries import QUERIES

    monkeypatch.setattr(simulate, "MAX_WALKER", 10)
    return [r.asDict() for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()]


def test_hill_mc_above_the_bound(spark, monkeypatch):
    assert [r["within"] for r in _above_the_bound(spark, monkeypatch, "hill_mc")] == [True, True]


def test_sampled_profile_above_the_bound(spark, monkeypatch):
    r = _above_the_bound(spark, monkeypatch, "sampled_profile")[0]
    assert r["n_walks"] == 10_000 and r["entropy_within"] and r["range_within"]


def test_scale_scores_above_the_bound(spark, monkeypatch):
    r = _above_the_bound(spark, monkeypatch, "scale_scores")[0]
    assert r["n"] == r["n_finite"] > 0 and r["centred"]


def test_feature_mass_profile_above_the_bound(spark, monkeypatch):
    rows = _above_the_bound(spark, monkeypatch, "feature_mass_profile")
    assert len(rows) > 5 and all(r["within"] for r in rows)


def test_simulate_flashback_above_the_bound(spark, monkeypatch):
    r = _above_the_bound(spark, monkeypatch, "simulate_flashback")[0]
    assert r["n"] == r["n_ids"] == r["n_scored_alike"] == 10_000 and r["mean_within"]


@pytest.mark.parametrize("most", [True, False])
def test_k_best_keeps_k_paths_only(most):
    """The best of a wide graph against all best paths of every node, in memory that does not hold those."""
    import tracemalloc

    rng, layers, width, fan, k = np.random.default_rng(5), 6, 200, 10, 100
    labels = [f"n{i:05d}" for i in range(1 + layers * width)]
    src, dst = [0] * width, list(range(1, 1 + width))
    for at in range(1, 1 + (layers - 1) * width):
        after = 1 + ((at - 1) // width + 1) * width
        src += [at] * fan
        dst += sorted(after + rng.choice(width, fan, replace=False))
    w = rng.integers(1, 9, len(src)) / 16  # few values, so many ties
    sink = np.arange(len(labels)) > (layers - 1) * width
    g = dp.LocalGraph(labels, labels, np.array(src), np.array(dst), np.ones(len(src)), w, sink, 0)
    kept, sign = {0: [(0, ())]}, -1 if most else 1  # products of whole numbers, so that ties are exact
    for s, d, x in zip(src, dst, np.round(w * 16).astype(int).tolist()):
        kept.setdefault(int(d), []).extend((sign * (abs(p) or 1) * x, (*q, int(d))) for p, q in kept[s])
        if s + 1 == d or len(kept[int(d)]) > 4 * k:
            kept[int(d)] = sorted(kept[int(d)])[:k]
    want = sorted(x for n in np.flatnonzero(sink) for x in kept.get(int(n), []))[:k]
    tracemalloc.start()
    got = dp.k_best(None, k, most, g)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [lp for lp, _ in got] == pytest.approx([math.log(abs(p)) - layers * math.log(16) for p, _ in want])
    assert sorted(p[1:] for _, p in got) == sorted([labels[n] for n in q] for _, q in want)
    assert peak < 3e6
