"""Tests between systems, agreement, expansion statistics, figures: against brute force and hand counts."""

import random
from itertools import permutations, product
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from irspan.functions.text import NO_STEM, PLAIN
from irspan.operators import agreement, expansion, generation, metrics, significance
from irspan.plans import figures


def values(spark, xs):
    return spark.createDataFrame([(f"q{i:03}", float(x)) for i, x in enumerate(xs)], "query_id string, value double")


@pytest.mark.parametrize("seed", range(4))
def test_exact_signs(spark, seed):
    r = random.Random(seed)
    d = [r.choice([0.0, 0.125, -0.25, 0.5, r.uniform(-1, 1)]) for _ in range(r.randrange(3, 11))]
    sums = [sum(s * x for s, x in zip(signs, d)) for signs in product((1, -1), repeat=len(d))]
    row = significance.paired_test(values(spark, d), values(spark, [0] * len(d))).first()
    assert row.p_value == pytest.approx(sum(abs(s) + 1e-12 >= abs(sum(d)) for s in sums) / len(sums)) and row.delta == pytest.approx(sum(d) / len(d))
    assert (row.n, row.ties, row.effective_queries, row.method, row.seed) == (len(d), d.count(0.0), len(d) - d.count(0.0), "exact", None)


def test_sampled_signs(spark):
    ahead = significance.paired_test(values(spark, [0.5] * 25), values(spark, [0.25] * 25), 400, 3).first()
    assert (ahead.method, ahead.assignments, ahead.seed) == ("monte-carlo", 400, 3) and ahead.p_value == pytest.approx(1 / 401)
    r = random.Random(2)
    a, b = ([r.random() for _ in range(30)] for _ in range(2))
    far = significance.paired_test(values(spark, a), values(spark, b), 2000).first()
    assert far.p_value == pytest.approx(significance.numpy_paired_test(significance.aligned(values(spark, a), values(spark, b)), 2000).first().p_value, abs=0.05)
    with pytest.raises(Exception, match="only one system has query q002"):
        significance.aligned(values(spark, [1, 2, 3]), values(spark, [1, 2])).collect()


@pytest.mark.parametrize(("start", "count"), [(0, 1), (0, 7), (3, 10), (8, 0), (1001, 512)])
def test_signs_of_the_stream_anywhere(start, count):
    whole = np.random.default_rng(11).choice(np.array([-1.0, 1.0]), size=2000)
    assert significance.stream_signs(11, start, count).tolist() == whole[start : start + count].tolist()


@pytest.mark.parametrize(("n", "block"), [(17, 4096), (40, 7), (200, 64)])
def test_published_p_values(spark, monkeypatch, n, block):
    """Both tests give what NumPy's generator gives in one process, whatever the blocks."""
    monkeypatch.setattr(significance, "BLOCK_QUERIES", block)
    monkeypatch.setattr(significance, "BLOCK_SIGNS", 3000)
    monkeypatch.setattr(significance, "STATE_EVERY", 130)
    r = np.random.default_rng(n)
    a, b = np.round(r.random(n), 1), np.round(r.random(n) + 0.05, 1)
    signs = np.random.default_rng(5).choice(np.array([-1.0, 1.0]), size=(500, n))
    d = a - b
    hits = int((np.abs(signs @ d) + 1e-12 * max(1.0, abs(d.sum())) >= abs(d.sum())).sum())
    row = significance.numpy_paired_test(significance.aligned(values(spark, a.tolist()), values(spark, b.tolist())), 500, 5).first()
    assert (row.p_value, row.n, row.ties) == ((hits + 1) / 501, n, int((d == 0).sum()))
    ranks = [np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]) for v in (a, b)]
    x, y = (v - v.mean() for v in ranks)
    scale = np.sqrt((x**2).sum() * (y**2).sum())
    observed = (x * y).sum() / scale
    rng = np.random.default_rng(5)
    hits = sum(abs((x * rng.permutation(y)).sum() / scale) + 1e-12 >= abs(observed) for _ in range(500))
    pairs = spark.createDataFrame([(f"q{i:03}", float(u), float(v)) for i, (u, v) in enumerate(zip(a, b))], "query_id string, x double, y double")
    row = significance.numpy_correlation_test(pairs, 500, 5).first()
    assert (row.p_value, row.n) == ((hits + 1) / 501, n) and row.rho == pytest.approx(observed, abs=1e-12)
    assert significance.numpy_correlation_test(pairs.withColumn("x", pairs.x * 0), 50).first()[:2] == (0.0, 1.0)


def step_down(ps):
    order = sorted(range(len(ps)), key=lambda i: (ps[i], i))
    out, most = [0.0] * len(ps), 0.0
    for k, i in enumerate(order):
        most = max(most, (len(ps) - k) * ps[i])
        out[i] = min(1.0, most)
    return out


def test_holm(spark):
    for ps in ([0.2, 0.01, 0.012, 0.04], [0.4, 0.4, 0.9], [0.03], [0.0, 1.0]):
        rows = significance.holm(spark.createDataFrame(list(enumerate(ps)), "position int, p double")).orderBy("position").collect()
        assert [x.adjusted for x in rows] == pytest.approx(step_down(ps))
    for bad in ([(0, -0.1)], [(0, float("nan"))], [(0, None)], []):
        with pytest.raises(ValueError):
            significance.holm(spark.createDataFrame(bad, "position int, p double"))


def slow_ranks(xs):
    return [sum(y < x for y in xs) + (xs.count(x) + 1) / 2 for x in xs]


def slow_rho(xs, ys):
    a, b = slow_ranks(xs), slow_ranks(ys)
    n, ma, mb = len(a), sum(a) / len(a), sum(b) / len(b)
    va, vb = sum((x - ma) ** 2 for x in a), sum((y - mb) ** 2 for y in b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / (va * vb) ** 0.5 if va and vb else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_rank_correlation(spark, seed):
    r = random.Random(seed)
    xs, ys = ([float(r.randrange(6)) for _ in range(7)] for _ in range(2))
    pairs = spark.createDataFrame([(f"q{i}", x, y) for i, (x, y) in enumerate(zip(xs, ys))], "query_id string, x double, y double")
    assert significance.spearman(pairs).first()[:] == (pytest.approx(slow_rho(xs, ys)), 7)
    row = significance.correlation_test(pairs, 3000).first()
    rho = slow_rho(xs, ys)
    exact = [abs(slow_rho(xs, list(p))) + 1e-9 >= abs(rho) for p in permutations(ys)]
    assert row.rho == pytest.approx(rho) and row.p_value == pytest.approx(sum(exact) / len(exact), abs=0.05)
    flat = pairs.withColumn("y", F.lit(2.0))
    assert significance.correlation_test(flat, 20).first()[:2] == (0.0, 1.0) and significance.spearman(flat).first().rho == 0.0


@pytest.mark.parametrize("n", [2, 3, 10, 11])
def test_thirds(spark, n):
    rows = spark.createDataFrame([(f"q{i:02}", float(i // 2), float(i)) for i in range(n)], "query_id string, predictor double, advantage double")
    got = {x.tercile: (x.n, x.low, x.high, x.mean_advantage) for x in significance.terciles(rows).collect()}
    want, at = {}, 0
    for t in (1, 2, 3):
        size = n // 3 + (t <= n % 3)
        part = range(at, at + size)
        at += size
        if part:
            want[t] = (size, part[0] // 2, part[-1] // 2, sum(part) / size)
    assert got == want


def test_families(spark):
    rows = spark.createDataFrame([("max_idf", 0.3, 0.01), ("max_idf", 0.1, 0.2), ("max_idf", 0.2, 0.04)], "predictor string, rho double, p double")
    assert significance.family_summary(rows).first()[:] == (True, 2, 0.1, 0.3, 0.2)
    with pytest.raises(ValueError, match="different predictors"):
        significance.family_summary(rows.unionByName(rows.withColumn("predictor", F.lit("num_terms"))))


# ---- agreement


def slow_kappa(pairs):
    n = len(pairs)
    po = sum(a == b for a, b in pairs) / n
    pc = sum(sum(a == x for a, _ in pairs) * sum(b == x for _, b in pairs) for x in {y for p in pairs for y in p}) / n**2
    return po, pc, 0.0 if pc >= 1 else (po - pc) / (1 - pc)


@pytest.mark.parametrize("pairs", [[(0, 1), (1, 1), (2, 2), (2, 0), (0, 0)], [(1, 1)] * 4, [(0, 1), (1, 0)] * 3, [(3, 4)]])
def test_kappa(spark, pairs):
    frame = spark.createDataFrame(pairs, "first int, second int")
    row = agreement.kappa(frame).first()
    assert (row.observed, row.chance, row.kappa) == pytest.approx(slow_kappa(pairs)) and row.n == len(pairs)
    labels = sorted({x for p in pairs for x in p})
    assert {(r.first, r.second): r.n for r in agreement.confusion(frame).collect()} == {(a, b): pairs.count((a, b)) for a in labels for b in labels}


def test_what_agreement_refuses(spark):
    none = spark.createDataFrame([], "first int, second int")
    with pytest.raises(ValueError, match="no items"):
        agreement.kappa(none)
    with pytest.raises(ValueError, match="yes or no"):
        agreement.calibrated(spark.createDataFrame([(1, "perhaps"), (0, None)], "grade int, answer string"))
    many = agreement.confusion(spark.createDataFrame([(i, 0) for i in range(60)], "first int, second int"))
    assert many.count() == 3600 and many.where("n > 0").count() == 60


def test_calibration(spark):
    rows = [(2, "Yes"), (1, "no"), (0, "Yes."), (0, "No"), (0, "?"), (-1, "no")]
    row = agreement.calibrated(spark.createDataFrame(rows, "grade int, answer string")).first()
    assert (row.n, row.unparseable, row.false_positives, row.false_negatives, row.yes_rate) == (5, 1, 1, 1, 0.4)
    assert row.kappa == pytest.approx(slow_kappa([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)])[2])


def test_pools(spark):
    qrels = spark.createDataFrame([("x", f"d{i}", i % 3 - 1) for i in range(9)] + [("y", "d1", 1), ("y", "d7", 0)], "query_id string, doc_id string, grade int")
    run = spark.createDataFrame([("x", "d4", 5.0), ("x", "e1", 4.0), ("x", "d2", 3.0), ("y", "d7", 2.0), ("y", "d1", 1.0)], "query_id string, doc_id string, score double")
    pool = lambda depth: {(r.query_id, r.doc_id, r.grade) for r in agreement.judgeable_pairs(qrels, run, depth, "retrieved", 0).collect()}
    assert pool(1) == {("x", "d4", 0), ("y", "d7", 0)} and pool(3) == {("x", "d4", 0), ("x", "d2", 1), ("y", "d7", 0), ("y", "d1", 1)}
    assert agreement.judgeable_pairs(qrels, min_per_class=4).count() == 11
    for bad in ({"min_per_class": 30}, {"source": "elsewhere"}, {"source": "retrieved"}):
        with pytest.raises(ValueError):
            agreement.judgeable_pairs(qrels, **bad)
    with pytest.raises(ValueError, match="isn't relevant"):
        agreement.judgeable_pairs(qrels.where("grade > 0"), min_per_class=0)


@pytest.mark.parametrize(("n", "most"), [(50, 7), (9, 9), (100, 33), (5, 80)])
def test_thinning(spark, n, most):
    pairs = [("a" if i < 20 else "b", f"d{i:03}", i) for i in range(n)]
    kept = agreement.thinned(spark.createDataFrame(pairs, "query_id string, doc_id string, grade int").repartition(5), most).collect()
    want = pairs if n <= most else [sorted(pairs)[int(i * (n / most))] for i in range(most)]
    assert sorted(tuple(r) for r in kept) == sorted(want)


# ---- expansion


@pytest.mark.parametrize("tokenizer", [PLAIN, NO_STEM])
def test_expansion_statistics(spark, tokenizer):
    """Words are those of white space, whatever the tokenizer drops; blank generations are empty."""
    texts = {"a": "low tide", "b": "the crane", "c": "fog", "d": "a buoy", "e": "rope", "f": None}
    made = {"a": ["tide-table, low tide"], "b": ["the of", " "], "c": ["\t", ""], "d": ["red buoy.", "where is it?"], "f": ["winch 9"]}
    row = expansion.summarise_expansions(spark.createDataFrame(list(texts.items()), "id string, text string"), spark.createDataFrame(list(made.items()), "id string, generations array<string>"), tokenizer).first()
    import re

    terms = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in (tokenizer.stopwords or ())}
    words, added, share = [], [], []
    for k, t in texts.items():
        whole = " ".join(g.strip() for g in made.get(k, []) if g.strip())
        if whole:
            new = terms(whole) - terms(t)
            words.append(len(whole.split()))
            added.append(len(new))
            share.append(len(new) / len(terms(whole)) if terms(whole) else 0.0)
    assert (row.inputs, row.empty, row.adding_nothing) == (6, 2, added.count(0))
    assert (row.words_median, row.added_median, row.words_min, row.words_max) == (median(words), median(added), min(words), max(words))
    assert (row.words_mean, row.added_mean, row.mean_fraction) == (round(sum(words) / len(words), 4), round(sum(added) / len(added), 4), round(sum(share) / len(share), 4))


def test_expansion_statistics_of_nothing(spark):
    row = expansion.summarise_expansions(spark.createDataFrame([("a", "x")], "id string, text string"), spark.createDataFrame([], "id string, generations array<string>")).first().asDict()
    assert (row.pop("inputs"), row.pop("empty")) == (1, 1) and set(row.values()) == {0}


# ---- generation


def shouting(prompts, settings):
    return [[f" {p.split(': ')[-1].upper()} {i}" for i in range(settings.generations)] for p in prompts]


def yes_to_tide(prompts, settings):
    assert len(prompts) <= settings.batch_size
    return [["yes" if "tide" in p else "no"] for p in prompts]


def test_generation(spark):
    texts = spark.createDataFrame([("b", "fog"), ("a", "tide"), ("c", None)], "id string, text string").repartition(3)
    two = generation.Settings("shout", 2, batch_size=2, sample=True)
    assert {r.id: r.generations for r in generation.generate(texts, shouting, two, "Write: {text}").collect()} == {"a": ["TIDE 0", "TIDE 1"], "b": ["FOG 0", "FOG 1"], "c": ["0", "1"]}
    assert sorted(r.id for r in generation.generate(texts, shouting, two, limit=2).collect()) == ["a", "b"]
    assert two.describe("query-expansion")["method"] == "query-expansion" and two.describe("x")["seed"] == 0
    with pytest.raises(ValueError, match="same text"):
        generation.Settings(generations=3)
    seeds = {r.id: r.generations[0] for r in generation.generate(texts, lambda prompts, s: [[str(s.seed)] * 2] * len(prompts), two).collect()}
    again = {r.id: r.generations[0] for r in generation.generate(texts.repartition(1), lambda prompts, s: [[str(s.seed)] * 2] * len(prompts), two).collect()}
    assert seeds == again and len(set(seeds.values())) > 1
    with pytest.raises(Exception, match="asked number"):
        generation.generate(texts, lambda prompts, s: [], two).collect()
    pairs = spark.createDataFrame([("q", "1", "when", "high tide"), ("q", "2", "when", "fog" * 500 + " tide"), ("p", "1", None, None)], "query_id string, doc_id string, query_text string, document string")
    assert {(r.query_id, r.doc_id): r.answer for r in generation.judge(pairs, yes_to_tide).collect()} == {("q", "1"): "yes", ("q", "2"): "no", ("p", "1"): "no"}


# ---- figures


@pytest.mark.parametrize(("low", "high", "most"), [(0.31, 0.36, 7), (0, 1, 5), (-3, 12, 4), (99.9, 100.1, 7), (1e-6, 3e-6, 3), (0.2, 0.7, 11)])
def test_ticks_cover_the_range(low, high, most):
    ticks = figures.nice_ticks(low, high, most)
    assert ticks[0] <= low and ticks[-1] >= high and 2 <= len(ticks) <= most
    steps = {round(b - a, 9) for a, b in zip(ticks, ticks[1:])}
    assert len(steps) == 1 and f"{steps.pop():e}"[:3] in ("1.0", "2.0", "5.0")


def test_ticks_need_a_range():
    for low, high in ((1, 1), (2, 1), (float("nan"), 1)):
        with pytest.raises(ValueError):
            figures.nice_ticks(low, high)


ROWS = [{"name": "plain", "group": "words", "values": {"x": 0.4, "y": 0.1}}, {"name": "vec <1>", "group": "vectors", "values": {"x": 0.5, "y": 0.1}}, {"name": "both", "group": "words", "values": {"x": 0.45, "y": 0.4}}]


def test_plots():
    plot = lambda **kw: figures.dot_plot_svg(**{"rows": ROWS, "panels": ["x", "y"], "title": "T & U", "reference": "plain", **kw})
    import xml.etree.ElementTree as ET

    svg = plot(subtitle="means")
    assert svg == plot(subtitle="means")
    tree, ns = ET.fromstring(svg), "{http://www.w3.org/2000/svg}"
    words = [t.text for t in tree.iter(f"{ns}text")]
    assert {"T & U", "means", "vec <1>", "0.5000 (+0.1000)", "0.1000 (+0.0000)", "0.4000 (+0.3000)"} <= set(words) and words.count("both") == 2
    marks = [p for p in tree.iter(f"{ns}path") if p.get("class") == "mark"]
    place = [float(p.get("transform")[10:].split(",")[0]) for p in marks]
    assert len(marks) == 6 and place[0] < place[2] < place[1] and place[3] == place[4] < place[5] and marks[0].get("d") == marks[2].get("d") != marks[1].get("d")
    assert len([p for p in tree.iter(f"{ns}path") if p.get("class") == "stem"]) == 6
    flat = [{"name": "a", "group": "g", "values": {"x": 0.3}}]
    assert ET.fromstring(figures.dot_plot_svg(flat, ["x"], "t", "a")) is not None
    assert [r["name"] for r in figures.by_gain(ROWS, ROWS[0])] == ["both", "vec <1>", "plain"]
    for bad, match in (({"panels": ["x", "z"]}, "no value for z"), ({"groups": ["words"]}, "unknown group"), ({"reference": "none"}, "no row")):
        with pytest.raises(ValueError, match=match):
            plot(**bad)


def test_labels_of_runs():
    label = figures.run_label
    assert label({"settings": {"model": "rm3", "fb_docs": 5, "fb_terms": 50, "alpha": 0.8, "tokenizer": {"stemmer": "s"}}}) == "rm3 [rm3]: fb_docs 5, fb_terms 50, alpha 0.8, stemmed"
    assert label({"tag": "mine", "settings": {"method": "rrf", "k": 5, "retrievers": [{"model": "bm25"}, {"method": "dense"}]}}) == "mine [rrf]: k 5, retrievers bm25+dense"
    assert label({"settings": {"method": "dense", "model": "m", "truncation_rate": 0.126}}) == "dense [dense]: model m, truncated 13 %" and label({}) == "run [run]"


def test_formulations(spark):
    rows = [("short", "a", "ndcg@10", 0.5), ("short", "b", "ndcg@10", 0.25), ("long", "a", "ndcg@10", 0.75), ("long", "a", "recall@10", 1.0)]
    means = metrics.formulation_means(spark.createDataFrame(rows, "formulation string, query_id string, metric string, value double"), 0.5)
    assert {(r.formulation, r.metric): (r.value, r.num_queries, r.delta_to_published) for r in means.collect()} == {("short", "ndcg@10"): (0.375, 2, -0.125), ("long", "ndcg@10"): (0.75, 1, 0.25), ("long", "recall@10"): (1.0, 1, None)}
    assert metrics.formulation_spread(means.where("metric = 'ndcg@10'")).first().spread == 0.375
