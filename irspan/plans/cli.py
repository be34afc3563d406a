"""Command line: ``python -m irspan.plans.cli COMMAND --data FOLDER --dataset NAME ...``.

Models are plug-ins named ``module:attribute``: an encoder object for dense and learned retrieval, a
function from query_text, title and text to a score Column for reranking, a text model for generation and
judging.  Results go to ``--results``: a summary and values by query a run, other records as JSON.
"""

from __future__ import annotations

import argparse
import json
import sys
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.functions.text import STOPWORDS, Tokenizer, document_text
from irspan.operators import agreement, combine, expansion, generation, metrics, significance, sweeps
from irspan.operators.bm25 import BM25Retriever, MultiFieldBM25Retriever
from irspan.operators.physical import written
from irspan.operators.retrievers import DenseRetriever, ExpandedRetriever, LateInteractionRetriever, SparseRetriever
from irspan.operators.rm3 import RM3Retriever
from irspan.plans import figures
from irspan.plans.service import SearchService
from irspan.sources import datasets

# Names of query formulations, as stored records have them, and the record's fields in each.
FORMULATIONS = {
    "text": ["text"],
    "metadata.query": ["metadata.query"],
    "metadata.narrative": ["metadata.narrative"],
    "query+text": ["metadata.query", "text"],
    "query+text+narrative": ["metadata.query", "text", "metadata.narrative"],
}


def plugin(name: str):
    """The object that ``module:attribute`` names."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"{name} isn't of the form module:attribute")
    return getattr(import_module(module), attribute)


class Run:
    """What the commands share: the session, the dataset and the options."""

    def __init__(self, options: argparse.Namespace):
        self.o, self.spark = options, SparkSession.builder.getOrCreate()

    def data(self, split: str | None = None) -> datasets.Dataset:
        return datasets.load_dataset(self.spark, self.o.dataset, split or self.o.split, self.o.data)

    def tokenizer(self) -> Tokenizer:
        return Tokenizer(None if self.o.no_stopwords else STOPWORDS, not self.o.no_stem)

    def lexical(self) -> BM25Retriever:
        make = BM25Retriever if self.o.single_field else MultiFieldBM25Retriever
        return make(k1=self.o.k1, b=self.o.b, tokenizer=self.tokenizer())

    def feedback(self) -> RM3Retriever:
        o = self.o
        return RM3Retriever(o.fb_docs, o.fb_terms, o.alpha, o.k1, o.b, self.tokenizer(), not o.single_field)

    def neural(self, kind: str):
        o = self.o
        if not o.encoder:
            raise ValueError(f"{kind} needs --encoder module:attribute")
        encoder = plugin(o.encoder)
        if kind == "dense":
            return DenseRetriever(encoder, o.chunk_words, o.chunk_overlap, o.encoder, o.max_tokens)
        return SparseRetriever(encoder, o.top_terms, o.encoder) if kind == "splade" else LateInteractionRetriever(encoder, o.encoder)

    def system(self, name: str):
        if name == "bm25":
            return self.lexical()
        return self.feedback() if name == "rm3" else self.neural(name)

    def scored(self, run: DataFrame, data: datasets.Dataset, settings: dict, name: str, published: float | None = None, **more) -> dict:
        """Evaluate a run, keep its values, and print its means."""
        values = written(metrics.evaluate_per_query(run, data.qrels, (10, self.o.top_k), (self.o.gain,)), "values")
        means = metrics.macro_mean(values)
        found = {r.metric: r.value for r in means.collect()}
        run_id = self.o.run_id or f"{self.o.dataset}-{name}" + (f"-{self.o.tag}" if self.o.tag else "")
        summary = {"run": run_id, "dataset": self.o.dataset, "split": data.split, "tag": self.o.tag, "settings": settings, "gain": self.o.gain, **more}
        datasets.write_results(means.withColumn("settings", F.lit(json.dumps(settings, default=str))), values, self.o.results, run_id)
        within = published is None or abs(found["ndcg@10"] - published) <= metrics.TOLERANCE
        return {**summary, "label": figures.run_label({"tag": self.o.tag, "settings": settings}), **found, "published": published, "within": within}

    def record(self, record: dict, name: str) -> dict:
        datasets.write_record(self.spark, record, self.o.output or f"{self.o.results}/{self.o.dataset}-{name}")
        return record

    def values(self, run_id: str) -> DataFrame:
        return datasets.read_per_query(self.spark, self.o.results, run_id, self.o.metric)

    def statistics(self, data: datasets.Dataset) -> DataFrame:
        index = BM25Retriever(self.o.k1, self.o.b, self.tokenizer()).index(data.corpus)
        return written(index.query_statistics(data.queries), "statistics")


def baseline(r: Run) -> dict:
    """BM25, against the published value."""
    data = r.data()
    retriever = r.lexical().index(data.corpus)
    profile = metrics.qrels_profile(data.qrels).first().asDict()
    published = metrics.PUBLISHED_NDCG_10.get(r.o.dataset)
    return r.scored(retriever.retrieve(data.queries, r.o.top_k), data, retriever.describe(), "bm25", published, qrels=profile)


def dense(r: Run) -> dict:
    data = r.data()
    retriever = r.neural("dense").index(data.corpus)
    return r.scored(retriever.retrieve(data.queries, r.o.top_k), data, retriever.describe(), "dense")


def learned(r: Run) -> dict:
    """Learned sparse or late interaction, against the published value of the method."""
    data = r.data()
    retriever = r.neural(r.o.method).index(data.corpus)
    published = metrics.PUBLISHED_LEARNED[r.o.method].get(r.o.dataset)
    return r.scored(retriever.retrieve(data.queries, r.o.top_k), data, retriever.describe(), r.o.method, published)


def rm3(r: Run) -> dict:
    """Feedback, or the sweep of its parameters."""
    data = r.data()
    corpus = data.corpus
    if r.o.document_expansions:
        corpus = expansion.expand_documents(corpus, datasets.read_expansions(r.spark, r.o.document_expansions))
    retriever = r.feedback().index(corpus)
    if r.o.sweep:
        return _swept(r, sweeps.sweep_rm3(retriever, data.queries, data.qrels), "rm3-sweep", ("fb_docs", "fb_terms", "alpha"))
    return r.scored(retriever.retrieve(data.queries, r.o.top_k), data, retriever.describe(), "rm3")


def _swept(r: Run, cells: DataFrame, name: str, axes: tuple[str, ...]) -> dict:
    cells = written(cells, "cells")
    rows = [row.asDict() for row in cells.orderBy("cell").collect()]  # a row a cell
    out = {"split": r.o.split, "best": sweeps.best_cell(cells).first().asDict(), "surface": sweeps.surface(cells).first().asDict(), "by_axis": {a: [row.asDict() for row in sweeps.best_by_axis(cells, a).orderBy(a).collect()] for a in axes}}
    if len(axes) == 1:
        out["shape"] = sweeps.shape(cells.select(F.col(axes[0]).cast("double").alias("x"), F.col("ndcg").alias("value"))).first().asDict()
    r.record({**out, "cells": rows}, name)
    return out


def sweep(r: Run) -> dict:
    """k1 by b of BM25."""
    data, o = r.data(), r.o
    k1s = sorted({*sweeps.frange(o.k1_min, o.k1_max, o.k1_step), 0.9})
    cells = [(k1, b) for k1 in k1s for b in sorted({*sweeps.frange(o.b_min, o.b_max, o.b_step), 0.4})]
    retriever = r.lexical().index(data.corpus)
    return _swept(r, sweeps.sweep_bm25(retriever, data.queries, data.qrels, cells), f"bm25-sweep-{o.split}", ("k1", "b"))


def hybrid(r: Run) -> dict:
    """Fusion of several systems, perhaps reranked; or the sweep of its constant."""
    data, o = r.data(), r.o
    names = [n.strip() for n in o.systems.split(",") if n.strip()]
    systems = [r.system(n).index(data.corpus) for n in names]
    runs = [written(s.retrieve(data.queries, o.top_k), "run") for s in systems]
    if o.sweep:
        return _swept(r, sweeps.sweep_rrf(runs, data.qrels), f"rrf-sweep-{o.split}", ("rrf_k",))
    run = combine.reciprocal_rank_fusion(runs, o.k, o.top_k)
    settings = {"method": "rrf", "k": o.k, "retrievers": [s.describe() for s in systems]}
    if o.rerank:
        before = metrics.evaluate(run, data.qrels, (10, o.top_k), (o.gain,)).collect()
        run = combine.rerank(run, data.queries, data.corpus, plugin(o.rerank)(F.col("query_text"), F.col("title"), F.col("text")), o.rerank_depth)
        settings = {"method": "rerank", "model": o.rerank, "depth": o.rerank_depth, "first_stage": settings}
        return r.scored(run, data, settings, "rrf-rerank", before_rerank={m.metric: m.value for m in before})
    return r.scored(run, data, settings, "rrf")


def expanded(r: Run) -> dict:
    """Queries or documents with generated text; or the sweep of the query's weight."""
    data, o = r.data(), r.o
    path = o.expansions or f"{o.results}/{o.dataset}-{o.kind}-expansions"
    made = datasets.read_expansions(r.spark, path)
    if o.sweep:
        if o.kind != "query":
            raise ValueError("only the weight of a query can be swept")
        passages = made.select(F.col("id").alias("query_id"), F.get("generations", F.lit(0)).alias("text")).join(data.queries.select("query_id"), "query_id", "left_semi")
        return _swept(r, sweeps.sweep_expansion(r.lexical().index(data.corpus), data.queries, passages, data.qrels), f"expansion-sweep-{o.split}", ("weight",))
    side = {"queries": made, "weight": o.weight} if o.kind == "query" else {"documents": made}
    retriever = ExpandedRetriever(r.lexical(), **side).index(data.corpus)
    return r.scored(retriever.retrieve(data.queries, o.top_k), data, retriever.describe(), f"{o.kind}-expansion")


def judge(r: Run) -> dict:
    """A text model's verdicts against the judgements."""
    data, o = r.data(), r.o
    run = r.lexical().index(data.corpus).retrieve(data.queries, o.depth) if o.source == "retrieved" else None
    pairs = agreement.judgeable_pairs(data.qrels, run, o.depth, o.source, o.min_per_class)
    pairs = agreement.thinned(pairs, o.max_pairs) if o.max_pairs else pairs
    texts = data.corpus.select("doc_id", document_text(F.col("title"), F.col("text")).alias("document"))
    rows = pairs.join(texts, "doc_id").join(data.queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    settings = generation.Settings(o.model, 1, 4, o.batch_size, o.seed)
    judged = written(generation.judge(rows, plugin(o.model), settings), "judged")
    return r.record({"source": o.source, "pairs": judged.count(), **agreement.calibrated(judged).first().asDict(), "settings": {**settings.describe("judge"), "prompt": generation.JUDGE_PROMPT}}, "judge")


def router(r: Run) -> dict:
    """Routing by a predictor: the oracle's headroom, and a threshold chosen on a training split."""
    o, data = r.o, r.data()
    names = {"lexical": o.lexical, "semantic": o.semantic}
    scores = lambda runs: [r.values(run).select("query_id", F.lit(s).alias("system"), "value") for s, run in runs.items()]
    test = written(scores(names)[0].unionByName(scores(names)[1]), "scores")
    single = {x.system: x.v for x in test.groupBy("system").agg(F.avg("value").alias("v")).collect()}
    best_single = max(sorted(single), key=single.get)
    oracle = combine.oracle_assignment(test).agg(F.avg("value").alias("v"), F.count_if(F.col("system") == "lexical").alias("n")).first()
    out = {"predictor": o.predictor, "metric": o.metric, "single": single, "oracle": oracle.v, "headroom": oracle.v - single[best_single], "oracle_lexical": oracle.n}
    if o.lexical_train and o.semantic_train:
        train = scores({"lexical": o.lexical_train, "semantic": o.semantic_train})
        stats = r.statistics(r.data(o.train_split))
        cells = written(sweeps.sweep_router(stats, train[0].unionByName(train[1]), o.predictor, "lexical", "semantic"), "cells")
        best = sweeps.best_cell(cells, "value").first()
        assigned = combine.threshold_assignment(r.statistics(data), o.predictor, best.threshold, "lexical", "semantic")
        routed = test.join(assigned, ["query_id", "system"]).agg(F.avg("value").alias("v"), F.count_if(F.col("system") == "lexical").alias("n")).first()
        out |= {"train": best.asDict(), "routed": routed.v, "routed_lexical": routed.n, "to_best_single": routed.v - single[best_single], "to_oracle": routed.v - oracle.v}
    return r.record(out, "router")


def analyse(r: Run) -> dict:
    """How a system's advantage over another goes with predictors of the query."""
    o = r.o
    stats = r.statistics(r.data())
    pairs = significance.aligned(r.values(o.lexical), r.values(o.semantic))
    advantage = written(pairs.select("query_id", (F.col("a") - F.col("b")).alias("advantage")), "advantage")
    order = (significance.PRIMARY, *significance.SECONDARY)
    tests = sorted((x.asDict() for x in significance.query_dependence(stats, advantage, o.permutations, o.seed).collect()), key=lambda t: order.index(t["predictor"]))
    thirds = significance.terciles(stats.select("query_id", F.col(significance.PRIMARY).alias("predictor")).join(advantage, "query_id"))
    return r.record({"dataset": o.dataset, "metric": o.metric, "tests": tests, "terciles": [x.asDict() for x in thirds.orderBy("tercile").collect()]}, "query-analysis")


def combine_analyses(r: Run) -> dict:
    """Several datasets' analyses as one family, corrected together."""
    rows = []
    for path in r.o.analysis:
        record = datasets.read_record(r.spark, path)
        first = next(t for t in record["tests"] if t["predictor"] == significance.PRIMARY)
        rows.append((len(rows), record["dataset"], first["predictor"], float(first["rho"]), float(first["p_value"])))
    tests = r.spark.createDataFrame(rows, "position long, dataset string, predictor string, rho double, p double")
    family = significance.family_summary(tests).first().asDict()
    adjusted = {x.position: x.adjusted for x in significance.holm(tests.select("position", "p")).collect()}
    return r.record({"family": family, "tests": [{"dataset": d, "predictor": c, "rho": rho, "p": p, "adjusted": adjusted[i]} for i, d, c, rho, p in rows]}, "query-dependence")


def compare(r: Run) -> dict:
    """Paired tests of pairs of runs, corrected if there are several."""
    o = r.o
    tests = []
    for a, b in o.pair:
        row = significance.paired_test(r.values(a), r.values(b), o.resamples, o.seed).first().asDict()
        tests.append({"first": a, "second": b, **row})
    if len(tests) > 1:
        p = r.spark.createDataFrame([(i, t["p_value"]) for i, t in enumerate(tests)], "position int, p double")
        for x in significance.holm(p).collect():
            tests[x.position]["adjusted"] = x.adjusted
    return r.record({"metric": o.metric, "tests": tests}, "comparison")


def fields(r: Run) -> dict:
    """Means of query formulations from fields of the records, and their spread."""
    data, path = r.data(), f"{r.o.data}/{r.o.dataset}/queries.jsonl"
    retriever = r.lexical().index(data.corpus)
    values = None
    for name in datasets.available_formulations(r.spark, path, FORMULATIONS):
        asked = datasets.formulated_queries(r.spark, path, FORMULATIONS[name]).join(data.queries.select("query_id"), "query_id", "left_semi")
        part = metrics.evaluate_per_query(retriever.retrieve(asked, r.o.top_k), data.qrels, (10, r.o.top_k), (r.o.gain,)).withColumn("formulation", F.lit(name))
        values = part if values is None else values.unionByName(part)
    if values is None:
        raise ValueError("the queries have none of the fields")
    means = written(metrics.formulation_means(values, metrics.PUBLISHED_NDCG_10.get(r.o.dataset)), "means")
    spread = metrics.formulation_spread(means.where("metric = 'ndcg@10'")).first().asDict()
    return r.record({"means": [m.asDict() for m in means.orderBy("formulation", "metric").collect()], **spread}, "query-fields")


def generate(r: Run) -> dict:
    """Expansions of queries or documents by a text model."""
    o, data = r.o, r.data()
    texts = data.queries.select(F.col("query_id").alias("id"), "text") if o.kind == "query" else data.corpus.select(F.col("doc_id").alias("id"), document_text(F.col("title"), F.col("text")).alias("text"))
    settings = generation.Settings(o.model, o.num, o.max_new_tokens, o.batch_size, o.seed, o.num > 1)
    made = generation.generate(texts, plugin(o.model), settings, o.prompt, o.limit)
    path = o.output or f"{o.results}/{o.dataset}-{o.kind}-expansions"
    described = {**settings.describe(f"{o.kind}-expansion"), "prompt": o.prompt, "limit": o.limit}
    datasets.write_expansions(made, path, described)
    return {"path": path, "expansions": datasets.read_expansions(r.spark, path).count(), **described}


def expansions(r: Run) -> dict:
    """What stored expansions add to their texts."""
    o, data = r.o, r.data()
    made = datasets.read_expansions(r.spark, o.expansions or f"{o.results}/{o.dataset}-{o.kind}-expansions")
    texts = data.queries.select(F.col("query_id").alias("id"), "text") if o.kind == "query" else data.corpus.select(F.col("doc_id").alias("id"), document_text(F.col("title"), F.col("text")).alias("text"))
    if o.kind == "document":
        texts = texts.join(made.select("id"), "id", "left_semi")
    return r.record(expansion.summarise_expansions(texts, made, r.tokenizer()).first().asDict(), f"{o.kind}-expansion-statistics")


def plot(r: Run) -> dict:
    """A dot plot of runs: ``--row NAME GROUP RUN[,RUN...]``, one run a panel; the first row is the reference."""
    o = r.o
    mean = lambda run: r.values(run).agg(F.avg("value")).first()[0]
    rows = [{"name": name, "group": group, "values": dict(zip(o.panel, map(mean, runs.split(",")), strict=True))} for name, group, runs in o.row]
    svg = figures.dot_plot_svg(figures.by_gain(rows, rows[0]), o.panel, o.title, rows[0]["name"], f"{o.metric}, higher is better")
    path = o.output or f"{o.results}/methods-svg"
    r.spark.createDataFrame([(svg,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return {"path": path, "characters": len(svg)}


def _service(r: Run) -> SearchService:
    data = r.data()
    return SearchService(r.o.dataset, data.corpus, data.qrels, plugin(r.o.encoder) if r.o.encoder else None, r.tokenizer(), data.split)


def search(r: Run) -> dict:
    return _service(r).search(" ".join(r.o.words), r.o.results_wanted, r.o.search_method)


def describe(r: Run) -> dict:
    return _service(r).describe_benchmark()


COMMANDS = {"baseline": baseline, "dense": dense, "learned": learned, "rm3": rm3, "sweep": sweep, "hybrid": hybrid, "expanded": expanded, "judge": judge, "router": router, "analyse": analyse, "combine": combine_analyses, "compare": compare, "fields": fields, "generate": generate, "expansions": expansions, "plot": plot, "search": search, "describe": describe}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="irspan", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    own: dict[str, argparse.ArgumentParser] = {}
    for name, run in COMMANDS.items():
        p = own[name] = commands.add_parser(name, help=(run.__doc__ or name).splitlines()[0])
        for flag, value in (("data", "data"), ("dataset", "scifact"), ("split", "train" if name == "sweep" else "test"), ("results", "results"), ("metric", "ndcg@10"), ("tag", ""), ("run-id", None), ("output", None), ("encoder", None)):
            p.add_argument(f"--{flag}", default=value)
        for flag, value in (("k1", 0.9), ("b", 0.4), ("alpha", 0.5)):
            p.add_argument(f"--{flag}", type=float, default=value)
        for flag, value in (("top-k", 100), ("fb-docs", 10), ("fb-terms", 10), ("seed", 0), ("chunk-words", None), ("chunk-overlap", 0), ("max-tokens", None), ("top-terms", None), ("batch-size", 16)):
            p.add_argument(f"--{flag}", type=int, default=value)
        for flag in ("no-stem", "no-stopwords", "single-field", "sweep"):
            p.add_argument(f"--{flag}", action="store_true")
        p.add_argument("--gain", default="exponential", choices=metrics.GAINS)
    own["learned"].add_argument("--method", choices=tuple(metrics.PUBLISHED_LEARNED), required=True)
    own["rm3"].add_argument("--document-expansions")
    for flag, value in (("k1-min", 0.2), ("k1-max", 2.0), ("k1-step", 0.2), ("b-min", 0.0), ("b-max", 1.0), ("b-step", 0.1)):
        own["sweep"].add_argument(f"--{flag}", type=float, default=value)
    own["hybrid"].add_argument("--systems", default="bm25,dense")
    own["hybrid"].add_argument("--k", type=float, default=60.0)
    own["hybrid"].add_argument("--rerank")
    own["hybrid"].add_argument("--rerank-depth", type=int, default=100)
    for name in ("expanded", "generate", "expansions"):
        own[name].add_argument("--kind", choices=("query", "document"), required=True)
    for name in ("expanded", "expansions"):
        own[name].add_argument("--expansions")
    own["expanded"].add_argument("--weight", type=int, default=5)
    own["judge"].add_argument("--source", default="qrels", choices=("qrels", "retrieved"))
    for flag, value in (("depth", 10), ("max-pairs", None), ("min-per-class", 30)):
        own["judge"].add_argument(f"--{flag}", type=int, default=value)
    for name in ("judge", "generate"):
        own[name].add_argument("--model", required=True)
    for flag, value in (("num", 1), ("max-new-tokens", 128), ("limit", None)):
        own["generate"].add_argument(f"--{flag}", type=int, default=value)
    own["generate"].add_argument("--prompt")
    for name in ("router", "analyse"):
        own[name].add_argument("--lexical", required=True)
        own[name].add_argument("--semantic", required=True)
    own["router"].add_argument("--lexical-train")
    own["router"].add_argument("--semantic-train")
    own["router"].add_argument("--train-split", default="train")
    own["router"].add_argument("--predictor", default=significance.PRIMARY)
    own["analyse"].add_argument("--permutations", type=int, default=20_000)
    own["combine"].add_argument("--analysis", action="append", required=True)
    own["compare"].add_argument("--pair", nargs=2, action="append", required=True)
    own["compare"].add_argument("--resamples", type=int, default=significance.RESAMPLES)
    own["plot"].add_argument("--panel", action="append", required=True)
    own["plot"].add_argument("--row", nargs=3, action="append", required=True)
    own["plot"].add_argument("--title", default="Methods")
    own["search"].add_argument("words", nargs="+")
    own["search"].add_argument("--results-wanted", type=int, default=10)
    own["search"].add_argument("--search-method", default="hybrid")
    return top


def main(argv: list[str] | None = None) -> int:
    """Run a command and print its record; 1 where a baseline is out of its published value's tolerance."""
    options = parser().parse_args(argv)
    out = COMMANDS[options.command](Run(options))
    json.dump(out, sys.stdout, ensure_ascii=False, default=str)
    sys.stdout.write("\n")
    return 0 if out.get("within", True) or options.command != "baseline" else 1


if __name__ == "__main__":
    raise SystemExit(main())
