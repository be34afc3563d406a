"""Datasets on disk, the search service, and every command over a small dataset written here."""

import json
import random

import pytest
from pyspark.sql import functions as F

from irspan.functions.text import PLAIN
from irspan.operators import generation, vectors
from irspan.plans import cli
from irspan.plans.service import SearchService
from irspan.sources import datasets

BIRDS = "heron plover curlew teal snipe dunlin avocet wigeon".split()
ENCODER = vectors.VocabularyEncoder(tuple(BIRDS))


def yes(prompts, settings):
    return [["yes" if p.count("heron") > 1 else "no"] for p in prompts]


def echo(prompts, settings):
    return [[f"{p} {BIRDS[i]} {BIRDS[i + 1]}" for i in range(settings.generations)] for p in prompts]


def cite(prompts, settings):
    assert all("[1]" in p for p in prompts)
    return [["It is so [2], and [1]; not [9]." for _ in range(settings.generations)] for _ in prompts]


def by_length(query_text, title, text):
    return F.length(text)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    r = random.Random(6)
    lines = lambda rows: "\n".join([json.dumps(x) for x in rows] + ["", ""])
    for name, seed in (("marsh", 1), ("fen", 2)):
        r.seed(seed)
        d = base / name
        (d / "qrels").mkdir(parents=True)
        (d / "corpus.jsonl").write_text(lines({"_id": f"d{i:02}", "title": r.choice(BIRDS), "text": " ".join(r.choices(BIRDS, k=r.randrange(3, 12)))} for i in range(30)))
        (d / "queries.jsonl").write_text(lines({"_id": f"q{i}", "text": " ".join(r.sample(BIRDS, 2)), "metadata": {"query": r.choice(BIRDS)}} for i in range(12)))
        for split, span in (("test", range(8)), ("train", range(4, 12))):
            rows = [f"q{i}\td{j:02}\t{r.randrange(3)}" for i in span for j in r.sample(range(30), 12)]
            (d / "qrels" / f"{split}.tsv").write_text("\n".join(["query-id\tcorpus-id\tscore", *rows, "q0\tshort"]) + "\n")
    return base


@pytest.fixture(scope="module")
def call(spark, folder, tmp_path_factory):
    results = tmp_path_factory.mktemp("results")

    def run(*args, dataset="marsh", capsys=None):
        options = cli.parser().parse_args([args[0], "--data", str(folder), "--dataset", dataset, "--results", str(results), "--no-stem", *args[1:]])
        out = cli.COMMANDS[options.command](cli.Run(options))
        json.dumps(out, default=str)
        return out

    run.results = results
    return run


HERE = __name__


def test_scans(spark, folder, tmp_path):
    data = datasets.load_dataset(spark, "marsh", "train", str(folder))
    assert data.corpus.count() == 30 and data.queries.count() == 8 and data.qrels.count() == 96
    with pytest.raises(ValueError, match="no split dev; it has test, train"):
        datasets.load_dataset(spark, "marsh", "dev", str(folder))
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\td1\t1\nq1\td1\t1.0\nquery-id\td2\t2\nq1\td1\t3\nq1\td9\n")
    assert {tuple(r) for r in datasets.read_qrels(spark, str(tmp_path / "qrels" / "test.tsv")).collect()} == {("q1", "d1", 3), ("query-id", "d2", 2)}
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1"}\n\n{"_id": "d2", "title": null, "text": "x"}\n')
    assert sorted(tuple(r) for r in datasets.read_corpus(spark, str(tmp_path / "corpus.jsonl")).collect()) == [("d1", "", ""), ("d2", "", "x")]
    (tmp_path / "queries.jsonl").write_text('{"_id": "zz", "text": "t", "metadata": {"query": "m"}}\n')
    with pytest.raises(ValueError, match="has no text"):
        datasets.load_dataset(spark, tmp_path.name, "test", str(tmp_path.parent))
    (tmp_path / "bad.jsonl").write_text('{"_id": "d1", \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        datasets.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()
    q = str(tmp_path / "queries.jsonl")
    assert datasets.formulated_queries(spark, q, ["metadata.query", "nothing", "text"]).first()[:] == ("zz", "m t")
    assert datasets.available_formulations(spark, q, {"a": ["text"], "b": ["text", "metadata.narrative"]}) == ["a"]


def test_digests_and_caches(spark, folder, tmp_path):
    corpus = datasets.read_corpus(spark, str(folder / "fen" / "corpus.jsonl"))
    digest = lambda c: datasets.corpus_digest(c).first().digest
    assert digest(corpus) == digest(corpus.orderBy(F.desc("doc_id")).repartition(4)) != digest(corpus.where("doc_id <> 'd03'"))
    calls = []

    class Counted:
        def encode(self, texts, text_column="text"):
            calls.append(1)
            return ENCODER.encode(texts, text_column)

    first = datasets.cached_embeddings(corpus, Counted(), str(tmp_path), {"model": "birds", "chunk": 3}).count()
    assert first == datasets.cached_embeddings(corpus, Counted(), str(tmp_path), {"model": "birds", "chunk": 3}).count() == 30 and len(calls) == 1
    datasets.cached_embeddings(corpus, Counted(), str(tmp_path), {"model": "birds", "chunk": 4})
    assert len(calls) == 2
    kept = next(p for p in tmp_path.iterdir() if "chunk=3" in p.name)
    ENCODER.encode(corpus.limit(4)).write.mode("overwrite").parquet(str(kept))
    with pytest.raises(ValueError, match="another corpus"):
        datasets.cached_embeddings(corpus, Counted(), str(tmp_path), {"model": "birds", "chunk": 3})


def test_archives(tmp_path, monkeypatch):
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("pond/corpus.jsonl", "{}")
    (tmp_path / "pond.zip").write_bytes(data.getvalue())
    url = (tmp_path / "{name}.zip").as_uri().replace("%7B", "{").replace("%7D", "}")
    target = datasets.download_dataset("pond", str(tmp_path / "data"), url)
    assert (target / "corpus.jsonl").read_text() == "{}" and datasets.download_dataset("pond", str(tmp_path / "data"), "nowhere") == target
    with zipfile.ZipFile(tmp_path / "mud.zip", "w") as z:
        z.writestr("other/x", "")
    with pytest.raises(ValueError, match="no corpus"):
        datasets.download_dataset("mud", str(tmp_path / "data"), url)


def test_stored_expansions(spark, tmp_path):
    made = spark.createDataFrame([(f"d{i}", [f"x{i}", "", "ü\n[1]"]) for i in range(50)] + [("e", [])], "id string, generations array<string>").repartition(4)
    datasets.write_expansions(made, str(tmp_path / "made"), {"model": "m", "seed": 3})
    assert sorted(map(tuple, datasets.read_expansions(spark, str(tmp_path / "made")).collect())) == sorted(map(tuple, made.collect()))
    assert datasets.read_settings(spark, str(tmp_path / "made")) == {"model": "m", "seed": 3}
    (tmp_path / "one.json").write_text(json.dumps({"model": "m", "expansions": {"a": ["x", "y"], "b": []}}, indent=1))
    assert {r.id: r.generations for r in datasets.read_expansions(spark, str(tmp_path / "one.json")).collect()} == {"a": ["x", "y"], "b": []}


def test_results(spark, tmp_path):
    values = spark.createDataFrame([("q1", "ndcg@10", 0.5), ("q1", "recall@100", 1.0)], "query_id string, metric string, value double")
    datasets.write_results(spark.createDataFrame([("x",)], "model string"), values, str(tmp_path), "run")
    assert [tuple(r) for r in datasets.read_per_query(spark, str(tmp_path), "run", "recall@100").collect()] == [("q1", 1.0)]
    with pytest.raises(KeyError):
        datasets.read_per_query(spark, str(tmp_path), "run", "ndcg@5")
    spark.createDataFrame([("x",)], "model string").write.json(str(tmp_path / "old"))
    with pytest.raises(ValueError, match="points to no values"):
        datasets.read_per_query(spark, str(tmp_path), "old", "ndcg@10")


def test_service(spark, folder):
    data = datasets.load_dataset(spark, "fen", folder=str(folder))
    s = SearchService("fen", data.corpus, data.qrels, tokenizer=PLAIN)
    assert s.search("heron teal", 3)["methods"] == ["bm25"] and len(s.search("heron teal", 3)["results"]) == 3
    with pytest.raises(RuntimeError, match="no encoder"):
        s.search("heron", method="dense")
    with pytest.raises(ValueError, match="method"):
        s.search("heron", method="guess")
    both = SearchService("fen", data.corpus, data.qrels, ENCODER, PLAIN)
    assert both.search("heron", 4)["methods"] == ["bm25", "dense"]
    compared = both.compare_methods("snipe dunlin", 5)
    shared = {x["doc_id"] for x in compared["bm25"]} & {x["doc_id"] for x in compared["dense"]}
    assert compared["shared"] == len(shared) and compared["query_statistics"]["num_terms"] == 2
    answer = both.answer("heron", cite, 3)
    assert (answer["cited_positions"], answer["invalid_citations"], answer["uncited"], answer["citation_precision"]) == ([2, 1, 9], [9], False, pytest.approx(2 / 3))
    assert answer["cited_doc_ids"] == [answer["doc_ids"][1], answer["doc_ids"][0]] and answer["settings"]["method"] == "answer"
    with pytest.raises(ValueError, match="no documents"):
        s.answer("penguin", cite)
    about = both.describe_benchmark()
    assert (about["documents"], about["queries"], about["levels"], about["split"], about["retriever"]["model"]) == (30, 8, [0, 1, 2], "test", "bm25") and about["caveat"]
    with pytest.raises(ValueError, match="judgements"):
        SearchService("x", data.corpus).describe_benchmark()
    assert generation.Settings().describe("answer")["model"] == "plug-in"


def test_runs_and_what_reads_them(call):
    for split in ("test", "train"):
        lexical = call("baseline", "--split", split, "--run-id", f"lex-{split}")
        assert 0 < lexical["ndcg@10"] < 1 and lexical["published"] is None and lexical["within"] and lexical["label"].startswith("bm25 [bm25]")
        call("dense", "--split", split, "--encoder", f"{HERE}:ENCODER", "--run-id", f"vec-{split}", "--chunk-words", "4")
    assert call("learned", "--method", "splade", "--encoder", f"{HERE}:ENCODER")["settings"]["method"] == "learned-sparse"
    assert call("learned", "--method", "colbert", "--encoder", f"{HERE}:ENCODER")["settings"]["method"] == "late-interaction"
    assert call("rm3", "--fb-docs", "3", "--tag", "t")["run"] == "marsh-rm3-t"
    fused = call("hybrid", "--systems", "bm25,rm3,dense", "--encoder", f"{HERE}:ENCODER", "--k", "5")
    assert [x.get("method") or x["model"] for x in fused["settings"]["retrievers"]] == ["bm25", "rm3", "dense"]
    assert call("hybrid", "--systems", "bm25,rm3", "--rerank", f"{HERE}:by_length", "--rerank-depth", "5")["before_rerank"]["ndcg@10"] > 0
    with pytest.raises(ValueError, match="encoder"):
        call("dense")
    routed = call("router", "--lexical", "lex-test", "--semantic", "vec-test", "--lexical-train", "lex-train", "--semantic-train", "vec-train")
    assert routed["oracle"] >= max(routed["single"].values()) and routed["oracle"] >= routed["routed"] and routed["train"]["cell"] in range(21)
    assert "routed" not in call("router", "--lexical", "lex-test", "--semantic", "vec-test")
    for name in ("marsh", "fen"):
        if name == "fen":
            call("baseline", "--run-id", "fen-lex", dataset="fen")
            call("dense", "--encoder", f"{HERE}:ENCODER", "--run-id", "fen-vec", dataset="fen")
        found = call("analyse", "--lexical", "lex-test" if name == "marsh" else "fen-lex", "--semantic", "vec-test" if name == "marsh" else "fen-vec", "--permutations", "60", dataset=name)
        assert [t["predictor"] for t in found["tests"]][0] == "max_idf" and sum(t["n"] for t in found["terciles"]) == 8
    family = call("combine", "--analysis", f"{call.results}/marsh-query-analysis", "--analysis", f"{call.results}/fen-query-analysis")
    assert len(family["tests"]) == 2 and all(t["adjusted"] >= t["p"] for t in family["tests"])
    tests = call("compare", "--pair", "lex-test", "vec-test", "--pair", "lex-test", "marsh-rm3-t")["tests"]
    assert all(0 < t["p_value"] <= t["adjusted"] <= 1 and t["method"] == "exact" for t in tests)
    assert "adjusted" not in call("compare", "--pair", "lex-test", "vec-test")["tests"][0]
    assert call("plot", "--panel", "marsh", "--row", "BM25", "words", "lex-test", "--row", "vectors", "vectors", "vec-test")["characters"] > 1000


def test_sweeping_commands(call, monkeypatch):
    from irspan.operators import sweeps

    swept = call("sweep", "--k1-min", "0.5", "--k1-max", "1.5", "--k1-step", "0.5", "--b-step", "0.5")
    assert swept["surface"]["cells"] == 4 * 4 and len(swept["by_axis"]["b"]) == 4 and swept["best"]["ndcg"] == pytest.approx(swept["surface"]["best"], abs=1e-6)
    assert call("hybrid", "--systems", "bm25,rm3", "--sweep")["surface"]["cells"] == 9
    monkeypatch.setattr(sweeps, "RM3_GRID", {"fb_docs": (2, 4), "fb_terms": (3,), "alpha": (0.2, 0.5)})
    assert call("rm3", "--sweep", "--single-field")["surface"]["cells"] == 4


def test_generating_commands(call):
    made = call("generate", "--kind", "query", "--model", f"{HERE}:echo", "--num", "2", "--prompt", "Say {text}")
    assert made["expansions"] == 8 and made["sample"] and made["prompt"] == "Say {text}"
    assert call("generate", "--kind", "document", "--model", f"{HERE}:echo", "--limit", "5", "--num", "1")["expansions"] == 5
    stats = call("expansions", "--kind", "query")
    assert (stats["inputs"], stats["empty"]) == (8, 0) and stats["words_min"] == 2 * 5
    assert call("expansions", "--kind", "document")["inputs"] == 5
    assert call("expanded", "--kind", "query", "--weight", "3")["settings"]["query_weight"] == 3
    assert call("expanded", "--kind", "document")["settings"]["expanded"] == ["documents"]
    assert call("expanded", "--kind", "query", "--sweep")["shape"]["direction"] in ("increasing", "decreasing", "neither")
    assert call("rm3", "--document-expansions", f"{call.results}/marsh-document-expansions", "--tag", "stacked")["ndcg@10"] > 0
    judged = call("judge", "--model", f"{HERE}:yes", "--max-pairs", "40", "--min-per-class", "5")
    assert judged["pairs"] == judged["n"] == 40 and judged["unparseable"] == 0 and "prompt" in judged["settings"]
    assert call("judge", "--model", f"{HERE}:yes", "--source", "retrieved", "--depth", "4", "--min-per-class", "1")["source"] == "retrieved"


def test_asking_commands(call, capsys, folder):
    assert len(call("search", "heron", "teal", "--results-wanted", "2")["results"]) == 2
    assert call("describe")["documents"] == 30
    found = call("fields")
    assert {m["formulation"] for m in found["means"]} == {"text", "metadata.query", "query+text"} and found["spread"] >= 0
    assert cli.main(["describe", "--data", str(folder), "--dataset", "fen"]) == 0
    assert json.loads(capsys.readouterr().out)["dataset"] == "fen"
    with pytest.raises(ValueError, match="module:attribute"):
        cli.plugin("nothing")
