"""Files, settings and the staged pipeline: a run that is stopped goes on where it stopped."""

import json
from pathlib import Path

import pytest

from sparkloom import config, pipeline
from sparkloom.__main__ import main
from sparkloom.pipeline import Models, Stage
from sparkloom.sources import files

RECORDS = [
    {"_id": "a", "question": "Where was Ada born?", "answer": "Lund", "type": "inference", "entity_ids": "Q1_Q2", "supporting_facts": [["Ada", 0], ["Lund/Skåne", 1]], "evidences": [["Ada", "born in", "Lund"], ["x", "y"]], "context": [["Ada", ["Ada was born in Lund.", "She wrote."]], ["Lund/Skåne", ["Lund is a town."]]]},
    {"_id": "b", "question": "Who taught Ben?", "answer": "Ada", "entity_ids": "Q3", "supporting_facts": [["Ben", 0]], "evidences": [["Ben", "teacher", "Ada"]], "context": [["Ben", ["Ben learned from Ada."]], ["Ada", ["Ada was born in Lund.", "She wrote."]]]},
    {"_id": "c", "question": "Nothing?"},
]


@pytest.fixture
def settings(spark, tmp_path):
    (tmp_path / "records.json").write_text(json.dumps(RECORDS))
    people = [("Q1", "female", "european"), ("Q3", " Male ", "unknown"), ("Q9", "male", "european")]
    spark.createDataFrame(people, "qid string, gender string, geo_group string").write.parquet(str(tmp_path / "people.parquet"))
    return config.load_config("standard", [f"paths.records={tmp_path}/records.json", f"paths.demographics={tmp_path}/people.parquet", f"paths.output_dir={tmp_path}/out", "logging.level=ERROR", "logging.to_file=false"])


def test_records_from_json(spark, settings):
    rows = {r._id: r for r in files.read_records(spark, settings["paths"]["records"]).collect()}
    assert rows["a"].context[0].sentences == ["Ada was born in Lund.", "She wrote."] and rows["a"].supporting_facts[1].sent_id == 1
    assert len(rows["a"].evidences) == 1 and rows["c"].question_type == "" and rows["c"].context == []


def test_runs_stops_and_goes_on(spark, settings):
    def broken(prompts):
        raise RuntimeError("no model today")

    first = pipeline.run_pipeline(spark, settings, models=Models(generate=broken))
    assert [r.status for r in first.values()] == ["completed"] * 5 + ["failed"] and "EVALUATE" not in first
    second = pipeline.run_pipeline(spark, settings)
    assert [r.status for r in second.values()] == ["skipped"] * 5 + ["completed"] * 2
    book = files.read_manifest(spark, settings["paths"]["output_dir"] + "/pipeline_manifest.json")
    assert book["stages"]["GENERATE"]["status"] == "completed" and len(book["stages"]["INDEX"]["artifacts"]["index"]) == 16
    assert second["INDEX"].artifacts == first["INDEX"].artifacts
    run = pipeline.Run(spark, settings)
    assert {r.chunk_id for r in run.table("chunks").collect()} == {"doc_Ada_0", "doc_Ben_0", "doc_Lund_Skåne_0"}
    rows = {r.id: r for r in run.table("retrieval").collect()}
    assert rows["a"].num_seed == 3 and rows["a"].num_final == len(rows["a"].retrieved_chunk_ids) > 0 and rows["a"].context_length == len(rows["a"].context.split())
    scores = {r.id: (r.gender, r.geo_group) for r in run.table("per_question").collect()}
    assert scores == {"a": ("female", "european"), "b": ("male", "unknown"), "c": (None, None)}
    n = run.table("metrics").filter("category = 'accuracy' and metric = 'n'").head().value
    assert n == 3.0
    only = pipeline.run_pipeline(spark, settings, only=Stage.EVALUATE)
    assert list(only) == ["EVALUATE"] and only["EVALUATE"].status == "completed"


@pytest.mark.parametrize("name", ["baseline_naive", "fair", "no_filter"])
def test_experiments(spark, settings, name):
    settings = config.merged(settings, config.load_config(name, [f"paths.{k}={v}" for k, v in settings["paths"].items()]) | {"logging": settings["logging"]})
    results = pipeline.run_pipeline(spark, settings)
    assert [r.status for r in results.values()] == ["completed"] * 7
    sizes = pipeline.Run(spark, settings).table("retrieval").filter("id = 'a'").head()
    assert name != "baseline_naive" or sizes.num_seed == sizes.num_expanded == sizes.num_final


def test_a_missing_source_fails_the_stage(spark, settings):
    settings["paths"]["records"] += ".gone"
    results = pipeline.run_pipeline(spark, settings)
    assert [(k, r.status) for k, r in results.items()] == [("PREPROCESS", "failed")]
    with pytest.raises(FileNotFoundError):
        pipeline.Run(spark, settings).table("chunks")


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "who": "${oc.env:LOOM_USER,nobody}"}')
    (tmp_path / "mine.json").write_text('{"base": "base.json", "a": {"y": 3}}')
    got = config.load_config(tmp_path / "mine.json", ["a.z=[1, 2]", "b.c.d=true", "e=plain text"])
    assert got["a"] == {"x": 1, "y": 3, "z": [1, 2]} and got["b"] == {"c": {"d": True}} and got["who"] == "nobody" and got["e"] == "plain text"
    monkeypatch.setenv("LOOM_USER", "me")
    assert config.load_config(tmp_path / "mine.json")["who"] == "me"
    with pytest.raises(FileNotFoundError):
        config.load_config(tmp_path / "none.json")
    assert config.load_config("fair")["retrieval"]["expansion"] == {"enabled": True, "fair": True, "strategy": "in_traversal", "max_hops": 2, "score_decay": 0.5, "max_chunks": 20}


def test_command_line_needs_an_experiment():
    with pytest.raises(SystemExit):
        main([])


def test_import_of_triples(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"subject": " A ", "relation": "r", "object": "B", "confidence": "0.5"}, {"subject": "A", "relation": "r", "obj": "C", "confidence": "high"}, {"subject": " ", "relation": "r", "obj": "C"}]))
    got = {(r.subject, r.obj, r.confidence, r.source_chunk_id) for r in files.import_triples(spark, str(tmp_path / "t.json")).collect()}
    assert got == {("A", "B", 0.5, ""), ("A", "C", 1.0, "")}


def test_graph_goes_to_files_and_back(spark, tmp_path):
    triples = spark.createDataFrame([("A", "r", "B", "c", 1.0)], "subject string, relation string, obj string, source_chunk_id string, confidence double")
    mentions = spark.createDataFrame([("c", "A")], "chunk_id string, entity string")
    files.save_graph(triples, mentions, triples.groupBy().count(), str(tmp_path / "g"))
    back = files.load_graph(spark, str(tmp_path / "g"))
    assert back[0].collect() == triples.collect() and back[1].collect() == mentions.collect()
    assert files.artifact_hash(spark, str(tmp_path / "g/related")) == files.artifact_hash(spark, str(tmp_path / "g/related"))


def test_demographics_by_transport(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def transport(request):
        with open(calls, "a") as f:
            f.write("x")
        if Path(calls).stat().st_size == 1:
            raise OSError("busy")
        known = {"Q1": [("Q6581072", "France"), ("Q6581072", "Japan")], "Q2": [(None, None)], "Q3": [("Q77", "Italy")]}
        uri = lambda x: x and f"http://example.org/entity/{x}"
        return [{"item": uri(q), "itemLabel": f"name {q}", "gender": uri(g), "countryLabel": c} for q in known if f"wd:{q} " in request for g, c in known[q]]

    qids = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",), ("Q4",), (None,), ("Q1",)], "qid string").coalesce(1)
    got = {tuple(r) for r in files.fetch_demographics(qids, transport, pause=0.0).collect()}
    assert got == {("Q1", "name Q1", "female", "Japan", "non_european"), ("Q2", "name Q2", None, None, "unknown"), ("Q3", "name Q3", "other", "Italy", "european")}
    assert files.fetch_demographics(qids, lambda r: (_ for _ in ()).throw(OSError()), pause=0.0).count() == 0
