"""The command line's stages on written records, execution, providers, configs and streams."""

import json

import pytest

from pathwright import cli, config
from pathwright.operators import execution
from pathwright.operators.verify import classify
from pathwright.sources import files, providers, publish, training_runs


def trajectory(i, success=False, teacher=None, process=0.0, gap=None):
    v = {"success": success, "execution_ok": True, "status": "OPTIMAL" if success else "FEASIBLE", "objective_value": None if gap is None else 10.0 + gap, "objective_match": success}
    return {"trajectory_id": f"s{i}", "response": f"answer {i}", "code": "", "verification": v, "process_score": process, "teacher_evaluation": None if teacher is None else {"overall_score": teacher}}


@pytest.fixture
def rollouts(tmp_path):
    rows = [
        ("a", [trajectory(1, True, 0.9, gap=0.0), trajectory(2, False, "0.5")]),
        ("b", [trajectory(1, False, "0.8", 0.3), trajectory(2, False, "x", 0.3), trajectory(3, False, None, 0.3)]),
        ("c", [trajectory(1, True)]),
        ("d", [trajectory(1, False, None, 0.3, gap=-2.0), trajectory(2, False, None, 0.1)]),
    ]
    path = tmp_path / "rollouts.jsonl"
    path.write_text("\n\n".join(json.dumps({"problem_id": p, "template_name": "tsp", "question": f"q {p}", "reference_solution": {"status": "OPTIMAL", "objective_value": 10.0}, "trajectories": t}) for p, t in rows))
    return path


def test_preferences_to_dpo(spark, tmp_path, rollouts, monkeypatch):
    monkeypatch.chdir(tmp_path)
    got = cli.build_preferences(spark, str(rollouts), str(tmp_path / "p"), report_dir=str(tmp_path / "r")).first()
    assert got.rationales == {"solver_success_beats_failure": 1, "teacher_score_gap": 1, "process_score_gap": 1} and (got.num_pairs, got.skipped_for_unsuccessful_chosen) == (3, 0)
    pairs = {r.problem_id: r for r in spark.read.schema(cli.PREFERENCE).json(str(tmp_path / "p")).collect()}
    assert (pairs["b"].chosen.response, pairs["b"].rejected.response, pairs["b"].weight, pairs["b"].question) == ("answer 1", "answer 3", 0.71, "q b")
    assert pairs["d"].weight == 0.5 and pairs["a"].weight == 1.0 and pairs["a"].chosen.verification.success
    (tmp_path / "d.yaml").write_text(f"preference_path: {tmp_path}/p\noutput_dir: {tmp_path}/d\n")
    assert cli.prepare_dpo(spark, str(tmp_path / "d.yaml")).first().asDict() == {"train": 2, "valid": 1, "output_dir": f"{tmp_path}/d"}
    rows = spark.read.json(str(tmp_path / "d")).collect()
    assert [r.problem_id for r in rows if r.split == "valid"] == ["d"]  # the last of the file
    assert all([m.role for m in r.prompt_messages] == ["system", "user"] and r.prompt_messages[1].content.endswith(f"q {r.problem_id}") for r in rows)
    got = cli.build_preferences(spark, str(rollouts), run_root=str(tmp_path / "runs"), run_prefix="prefs", require_chosen_success=True).first()
    assert (got.num_pairs, got.skipped_for_unsuccessful_chosen, got.require_chosen_success) == (1, 2, True) and got.run_dir.startswith(f"{tmp_path}/runs/prefs_20")
    assert spark.read.json(got.output_path).count() == 1


def test_later_predictions_count(spark, tmp_path):
    line = lambda v: json.dumps({"problem_id": "a", "response": "", "code": "print('__RESULT__={\"status\": 0, \"objective_value\": %d}')" % v})
    (tmp_path / "p.jsonl").write_text("\n".join(map(line, (3, 9, 2))))
    (tmp_path / "s.jsonl").write_text(json.dumps({"problem_id": "a", "template_name": "tsp", "reference_solution": {"objective_value": 2.0}}))
    assert cli.evaluate_predictions(spark, str(tmp_path / "s.jsonl"), str(tmp_path / "o"), str(tmp_path / "p.jsonl"), True).first().pass_at_1 == 1.0


def test_latest_file(spark, tmp_path):
    import os

    for name, at in (("a/x_1.json", 100), ("a/x_2.json", 300), ("b/x_3.json", 200), ("b/y.json", 400)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"name": name}, indent=1))
        os.utime(tmp_path / name, (at, at))
    assert files.latest(spark, f"{tmp_path}/*/x_*.json").endswith("a/x_2.json") and files.latest(spark, f"{tmp_path}/none*") is None
    assert files.latest_json(spark, f"{tmp_path}/b/*.json") == {"name": "b/y.json"} and files.latest_json(spark, f"{tmp_path}/none*") == {}
    assert files.relative(f"{tmp_path}/a/report.md", f"{tmp_path}/b/y.json") == "../b/y.json" and files.relative("x", None) == ""
    files.write_json(str(tmp_path / "deep" / "s.json"), {"a": 1, "b": None})
    assert (tmp_path / "deep" / "s.json").read_text() == '{\n  "a": 1,\n  "b": null\n}'


def test_training_run(spark, tmp_path):
    made = training_runs.folders(str(tmp_path / "sft"), run_prefix="sft_train")
    assert set(made) == set(training_runs.LAYOUT) and all(training_runs.Path(p).is_dir() for p in made.values())
    assert made["run_dir"].startswith(f"{tmp_path}/sft_runs/sft_train_") and made["final_dir"] == made["run_dir"] + "/weights/final_adapter"
    assert training_runs.folders("x", str(tmp_path / "all"))["run_dir"].startswith(f"{tmp_path}/all/train_")
    rows = [{"step": 5, "loss": 2.0, "entropy": 0.5}, {"step": 7, "eval_loss": 1}, "noise", {"step": 10, "loss": 0.5, "entropy": 0.75, "grad_norm": 3}, {"step": 15, "loss": 1.0, "entropy": 0.25, "learning_rate": 0.125}, {"train_loss": 1.0}]
    got = training_runs.summarize(spark, rows, {"epoch": 3}, "sft")
    want = {"num_log_points": 3, "first_step": 5, "last_step": 15, "first_loss": 2.0, "last_loss": 1.0, "best_loss": 0.5, "loss_delta": -1.0, "loss_reduction": 1.0, "relative_loss_reduction": 0.5, "final_epoch": 3.0, "final_learning_rate": 0.125}
    want |= {"first_entropy": 0.5, "last_entropy": 0.25, "best_entropy": 0.25, "first_grad_norm": 3.0, "last_grad_norm": 3.0, "best_grad_norm": 3.0}
    assert got == want | {"stage_name": "sft", "train_metrics": {"epoch": 3}}
    assert training_runs.summarize(spark, [{"step": 1, "loss": 0, "epoch": 0.5}])["final_epoch"] == 0.5
    assert training_runs.summarize(spark, ["noise"]) == {"stage_name": "training", "num_log_points": 0}
    paths = training_runs.report(made["metrics_dir"], got, rows, {"lr": 1})
    assert {k: files.read_json(spark, p) for k, p in paths.items()} == {"summary_path": got, "log_history_path": {"log_history": rows}, "config_path": {"lr": 1}}
    assert "config_path" not in training_runs.report(made["metrics_dir"], got, rows)


def test_published_documents(spark):
    docs = spark.createDataFrame([("a", "# T\n" + "\n".join(f"- {i}" for i in range(23))), ("b", "```\nx\n```")], "doc_id string, text string")
    sent = []
    got = {r.doc_id: r.asDict() for r in publish.publish(docs, lambda title, chunks: sent.append((title, chunks)) or f"id-{title}", dry_run=True).collect()}
    assert got == {"a": {"doc_id": "a", "title": "T", "block_count": 23, "dry_run": True, "document_id": None}, "b": {"doc_id": "b", "title": "b Upload", "block_count": 1, "dry_run": True, "document_id": None}}
    rows = publish.requests(docs).collect()
    assert [(r.doc_id, r.chunk, len(r.blocks)) for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk))] == [("a", 0, 10), ("a", 1, 10), ("a", 2, 3), ("b", 0, 1)]
    assert [r for r in rows if r.doc_id == "b"][0].blocks[0].wrap
    got = {r.doc_id: r.document_id for r in publish.publish(docs, lambda title, chunks: f"{title}:{','.join(str(len(c)) for c in chunks)}").collect()}
    assert got == {"a": "T:10,10,3", "b": "b Upload:1"}


def test_paths(tmp_path, monkeypatch):
    for name in ("PROJECT_ROOT", "PROJECT_DATA_DIR", "PROJECT_OUTPUT_DIR"):
        monkeypatch.delenv(name, raising=False)
    assert config.mapped("data/x", tmp_path) == f"{tmp_path}/data/x" and config.mapped("runs/a", tmp_path) == f"{tmp_path}/outputs/runs/a" and config.mapped("other/a", tmp_path) == f"{tmp_path}/other/a"
    monkeypatch.setenv("PROJECT_OUTPUT_DIR", "/elsewhere")
    assert config.mapped("runs/a", tmp_path) == "/elsewhere/runs/a" and config.mapped("/abs", tmp_path) == "/abs"
    assert config.folders(tmp_path)["PROJECT_OUTPUT_DIR"] == "/elsewhere" and config.resolve({"model_path": "outputs/m"}, tmp_path) == {"model_path": "/elsewhere/m"}
    assert config.stage(config.Factory, {"output_dir": "o", "seed": 1, "template_weights": {}, "splits": {}, "num_samples": 7}).target_verified_samples == 7


def test_paths_by_what_exists(tmp_path, monkeypatch):
    for name in ("PROJECT_ROOT", "PROJECT_OUTPUT_DIR"):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("PROJECT_ROOT", str(tmp_path / "root"))
    base = tmp_path / "configs"
    (base / "runs").mkdir(parents=True)
    of = lambda: config.resolve({"model_path": "runs/a"}, base)["model_path"]
    root = tmp_path / "root/outputs/runs/a"
    assert of() == str(root)  # neither is there
    (base / "runs/a").mkdir()
    assert of() == str(base / "runs/a")
    root.mkdir(parents=True)
    assert of() == str(root)  # the alias's folder, without its variable


def test_evaluate(spark, tmp_path, rollouts):
    r = cli.evaluate(spark, str(rollouts), str(tmp_path / "m")).first()
    assert (r.num_examples, r.pass_at_1, r.execution_rate, r.mean_abs_objective_gap) == (4, 0.5, 1.0, 1.0)


def test_stream_counts_statuses(spark, tmp_path, rollouts):
    from pathwright.streaming import rollouts as stream

    q = stream.status_counts(stream.read(spark, str(rollouts.parent))).writeStream.outputMode("complete").format("memory").queryName("statuses").option("checkpointLocation", str(tmp_path.parent / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.status: r.n for r in spark.table("statuses").collect()} == {"OPTIMAL": 2, "FEASIBLE": 6}


def test_sft(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps({"problem_id": str(i), "split": "train" if i else "test", "template_name": "tsp", "question": "q", "response": "r"}) for i in range(4)))
    assert {r.split: r.n for r in cli.prepare_sft(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out")).collect()} == {"train": 3, "test": 1}


def test_missing_field_and_malformed_line_raise(spark, tmp_path):
    for text in ('{"question": "q"}', '{"problem_id": '):
        (tmp_path / "x.jsonl").write_text(text)
        with pytest.raises(Exception):
            cli.evaluate(spark, str(tmp_path / "x.jsonl"), str(tmp_path / "o"))


def test_execution(spark):
    codes = ["print('__RESULT__={\"status\": \"OPTIMAL\", \"objective_value\": 2}')", "raise ValueError", "while True: pass", None]
    df = spark.createDataFrame([(i, c, 2.0) for i, c in enumerate(codes)], "i int, code string, reference_objective double")
    with pytest.raises(PermissionError):
        execution.run(df)
    got = {r.i: (r.status, r.success) for r in classify(execution.run(df, timeout=2, allow=True)).collect()}
    assert got == {0: ("OPTIMAL", True), 1: ("RUNTIME_ERROR", False), 2: ("TIMEOUT", False), 3: ("MISSING_RESULT", False)}


def test_chat_repeats_failed_calls():
    said = iter(["not json", '{"choices": [{"message": {"content": ""}}]}', '{"choices": [{"message": {"content": null, "reasoning_content": " yes "}}]}'])
    chat = providers.Chat("http://x", "k", "m", backoff=0.0, post=lambda *a: next(said))
    assert chat.complete("?") == "yes"
    with pytest.raises(OSError):
        providers.Chat("http://x", "k", "m", retries=0, post=lambda *a: (_ for _ in ()).throw(OSError())).complete("?")


def test_replay(spark):
    recorded = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (3, 1, "c")], "k int, sample int, answer string")
    got = providers.Replay(recorded).answers(spark.createDataFrame([(1, "p"), (2, "p")], "k int, p string"), "k", "p")
    assert sorted(r.answer for r in got.collect()) == ["a", "b"]


def test_config(tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "c.yaml").write_text("output_dir: ./out\nseed: 5\ntemplate_weights: {tsp: 1}\nsplits: {train: 1.0}\nurl: https://a/b\nstyles: [a/b]\n")
    c = config.load(str(tmp_path / "c.yaml"))
    assert c["output_dir"] == str(tmp_path / "out") and c["url"] == "https://a/b" and c["styles"] == ["a/b"]
    f = config.stage(config.Factory, c)
    assert (f.seeds(), f.temperatures()) == (60, [0.25, 0.53, 0.8])
    (tmp_path / "e.yaml").write_text("")
    assert config.load(str(tmp_path / "e.yaml")) == {}
