"""The stages that ask models, with recorded answers and recorded executions."""

import json

import pytest

from pathwright import cli, config, records, stages
from pathwright.functions.text import MARKER
from pathwright.operators import instances, optima, templates
from pathwright.sources.providers import Chat, Replay


def printed(value, status="OPTIMAL"):
    return f"{MARKER}{json.dumps({'status': status, 'objective_value': value})}"


def answer(value):
    """The result print at the end is added: it reads `result`."""
    return f"```python\nresult = {{'status': 'OPTIMAL', 'objective_value': {value}}}\n```"


def test_registered_family(spark, monkeypatch):
    monkeypatch.setattr(templates, "_REGISTERED", {})
    doubled = templates.Family(
        "doubled",
        lambda seeds: seeds.selectExpr("seed", "concat('Twice ', seed, '?') AS question", "to_json(struct(seed)) AS instance"),
        lambda made: made.selectExpr("seed", "'OPTIMAL' AS status", "2 * seed AS objective_value", "CAST(NULL AS STRING) AS metadata"),
    )
    seeds, weights = spark.range(40).withColumnRenamed("id", "seed").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS seed")), {"knapsack": 1, "doubled": 2}
    with pytest.raises(ValueError, match="doubled"):
        templates.problems(seeds, weights)
    templates.register(doubled)
    assert templates.names()[-1] == "doubled" and len(templates.names()) == 6
    got = {r.seed: r for r in templates.problems(seeds, weights).collect()}
    drawn = {r.seed: r.f for r in seeds.where("seed IS NOT NULL").select("seed", instances.choose(weights).alias("f")).collect()}
    assert {s: r.template_name for s, r in got.items()} == drawn and set(drawn.values()) == set(weights)
    kept = {r.seed: r.objective_value for r in optima.solve(instances.instances(seeds, weights, ["knapsack"])).collect()}
    for s, r in got.items():
        if drawn[s] == "doubled":
            assert (r.question, r.instance) == (f"Twice {s}?", f'{{"seed":{s}}}') and tuple(r.reference_solution) == ("OPTIMAL", 2.0 * s, None)
        else:
            assert r.reference_solution.objective_value == kept[s]
    assert all(r.template_name == "doubled" for r in templates.problems(seeds, {"doubled": 1}).collect())
    with pytest.raises(ValueError, match="engine"):
        templates.register(templates.Family("tsp", doubled.make, doubled.solve))


@pytest.fixture
def problems(spark):
    rows = [(p, "knapsack", f"q {p}", ("OPTIMAL", 10.0)) for p in "ab"]
    return spark.createDataFrame(rows, "problem_id string, template_name string, question string, reference_solution struct<status: string, objective_value: double>")


@pytest.fixture
def ran(spark):
    """Executions of the samples of both problems: a finds the optimum with its second sample, b never."""
    out = {"a::sample0": (0, printed(9.0)), "a::sample1": (0, printed(10.00005)), "b::sample0": (1, ""), "b::sample1": (0, printed(7.0, "FEASIBLE"))}
    return stages.replayed(spark.createDataFrame([(k, e, False, o, "") for k, (e, o) in out.items()], "trajectory_id string, exit_code int, timed_out boolean, stdout string, stderr string"), "trajectory_id")


@pytest.fixture
def policy(spark):
    return Replay(spark.createDataFrame([(p, s, "```python\nprint(1)\n```") for p in "ab" for s in (1, 2)], "problem_id string, sample int, answer string"))


def judge(spark, said):
    return Replay(spark.createDataFrame([(k, 1, v) for k, v in said.items()], "trajectory_id string, sample int, answer string"))


def test_rollouts_and_metrics(spark, problems, policy, ran):
    said = {"a::sample0": '{"overall_score": 0.9, "strengths": ["x"]}', "a::sample1": '```json\n{"overall_score": "0.5", "verdict": "good"}\n```', "b::sample0": "no", "b::sample1": '{"overall_score": "high"}'}
    got = {r.problem_id: r.trajectories for r in stages.rollouts(problems, policy, ran, judge(spark, said), "m").collect()}
    assert [t.trajectory_id for t in got["a"]] == ["a::sample1", "a::sample0"]
    first, second = got["a"]
    assert first.verification.success and first.verification.error_message is None and first.teacher_evaluation.verdict == "good" and first.source == "m"
    assert second.verification.error_message == "another objective" and second.teacher_evaluation.strengths == ["x"]
    # b: neither has a usable score; the one that ran has the greater process score
    assert [(t.trajectory_id, t.verification.status) for t in got["b"]] == [("b::sample1", "FEASIBLE"), ("b::sample0", "RUNTIME_ERROR")]
    assert (got["b"][1].teacher_evaluation.overall_score, got["b"][1].teacher_evaluation.verdict) == ("0.0", "bad")

    rows = stages.rollouts(problems, policy, ran, judge(spark, said), "m")
    assert stages.rollout_summary(rows).first().asDict() == {"num_problems": 2, "num_trajectories": 4, "solver_status_counts": {"OPTIMAL": 2, "FEASIBLE": 1, "RUNTIME_ERROR": 1}}
    m = stages.metrics(stages.predictions(rows)).first()
    # a's gap is 0.00005, b's 3; only a has a score
    assert (m.num_examples, m.execution_rate, m.feasible_rate, m.pass_at_1, m.mean_abs_objective_gap, m.teacher_mean_score, m.teacher_var_score) == (2, 1.0, 0.5, 0.5, 1.5, 0.5, 0.0)


def test_comparison(spark, problems, policy, ran):
    empty = Replay(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "problem_id string, sample int, answer string"))
    got, details = stages.compare_models(problems, {"two": policy, "one": empty}, ran)
    assert {r.model_name: (r.num_examples, r.pass_at_1) for r in got.collect()} == {"two": (2, 0.5), "one": (2, 0.0)}
    assert details.count() == 4


def test_wordings(spark):
    seeds = spark.createDataFrame([(i, "tsp", "own", "{}", ("OPTIMAL", 1.0)) for i in range(4)], "at long, template_name string, canonical string, instance string, reference_solution struct<status: string, objective_value: double>")
    said = {0: '{"variants": [" first ", 3, "own", "first", "", "second"]}', 1: "nothing", 2: '{"variants": []}'}
    rewriter = Replay(spark.createDataFrame([(k, 1, v) for k, v in said.items()], "at long, sample int, answer string"))
    read = lambda *a: sorted((r.at, r.variant, r.question) for r in stages.variants(seeds, rewriter, *a)[0].collect())
    assert read(3, True, []) == [(0, 0, "own"), (0, 1, "first"), (0, 2, "second"), (1, 0, "own"), (2, 0, "own"), (3, 0, "own")]
    assert read(2, False, []) == [(0, 0, "first"), (0, 1, "own"), (1, 0, "own"), (2, 0, "own"), (3, 0, "own")]
    assert read(0, True, []) == [(i, 0, "own") for i in range(4)]
    assert stages.variants(seeds, rewriter, 3, True, [])[1] == 1
    with pytest.raises(RuntimeError):
        stages.variants(seeds, rewriter, 3, True, [], strict=True)


def factory(tmp_path, **more):
    return config.Factory(**({"output_dir": str(tmp_path / "out"), "seed": 5, "template_weights": {"knapsack": 1, "assignment": 1}, "splits": {"train": 0.5, "test": 0.5}, "max_seed_problems": 6, "question_variants_per_seed": 1, "trajectories_per_variant": 2, "target_verified_samples": 4} | more))


def test_generate_dataset(spark, tmp_path):
    c = factory(tmp_path)
    seeds = {r.at: r for r in stages.seed_problems(spark, c.seed, c.seeds(), c.template_weights).collect()}
    group = lambda i: f"{seeds[i].template_name}-seed{i:04d}-q00"
    teacher = Replay(spark.createDataFrame([(group(i), s, "x = 1") for i in range(6) for s in (1, 2)], "group_id string, sample int, answer string"))
    right = {(0, 0), (1, 1), (2, 0), (2, 1), (4, 0)}
    runs = [(f"{group(i)}-t{t:02d}", 0, False, printed(seeds[i].reference_solution.objective_value + (0 if (i, t) in right else 1)), "") for i in range(6) for t in (0, 1)]
    run = stages.replayed(spark.createDataFrame(runs, "attempt_id string, exit_code int, timed_out boolean, stdout string, stderr string"), "attempt_id")
    got = stages.generate_dataset(spark, c, teacher, run).first()
    # the fourth success is the second attempt of seed 2
    assert (got.accepted_samples, got.attempted_trajectories, got.verification_rate, got.seed_problem_count, got.question_variant_count, got.api_request_errors) == (4, 6, 0.6667, 3, 3, 0)
    rows = spark.read.schema(records.DATASET).json(str(tmp_path / "out/dataset")).collect()
    assert {r.problem_id for r in rows} == {f"{group(i)}-t{t:02d}" for i, t in right - {(4, 0)}}
    assert len({r.split for r in rows if r.problem_id.startswith(group(2))}) == 1 and got.splits == {s: sum(r.split == s for r in rows) for s in ("train", "test")}
    assert spark.read.json(str(tmp_path / "out/generation_trace")).count() == 6
    # a target that is not reached: every attempt counts; a failed call drops its question's answers
    class Failing:
        def answers(self, df, key, prompt):
            said = teacher.answers(df, key, prompt)
            return said.selectExpr(key, "sample", "answer", f"IF({key} = '{group(1)}' AND sample = 1, 'OSError', error) AS error")

    got = stages.generate_dataset(spark, factory(tmp_path, target_verified_samples=40), Failing(), run).first()
    assert (got.accepted_samples, got.attempted_trajectories, got.seed_problem_count, got.api_request_errors) == (4, 10, 6, 1)


def test_evaluate_predictions(spark, tmp_path):
    rows = [{"problem_id": p, "template_name": "tsp", "question": "q", "response": answer(v), "reference_solution": {"status": "OPTIMAL", "objective_value": 3.0}} for p, v in (("a", 3.0), ("b", 4.0), ("c", 3.0))]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "p.jsonl").write_text(json.dumps({"problem_id": "a", "response": "", "code": "raise SystemExit(3)"}))
    with pytest.raises(PermissionError):
        cli.evaluate_predictions(spark, str(tmp_path / "d.jsonl"), str(tmp_path / "o"))
    own = cli.evaluate_predictions(spark, str(tmp_path / "d.jsonl"), str(tmp_path / "o"), allow_execution=True).first()
    assert (own.num_examples, own.execution_rate, own.feasible_rate, own.pass_at_1) == (3, 1.0, 1.0, 0.6667)
    given = cli.evaluate_predictions(spark, str(tmp_path / "d.jsonl"), str(tmp_path / "o"), str(tmp_path / "p.jsonl"), True).first()
    assert (given.num_examples, given.execution_rate, given.pass_at_1) == (1, 0.0, 0.0)


def test_commands_with_recorded_answers(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("PATHWRIGHT_CHAT_URL", raising=False)
    rows = [{"problem_id": p, "template_name": "tsp", "question": "q", "reference_solution": {"status": "OPTIMAL", "objective_value": 3.0}} for p in "ab"]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"problem_id": p, "sample": s, "answer": answer(2.0 + s)}) for p in "ab" for s in (1, 2)))
    text = f"dataset_path: {tmp_path}/d.jsonl\nrecorded_answers: {tmp_path}/r.jsonl\nrun_root: {tmp_path}/runs\nallow_execution: true\nmodel_path: m\n"
    (tmp_path / "c.yaml").write_text(text)
    got = cli.evaluate_model(spark, str(tmp_path / "c.yaml")).first()
    assert (got.num_examples, got.pass_at_1, got.teacher_mean_score) == (2, 1.0, 0.0)
    assert cli.generate_real_rollouts(spark, str(tmp_path / "c.yaml")).first().num_trajectories == 4
    (tmp_path / "n.yaml").write_text(text.replace("recorded_answers", "other"))
    with pytest.raises(RuntimeError):
        cli.evaluate_model(spark, str(tmp_path / "n.yaml"))


def test_chat_asks_at_each_temperature(spark):
    heats = []
    chat = Chat("http://x", "k", "m", temperatures=(0.1, 0.7), post=lambda u, h, body, t: heats.append(json.loads(body)["temperature"]) or '{"choices": [{"message": {"content": "ok"}}]}')
    assert [chat.complete("?", t) for t in chat.temperatures] == ["ok", "ok"] and heats == [0.1, 0.7]
