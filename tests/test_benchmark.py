import inspect
import itertools

from tetragrid.plans import benchmark


def test_the_default_grid_has_every_candidate():
    for f in (benchmark.run_task, benchmark.train_and_evaluate):
        grid = inspect.signature(f).parameters["grid"].default
        assert len(list(itertools.product(*grid.values()))) == 24 and 1000 in grid["n_estimators"]


def test_the_command_line_uses_the_full_grid_unless_told(spark, monkeypatch):
    seen = []
    task = type("Task", (), {"name": "t", "train_path": "", "test_path": ""})
    rows = spark.createDataFrame([(1, "train")], "id long, split string")
    monkeypatch.setattr(benchmark, "discover_tasks", lambda *a: type("Tasks", (), {"collect": lambda self: [task]})())
    monkeypatch.setattr(benchmark, "load_task", lambda *a: rows)
    monkeypatch.setattr(benchmark, "run_task", lambda *a, grid, **b: seen.append(grid))
    for more in ([], ["--full-grid"], ["--small-grid"]):
        benchmark.main(["--data-root", "x", *more])
    assert seen == [benchmark.FULL_GRID, benchmark.FULL_GRID, benchmark.SMALL_GRID]
