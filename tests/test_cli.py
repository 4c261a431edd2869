import json

import pytest

from joinloom.__main__ import main, parser


def test_plan_star_join_and_grid(spark, data, tmp_path, capsys):
    sink = f"file://{tmp_path}/runs"
    for strategy in ("SMJ", "AUTO"):
        (row,) = main(["--sink", sink, "plan", "q7", "--data", data, "--strategy", strategy])
        assert row["plan"] == "q7" and row["seconds"] > 0
    assert spark.read.csv(sink, header=True).count() == 2
    assert main(["star", "--fact", "500", "--dim", "16", "--strategy", "shj"])[0]["fact"] == 500
    rows = main(["join", "--nr", "8", "--ratio", "2", "--pr", "2", "--ps", "1", "--algo", "phj", "--key", "bigint", "--payload", "bigint", "--repeats", "2"])
    assert [(r["rows"], r["strategy"], r["error"]) for r in rows] == [(1024, "PHJ", "")] * 2
    rows = main(["grid", "4b8b", "--smaller", "18", "--repeats", "1"])
    assert len(rows) == 24 and not any(r["error"] for r in rows)
    main(["query", "scan_cast", "--data", data, "--rows", "2"])
    assert "NATION_0" in capsys.readouterr().out


def test_grids_are_saved_and_experiments_listed_in_files(spark, tmp_path):
    from joinloom.plans import experiments

    some = experiments.grid(spark).where("nr = 20 and ratio = 1 and unique_keys = 21 and pr = 2 and ps = 1")
    experiments.save_grid(some, f"file://{tmp_path}/grid")
    again = experiments.saved_grid(spark, f"file://{tmp_path}/grid")
    assert again.dtypes == some.dtypes and sorted(map(tuple, again.collect())) == sorted(map(tuple, some.collect()))
    listed = {"experiments": [{"name": "mine", "group": 3, "output": "mine.csv", "key": "bigint", "query": "SELECT DISTINCT * FROM df WHERE algo = 'smj' AND zipf_factor = 0 AND selectivity IN (1, 4) AND dist = 'uniform' ORDER BY selectivity"}]}
    (tmp_path / "e.json").write_text(json.dumps(listed))
    (tmp_path / "e.yaml").write_text(f"experiments:\n  - name: mine\n    group: 0\n    output: mine.csv\n    key: bigint\n    query: >\n      {listed['experiments'][0]['query']}\n")
    for name in ("e.json", "e.yaml"):
        rows = main(["--sink", f"file://{tmp_path}/{name}-runs", "grid", "mine", "--experiments", f"file://{tmp_path}/{name}", "--configs", f"file://{tmp_path}/grid", "--smaller", "12", "--repeats", "1"])
        assert [(r["selectivity"], r["rows"], r["error"]) for r in rows] == [(1, 512, ""), (4, 128, "")]
        assert spark.read.csv(f"file://{tmp_path}/{name}-runs/mine.csv", header=True).count() == 2
    with pytest.raises(SystemExit):
        main(["grid", "other", "--experiments", f"file://{tmp_path}/e.json"])


def test_no_configuration_is_dropped(spark):
    from joinloom.plans import experiments

    df = experiments.grid(spark).where("nr = 20 and pr = 1 and ps < 4")
    assert len(experiments.configs(df)) == df.count() > 10_000


def test_unknown_names():
    for bad in (["plan", "q1", "--data", "x"], ["plan", "q7", "--data", "x", "--strategy", "nested"], []):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)
