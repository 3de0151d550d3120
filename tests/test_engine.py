"""The engine on the small matrices of FIXTURES.md."""

import json
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from guidewell import cli, model
from guidewell.functions.linear import conjugate_gradients, ridge, solve_from_gram
from guidewell.functions.quadratic import best_of_maps, descend, objective, solve
from guidewell.operators import clip, labels, normalize, output, ridge as ridge_op, stats, targets
from guidewell.plans.run import run
from guidewell.sources.datasets import from_rows, write_folder

KW = {"perturb_column": "perturbation", "ctrl_name": "control"}
M1 = [[4, 1, 0], [5, 1, 0], [1, 5, 0], [1, 6, 0], [0, 1, 5], [0, 1, 6]]
L1 = ["control"] * 2 + ["pertA"] * 2 + ["pertB"] * 2


def t1(spark):
    return from_rows(spark, M1, {"perturbation": L1}, highly_variable=[1, 1, 1])


def scores(result):
    return [(r.row_id, r.p_idx, r.score) for r in result.scores.orderBy("row_id", "p_idx").collect()]


@pytest.mark.parametrize("mode", ["single", "multilabel"])
def test_one_perturbation_per_cell(spark, mode):
    out = run(t1(spark), mode=mode, target_mode="hvg", scale_score=False, perturbations=["pertA", "pertB"], **KW)
    assert [s[:2] for s in scores(out)] == [(2, 1), (3, 1), (4, 2), (5, 2)]
    assert np.allclose([s[2] for s in scores(out)], [0.325242, 0.344758, 0.334713, 0.335287], atol=1e-6)


def test_two_guides_and_multiplicity(spark):
    rows = [[8, 1, 1], [7, 1, 1], [1, 8, 1], [1, 7, 1], [1, 1, 8], [1, 1, 7], [1, 7, 7]]
    data = from_rows(spark, rows, {"perturbation": [*L1, " pertA + pertB "]}, highly_variable=[1, 1, 1])
    out = run(data, mode="multilabel", target_mode="hvg", score_lambda=0.2, scale_factor=10, scale_score=False, **KW)
    assert np.allclose([s[2] for s in scores(out)], [0.109915, 0.105772, 0.109915, 0.105772, 0.078472, 0.078472], atol=1e-6)
    assert out.metadata["guide_multiplicity"]["multi_count"] == 1


def test_background(spark):
    data = from_rows(spark, [[9, 1], [8, 2], [2, 8], [1, 9], [9, 1], [4, 6]], {"perturbation": ["control"] * 4 + ["pertA"] * 2, "cluster": ["c1", "c1", "c2", "c2", "c1", "c2"]}, highly_variable=[1, 1])
    out = run(data, target_mode="hvg", lr_lambda=0, scale_factor=10, target_sum=100, scale_score=False, background_cluster_column="cluster", **KW)
    assert np.allclose([s[2] for s in scores(out)], [0.035728, 0.164272], atol=1e-6)
    assert out.metadata["background_control_cell_counts"] == {"c1": 2, "c2": 2}


def test_ranked_targets_and_clip(spark):
    out = run(t1(spark), clip_quantile=0.5, **KW)
    assert out.metadata["target_gene_metadata"]["pertB"]["selected_genes"] == ["g3", "g1", "g2"]
    assert np.allclose([s[2] for s in scores(out)], [1, 0.724412, 0.999748, 1], atol=1e-6)


def test_cells_without_expression_and_without_counts(spark):
    data = from_rows(spark, [*M1, [0, 0, 0], [0, 0, 0]], {"perturbation": [*L1, "control", "pertA"]}, highly_variable=[1, 1, 1])
    out = run(data, target_mode="hvg", **KW)
    assert out.metadata["control_cell_count"] == 3
    assert [s[0] for s in scores(out)] == [2, 3, 4, 5, 7]


def test_csv_and_manifest(spark, tmp_path):
    data = from_rows(spark, [[5, 1], [4, 1], [1, 5], [3, 3]], {"perturbation": ["control", "control", "pertA", "pertB"]}, obs_index=[f"cell_{i}" for i in range(4)], highly_variable=[1, 1])
    made = run(data, target_mode="hvg", perturbations=["pertA"], scale_score=False, output_dir=f"file://{tmp_path}/out", **KW)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[0] != ".") == [output.MANIFEST, output.SCORES]
    assert json.loads((tmp_path / "out" / output.MANIFEST).read_text()) == made and made["clip_method"] is None and made["clip_bins"] is None
    assert (tmp_path / "out" / output.SCORES).read_text().splitlines()[-1] == "cell_3,,"
    table = pd.read_csv(made["score_output_paths"]["scores"]).set_index("obs_index")
    assert list(table.columns) == ["ps_score", "perturbation"] and made["score_count"] == 4 and made["score_output_format"] == "csv_long"
    assert table.ps_score["cell_0"] == 0 and math.isclose(table.ps_score["cell_2"], 0.336667, abs_tol=1e-6)
    assert pd.isna(table.ps_score["cell_3"]) and pd.isna(table.perturbation["cell_3"])


@pytest.mark.parametrize(("labels", "kw", "message"), [
    (L1, {"perturbations": ["pertC"]}, "not present"),
    (L1, {"perturbations": ["pertA", "pertA"]}, "unique"),
    (["control", "", *L1[2:]], {}, "row 1"),
    (["control", None, *L1[2:]], {}, "row 1"),
    (["control", "control", "A+", *L1[3:]], {"mode": "multilabel"}, "Malformed"),
    (["control", "control", "A+control", *L1[3:]], {"mode": "multilabel"}, "row 2"),
    (["control"] * 6, {}, "non-control"),
    (["pertA"] * 6, {}, "control cells"),
    (L1, {"logfc_threshold": -1}, ">= 0"),
    (L1, {"mode": "other"}, "mode"),
])
def test_errors(spark, labels, kw, message):
    with pytest.raises(ValueError, match=message):
        run(from_rows(spark, M1, {"perturbation": labels}, highly_variable=[1, 1, 1]), target_mode=kw.pop("target_mode", "hvg"), **KW, **kw)


def test_enumeration_and_descent_agree():
    rng = np.random.default_rng(3)
    for k in (2, 3, 4):
        b = rng.normal(size=(k, 6))
        gram, rhs = b @ b.T, rng.normal(size=(20, k)) * 3
        a, d = best_of_maps(gram, rhs, 0.1, 2.0), descend(gram, rhs, 0.1, 2.0)
        assert np.allclose(objective(a, gram, rhs, 0.1), objective(d, gram, rhs, 0.1), atol=1e-8)
        assert np.allclose(a, d, atol=1e-5)


def test_singular_and_unreachable_programs():
    flat = np.ones((2, 2))
    assert np.allclose(solve(flat, np.array([[1.0, 1.0]]), 0.0, 5.0).sum(), 1)  # any split is as good
    assert (solve(np.eye(3), np.array([[-1.0, -2.0, -3.0]]), 0.0, 1.0) == 0).all()
    assert (solve(np.zeros((1, 1)), np.array([[3.0]]), 0.0, 1.0) == 0).all()
    rng = np.random.default_rng(8)
    b = rng.normal(size=(6, 9))
    s = solve(b @ b.T, rng.normal(size=(10, 6)) * 4, 0.1, 2.0)
    assert ((s >= 0) & (s <= 2)).all() and s.any()


def test_ridge_solves():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2, (40, 6)).astype(float), rng.normal(size=(40, 3))
    assert np.allclose(ridge(x, y, 0.5), np.linalg.solve(x.T @ x + 0.5 * np.eye(6), x.T @ y))
    gram = x.T @ x + 0.5 * np.eye(6)
    row, column = np.nonzero(gram)
    assert np.allclose(conjugate_gradients(row, column, gram[row, column], x.T @ y), np.linalg.solve(gram, x.T @ y))
    assert np.allclose(solve_from_gram(np.ones((2, 2)), np.ones((2, 1)), 0.0), 0.5)  # singular: the shortest solution


WIDE = ["control", "control", "control", "a", "b", "c", "d", "e", "a+b", "a+b+c", "a+b+c+d", "a+b+c+d+e", "e+d", "d+e"]


def wide(spark):
    rng = np.random.default_rng(12)
    rows = rng.poisson(2, (len(WIDE), 9)).astype(float)
    for i, label in enumerate(WIDE):
        for p in label.split("+"):
            if p != "control":
                rows[i, "abcde".index(p)] += 25
    clusters = ["x" if i % 2 else "y" for i in range(len(WIDE))]
    return from_rows(spark, rows.tolist(), {"perturbation": WIDE, "cluster": clusters}, highly_variable=[1] * 9)


@pytest.mark.parametrize("kw", [{"mode": "multilabel"}, {"mode": "multilabel", "background_cluster_column": "cluster"}, {"mode": "multilabel", "clip_quantile": 0.9, "scale_score": False}])
def test_exchanged_effects_score_as_broadcast_ones(spark, monkeypatch, kw):
    """Up to five perturbations a cell, by both ways; the second is that of effects too large to broadcast."""
    near = scores(run(wide(spark), target_mode="hvg", scale_factor=10, **KW, **kw))
    assert {len([s for s in near if s[0] == i]) for i in range(3, len(WIDE))} == {1, 2, 3, 4, 5}
    monkeypatch.setattr(model, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ridge_op, "DENSE", 0)
    far = scores(run(wide(spark), target_mode="hvg", scale_factor=10, **KW, **kw))
    assert [s[:2] for s in near] == [s[:2] for s in far] and np.allclose([s[2] for s in near], [s[2] for s in far], atol=2e-6)


def test_exchanged_effects_in_single_mode(spark, monkeypatch):
    near = scores(run(t1(spark), clip_quantile=0.5, **KW))
    monkeypatch.setattr(model, "BROADCAST_BYTES", 0)
    assert np.allclose([s[2] for s in near], [s[2] for s in scores(run(t1(spark), clip_quantile=0.5, **KW))], atol=1e-6)


def test_a_run_frees_what_it_keeps(spark):
    spark.catalog.clearCache()
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = kept()
    out = run(t1(spark), target_mode="hvg", **KW)
    assert kept() > before
    rows = scores(out)
    out.release()
    assert len(out.held) == 0 and scores(out) == rows


def test_command_line(spark, tmp_path, capsys):
    rows = [[4, 1, 0], [5, 1, 0], [1, 5, 0], [1, 1, 5], [1, 5, 5]]
    data = from_rows(spark, rows, {"perturbation": ["control", "control", "pertA", "pertB", "pertA+pertB"]}, obs_index=[f"cell_{i}" for i in range(5)], highly_variable=[1, 1, 1])
    write_folder(data, f"{tmp_path}/screen")
    made = cli.main(["--dataset-path", f"{tmp_path}/screen", "--output-dir", f"{tmp_path}/out", "--perturb-column", "perturbation", "--ctrl-name", "control", "--mode", "multilabel", "--target-mode", "hvg", "--chunk-size", "2", "--no-scale-score"])
    assert made["score_count"] == 6 and made["scored_pair_count"] == 4 and made["dataset_path"] == f"{tmp_path}/screen"
    table = pd.read_csv(made["score_output_paths"]["scores"])
    assert set(table[table.obs_index == "cell_4"].perturbation) == {"pertA", "pertB"} and (table[table.perturbation == "control"].ps_score == 0).all()
    got = table[table.perturbation != "control"].ps_score
    assert np.allclose(got, [0.386473, 0.341642, 0.282177, 0.327849], atol=1e-6)
    cli.cli(["--dataset-path", f"{tmp_path}/screen", "--output-dir", f"{tmp_path}/again", "--perturb-column", "perturbation", "--ctrl-name", "control", "--mode", "multilabel", "--target-mode", "hvg", "--no-scale-score"])
    assert json.loads(capsys.readouterr().out)["score_count"] == 6


def test_json_of_odd_values():
    made = output.jsonable({1: np.arange(3), "p": Path("/x"), "t": (np.float32(0.5), np.int64(2), None, True), "n": {"a": np.bool_(False)}})
    assert made == {"1": [0, 1, 2], "p": "/x", "t": [0.5, 2, None, True], "n": {"a": False}}


def test_malformed_rows_raise(spark):
    data = t1(spark)
    for rows, message in (([(0, [0, 1], [1.0])], "match"), ([(0, [0, 9], [1.0, 2.0])], "match"), ([(0, [0, 0], [1.0, 2.0])], "match"), ([(0, [0], [1.0]), (0, [1], [1.0])], "repeated")):
        expr = spark.createDataFrame(rows, "row_id long, indices array<int>, values array<double>")
        with pytest.raises(ValueError, match=message):
            normalize.check_rows(expr, 3)
        with pytest.raises(ValueError, match=message):
            run(model.PerturbData(data.cells, data.genes, expr), target_mode="hvg", **KW)
    normalize.check_rows(data.expr, 3)


def test_single_codes(spark):
    cells = labels.parse(spark.createDataFrame([(0, "c"), (1, "a"), (2, "a+b")], "row_id long, label0 string"), "label0", "multilabel", "c").cells
    with pytest.raises(ValueError, match="row 2"):
        labels.single_codes(cells)
    assert [r.p_idx for r in labels.single_codes(cells.where("row_id < 2")).orderBy("row_id").collect()] == [0, 1]


def test_statistics_of_matrices(spark):
    rng = np.random.default_rng(4)
    case, control = rng.poisson(1.0, (12, 5)).astype(float), rng.poisson(1.5, (9, 5)).astype(float)
    entries = lambda x: spark.createDataFrame([(int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "gene_id int, y double")
    genes = spark.createDataFrame([(i,) for i in range(5)], "gene_id int")
    got = [r.t for r in targets.welch_of_matrices(entries(case), entries(control), genes, 12, 9).orderBy("gene_id").collect()]
    assert np.allclose(got, (case.mean(0) - control.mean(0)) / np.sqrt(case.var(0, ddof=1) / 12 + control.var(0, ddof=1) / 9))
    with pytest.raises(ValueError, match="both"):
        targets.welch_of_matrices(entries(case), entries(control), genes, 12, 0)
    with pytest.raises(ValueError, match="k must"):
        targets.top_genes(genes, 0)
    clipped = clip.clip_exactly(entries(case), genes, 12, 0.8).groupBy("gene_id").sum("y").orderBy("gene_id").collect()
    want = np.minimum(case, np.quantile(case, 0.8, axis=0)).sum(0)
    assert np.allclose([r[1] for r in clipped], want[want > 0])
    for n, q in ((0, 0.5), (5, 0.0)):
        with pytest.raises(ValueError, match="quantile"):
            clip.histogram_quantiles(genes, genes, n, q, 16, 1.0)
    with pytest.raises(ValueError, match="clusters"):
        stats.cluster_background(spark.createDataFrame([(1, True)], "row_id long, is_control boolean"), genes, genes)


def test_streamed_sums(spark, tmp_path):
    """Sums over a stream of row files equal those of the whole."""
    from guidewell.streaming.moments import streamed_group_sums

    rows = [(0, True, [], [0, 1], [3.0, 1.0]), (1, False, [1], [0], [2.0]), (2, False, [1, 2], [1, 2], [4.0, 4.0])]
    schema = "row_id long, is_control boolean, active array<int>, indices array<int>, values array<double>"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).write.parquet(f"{tmp_path}/in/{i}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    query = streamed_group_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    whole = stats.group_sums(normalize.normalized(spark.createDataFrame(rows, schema), 1e4))
    plain = lambda t: sorted((r.p_idx, r.gene_id, round(r.s, 9), round(r.q, 9), round(r.lin, 9)) for r in t.collect())
    assert plain(spark.table("sums")) == plain(whole) and len(plain(whole)) > 3
