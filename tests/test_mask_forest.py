"""Permutation tests of the mask over blocks of rows against plain sums over whole datasets."""

import numpy as np
import pandas as pd
import pytest

from lacuna.operators import mask_forest as mf


def frame(n, blocks, seed=0):
    rng = np.random.default_rng(seed)
    block = np.sort(rng.integers(0, blocks, n)) if blocks > 1 else np.zeros(n, int)
    codes, mask = rng.integers(0, 20, (n, 4)), rng.integers(0, 4, n) == 0
    sizes, gone = [np.bincount(block, w, blocks).astype(int).tolist() for w in (None, mask.astype(float))]
    f = pd.DataFrame({"row_id": range(n), "dataset_no": 3, "mask": mask.astype(int), "block": block, **{f"c{k + 1}": codes[:, k] for k in range(4)}, **{f"top{k}": 19 for k in range(1, 5)}})
    return f.assign(sizes=[sizes] * n, gone=[gone] * n)


@pytest.mark.parametrize("held", [False, True])
@pytest.mark.parametrize("blocks", [1, 4])
def test_blocks_add_up_to_the_dataset(held, blocks):
    spec, f = mf.Forest(6, 12, 3, 4, 9, held), frame(160, blocks)
    made = [mf.Block(spec, own) for _, own in f.groupby("block")]
    total = {t: sum(b.sums(t) for b in made) for t in range(spec.trees)}
    got = sum(b.histogram(total.__getitem__) for b in made)
    labels, fold = np.concatenate([b.labels for b in made]), np.concatenate([b.fold for b in made])
    assert (labels.sum(axis=0) == f["mask"].sum()).all() and len({tuple(c) for c in labels.T}) == 7  # permutations keep the number of missing rows
    assert sorted(np.bincount(fold, f["mask"]))[0] >= f["mask"].sum() // 5
    out, times = np.zeros(labels.shape), np.zeros((160, 1))
    for t in range(spec.trees):
        leaf = np.concatenate([mf.leaf(b.codes, *b.plan, t) for b in made])
        w = np.concatenate([np.ones(len(b.labels)) if held else b._weight(t) for b in made])
        assert w.sum() == 160
        for i in range(160):
            if not held and w[i]:
                continue
            others = (leaf == leaf[i]) & ((fold != fold[i]) if held else True)
            out[i] += labels[others].T @ w[others] / w[others].sum() if w[others].sum() >= 4 else f["mask"].mean()
            times[i] += 1
    share = np.where(times > 0, out / np.maximum(times, 1), f["mask"].mean())
    if held:
        want = []
        for c in range(7):
            each = []
            for k in range(5):
                s = np.floor(share[:, c] * mf.STEPS + 0.5)
                one, zero = s[(fold == k) & (labels[:, c] == 1)], s[(fold == k) & (labels[:, c] == 0)]
                if len(one) and len(zero):
                    each.append(((one[:, None] > zero) + 0.5 * (one[:, None] == zero)).mean())
            want.append(np.mean(each))
        assert mf.aucs(got) == pytest.approx(want, abs=0.01)
    else:
        want = []
        for c in range(7):
            a, b = (np.bincount(np.minimum(share[labels[:, c] == k, c] * 20, 19).astype(int), minlength=20) for k in (1, 0))
            p, q = a / a.sum() + 1e-10, b / b.sum() + 1e-10
            want.append(0.5 * (p * np.log(2 * p / (p + q))).sum() + 0.5 * (q * np.log(2 * q / (p + q))).sum())
        assert mf.divergences(got) == pytest.approx(want, abs=0.02)


def test_datasets_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for no, kind in enumerate(("MCAR", "MAR", "few")):
        x = rng.normal(0, 1, (700, 4))
        gone = {"MCAR": rng.random(700) < 0.2, "MAR": rng.random(700) < np.clip(0.4 / (1 + np.exp(-3 * x[:, 0])), 0, 1), "few": np.arange(700) < 3}[kind]
        rows += [(kind, no, i, None if g else 1.0, *map(float, v)) for i, (g, v) in enumerate(zip(gone, x, strict=True))]
    panel = spark.createDataFrame(rows, "dataset_id string, dataset_no long, row_id long, x0 double, x1 double, x2 double, x3 double, x4 double")
    monkeypatch.setattr(mf, "BLOCK", 200)
    p = {r["dataset_id"]: r for r in mf.pklm(panel, 40, 30).collect()}
    a = {r["dataset_id"]: r for r in mf.mask_auc_permutation(panel, 40, 30).collect()}
    assert p["MAR"]["pklm_p"] < 0.03 < p["MCAR"]["pklm_p"] and p["few"]["pklm_p"] == 1 and a["few"]["auc_obs"] == 0.5
    assert a["MAR"]["auc_obs"] > 0.7 and a["MAR"]["auc_p"] < 0.03 < a["MCAR"]["auc_p"]
    monkeypatch.setattr(mf, "BLOCK", 5000)
    one = {r["dataset_id"]: r for r in mf.mask_auc_permutation(panel, 40, 30).collect()}
    assert one["MAR"]["auc_obs"] == pytest.approx(a["MAR"]["auc_obs"], abs=0.03)
