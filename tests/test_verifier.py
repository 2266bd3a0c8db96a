"""The gated verifier against differences, a plain descent over arrays, and rows that only a gate can tell apart."""

import numpy as np
import pytest

from cadenza.operators import verifier

SIZES = verifier.Sizes(audio=6, phone=3, group=2, hidden=5)


def arrays(n, seed=1):
    draw = np.random.default_rng(seed)
    return draw.normal(size=(n, 3)), draw.normal(size=(n, 2)), draw.integers(1, 5, n), draw.integers(1, 4, n), draw.integers(0, 2, n).astype(float)


@pytest.mark.parametrize("gated", [True, False])
def test_gradient_is_that_of_the_loss(gated):
    rows = arrays(20)
    p = verifier.initial(SIZES, 3, 2, 5, 4, 7)
    p["w2"] = np.linspace(-1, 1, SIZES.hidden)
    _, found = verifier.gradient(p, *rows, 2.5, gated)
    w, g = verifier.flat(p), verifier.flat(found)
    for i in range(0, w.size, 3):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        expected = (verifier.gradient(verifier.shaped(up, p), *rows, 2.5, gated)[0] - verifier.gradient(verifier.shaped(down, p), *rows, 2.5, gated)[0]) / 2e-6
        assert g[i] == pytest.approx(expected, abs=1e-4)


def frame(spark, n, seed=3):
    """Feature a says an error where it is high for the phones of group x, where it is low for those of group y."""
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, group = float(draw.normal()), float(draw.normal()), "xy"[i % 2]
        rows.append((i, a, b, float(draw.normal()), f"{group}{i % 6}", group, int((a > 0) == (group == "x"))))
    return spark.createDataFrame(rows, "id int, w2v_0 double, w2v_1 double, gop double, target_phone string, phone_group string, gold int")


def test_fit_is_the_plain_descent_however_the_rows_are_parted(spark):
    df = frame(spark, 240)
    options = dict(sizes=SIZES, steps=5, rate=0.05)
    model = verifier.fit(df.repartition(7), "gold", ["w2v_0", "w2v_1"], ["gop"], **options)
    rows = df.toPandas()
    x = rows[["w2v_0", "w2v_1"]].to_numpy()
    x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    z = rows[["gop"]].to_numpy()
    z = (z - z.mean(axis=0)) / (z.std(axis=0) + 1e-6)
    names = [["<pad>", "<unk>", *sorted(set(rows[c]))] for c in ("target_phone", "phone_group")]
    ids = [np.array([known.index(v) for v in rows[c]]) for known, c in zip(names, ("target_phone", "phone_group"))]
    y = rows["gold"].to_numpy().astype(float)
    p = verifier.initial(SIZES, 2, 1, len(names[0]), len(names[1]), 42)
    m = v = 0.0
    for step in range(1, 6):
        g = verifier.flat(verifier.gradient(p, x, z, *ids, y, (y == 0).sum() / (y == 1).sum(), True)[1]) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = verifier.flat(p)
        p = verifier.shaped(w - 0.05 * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + 1e-4 * w), p)
    assert verifier.flat(model.parameters) == pytest.approx(verifier.flat(p), abs=1e-6)
    expected = 1 / (1 + np.exp(-verifier.forward(p, x, z, *ids, True)[0]))
    found = {r["id"]: r["verifier_score"] for r in verifier.scored(model, df).collect()}
    assert [found[i] for i in rows["id"]] == pytest.approx(list(expected), abs=1e-6)


def test_held_out_rows_unknown_phones_and_absent_values(spark):
    model = verifier.fit(frame(spark, 600), "gold", ["w2v_0", "w2v_1"], ["gop"], steps=60, rate=0.05)
    held = verifier.scored(model, frame(spark, 400, seed=9)).collect()
    assert np.mean([(r["verifier_score"] >= 0.5) == (r["gold"] == 1) for r in held]) > 0.9
    odd = spark.createDataFrame([(1, None, None, None, None, None, "kept"), (2, 1.0, 0.0, 0.0, "never", "seen", "too")], "id int, w2v_0 double, w2v_1 double, gop double, target_phone string, phone_group string, _token string")
    found = verifier.scored(model, odd).collect()
    assert sorted(r["_token"] for r in found) == ["kept", "too"] and all(0 < r["verifier_score"] < 1 for r in found)


def test_no_rows_say_nothing_and_too_many_parameters_fail(spark, monkeypatch):
    df = frame(spark, 20)
    model = verifier.fit(df.where("false"), "gold", ["w2v_0"], [], steps=2)
    assert {r["verifier_score"] for r in verifier.scored(model, df).collect()} == {0.5}
    assert verifier.scored(model, df.where("false")).count() == 0
    monkeypatch.setattr(verifier, "MOST_PARAMETERS", 10)
    with pytest.raises(ValueError, match="parameters"):
        verifier.fit(df, "gold", ["w2v_0"], ["gop"], steps=1)
