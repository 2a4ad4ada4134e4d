"""The leave-one-out mean against a plain loop, and what it reads and shuffles."""

import random

import pytest

from lithos.operators import thickness as th

SCHEMA = "build_id long, bauperiode string, ort string, art string, nettoflaeche double, pos int, material string, thickness double"
LEVELS = [lambda c: c, lambda c: c[1:], lambda c: c[2:], lambda c: ()]


def rows(seed, mixed):
    """Build-ups of few sequences; some cells are null, some build-ups have places of their own, or layers of two cells."""
    r, out = random.Random(seed), []
    for b in range(1, 161):
        cell = (r.choice(["p", "q"]), r.choice(["o", None]), r.choice(["x", "y"]))
        w, places = r.choice([None, -1.0, 2.0, 5.5]), r.choice([(1, 2), (1, 2), (1, 3)])
        for i, m in zip(places, r.choice([("STB", "Putz"), ("Putz", "STB"), ("Putz",), ("Holz", "Putz")]), strict=False):
            own = ("z", *cell[1:]) if mixed and b % 9 == 0 and i > 1 else cell
            out.append((b, *own, w, i, m, r.randint(1, 40) / 100))
    return out


@pytest.mark.parametrize("mixed", [False, True])
def test_against_a_loop(spark, mixed):
    layers = rows(4, mixed)
    seq = {}
    for x in sorted(layers, key=lambda x: (x[0], x[5])):
        seq[x[0]] = (*seq.get(x[0], ()), x[6])
    weight = lambda x: max(x[4] or 0.0, 0.0) + 0.01
    want = {}
    for x in layers:
        for level, key in enumerate(LEVELS):
            like = [y for y in layers if seq[y[0]] == seq[x[0]] and y[5] == x[5] and key(y[1:4]) == key(x[1:4])]
            if len(like) >= 3:
                rest = [y for y in like if y is not x]
                want[x[0], x[5]] = (level, sum(y[7] * weight(y) for y in rest) / sum(map(weight, rest)))
                break
    got = {(r.build_id, r.pos): (r.level, r.seq_mean) for r in th.leave_one_out(spark.createDataFrame(layers, SCHEMA)).collect()}
    assert got.keys() == want.keys() and {v[0] for v in want.values()} >= {0, 1}
    assert all(got[k][0] == v[0] and got[k][1] == pytest.approx(v[1]) for k, v in want.items())


def test_layers_are_put_together_once(spark, capsys):
    """The source is not read again for the totals, and levels multiply no rows."""
    th.leave_one_out(spark.createDataFrame(rows(1, False), SCHEMA)).explain()
    plan = capsys.readouterr().out
    assert "ExistingRDD" not in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") <= 3


def test_models_read_the_layers_once(spark, capsys):
    """Nothing but the layers without a build_id is read from the source again; every layer has its models."""
    layers = [(*x[:2], x[2] or "o", *x[3:]) for x in rows(2, False)] + [(None, "p", "o", "x", 1.0, 1, "Putz", 0.1)]
    got = th.models(spark.createDataFrame(layers, SCHEMA))
    got.explain()
    plan = capsys.readouterr().out
    scans = plan.count("ExistingRDD")
    assert 0 < scans <= 2 and plan.count("isnull(build_id") >= scans
    alone = {(r.build_id, r.pos): r.seq_mean for r in th.leave_one_out(spark.createDataFrame(layers, SCHEMA)).collect()}
    got = {(r.build_id, r.pos): r for r in got.collect()}
    assert len(got) == len(layers) and got[None, 1].thickness == pytest.approx(got[None, 1].b) == pytest.approx(0.1)
    sums = {}
    for (b, _), r in got.items():
        sums[b] = sums.get(b, 0.0) + r.thickness - r.b
    assert max(map(abs, sums.values())) < 1e-9 and len(alone) > 100
