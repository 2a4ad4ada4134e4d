"""The plausibility answer: goldens on a small catalog, and a plain loop over the same model."""

import itertools
import json
import math

from lithos.operators import markov, plausibility
from lithos.plans.model_queries import QUERIES
from lithos.vocab import ALIASES

CATALOG = [(["STB", "Styropor", "Putz"], 5), (["STB", "Styropor", "Putz"], 4), (["STB", "Dämmung-hart", "Putz"], 3), (["Putz", "Ziegel", "Putz"], 9), (["Ziegel", "Styropor", "Putz"], 2)]


def catalog(spark):
    rows = [(i, p, "RG", "AW", float(w), k + 1, m, 0.1) for p in ("1980-1999", "bis 1918") for i, (seq, w) in enumerate(CATALOG, 1 if p == "bis 1918" else 100) for k, m in enumerate(seq)]
    return markov.sequences(spark.createDataFrame(rows, "build_id long, bauperiode string, ort string, art string, nettoflaeche double, pos int, material string, thickness double"))


def loop(seq, weights):
    """Score of a sequence in a catalog of one cell, by plain counting with backoff from two words to one."""
    two, one = {}, {}
    for s, w in weights:
        pad = ["^", "^", *s, "$"]
        for a, b, c in zip(pad, pad[1:], pad[2:]):
            two.setdefault((a, b), {})[c] = two.get((a, b), {}).get(c, 0) + w + 0.01
            one.setdefault(b, {})[c] = one.get(b, {}).get(c, 0) + w + 0.01
    pad, p = ["^", "^", *seq, "$"], []
    for a, b, c in zip(pad, pad[1:], pad[2:]):
        at = two.get((a, b)) or one.get(b) or {}
        p.append(at.get(c, 0) / sum(at.values()) if at else 0)
    return math.exp(sum(map(math.log, p)) / len(p)) if min(p) > 0 else 0.0


def expected(materials):
    """(tier, backwards, reading) of a question in the catalog's one cell."""
    score = lambda s: loop(s, CATALOG)
    best, top = None, -1.0
    for v in itertools.product(*[ALIASES.get(m, [m]) for m in materials]):
        if (s := max(score(v), score(v[::-1]))) > top + 1e-12:
            best, top = list(v), s
    known = {m for s, _ in CATALOG for m in s}
    f, r, floor = score(best), score(best[::-1]), min(score(s) for s, _ in CATALOG)
    if set(best) - known:
        return 2, False, best
    if len(best) > 1 and f < floor <= r and r >= 3 * f and r > 0:
        return 2, True, best
    return (1 if f <= 0 else 3 if f >= floor else 2), False, best


def test_answers(spark):
    aw = {"period": "1980-1999", "floor_type": "RG", "part_type": "AW"}
    layers = [{"layer_index": i, "material": m, "thickness": 20} for i, m in enumerate(["Beton", "Styropor", "", "Putz"])]
    bodies = {
        1: aw | {"materials": ["STB", "Styropor", "Putz"]}, 2: aw | {"materials": ["Beton", "Styropor", "Putz"]}, 3: aw | {"materials": ["Putz", "Styropor", "Beton"]},
        4: aw | {"period": "vor 1919", "floor_type": "Regelgeschoss", "part_type": "Außenwand", "materials": ["Putz", "Ziegel", "Putz"]},
        5: aw | {"materials": ["STB", "Karton", "Putz", "Pappe"]}, 6: aw | {"materials": [], "layers": layers}, 7: aw | {"materials": ["Styropor", "STB", "Ziegel"]},
        8: {}, 9: aw | {"materials": ["Putz", None]}, 10: aw | {"materials": ["Beton", "Styropor", "Putz"]},
    }
    rows = [(k, json.dumps(v)) for k, v in bodies.items()] + [(11, "no JSON"), (12, None), (13, '["Putz"]'), (14, '{"materials": ["Putz"')]
    got = {r.id: r for r in plausibility.answers(spark.createDataFrame(rows, "id long, body string"), catalog(spark)).collect()}
    assert len(got) == 14
    assert (got[1].stufe, got[1].umgekehrt, got[1].gelesen_als, got[1].label) == (3, False, None, "passt ins übliche Bild")
    assert (got[2].stufe, got[2].gelesen_als) == (3, ["STB", "Styropor", "Putz"]) and got[10][1:] == got[2][1:]
    assert (got[3].stufe, got[3].umgekehrt, got[3].gelesen_als) == (2, True, ["Putz", "Styropor", "STB"])
    assert (got[4].stufe, got[4].umgekehrt, got[4].referenz_n) == (3, False, 4)
    assert got[5].stufe == 2 and got[5].detail == "unbekannt: Karton, Pappe" and not got[5].umgekehrt
    assert got[6][2:] == got[2][2:] and got[7].stufe == 1
    assert got[8].stufe == got[12].stufe == 1 and got[8].error is None
    assert all(got[k].stufe is None and got[k].error for k in (9, 11, 13, 14))


def test_answers_against_a_loop(spark):
    words = ["STB", "Beton", "Styropor", "Putz", "Ziegel", "Karton"]
    asked = [list(x) for n in (1, 2, 3) for x in itertools.product(words, repeat=n)][::3]
    rows = [(i, json.dumps({"period": "1980-1999", "floor_type": "RG", "part_type": "AW", "materials": m})) for i, m in enumerate(asked)]
    got = {r.id: r for r in plausibility.answers(spark.createDataFrame(rows, "id long, body string"), catalog(spark)).collect()}
    for i, m in enumerate(asked):
        tier, backwards, reading = expected(m)
        assert (got[i].stufe, got[i].umgekehrt, got[i].gelesen_als or m) == (tier, backwards, reading), m


def test_query_answers_every_build_up(spark):
    d = "/root/testdata/sf0.001"
    got = QUERIES["plausibility_answers"](spark, d).toPandas()
    assert len(got) == got.build_id.nunique() == spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert (got.error.notna() == (got.build_id % 101 == 0)).all() and got.stufe.dropna().isin([1, 2, 3]).all()
    odd = got[(got.build_id % 7 == 0) & got.error.isna()]
    assert odd.detail.str.contains("Karton").all() and (odd.stufe == 2).all()
