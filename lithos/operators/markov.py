"""Second-order Markov model of layered build-ups, and its plausibility check.

Layers come as rows (build_id, bauperiode, ort, art, nettoflaeche, pos, material). Counts are aggregated per cell before
they are spread over the backoff levels, so the levels multiply a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithos.operators.backoff import leveled
from lithos.operators.paths import END, START, judged
from lithos.session import cut, stored
from lithos.vocab import ALIASES

CELL = ["bauperiode", "ort", "art"]
MIN_MASS = 0.5


def sequences(layers: DataFrame) -> DataFrame:
    """One row per build-up: seq, and its weight w."""
    by = layers.groupBy("build_id", *CELL, "nettoflaeche").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "material"))), lambda x: x["material"]).alias("seq"))
    return by.withColumn("w", F.greatest(F.coalesce("nettoflaeche", F.lit(0.0)), F.lit(0.0)) + 0.01)


def condensed(seqs: DataFrame, **more: F.Column) -> DataFrame:
    """One row per cell and sequence with the weights' sum, written once: what models and references need, however many
    build-ups say the same."""
    return stored(seqs.groupBy(*CELL, "seq").agg(F.sum("w").alias("w"), *[v.alias(k) for k, v in more.items()]))


def transitions(seqs: DataFrame, *carry: str) -> DataFrame:
    """Each step (i, p2, p1, next) of the padded sequences."""
    padded = F.concat(F.array(F.lit(START), F.lit(START)), F.col("seq"), F.array(F.lit(END)))
    steps = seqs.select(*carry, *CELL, "w", padded.alias("p"))
    return steps.select("*", F.explode(F.sequence(F.lit(2), F.size("p") - 1)).alias("i")).select(*carry, *CELL, "w", "i", F.get("p", F.col("i") - 2).alias("p2"), F.get("p", F.col("i") - 1).alias("p1"), F.get("p", F.col("i")).alias("next"))


def counts(seqs: DataFrame, order: int = 2) -> DataFrame:
    """Weighted transition counts per cell; order 1 leaves p2 out."""
    by = ["p2", "p1", "next"] if order == 2 else ["p1", "next"]
    return transitions(seqs).groupBy(*CELL, *by).agg(F.sum("w").alias("mass"))


def distributions(seqs: DataFrame) -> DataFrame:
    """P(next | context) at every level: order 2 as ranks 0-3, order 1 as ranks 4-7, with the context's mass."""
    two = leveled(counts(seqs, 2), CELL).groupBy("level", "key", "p2", "p1", "next").agg(F.sum("mass").alias("mass"))
    one = leveled(counts(seqs, 1), CELL).groupBy("level", "key", "p1", "next").agg(F.sum("mass").alias("mass")).select((F.col("level") + 4).alias("level"), "key", F.lit("").alias("p2"), "p1", "next", "mass")
    every = two.unionByName(one)
    total = F.sum("mass").over(W.partitionBy("level", "key", "p2", "p1"))
    return every.withColumn("total", total).where(F.col("total") >= MIN_MASS).select("level", "key", "p2", "p1", "next", (F.col("mass") / F.col("total")).alias("p"))


def context_keys() -> F.Column:
    """(level, key, p2) of a step in the order in which its context is looked up."""
    parts = []
    for rank in range(8):
        i = rank % 4
        parts.append(F.struct(F.lit(rank).alias("level"), F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in CELL[i:]], F.lit(f"#{i}")).alias("key"), (F.col("p2") if rank < 4 else F.lit("")).alias("p2")))
    return F.array(*parts)


def contexts(steps: DataFrame, dists: DataFrame) -> DataFrame:
    """For each distinct (cell, p2, p1): the level whose distribution holds."""
    asked = steps.select(*CELL, "p2", "p1").distinct()
    found = asked.withColumn("c", F.explode(context_keys())).select(*CELL, F.col("p2").alias("ask2"), "p1", "c.level", "c.key", "c.p2")
    have = dists.select("level", "key", "p2", "p1").distinct()
    return found.join(have, ["level", "key", "p2", "p1"]).groupBy(*CELL, "ask2", "p1").agg(F.min(F.struct("level", "key", "p2")).alias("b")).select(*CELL, "ask2", "p1", "b.level", "b.key", F.col("b.p2").alias("use2"))


def step_probabilities(steps: DataFrame, dists: DataFrame) -> DataFrame:
    """steps with p, 0 for a step that the model does not know."""
    at = contexts(steps, dists)
    steps = steps.withColumnRenamed("p2", "ask2").join(at, [*CELL, "ask2", "p1"], "left")
    d = dists.select("level", "key", F.col("p2").alias("use2"), "p1", "next", "p")
    return steps.join(d, ["level", "key", "use2", "p1", "next"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def geomean(p) -> F.Column:
    """Geometric mean as an aggregate; 0 if any value is not positive. Logarithms are summed as decimals, so that equal
    sequences have equal scores in whatever order their steps arrive."""
    logs = F.avg(F.ln(F.when(p > 0, p)).cast("decimal(18,14)")).cast("double")
    return F.coalesce(F.when(F.min(p) > 0, F.exp(logs)), F.lit(0.0))


def scores(seqs: DataFrame, dists: DataFrame, carry: str, aliases: dict[str, list[str]] | None = None, vocabulary: DataFrame | None = None, both: bool = True) -> DataFrame:
    """Per sequence (carry is its key): score, the geometric mean of its steps. With aliases or a vocabulary, the sequences
    are questions by req_id: their readings, or their scores both ways and unknown materials, as paths.judged has them."""
    if aliases is not None or vocabulary is not None:
        known = lambda steps: step_probabilities(steps, dists).withColumnRenamed("ask2", "p2")
        return judged(seqs, CELL, known, aliases, vocabulary, both)
    steps = step_probabilities(transitions(seqs, carry), dists)
    return steps.groupBy(carry, *CELL).agg(geomean(F.col("p")).alias("score"))


def references(seqs: DataFrame, cells: DataFrame, least: int = 2) -> DataFrame:
    """cells with level and key of the first level that has enough distinct sequences, and their number (0: none)."""
    from lithos.operators.backoff import levels

    flat = seqs.select(*CELL, F.concat_ws(";", "seq").alias("seq")).distinct()
    per = leveled(flat, CELL).where("level < 3").groupBy("level", "key").agg(F.countDistinct("seq").alias("n_ref")).where(F.col("n_ref") >= least)
    asked = cells.select(*CELL).distinct().withColumn("l", F.explode(levels(CELL))).select(*CELL, "l.level", "l.key")
    found = asked.join(per, ["level", "key"]).groupBy(*CELL).agg(F.min(F.struct("level", "key", "n_ref")).alias("b"))
    return cells.select(*CELL).distinct().join(found, CELL, "left").select(*CELL, "b.level", "b.key", F.coalesce("b.n_ref", F.lit(0)).alias("n_ref"))


def _distinct(every: DataFrame) -> DataFrame:
    """One row for each _same of requests, with a number of its own as req_id; written, so that the numbers stay."""
    by = every.groupBy("_same").agg(*[F.first(k).alias(k) for k in (*CELL, "seq")])
    return stored(by.withColumn("req_id", F.monotonically_increasing_id()))


def check(requests: DataFrame, seqs: DataFrame, dists: DataFrame | None = None) -> DataFrame:
    """requests(req_id, cell, seq) -> tier, reversed, unknown, score, floor, n_ref and the unknown_materials in order.

    Rules in order: an unknown material 2; better backwards 2 (reversed); impossible 1; as good as the worst reference
    3; else 2.
    """
    dists = cut(distributions(seqs)) if dists is None else dists
    # requests that ask the same are judged once; req_id below is that of a distinct question
    same = F.sha2(F.to_json(F.struct(*CELL, "seq"), {"ignoreNullFields": "false"}), 256)
    every = requests.select(F.col("req_id").alias("_own"), *CELL, "seq").withColumn("_same", same)
    requests = _distinct(every)
    vocabulary = seqs.select(F.explode("seq").alias("m")).distinct()
    score = lambda c: F.coalesce(F.exp(c), F.lit(0.0))
    said = scores(requests, dists, "req_id", None, vocabulary)
    said = said.select("req_id", score("fwd").alias("fwd"), score("rev").alias("rev"), F.when(F.size("unknown") > 0, F.col("unknown")).alias("unknown_materials"))
    refs = stored(references(seqs, requests))
    # the references' scores are judged in the request's own cell, which is the key of their least
    observed = leveled(seqs.select(*CELL, "seq").distinct(), CELL).where("level < 3").select("level", "key", "seq").distinct()
    of = refs.where("n_ref > 0").join(observed, ["level", "key"]).select(F.struct(*CELL).alias("req_id"), *CELL, "seq")
    floors = scores(stored(of), dists, "req_id", None, vocabulary, False).groupBy("req_id").agg(F.min(score("fwd")).alias("floor"))
    cells = refs.select(*CELL, "n_ref").join(floors.select("req_id.*", "floor"), CELL, "left")
    out = requests.join(said.hint("merge"), "req_id").join(cells, CELL, "left")
    f, r, floor = F.col("fwd"), F.col("rev"), F.coalesce("floor", F.lit(0.0))
    is_rev = (F.size("seq") >= 2) & (f < floor) & (r >= floor) & (r >= 3 * f) & (r > 0)
    known = F.col("unknown_materials").isNull()
    tier = F.when(~known, 2).when(is_rev, 2).when(f <= 0, 1).when((F.col("n_ref") > 0) & (f >= floor), 3).otherwise(2)
    out = out.select("req_id", "_same", tier.alias("tier"), (known & is_rev).alias("reversed"), (~known).alias("unknown"), f.alias("score"), floor.alias("floor"), "n_ref", "unknown_materials")
    names = [c for c in out.columns if c != "_same"]
    return every.select(F.col("_own").alias("req_id"), "_same").join(out.drop("req_id").hint("merge"), "_same").select(*names)


def observed_top(seqs: DataFrame, k: int = 3) -> DataFrame:
    """The k commonest sequences of each cell by net area, with their share of the cell's total."""
    agg = seqs.groupBy(*CELL, F.concat_ws(";", "seq").alias("seq")).agg(F.sum(F.coalesce("nettoflaeche", F.lit(0.0))).alias("area"))
    cell = W.partitionBy(*CELL)
    ranked = agg.withColumn("total", F.sum("area").over(cell)).withColumn("rank", F.row_number().over(cell.orderBy(F.desc("area"), "seq")))
    return ranked.where(F.col("rank") <= k).select(*CELL, "rank", "seq", (F.col("area") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).alias("share"))


def beam_predict(cells: DataFrame, dists: DataFrame, k: int = 3, beam: int = 12, max_len: int = 6) -> DataFrame:
    """The k likeliest sequences of each cell, their probabilities rescaled to the k. Cells are few; the loop over
    lengths unrolls into joins, and every step keeps beam rows per cell."""
    dists = cut(dists)
    live = cells.select(*CELL).distinct().select(*CELL, F.array().cast("array<string>").alias("gen"), F.lit(1.0).alias("prob"))
    finished = None
    for _ in range(max_len + 1):
        n = F.size("gen")
        live = cut(live)
        asked = live.select("*", F.coalesce(F.get("gen", n - 2), F.lit(START)).alias("ask2"), F.coalesce(F.get("gen", n - 1), F.lit(START)).alias("p1"))
        at = contexts(asked.withColumnRenamed("ask2", "p2"), dists)
        d = dists.select("level", "key", F.col("p2").alias("use2"), "p1", "next", "p")
        step = asked.join(at, [*CELL, "ask2", "p1"], "left").join(d, ["level", "key", "use2", "p1"], "left")
        step = cut(step)
        done = step.where((F.size("gen") > 0) & (F.col("next").isNull() | (F.col("next") == END))).select(*CELL, "gen", (F.col("prob") * F.coalesce("p", F.lit(1.0))).alias("prob"))
        grown = step.where(F.col("next") != END).select(*CELL, F.concat("gen", F.array("next")).alias("gen"), (F.col("prob") * F.col("p")).alias("prob"))
        best = W.partitionBy(*CELL).orderBy(F.desc("prob"), F.concat_ws(";", "gen"))
        live = grown.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r")
        finished = done if finished is None else finished.unionByName(done)
    finished = finished.unionByName(live).groupBy(*CELL, F.concat_ws(";", "gen").alias("seq")).agg(F.max("prob").alias("prob"))
    cell = W.partitionBy(*CELL)
    top = finished.withColumn("rank", F.row_number().over(cell.orderBy(F.desc("prob"), "seq"))).where(F.col("rank") <= k)
    return top.withColumn("share", F.col("prob") / F.sum("prob").over(cell)).select(*CELL, "rank", "seq", "share")


def translate(requests: DataFrame, dists: DataFrame) -> DataFrame:
    """req_id and the reading of its hub materials as catalog materials that scores best in either direction; the first
    variant wins ties. Readings are not multiplied out."""
    same = F.sha2(F.to_json(F.struct(*CELL, "seq"), {"ignoreNullFields": "false"}), 256)
    every = requests.select(F.col("req_id").alias("_own"), *CELL, "seq").withColumn("_same", same)
    asked = _distinct(every)
    best = scores(asked, dists, "req_id", ALIASES).withColumnRenamed("seq", "_read")
    best = asked.select("req_id", "_same").join(best.hint("merge"), "req_id").select("_same", F.col("_read").alias("seq"))
    return every.select("_own", "_same").join(best.hint("merge"), "_same").select(F.col("_own").alias("req_id"), "seq")
