"""Build-ups judged along their steps, a task's questions at a time: scores in both directions, and the best reading.

Questions are sorted by cell and dealt into tasks by their number; a task gets the probabilities of the steps that occur in
its cells, which grow with the vocabulary and not with the questions. So no question is exploded into rows or joined.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.session import parts, ship_package, stored

#: Questions that a task takes.
QUESTIONS_A_TASK = 20_000
START, END = "^", "$"
#: Logarithms are held as whole numbers of this part, so that sums do not hang on their order.
UNIT = 10**14
Steps = dict[tuple, int | None]


def mean_log(total: int | None, n: int) -> float | None:
    """The mean of n logarithms, rounded half up to 18 decimals as Spark does it; None if a step is impossible."""
    if total is None:
        return None
    whole, rest = divmod(abs(total) * 10_000, n)
    size = (whole + (2 * rest >= n)) / 10**18
    return -size if total < 0 else size


def total_log(seq: list, steps: Steps) -> int | None:
    a, b, total = START, START, 0
    for c in [*seq, END]:
        log = steps.get((a, b, c))
        if log is None:
            return None
        a, b, total = b, c, total + log
    return total


def _best(options: list[list], steps: Steps, backwards: bool) -> tuple[int, list[int]] | None:
    """The greatest total over all choices of an option each, and the choice that comes first of those that have it.

    A step hangs on three neighbours, so what follows is known by the last two choices: the best rest for each two is built
    from the end on, and the choice is read off from the front. Nothing is multiplied out.
    """
    ends: list[list] = [[START], [START], *options, [END]] if not backwards else [[END], *options, [START], [START]]
    find = (lambda a, b, c: steps.get((a, b, c))) if not backwards else (lambda a, b, c: steps.get((c, b, a)))
    rest: list[dict[tuple[int, int], int]] = [{(i, j): 0 for i in range(len(ends[-2])) for j in range(len(ends[-1]))}]
    for at in range(len(ends) - 3, -1, -1):
        after, here = rest[-1], {}
        for j, b in enumerate(ends[at + 1]):
            for i, a in enumerate(ends[at]):
                most = None
                for k, c in enumerate(ends[at + 2]):
                    more = after.get((j, k))
                    if more is not None and (log := find(a, b, c)) is not None and (most is None or log + more > most):
                        most = log + more
                if most is not None:
                    here[i, j] = most
        rest.append(here)
    rest.reverse()
    if not rest[0]:
        return None
    total = max(rest[0].values())
    i, j = min(k for k, v in rest[0].items() if v == total)
    picked = [i, j]
    for at in range(len(ends) - 2):
        left, a, b = rest[at][i, j], ends[at][i], ends[at + 1][j]
        k = next(k for k, c in enumerate(ends[at + 2]) if (more := rest[at + 1].get((j, k))) is not None and (log := find(a, b, c)) is not None and log + more == left)
        picked.append(k)
        i, j = j, k
    return total, (picked[1:-2] if backwards else picked[2:-1])


def best_reading(seq: list, aliases: dict[str, list[str]], steps: Steps) -> list:
    """The reading of seq that scores best in either direction, the first in order of its options if several do."""
    options = [aliases.get(m, [m]) for m in seq]
    if all(len(o) == 1 for o in options):
        return [o[0] for o in options]
    found = [x for x in (_best(options, steps, back) for back in (False, True)) if x is not None]
    total = max((t for t, _ in found), default=None)
    choice = min((c for t, c in found if t == total), default=[0] * len(seq))
    return [o[i] for o, i in zip(options, choice, strict=True)]


def _raw_steps(dealt: DataFrame, cell: list[str], both: bool) -> DataFrame:
    """Distinct (cell, p2, p1, next) of the questions, read forwards and, if asked, backwards."""
    start, end = F.array(F.lit(START), F.lit(START)), F.array(F.lit(END))
    padded = lambda s: F.concat(start, s, end)
    ways = F.array(padded(F.col("seq")), padded(F.reverse("seq"))) if both else F.array(padded(F.col("seq")))
    p = dealt.select(*cell, F.explode(ways).alias("p")).select(*cell, "p", F.explode(F.sequence(F.lit(2), F.size("p") - 1)).alias("i"))
    return p.select(*cell, F.get("p", F.col("i") - 2).alias("p2"), F.get("p", F.col("i") - 1).alias("p1"), F.get("p", F.col("i")).alias("next")).distinct()


def judged(asked: DataFrame, cell: list[str], probabilities, aliases: dict[str, list[str]] | None = None, vocabulary: DataFrame | None = None, both: bool = True) -> DataFrame:
    """asked(req_id, *cell, seq) -> req_id with fwd and rev, the means of the logarithms of the steps either way (null if
    one is impossible; rev only if both), and unknown, the materials that are not in vocabulary(m), in order. With aliases
    -> req_id with the best reading as seq. Several rows can have one req_id; those without a seq are left out.

    probabilities(steps) gives steps(*cell, p2, p1, next) with p.
    """
    place = F.to_json(F.struct(*cell), {"ignoreNullFields": "false"})
    ship_package(asked.sparkSession)
    rows = asked.where("seq IS NOT NULL").select("req_id", *cell, "seq", place.alias("_cell"))
    by = rows.repartitionByRange(parts(asked, QUESTIONS_A_TASK), F.col("_cell"), F.xxhash64("seq"))
    dealt = stored(by.withColumn("_task", F.spark_partition_id()))
    steps = _raw_steps(dealt, cell, both)
    if aliases is not None:
        pairs = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        for c in ("p2", "p1", "next"):
            steps = steps.withColumn(c, F.explode(F.coalesce(F.element_at(pairs, c), F.array(c))))
        steps = steps.distinct()
    steps = probabilities(stored(steps))
    log = (F.ln(F.when(F.col("p") > 0, F.col("p"))).cast("decimal(18,14)") * F.lit(UNIT).cast("decimal(15,0)")).cast("long")
    steps = steps.select(place.alias("_cell"), "p2", "p1", "next", log.alias("log"))
    if vocabulary is not None:
        steps = steps.join(vocabulary.select(F.col("m").alias("next"), F.lit(True).alias("known")), "next", "left")
    else:
        steps = steps.withColumn("known", F.lit(True))
    where = dealt.select(F.col("_task").alias("_for"), F.col("_cell").alias("_of")).distinct()
    steps = where.join(steps.hint("merge"), F.col("_of") == F.col("_cell")).select("_for", "_of", "p2", "p1", "next", "log", "known")
    names, value = (["req_id", "seq"], "seq array<string>") if aliases is not None else (["req_id", "fwd", "rev", "unknown"], "fwd double, rev double, unknown array<string>")

    def task(questions: pa.Table, table: pa.Table) -> pa.Table:
        at: dict[str, Steps] = {}
        known: set = set()
        for c, a, b, n, x, k in zip(*[table[i].to_pylist() for i in ("_of", "p2", "p1", "next", "log", "known")], strict=True):
            at.setdefault(c, {})[a, b, n] = x
            if k:
                known.add(n)
        out: list[tuple] = []
        for c, seq in zip(questions["_cell"].to_pylist(), questions["seq"].to_pylist(), strict=True):
            of = at.get(c, {})
            if aliases is not None:
                out.append((best_reading(seq, aliases, of),))
            else:
                back = total_log(seq[::-1], of) if both else None
                out.append((mean_log(total_log(seq, of), len(seq) + 1), mean_log(back, len(seq) + 1), [m for m in seq if m not in known]))
        kinds = [pa.list_(pa.string())] if aliases is not None else [pa.float64(), pa.float64(), pa.list_(pa.string())]
        return pa.table([questions["req_id"], *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]], names=names)

    kind = dict(dealt.dtypes)["req_id"]
    return dealt.select("_task", "_cell", "req_id", "seq").groupBy("_task").cogroup(steps.groupBy("_for")).applyInArrow(task, f"req_id {kind}, {value}")
