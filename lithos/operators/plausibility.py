"""The plausibility check as a client asks for it: JSON questions to answers.

Questions that say the same are judged once: distinct (cell, materials) are translated to the catalog's words and checked,
and each question is joined to its answer by a merge, so a build-up that a third of all questions ask about costs one check
and no answers are sent whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.operators import markov as mk
from lithos.session import cut, stored
from lithos.vocab import ANSWERS, CLIENT_KINDS, CLIENT_PERIODS, CLIENT_PLACES

BODY = "period string, floor_type string, part_type string, materials array<string>, layers array<struct<material:string>>, _bad string"


def _read_as(value: F.Column, words: dict[str, str]) -> F.Column:
    """The catalog's word for a client's; words that have none stay, and a missing one is the empty word."""
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    given = F.coalesce(value, F.lit(""))
    return F.coalesce(F.try_element_at(known, given), given)


def parsed(questions: DataFrame, body: str = "body") -> DataFrame:
    """questions with the catalog's cell, materials (from layers if none are given) and error.

    An empty or null body asks about no materials. A body that is no JSON object, has fields of other types or a null
    among its materials is an error; layers without a material are left out.
    """
    text = F.btrim(F.coalesce(F.col(body), F.lit("")))
    text = F.when(text == "", "{}").otherwise(text)
    j = F.from_json(text, BODY, {"columnNameOfCorruptRecord": "_bad"})
    rows = questions.withColumn("_j", j).withColumn("_text", text)
    layers = F.filter(F.transform("_j.layers", lambda x: x["material"]), lambda m: F.coalesce(m != "", F.lit(False)))
    none = F.array().cast("array<string>")
    given = F.coalesce(F.col("_j.materials"), none)
    materials = F.when(F.size(given) > 0, given).otherwise(F.coalesce(layers, none))
    broken = F.col("_j").isNull() | F.col("_j._bad").isNotNull() | ~F.col("_text").startswith("{")
    error = F.when(broken, "the question is no JSON object of the known fields").when(F.exists(given, lambda m: m.isNull()), "a material is null")
    cell = {"bauperiode": _read_as(F.col("_j.period"), CLIENT_PERIODS), "ort": _read_as(F.col("_j.floor_type"), CLIENT_PLACES), "art": _read_as(F.col("_j.part_type"), CLIENT_KINDS)}
    return rows.select(*questions.columns, *[v.alias(k) for k, v in cell.items()], F.when(error.isNull(), materials).alias("materials"), error.alias("error"))


def answers(questions: DataFrame, seqs: DataFrame, body: str = "body") -> DataFrame:
    """questions with stufe, label, detail, umgekehrt, referenz_n, gelesen_als (null unless the reading differs) and error."""
    names = questions.columns
    rows = parsed(questions, body).withColumn("req_id", F.when(F.col("error").isNull(), F.sha2(F.to_json(F.struct(*mk.CELL, "materials")), 256)))
    asked = stored(rows.where("error IS NULL").select("req_id", *mk.CELL, "materials").dropDuplicates(["req_id"]))
    dists = cut(mk.distributions(seqs))
    read = stored(mk.translate(asked.withColumnRenamed("materials", "seq"), dists))
    checked = mk.check(asked.select("req_id", *mk.CELL).join(read.hint("merge"), "req_id"), seqs, dists)
    kind = F.when(F.col("unknown"), "unknown").when(F.col("reversed"), "reversed").when(F.col("tier") == 1, "impossible").when(F.col("tier") == 3, "usual").otherwise("unusual")
    said = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in ANSWERS.items() for x in (k, v[i])]), kind)
    detail = F.concat(said(1), F.when(F.col("unknown"), F.array_join("unknown_materials", ", ")).otherwise(""))
    out = checked.select("req_id", F.col("tier").alias("stufe"), said(0).alias("label"), detail.alias("detail"), F.col("reversed").alias("umgekehrt"), F.col("n_ref").alias("referenz_n")).join(read.hint("merge"), "req_id")
    return rows.join(out.hint("merge"), "req_id", "left").select(*names, "stufe", "label", "detail", "umgekehrt", "referenz_n", F.when(F.col("seq") != F.col("materials"), F.col("seq")).alias("gelesen_als"), "error")
