"""Operator 8: quality rules with distribution divergence, in DataFrame operations only.

Each document's character-class histogram and its histogram over its language's common words are compared with the
language's reference by Jensen-Shannon distance. The references are the sums over all documents of the language that
pass the base rules. A document shorter than the guard is not judged by a divergence.

Everything about one document is computed in its own row: three-word windows are hashed, sorted with their positions and
compared with their neighbours, so a long document costs n log n and no row is exploded or shuffled. Only the
per-document counts are written and read again for the references.

Edge cases: null and empty texts have no words and fail the base rule; null languages form a language of their own; a
language without a word list is judged by characters alone; repeated rows and doc_ids are judged row by row; kept_documents
carries all columns through packed, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.shared import WORD, let, stored, table, words

MIN_WORDS = 50
MOST_REPEATED = 50
#: A Jensen-Shannon distance (square root of the divergence, base 2) over a + b / sqrt(words) counts as foreign: the
#: fewer words a histogram has, the further chance alone takes it from its reference.
CHAR_LIMIT = (0.14, 1.2)
WORD_LIMIT = (0.14, 1.7)
#: The commonest function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
}
N_COMMON = 10
LONGEST_COMMON = 4
CHAR_CLASSES = ("upper", "digit", "stop", "symbol", "gap", "other")


def base_counts(text: Column) -> dict[str, Column]:
    """A text's base figures and class counts; w holds what is computed from its words."""
    text = F.coalesce(text, F.lit(""))
    count = lambda x: F.regexp_count(text, F.lit(x)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        hashes = F.transform(F.slice(ws, 1, n - 2), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
        windows = lambda hs: F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        same = lambda a, x, j: F.get(a, j)["h"] == x["h"]
        twice = lambda hs: let(F.sort_array(windows(hs)), lambda a: F.filter(a, lambda x, j: F.coalesce(F.when(j > 0, same(a, x, j - 1)), F.lit(False)) | F.coalesce(same(a, x, j + 1), F.lit(False))))
        at = lambda hs: F.sort_array(F.transform(twice(hs), lambda x: x["i"]))
        covered = lambda hs: let(at(hs), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x))
        return F.when(n < 3, F.lit(0)).otherwise(let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs))))

    return {
        "n_chars": F.length(text).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "w": let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated(ws).cast("long").alias("n_repeat_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), F.filter(ws, lambda w: F.length(w) <= LONGEST_COMMON).alias("short"))),
        "n_symbols": count("[#*$%&|<>]"),
        "c_upper": count("[A-Z]"),
        "c_digit": count("[0-9]"),
        "c_stop": count("[.,;:!?]"),
    }


def measured(docs: DataFrame, carried: tuple[Column, ...] = ()) -> DataFrame:
    """Per document: the base figures, class counts c_*, common-word counts (array w) and the carried columns."""
    row = docs.select(*carried, "doc_id", "lang", *[c.alias(k) for k, c in base_counts(F.col("text")).items()])
    row = row.select("*", F.col("w.n_words").alias("n_words"), F.col("w.n_repeat_words").alias("n_repeat_words"), F.col("w.word_chars").alias("word_chars"), F.col("w.short").alias("short"))
    count = lambda c: F.size(F.filter(F.col("short"), lambda w: w == c)).cast("long")
    common = reduce(lambda rest, k: F.when(F.col("lang") == k, F.array(*[count(c) for c in COMMON_WORDS[k]])).otherwise(rest), COMMON_WORDS, F.array_repeat(F.lit(0).cast("long"), N_COMMON))
    gap = F.col("n_chars") - F.col("word_chars")
    other = F.col("word_chars") - F.col("c_upper") - F.col("c_digit") - F.col("c_stop") - F.col("n_symbols")
    names = docs.select(*carried).columns
    out = row.select(*names, "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "c_upper", "c_digit", "c_stop", F.col("n_symbols").alias("c_symbol"), gap.alias("c_gap"), other.alias("c_other"), common.alias("w"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as arrays of counts; null where either is empty."""
    total = lambda x: F.nullif(F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v), F.lit(0).cast("long"))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = let(F.struct(p.alias("p"), q.alias("q"), total(p).alias("n"), total(q).alias("m")), lambda s: F.zip_with(s["p"], s["q"], lambda a, b: F.struct((a / s["n"]).alias("a"), (b / s["m"]).alias("b"))))
    terms = F.transform(both, lambda t: part(t["a"], (t["a"] + t["b"]) / 2) + part(t["b"], (t["a"] + t["b"]) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2))


def judge(docs: DataFrame, char_limit=CHAR_LIMIT, word_limit=WORD_LIMIT, carried: tuple[Column, ...] = ()) -> DataFrame:
    """One row per document: the carried columns, the base figures, both distances and kept."""
    names = docs.select(*carried).columns
    rows = stored(measured(docs, carried), "quality")
    sums = [F.sum(f"c_{k}").alias(f"r_{k}") for k in CHAR_CLASSES] + [F.sum("n_words").alias("r_words")] + [F.sum(F.get("w", F.lit(i))).alias(f"r_w{i}") for i in range(N_COMMON)]
    refs = rows.where("NOT base_failed").groupBy("lang").agg(*sums).withColumnRenamed("lang", "r_lang")
    refs = stored(refs, "quality-references")  # a row per language; written, its size is known and the rows are not shuffled
    rows = rows.join(refs, rows["lang"].eqNullSafe(refs["r_lang"]), "left")
    w = [F.get("w", F.lit(i)) for i in range(N_COMMON)]
    r_w = [F.col(f"r_w{i}") for i in range(N_COMMON)]
    chars = distance(F.array(*[f"c_{k}" for k in CHAR_CLASSES]), F.array(*[f"r_{k}" for k in CHAR_CLASSES]))
    commons = distance(F.array(*w, F.col("n_words") - sum(w, F.lit(0))), F.array(*r_w, F.col("r_words") - sum(r_w, F.lit(0))))
    rows = rows.withColumn("char_distance", F.when(F.col("n_words") >= MIN_WORDS, chars)).withColumn("word_distance", F.when((F.col("n_words") >= MIN_WORDS) & F.col("lang").isin(*COMMON_WORDS), commons))
    over = lambda k, limit: F.coalesce(F.col(k) > limit[0] + limit[1] / F.sqrt("n_words"), F.lit(False))
    far = over("char_distance", char_limit) | over("word_distance", word_limit)
    return rows.select(*names, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"), (~F.col("base_failed") & ~far).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep: each row by its own text, whatever its doc_id, and with all its columns."""
    row = F.struct(*docs.columns).alias("carried_row")  # packed, so that no column of the documents can clash
    return judge(docs, carried=(row,)).where("kept").select("carried_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    per_lang = lambda i: " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in COMMON_WORDS.items())
    commons = ", ".join(f"len(list_filter(ws, lambda x: x = CASE lang {per_lang(i)} END)) AS w{i}" for i in range(N_COMMON))
    classes, ws = [f"c_{k}" for k in CHAR_CLASSES], [f"w{i}" for i in range(N_COMMON)]
    sums = ", ".join(f"sum({k}) AS r_{k}" for k in [*classes, *ws, "n_words"])
    part = lambda x, y: f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END)"

    def far(ks: list[str], n: str, limit) -> str:
        pairs = [(f"({k}::DOUBLE / nullif({n}, 0))", f"(r_{k}::DOUBLE / nullif(r_{n}, 0))") for k in ks]
        return f"coalesce(sqrt(greatest(0, ({' + '.join(part(a, b) + ' + ' + part(b, a) for a, b in pairs)}) / 2)) > {limit[0]} + {limit[1]} / sqrt(n_words), false)"

    langs = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
a AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, string_split(text, chr(10)) AS ls FROM t),
tri AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM a WHERE len(ws) > 2)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri),
rep AS (SELECT rid, count(*)::BIGINT AS n_repeat_words FROM (SELECT DISTINCT rid, i + k AS at FROM twice, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1) GROUP BY rid),
b AS (SELECT a.rid, doc_id, lang, ws, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
             (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(list_filter(ls, lambda x: regexp_matches(x, '[^ 	-
]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^ 	-
]')))))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(text) AS n_chars,
             len(text) - len(regexp_replace(text, '[A-Z]', '', 'g')) AS c_upper, len(text) - len(regexp_replace(text, '[0-9]', '', 'g')) AS c_digit,
             len(text) - len(regexp_replace(text, '[.,;:!?]', '', 'g')) AS c_stop
      FROM a LEFT JOIN rep ON a.rid = rep.rid),
c AS (SELECT *, n_symbols AS c_symbol, n_chars - word_chars AS c_gap, word_chars - c_upper - c_digit - c_stop - n_symbols AS c_other,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {commons} FROM b),
r AS (SELECT lang AS r_lang, {sums} FROM c WHERE NOT base_failed GROUP BY lang),
e AS (SELECT *, n_words - ({" + ".join(ws)}) AS w_rest, r_n_words - ({" + ".join("r_" + w for w in ws)}) AS r_w_rest,
             {" + ".join(classes)} AS n_all, {" + ".join("r_" + k for k in classes)} AS r_n_all
      FROM c LEFT JOIN r ON lang IS NOT DISTINCT FROM r_lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT {far(classes, "n_all", CHAR_LIMIT)} AND NOT (coalesce(lang IN ({langs}), false) AND {far([*ws, "w_rest"], "n_words", WORD_LIMIT)}) AS kept FROM e
"""


SQL = _sql()
