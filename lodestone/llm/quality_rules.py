"""Quality rules whose cutoffs are certified on labelled rows: no stratum loses more good documents than stated.

Each rule rejects a document when a quantised feature exceeds a cutoff. Rules are
judged per stratum (length band by script). A cutoff is admissible when, with k of
n good labelled documents rejected, the exact binomial chance of k or fewer at a
rejection rate of RISK / rules is at most CONFIDENCE_LOSS / (strata x rules):
from the loosest cutoff to the tightest this is fixed-sequence testing, so only
the sequences share the error. Of the admissible cutoffs the one with the best
utility on labelled rows is taken; without evidence a rule is off. Only
DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table

#: Largest share of a stratum's good documents that all rules together may reject, and the chance that any bound fails.
RISK, CONFIDENCE_LOSS = 0.03, 0.05
#: A rejected good document weighs as much as this many rejected bad ones.
REGRET = 20
LEVELS = 48
#: Rule -> SQL of its level; a level above LEVELS counts as LEVELS.
RULES = {
    "symbols": "(96 * n_symbols) DIV greatest(word_chars, 1)",
    "dup_lines": "(48 * n_dup_lines) DIV greatest(n_lines, 1)",
    "repeats": "(48 * n_repeat_words) DIV greatest(n_words, 1)",
    "capitals": "(48 * n_capitals) DIV greatest(word_chars, 1)",
    "marks": "(48 * n_marks) DIV greatest(n_words, 1)",
    "long_words": "greatest(word_chars DIV greatest(n_words, 1) - 4, 0)",
}
STRATA = 4
STRATUM = "(CASE WHEN n_words >= 200 THEN 2 ELSE 0 END) + (CASE WHEN n_wide > 0 THEN 1 ELSE 0 END)"
FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules use, of whole texts; a null text has none of anything."""
    space = r"[\\x20\\x09-\\x0D]"
    left = lambda drop: f"CAST(length(regexp_replace(_text, '{drop}', '')) AS BIGINT)"
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.withColumns({
        "_words": F.expr(f"filter(split(_text, '{space}+'), w -> w <> '')"),
        "_lines": F.expr(rf"filter(split(_text, '\\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')"),
        "word_chars": F.expr(left(f"{space}+")),
        "n_symbols": F.expr(left("[^#*$%&|<>]+")),
        "n_capitals": F.expr(left("[^A-ZÀ-ÖØ-Þ]+")),
        "n_marks": F.expr(left("[^!]+")),
        "n_wide": F.expr("CAST(octet_length(_text) - length(_text) AS BIGINT)"),
    })
    rows = rows.withColumns({
        "n_words": F.expr("CAST(size(_words) AS BIGINT)"),
        "n_lines": F.expr("CAST(size(_lines) AS BIGINT)"),
        "n_dup_lines": F.expr("CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)"),
        "_hashes": F.expr("transform(_words, w -> xxhash64(w))"),
    }).drop("_words", "_lines", "_text")
    rows = rows.withColumn(
        "_windows",
        F.expr("if(size(_hashes) < 3, cast(array() as array<bigint>), transform(slice(_hashes, 1, greatest(size(_hashes) - 2, 0)), (h, i) -> xxhash64(h, _hashes[i + 1], _hashes[i + 2])))"),
    ).drop("_hashes")
    # windows in order; most texts have no two alike and need no more than this comparison
    rows = rows.withColumn("_repeated", F.expr("size(array_distinct(_windows)) < size(_windows)"))
    rows = rows.withColumn("_placed", F.expr("if(_repeated, array_sort(transform(_windows, (h, i) -> named_struct('h', h, 'i', i))), null)")).drop("_windows", "_repeated")
    again = "filter(_placed, (x, j) -> (j > 0 AND _placed[greatest(j - 1, 0)].h = x.h) OR (j + 1 < size(_placed) AND _placed[least(j + 1, size(_placed) - 1)].h = x.h))"
    rows = rows.withColumn("n_repeat_words", F.expr(f"if(_placed IS NULL, 0L, CAST(size(array_distinct(flatten(transform({again}, x -> array(x.i, x.i + 1, x.i + 2))))) AS BIGINT))"))
    return rows.drop("_placed")


def levels(counts: DataFrame) -> DataFrame:
    """The counts with base_failed, the stratum and each rule's level."""
    rows = counts.withColumns({"base_failed": F.expr(FAILED), "_stratum": F.expr(STRATUM)})
    return rows.withColumns({f"_{rule}": F.least(F.expr(level), F.lit(LEVELS)).cast("int") for rule, level in RULES.items()})


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, loss: float = CONFIDENCE_LOSS) -> DataFrame:
    """_stratum and one column a rule: the cutoff, LEVELS where the rule is off; STRATA rows at most.

    All labelled rows that pass the base rules count. A label that repeats with
    both values for an id counts as bad.
    """
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"))
    known = rows.where("NOT base_failed").join(marks, F.col("doc_id") == F.col("_id"))
    long = known.select("_stratum", "_good", F.explode(F.create_map(*(x for rule in RULES for x in (F.lit(rule), F.col(f"_{rule}"))))).alias("_rule", "_level"))
    tally = long.groupBy("_stratum", "_rule", "_level").agg(F.sum("_good").alias("_g"), F.sum(1 - F.col("_good")).alias("_b"))
    every = Window.partitionBy("_stratum", "_rule")
    grid = tally.select("_stratum", "_rule").distinct().withColumn("_cut", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))  # STRATA x RULES x LEVELS rows
    t = tally.select(F.col("_stratum").alias("_s"), F.col("_rule").alias("_r"), "_level", "_g", "_b")
    counted = (
        grid.join(t, (F.col("_stratum") == F.col("_s")) & (F.col("_rule") == F.col("_r")))
        .groupBy("_stratum", "_rule", "_cut")
        .agg(F.sum("_g").alias("_n"), *(F.sum(F.when(F.col("_level") > F.col("_cut"), F.col(c)).otherwise(0)).alias(f"_k{c}") for c in ("_g", "_b")))
    )
    p = risk / len(RULES)
    # the exact lower tail by its recurrence, kept as logarithms; no tail above the mean can pass
    tail = f"""
      if(_n = 0 OR _k_g > _n * {p}D, 1D, exp(aggregate(sequence(0L, _k_g),
        named_struct('term', CAST(NULL AS DOUBLE), 'total', CAST(NULL AS DOUBLE)),
        (s, i) -> aggregate(array(if(i = 0, _n * ln(1D - {p}D), s.term + ln((_n - i + 1D) / i) + ln({p}D / (1D - {p}D)))),
          s, (u, x) -> named_struct('term', x, 'total',
            if(u.total IS NULL, x, greatest(u.total, x) + ln(1D + exp(least(u.total, x) - greatest(u.total, x)))))),
        s -> s.total)))
    """
    tested = counted.withColumn("_p", F.expr(tail)).withColumn("_use", F.col("_k_b") - REGRET * F.col("_k_g"))
    passed = tested.where((F.col("_p") <= loss / (STRATA * len(RULES))) & (F.col("_use") > 0))
    best = passed.withColumn("_at", F.row_number().over(every.orderBy(F.desc("_use"), F.desc("_cut")))).where("_at = 1")
    return best.groupBy("_stratum").pivot("_rule", list(RULES)).agg(F.first("_cut"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The measures of every row with base_failed and kept. Repeated rows are judged alike; an empty table gives no rows."""
    rows = levels(Scratch(docs.sparkSession, "rules").keep(measures(docs), "measures"))  # counts only; texts are read once
    cut = cutoffs(rows, labels)
    cut = cut.select(F.col("_stratum").alias("_of"), *(F.col(rule).alias(f"_cut_{rule}") for rule in RULES))
    told = rows.join(F.broadcast(cut), F.col("_stratum") == F.col("_of"), "left")  # STRATA rows
    passes = ~F.col("base_failed")
    for rule in RULES:
        passes &= F.col(f"_{rule}") <= F.coalesce(f"_cut_{rule}", F.lit(LEVELS))
    return told.withColumn("kept", passes)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed and kept of every document."""
    told = judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LEVEL = {rule: sql.replace(" DIV ", " // ") for rule, sql in RULES.items()}
OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \t\n\v\f\r]')) AS ls
  FROM documents
), tri AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM d WHERE len(ws) >= 3
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1
  ) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(ws) AS n_words, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    length(regexp_replace(t, '[ \t\n\v\f\r]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_marks, octet_length(encode(t)) - length(t) AS n_wide
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id
), v AS (
  SELECT *, ({FAILED}) AS base_failed, {STRATUM} AS stratum, {{{', '.join(f"'{r}': least({s}, {LEVELS})" for r, s in _LEVEL.items())}}} AS lv FROM m
), lab AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id
), known AS (SELECT v.stratum, v.lv, lab.good FROM v JOIN lab ON lab.doc_id = v.doc_id WHERE NOT base_failed
), long AS ({' UNION ALL '.join(f"SELECT stratum, '{r}' AS rule, lv.{r} AS level, good FROM known" for r in RULES)}
), cnt AS (
  SELECT stratum, rule, cut, sum(good) AS n, sum(CASE WHEN level > cut THEN good ELSE 0 END) AS k, sum(CASE WHEN level > cut THEN 1 - good ELSE 0 END) AS b
  FROM long, range({LEVELS}) r(cut) GROUP BY ALL
), tail AS (
  SELECT *, CASE WHEN n = 0 OR k > n * {RISK / len(RULES)!r} THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK / len(RULES)!r}) + (n - i) * ln(1 - {RISK / len(RULES)!r})))) END AS p
  FROM cnt
), best AS (
  SELECT stratum, rule, cut FROM tail WHERE p <= {CONFIDENCE_LOSS / (STRATA * len(RULES))!r} AND b - {REGRET} * k > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY b - {REGRET} * k DESC, cut DESC) = 1
), lost AS (
  SELECT DISTINCT v.doc_id FROM v JOIN best ON best.stratum = v.stratum
  WHERE CASE best.rule {' '.join(f"WHEN '{r}' THEN v.lv.{r}" for r in RULES)} END > best.cut
)
SELECT v.doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost.doc_id IS NULL AS kept
FROM v LEFT JOIN lost ON lost.doc_id = v.doc_id
"""
