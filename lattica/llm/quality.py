"""Quality rules with risk-controlled thresholds, in built-in expressions only.

Each rule rejects a document whose feature reaches a cutoff. Cutoffs come from fixed grids, so labelled documents are
holdouts for all of them. Per stratum and rule the cutoffs are tested from the most lenient on: with k of n good
documents rejected, a cutoff is certified if P(Bin(n, ALPHA / rules) <= k) <= DELTA / (strata * rules), the exact
binomial test that its false-rejection rate exceeds its share of ALPHA; the first failure ends the sequence. Testing in
a fixed order needs no correction over the grid, the division of DELTA is Bonferroni's over strata and rules, and the
shares of ALPHA add up, so with probability 1 - DELTA the rules of every stratum together falsely reject at most ALPHA of
its good documents. Among the certified ones the rule takes that
with the largest gain (bad documents rejected, less PRICE for each good one); no gain, no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage

#: False-rejection rate of all rules together, per stratum; probability that any bound fails; price of a good document.
ALPHA, DELTA, PRICE = 0.01, 0.05, 10
#: Base rules: fewest words; most words in repeated windows, in percent; words of a window.
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
#: Grids of cutoffs, most aggressive first: share of symbols and of capitals among word characters, of repeated lines,
#: of words in repeated windows, and of exclamation marks and bars among words.
RULES = {
    "symbols": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5],
    "capitals": [0.05, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8],
    "lines": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6],
    "repeats": [0.02, 0.05, 0.1, 0.15, 0.2, 0.25],
    "marks": [0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5],
}
#: Fixed values of the contract: white space between words, symbols.
SPACE, SYMBOLS = " \t\n\x0b\f\r", "[#*$%&|<>]+"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it often in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; ``windows`` holds one hash per start."""

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    return _let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", carry: bool = False) -> DataFrame:
    """One row per document: id, stratum, the base counts and one feature per rule; with ``carry`` also the whole row as
    ``_row``. Null text has no words."""
    t, space = F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(SPACE)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    also = ["_row"] if carry else []
    one = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), t.alias("t"), *row)
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, space) != "")
    words = F.when(F.btrim("t", space) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim("t", space), "[ \t-\r]+"))
    two = one.withColumns({"w": words, "l": lines})
    starts = F.sequence(F.lit(1), F.size("w") - (WINDOW - 1))
    hashes = F.when(F.size("w") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    without = lambda p: (F.length("t") - F.length(F.regexp_replace("t", p, ""))).cast("long")
    three = two.select(
        *also, "doc_id", "stratum", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").alias("n_lines"), without(r"\p{Lu}+").alias("n_capitals"), without("[!|]+").alias("n_marks"), hashes.alias("h"),
    )
    repeats = F.when(F.size(F.array_distinct("h")) < F.size("h"), _covered(F.col("h"))).otherwise(F.lit(0).cast("long"))
    four = three.withColumn("n_repeat_words", repeats).drop("h")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return four.select(
        *also, "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"), share("n_capitals", "word_chars").alias("capitals"),
        share("n_dup_lines", "n_lines").alias("lines"), share("n_repeat_words", "n_words").alias("repeats"), share("n_marks", "n_words").alias("marks"),
    )


def _grid(rule: str) -> Column:
    return F.array(*[F.lit(float(x)) for x in RULES[rule]])


def _reached(rule: str) -> Column:
    """How many cutoffs of the grid the feature reaches."""
    return F.size(F.filter(_grid(rule), lambda c: c <= F.col(rule)))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly, by the recurrence of its terms in logarithms; 1 where k >= n p, as it is not needed
    there (a rejection rate at or above ``p`` certifies nothing)."""
    first = n * F.log(F.lit(1 - p))
    zero = F.struct(first.alias("term"), first.alias("sum"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j * (p / (1 - p)))
        top = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["sum"] - top) + F.exp(term - top))).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * p, F.exp(F.aggregate(terms, zero, step, lambda a: a["sum"]))).otherwise(F.lit(1.0))


def certify(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, price: float = PRICE) -> DataFrame:
    """``(stratum, rule, cutoff)``: the chosen cutoffs. ``labels(doc_id, quality)``: 1 good, 0 bad; a document labelled
    both ways counts as bad, others with null labels do not count."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = feats.join(marks, "doc_id")
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _reached(r).alias("at")) for r in RULES]))
    counted = held.select("stratum", "quality", rows.alias("x")).groupBy("stratum", "x.rule", "x.at").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    grids = F.create_map(*[x for r in RULES for x in (F.lit(r), _grid(r))])
    every = counted.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.collect_list(F.struct("at", "good", "bad")).alias("cells"))  # one cell per cutoff
    every = every.withColumn("grid", F.element_at(grids, F.col("rule")))
    every = every.select("stratum", "rule", "n", "cells", F.posexplode("grid").alias("pos", "cutoff"))
    reach = lambda what: F.aggregate(F.filter("cells", lambda c: c["at"] > F.col("pos")), F.lit(0).cast("long"), lambda a, c: a + c[what])
    every = every.withColumns({"k": reach("good"), "b": reach("bad")})
    strata = every.agg(F.countDistinct("stratum").alias("strata"))
    every = every.join(F.broadcast(strata))  # a single number
    ok = binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= F.lit(delta) / (F.col("strata") * len(RULES))
    lenient = Window.partitionBy("stratum", "rule").orderBy(F.col("pos").desc())
    tested = every.withColumn("ok", F.min(ok.cast("int")).over(lenient)).withColumn("gain", F.col("b") - F.lit(price) * F.col("k"))
    best = tested.where("ok = 1 and gain > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "pos", "cutoff")).alias("x"))
    return best.select("stratum", "rule", "x.cutoff")


#: Cutoffs that are joined by broadcast at most; their number is counted first.
FEW_CUTS = 10_000


def _verdicts(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``failed_rules`` and ``kept``."""
    chosen = cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    if cuts.count() <= FEW_CUTS:
        chosen = F.broadcast(chosen)
    failed = F.array_compact(F.array(*[F.when(F.col(r) >= F.try_element_at("cuts", F.lit(r)), F.lit(r)) for r in RULES]))
    out = feats.join(chosen, "stratum", "left").withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules)``.

    Every row is judged by itself, repeated ids too. Without labels no rule is certified and only the base rules
    reject. Documents with a null language are a stratum of their own. Null and empty texts have no words and fail the
    base rules; texts of any length are judged whole. An empty table gives an empty result. Further columns, whatever
    their names, are not read (``keep`` returns them as they are).
    """
    feats = stage(features(docs, key, text, stratum), "features")
    out = _verdicts(feats, stage(certify(feats, labels), "cuts"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns. The rows are staged beside their features: without that
    table a filter on the verdict would be pushed below the projections and repeat all their work."""
    feats = stage(features(docs, key, text, stratum, carry=True), "features")
    return _verdicts(feats, stage(certify(feats, labels), "cuts")).where("kept").select("_row.*")


def oracle() -> str:
    """DuckDB SQL of ``judge`` over ``documents`` and ``labels`` (ids unique), without ``failed_rules``."""
    rate = repr(ALPHA / len(RULES))
    ws = r"[ \t\n\x0b\f\r]+"
    grids = " UNION ALL ".join(f"SELECT '{r}' AS rule, {i} AS pos, {float(c)!r}::DOUBLE AS cutoff" for r, g in RULES.items() for i, c in enumerate(g))
    values = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {r} AS v FROM f" for r in RULES)
    return rf"""
WITH a AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
b AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(t, '{ws}'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{ws}', '', 'g') <> '') AS l FROM a),
p AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM b WHERE len(w) >= {WINDOW})),
q AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM p) WHERE c > 1),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS x FROM q, range(0, {WINDOW}) z(j)) GROUP BY 1),
c AS (SELECT b.doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
  length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_capitals, length(t) - length(regexp_replace(t, '[!|]+', '', 'g')) AS n_marks, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM b LEFT JOIN r ON r.doc_id = b.doc_id),
f AS MATERIALIZED (SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  CASE WHEN word_chars = 0 THEN 0 ELSE n_symbols::DOUBLE / word_chars END AS symbols, CASE WHEN word_chars = 0 THEN 0 ELSE n_capitals::DOUBLE / word_chars END AS capitals,
  CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines::DOUBLE / n_lines END AS lines, CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words::DOUBLE / n_words END AS repeats, CASE WHEN n_words = 0 THEN 0 ELSE n_marks::DOUBLE / n_words END AS marks FROM c),
g AS ({grids}), v AS MATERIALIZED ({values}),
m AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
h AS (SELECT v.stratum, g.rule, g.pos, g.cutoff, count(*) FILTER (WHERE quality = 1) AS n, count(*) FILTER (WHERE quality = 1 AND v >= cutoff) AS k, count(*) FILTER (WHERE quality = 0 AND v >= cutoff) AS b
  FROM v JOIN m USING (doc_id) JOIN g USING (rule) GROUP BY ALL),
t AS (SELECT *, CASE WHEN k >= n * {rate} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate}) + (n - j) * ln(1 - {rate}))) FROM range(0, k + 1) z(j)) END AS tail FROM h),
o AS (SELECT *, min(CASE WHEN tail <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM h) * {len(RULES)}) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY pos DESC) AS ok, b - {PRICE} * k AS gain FROM t),
best AS (SELECT stratum, rule, arg_max(cutoff, (gain, pos)) AS cutoff FROM o WHERE ok = 1 AND gain > 0 GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM v JOIN best USING (stratum, rule) WHERE v >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f"""
