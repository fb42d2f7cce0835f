"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule bounds the ratio of two measures of a text; `measures` builds all measures as one struct expression and
`verdict` turns a table of rules into one boolean expression, so that the whole operator is a single projection
without shuffles or user functions. All comparisons are of integers, so results are exact.

Defined cases: a null text is the empty text, which has no words and fails; text without line breaks is one line; a text of
fewer than three words has no three-word window; repeated rows give repeated rows; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Frequent function words of the four languages.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it of on or that the this to was were will with "
    "au aux avec ce dans de des du elle en est et il la le les on ou par pas pour que qui se sur un une "
    "auch auf aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie und von war zu "
    "al como con del el en es la las lo los más no para pero por que se su un una y"
)


@dataclass(frozen=True)
class Rule:
    """Passes while low <= 100 * measure / per <= high; an open end is None, and `per` 0 passes."""

    name: str
    measure: str
    per: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("length", "n_words", "one", 100 * MIN_WORDS, 100 * 1_000_000),
    Rule("word_length", "word_chars", "n_words", 200, 1_500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("repeated_words", "n_repeat_words", "n_words", None, MAX_REPEAT_PERCENT),
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: as a lambda's variable it isn't evaluated again at each use."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, hashed=F.xxhash64) -> Column:
    """Words in three-word windows that occur twice or more. Sorted window hashes put equal windows side by side.

    Neighbours of one hash are compared by their words; should two differ, the text's windows are sorted by the words instead.
    """
    later = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    windows = lambda of: F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), of)
    same = lambda x, y: (words[x["i"]] == words[y["i"]]) & (words[x["i"] + 1] == words[y["i"] + 1]) & (words[x["i"] + 2] == words[y["i"] + 2])
    beside = lambda rows, pair: F.filter(_let(F.sort_array(rows), lambda s: F.zip_with(s, later(s), pair)), lambda p: p.isNotNull())
    by_hash = windows(lambda x, i: F.struct(hashed(x, words[i + 1], words[i + 2]).alias("h"), i.alias("i")))
    by_words = windows(lambda x, i: F.struct(x.alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("i")))
    # A pair that begins with -1 marks a clash of hashes.
    met = beside(by_hash, lambda x, y: F.when(x["h"] == y["h"], F.array(F.when(same(x, y), x["i"]).otherwise(-1), y["i"])))
    pairs = _let(met, lambda m: F.when(F.exists(m, lambda p: p[0] < 0), beside(by_words, lambda x, y: F.when(same(x, y), F.array(x["i"], y["i"])))).otherwise(m))
    starts = F.sort_array(F.array_distinct(F.flatten(pairs)))
    steps = _let(starts, lambda s: F.zip_with(s, later(s), lambda x, y: F.least(F.coalesce(y - x, F.lit(3)), F.lit(3))))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x)).cast("long")


def measures(text: Column) -> Column:
    """Struct of the measures that rules name."""
    text = F.coalesce(text, F.lit(""))
    stripped = F.btrim(text, F.lit(SPACE))
    words = F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    gone = lambda t, chars: F.translate(t, chars, "")
    stop = sorted(set(STOP_WORDS.split()))
    both = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    by_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        both.alias("words"),
        by_line.alias("lines"),
        F.length(gone(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(gone(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )


def verdict(rules: tuple[Rule, ...] = RULES, of=F.col) -> Column:
    """The rules as one boolean expression over columns of the measures' names."""
    out = F.lit(True)
    for rule in rules:
        per = F.lit(1) if rule.per == "one" else of(rule.per)
        value = 100 * of(rule.measure)
        if rule.low is not None:
            out = out & (value >= rule.low * per)
        if rule.high is not None:
            out = out & (value <= rule.high * per)
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of each text, the base verdict and the rules' verdict."""
    m = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    flat = m.select("doc_id", "m.words.n_words", "m.word_chars", "m.n_symbols", "m.lines.n_dup_lines", "m.words.n_repeat_words", "m.words.n_stop_words", "m.lines.n_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))


def _rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    terms = []
    for r in rules:
        per = "1" if r.per == "one" else r.per
        terms += [f"100 * {r.measure} >= {r.low} * {per}"] * (r.low is not None) + [f"100 * {r.measure} <= {r.high} * {per}"] * (r.high is not None)
    return " AND ".join(terms)


ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
u AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT r, i, word, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) AS n FROM t WHERE c IS NOT NULL) WHERE n > 1),
n3 AS (SELECT r, count(DISTINCT i + k) AS n FROM g CROSS JOIN (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
per AS (SELECT r, count(*) AS n_words, sum(length(word)) AS chars, count(*) FILTER (lower(word) IN ({_STOP_SQL})) AS n_stop FROM u GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n3.n, 0)::BIGINT AS n_repeat_words,
  coalesce(n_stop, 0)::BIGINT AS n_stop_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN per USING (r) LEFT JOIN n3 USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_rules_sql()} AS kept FROM f
"""
