"""Quality rules with thresholds that follow each language and source.

Every text is measured in its own row (no shuffle): words, symbols, repeated lines and words in repeated windows of
``WINDOW`` words. Four ratios, as whole numbers, then decide beside the fixed base rule: symbols per 1,000 characters of
words, repeated lines per 1,000 lines, repeated words per 1,000 words, and characters per 100 words.

The thresholds come from quantile sketches: counts of rounded ratios per language, source and ratio, in which a value
keeps its six leading bits. Sketches merge by adding counts, so Spark combines them before the shuffle, and a source
with fewer than ``ENOUGH`` documents is judged by its language's sketch, a small language by that of all documents. The
upper threshold is the third quartile plus ``FENCE`` times the quartiles' distance, the lower one (characters a word
only) the first quartile less that. Where most texts have the same ratio, mostly none, the quartiles coincide, and
``LEAST_SPREAD`` stands for their distance. Joined to the measured rows by language and source, the thresholds decide
which are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import only, text_of

SPACE = r"[\x09-\x0D\x20]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
FEWEST_WORDS, MOST_REPEATED = 20, 30
ENOUGH = 100
FENCE = 4
LEADING = 6
# ratio -> the least distance of the quartiles that counts, and whether there is a lower threshold
LEAST_SPREAD: dict[str, tuple[int, bool]] = {
    "symbols": (10, False),
    "lines": (75, False),
    "repeats": (60, False),
    "letters": (10, True),
}


def measure(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (text) and n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    given = docs.columns
    has_word = lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0
    split = docs.select(
        "*",
        F.array_remove(F.split(text_of(), SPACE), "").alias("__words"),
        F.filter(F.split(text_of(), "\n"), has_word).alias("__lines"),
        F.regexp_count(text_of(), F.lit(SYMBOL)).cast("long").alias("n_symbols"),
    )
    counted = split.select(
        *given,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hash"),
    )
    names = [*given, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words in a row; the last ones run over the end
        shifted = F.slice("__hash", step + 1, F.greatest(F.size("__hash"), F.lit(1)))
        counted = counted.select(*names, F.zip_with("__hash", shifted, lambda a, b: F.xxhash64(a, b)).alias("__hash"))
    windows = F.greatest(F.size("__hash") - F.lit(WINDOW - 1), F.lit(0))
    whole = counted.select(*names, F.slice("__hash", F.lit(1), windows).alias("__hash"))
    repeated = F.size(F.array_distinct("__hash")) < F.size("__hash")
    numbered = F.arrays_zip(F.col("__hash").alias("h"), F.sequence(F.lit(0), F.size("__hash") - 1).alias("at"))
    ordered = whole.select(*names, F.when(repeated, F.sort_array(numbered)).alias("__sorted"))
    equal = lambda x, i: (F.get("__sorted", i - 1)["h"] == x["h"]) | (F.get("__sorted", i + 1)["h"] == x["h"])
    twice = F.filter("__sorted", lambda x, i: F.coalesce(equal(x, i), F.lit(False)))
    starts = ordered.select(*names, F.sort_array(F.transform(twice, lambda x: x["at"])).alias("__at"))
    covers = F.transform("__at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", i + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)
    return starts.select(*names, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def _per(part: str, whole: str, scale: int) -> Column:
    return F.floor(F.col(part) * scale / F.greatest(F.col(whole), F.lit(1))).cast("long")


def ratios() -> dict[str, Column]:
    return {
        "symbols": _per("n_symbols", "word_chars", 1000),
        "lines": _per("n_dup_lines", "n_lines", 1000),
        "repeats": _per("n_repeat_words", "n_words", 1000),
        "letters": _per("word_chars", "n_words", 100),
    }


def _rounded(value: Column) -> Column:
    """The value without what follows its LEADING highest bits."""
    low = F.greatest(F.length(F.bin(value)) - LEADING, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, value, n): the sketch of every language and source."""
    each = F.array(*[F.struct(F.lit(k).alias("ratio"), _rounded(F.col(k)).alias("value")) for k in LEAST_SPREAD])
    return measured.where("n_words > 0").select("lang", "source", F.inline(each)).groupBy("lang", "source", "ratio", "value").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketch.groupBy(*keys, "ratio", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    up_to = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.select("*", up_to.alias("up_to"), F.sum("n").over(group).alias("size"))
    quarter = lambda k: F.min(F.when(F.col("up_to") * 4 >= F.col("size") * k, F.col("value")))
    return ranked.groupBy(*keys, "ratio").agg(quarter(1).alias("q1"), quarter(3).alias("q3"), F.max("size").alias("size"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, and <ratio>_most and <ratio>_least of every ratio) for every language and source that has a sketch."""
    own = _quartiles(sketch, ["lang", "source"])
    by_lang = _quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("ratio").alias("r"), F.struct("q1", "q3", "size").alias("wider"))
    of_all = _quartiles(sketch, []).select(F.col("ratio").alias("k"), F.struct("q1", "q3", "size").alias("widest"))
    both = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("r"))).join(of_all, F.col("ratio") == F.col("k"))
    used = F.when(F.col("size") >= ENOUGH, F.struct("q1", "q3", "size")).when(F.col("wider.size") >= ENOUGH, F.col("wider")).otherwise(F.col("widest"))
    limits = both.select("lang", "source", "ratio", used["q1"].alias("q1"), used["q3"].alias("q3"))
    out = []
    for k, (spread, lower) in LEAST_SPREAD.items():
        this, reach = F.col("ratio") == k, F.greatest(F.col("q3") - F.col("q1"), F.lit(spread)) * FENCE
        out.append(F.max(F.when(this, F.col("q3") + reach)).alias(f"{k}_most"))
        if lower:
            out.append(F.max(F.when(this, F.col("q1") - reach)).alias(f"{k}_least"))
    return limits.groupBy("lang", "source").agg(*out)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, the ratios, base_failed and kept of every row of ``docs`` (doc_id, text, lang, source).

    A null text has no words and fails. Null languages and sources form groups of their own. Repeated rows count as often
    as they occur. An empty table gives no rows.
    """
    measured = measure(only(docs, "doc_id", "lang", "source", "text")).drop("text")
    measured = cut(measured.select("*", *[c.alias(k) for k, c in ratios().items()]), "measured")
    limits = thresholds(sketches(measured)).withColumnsRenamed({"lang": "l", "source": "s"})
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    within = [F.col(k) <= F.col(f"{k}_most") for k in LEAST_SPREAD]
    within += [F.col(k) >= F.col(f"{k}_least") for k, (_, lower) in LEAST_SPREAD.items() if lower]
    sound = F.coalesce(reduce(lambda a, b: a & b, within), F.lit(False))
    return measured.join(limits, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & sound).alias("kept"), *LEAST_SPREAD
    )


def keep_sound(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is kept in every row that has it, all columns."""
    bad = quality(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__llm_id")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__llm_id")), "left_anti")


ORACLE = r"""
WITH given AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT id, list_filter(regexp_split_to_array(text, '[\x09-\x0D\x20]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x09-\x0D\x20]')) AS lines,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM given
), windows AS (
  SELECT id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS w
  FROM (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8) AS s
), starts AS (
  SELECT id, i FROM windows WHERE (id, w) IN (SELECT (id, w) FROM windows GROUP BY id, w HAVING count(*) > 1)
), repeats AS (
  SELECT id, sum(least(8, coalesce(next - i, 8))) AS n
  FROM (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS next FROM starts) AS s GROUP BY id
), measured AS (
  SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM given JOIN split USING (id) LEFT JOIN repeats USING (id)
), rated AS (
  SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS lines,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 100 // greatest(n_words, 1) AS letters
  FROM measured
), ratio AS (
  SELECT lang, source, 'symbols' AS ratio, symbols AS v FROM rated WHERE n_words > 0 UNION ALL
  SELECT lang, source, 'lines', lines FROM rated WHERE n_words > 0 UNION ALL
  SELECT lang, source, 'repeats', repeats FROM rated WHERE n_words > 0 UNION ALL
  SELECT lang, source, 'letters', letters FROM rated WHERE n_words > 0
), sketch AS (
  SELECT lang, source, ratio, v // pow2 * pow2 AS value, count(*) AS n
  FROM (SELECT *, CAST(power(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT) AS pow2 FROM ratio) AS r GROUP BY ALL
), ranked AS (
  SELECT 3 AS level, lang, source, ratio, value, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY value) AS up_to,
         sum(n) OVER (PARTITION BY lang, source, ratio) AS size FROM sketch
  UNION ALL
  SELECT 2, lang, NULL, ratio, value, sum(n) OVER (PARTITION BY lang, ratio ORDER BY value), sum(n) OVER (PARTITION BY lang, ratio)
  FROM (SELECT lang, ratio, value, sum(n) AS n FROM sketch GROUP BY ALL) AS a
  UNION ALL
  SELECT 1, NULL, NULL, ratio, value, sum(n) OVER (PARTITION BY ratio ORDER BY value), sum(n) OVER (PARTITION BY ratio)
  FROM (SELECT ratio, value, sum(n) AS n FROM sketch GROUP BY ALL) AS a
), quartiles AS (
  SELECT level, lang, source, ratio, min(value) FILTER (WHERE up_to * 4 >= size) AS q1, min(value) FILTER (WHERE up_to * 4 >= size * 3) AS q3, max(size) AS size
  FROM ranked GROUP BY ALL
), fences AS (
  SELECT o.lang, o.source, o.ratio,
         CASE WHEN o.size >= 100 THEN o.q1 WHEN l.size >= 100 THEN l.q1 ELSE a.q1 END AS q1,
         CASE WHEN o.size >= 100 THEN o.q3 WHEN l.size >= 100 THEN l.q3 ELSE a.q3 END AS q3
  FROM quartiles AS o JOIN quartiles AS l ON l.level = 2 AND l.lang IS NOT DISTINCT FROM o.lang AND l.ratio = o.ratio
  JOIN quartiles AS a ON a.level = 1 AND a.ratio = o.ratio WHERE o.level = 3
), limits AS (
  SELECT lang, source, max(q3 + 4 * greatest(q3 - q1, 10)) FILTER (WHERE ratio = 'symbols') AS s,
         max(q3 + 4 * greatest(q3 - q1, 75)) FILTER (WHERE ratio = 'lines') AS l,
         max(q3 + 4 * greatest(q3 - q1, 60)) FILTER (WHERE ratio = 'repeats') AS r,
         max(q3 + 4 * greatest(q3 - q1, 10)) FILTER (WHERE ratio = 'letters') AS c,
         max(q1 - 4 * greatest(q3 - q1, 10)) FILTER (WHERE ratio = 'letters') AS f
  FROM fences GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND coalesce(symbols <= s AND lines <= l AND repeats <= r AND letters <= c AND letters >= f, false) AS kept,
       symbols, lines, repeats, letters
FROM rated LEFT JOIN limits ON limits.lang IS NOT DISTINCT FROM rated.lang AND limits.source IS NOT DISTINCT FROM rated.source
"""
