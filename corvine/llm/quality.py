"""Quality rules: a table of thresholds compiled into one Spark projection.

Each metric is a native expression over the text of one row; each rule is (metric, test, threshold), and the table of
rules becomes one boolean expression. There is no shuffle, no user function and no limit on the length of a text.

Three-word windows are counted within the row: each window is hashed, the hash is shifted left by as many bits as the
window's number needs, the number is put into these bits, and the longs are sorted. Equal hashes are neighbours then, so
one pass finds the few windows that may occur twice or more. Of these the words themselves are sorted and compared, so the
count is exact, in O(n log n) for any text.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are judged one by one; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import packed, read, unpacked

#: Frequent short words of English, German, French and Spanish (fixed values).
STOP_WORDS = """
the of and to a in is that it for be with as on at by this are from or was not
der die das und in den von zu mit ist im auf für nicht ein eine dem des sich es als
de la le les et des en un une du que est pour qui dans par sur au pas il avec
el los las y que en un una por con para su se del al lo como no es
""".split()

#: (metric, test, threshold): a document fails a rule if the metric is below or above the threshold.
RULES = (
    ("n_words", "below", 50.0),
    ("repeat_word_share", "above", 0.5),
    ("n_words", "above", 1_000_000.0),
    ("mean_word_chars", "below", 2.0),
    ("mean_word_chars", "above", 14.0),
    ("symbol_share", "above", 0.3),
    ("symbols_a_word", "above", 0.25),
    ("dup_line_share", "above", 0.5),
    ("stop_word_share", "below", 0.02),
)
#: The first rules are the base: their verdict is returned on its own too.
N_BASE = 2


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(ws: Column) -> Column:
    """How many words stand in a three-word window that occurs twice or more; ``ws`` is an array without nulls."""
    n = F.size(ws) - 2
    shift = lambda kind, x, bits: F.call_function(kind, x, bits)

    def counted(bits: Column) -> Column:
        keys = F.sort_array(
            F.transform(F.slice(ws, 1, n), lambda w, i: shift("shiftleft", F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)), bits).bitwiseOR(i.cast("long")))
        )
        number = shift("shiftleft", F.lit(1).cast("long"), bits) - 1

        def found(ks: Column) -> Column:
            same = lambda x, i: F.coalesce(shift("shiftrightunsigned", x.bitwiseXOR(F.get(ks, i)), bits) == 0, F.lit(False))
            return F.sort_array(F.transform(F.filter(ks, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.bitwiseAND(number)))

        # their words in order, each with its place: equal ones are neighbours
        def exact(ps: Column) -> Column:
            triples = F.sort_array(F.transform(ps, lambda p: F.struct(F.array_join(F.slice(ws, p.cast("int") + 1, F.lit(3)), " ").alias("words"), p.alias("place"))))
            same = lambda ts, t, i: F.coalesce(F.get(ts, i)["words"] == t["words"], F.lit(False))
            return let(triples, lambda ts: F.sort_array(F.transform(F.filter(ts, lambda t, i: same(ts, t, i - 1) | same(ts, t, i + 1)), lambda t: t["place"])))

        # each window covers three words; those that the next window covers too count there
        steps = lambda ps: F.transform(ps, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(ps, i + 1) - p, F.lit(3).cast("long"))))
        return F.aggregate(let(let(let(keys, found), exact), steps), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(n >= 2, let(F.ceil(F.log2(n + 1.0)).cast("int"), counted)).otherwise(F.lit(0).cast("long"))


def metrics(text: Column) -> dict[str, Column]:
    """The metrics that need the text: one struct of those over words, one of those over lines, and the symbols."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    over_words = lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        F.size(F.filter(ws, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        repeated_words(ws).alias("n_repeat_words"),
    )
    over_lines = lambda xs: F.struct(F.size(xs).cast("long").alias("n_lines"), (F.size(xs) - F.size(F.array_distinct(xs))).cast("long").alias("n_dup_lines"))
    return {"over_words": let(words, over_words), "over_lines": let(lines, over_lines), "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")}


def ratios() -> dict[str, Column]:
    """What the rules compare, from the columns of ``metrics``."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_word_share": F.col("n_repeat_words") / words,
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "symbols_a_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "stop_word_share": F.col("n_stop_words") / words,
    }


def failed(rules) -> Column:
    """The rules as one boolean expression: true if any of them fails."""
    value = ratios()
    return reduce(lambda a, b: a | b, (value[m] < limit if test == "below" else value[m] > limit for m, test, limit in rules), F.lit(False))


def quality(docs: DataFrame, rules=RULES, n_base: int = N_BASE) -> DataFrame:
    """Adds the metrics, ``base_failed`` and ``kept`` to documents with a ``text``."""
    docs, names = packed(docs, "text")
    judged = docs.withColumns(metrics(F.col("text"))).select("text", "rest", "n_symbols", "over_words.*", "over_lines.*")
    judged = judged.withColumns({"base_failed": failed(rules[:n_base]), "kept": ~failed(rules)})
    return judged.select("text", *unpacked(names, *[c for c in judged.columns if c not in ("text", "rest")]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN (STOP))) AS BIGINT) AS n_stop_words
  FROM d
), win AS (
  SELECT row_number() OVER () AS r, doc_id, w FROM d
), tri AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM win)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), z AS (
  SELECT m.*, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM m JOIN win USING (doc_id) LEFT JOIN rep USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_words > 1000000 OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR n_symbols / greatest(word_chars, 1) > 0.3 OR n_symbols > 0.25 * n_words OR n_dup_lines / greatest(n_lines, 1) > 0.5 OR n_stop_words / greatest(n_words, 1) < 0.02) AS kept
FROM z
""".replace("STOP", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
