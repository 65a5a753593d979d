"""Quality rules: a threshold table compiled into one projection of built-in functions, without a shuffle.

Each rule bounds one measure of a text: lengths, symbol, stop-word, line and repetition ratios. compile_rules() turns a table
of rules into columns; every measure is worked out once for each text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, table

SPACES = " \t\n\x0b\x0c\r"
#: Common function words of the corpus's four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are", "or", "his", "from", "at",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "dans", "pour", "par", "sur", "est", "pas", "au", "avec",
    "der", "die", "das", "den", "dem", "und", "zu", "von", "mit", "ist", "ein", "eine", "im", "nicht", "sich", "auf", "für", "es", "auch", "an",
    "el", "los", "las", "y", "se", "del", "una", "con", "no", "su", "al", "lo", "como", "más", "o", "pero", "sus", "esta",
)


@dataclass(frozen=True)
class Rule:
    """A text fails if measure lies outside low..high (None: no bound)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Measures are SQL over n_words, word_chars, n_symbols, n_stop, n_marks, n_lines, n_dup_lines, n_repeat_words.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "word_chars / nullif(n_words, 0)", low=2, high=20),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", high=0.1),
    Rule("stop_words", "n_stop / nullif(n_words, 0)", low=0.04),
    Rule("marks", "n_marks / nullif(n_words, 0)", high=0.3),
    Rule("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", high=0.5),
    Rule("repetition", "n_repeat_words / nullif(n_words, 0)", high=0.5),
)


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    A window's hash and place share one long, so sorting longs brings equal hashes together. Only windows with a neighbour of
    the same hash are then compared as strings, which makes the count exact.
    """
    high = F.lit(-(1 << 32))
    key = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))
    same = lambda a, b: F.coalesce(a.bitwiseAND(high) == b.bitwiseAND(high), F.lit(False))
    near = lambda s: F.filter(s, lambda x, p: same(x, F.get(s, p - 1)) | same(x, F.get(s, p + 1)))
    place = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    window = lambda w, i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i"))
    equal = lambda t: F.filter(t, lambda x, p: F.coalesce(x["s"] == F.get(t, p - 1)["s"], F.lit(False)) | F.coalesce(x["s"] == F.get(t, p + 1)["s"], F.lit(False)))
    covered = lambda at: F.aggregate(F.transform(at, lambda v, p: F.least(F.lit(3), F.coalesce(F.get(at, p + 1) - v, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    def count(w: Column) -> Column:
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: key(w, i)))
        candidates = _let(keys, near)
        strings = F.sort_array(F.transform(candidates, lambda x: window(w, place(x))))
        found = F.transform(_let(strings, equal), lambda x: x["i"])
        return _let(F.sort_array(found), covered)

    return _let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(count(w))).cast("long")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(text: Column) -> Column:
    """A struct of all counts of a text (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    bare = lambda x: F.length(_without(x, SPACES))

    def of_lines(lines: Column) -> Column:
        full = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != "")
        return _let(full, lambda f: F.struct(F.size(f).alias("n"), (F.size(f) - F.size(F.array_distinct(f))).alias("dup")))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).alias("n_stop"), repeated_words(w).alias("n_repeat_words"))

    return F.struct(
        _let(words_of(t), counts).alias("w"),
        bare(t).alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count(t, F.lit("[!?]")).alias("n_marks"),
        of_lines(F.split(t, "\n")).alias("l"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that a row of measures breaks, joined by a comma."""
    broken = []
    for r in rules:
        fails = [f"({r.measure}) < {r.low}"] * (r.low is not None) + [f"({r.measure}) > {r.high}"] * (r.high is not None)
        # Ratios of a text without words are null: the length rule speaks there.
        broken.append(F.expr(f"CASE WHEN n_words > 0 AND ({' OR '.join(fails)}) THEN '{r.name}' WHEN n_words = 0 AND '{r.name}' = 'length' THEN 'length' END"))
    return F.concat_ws(",", *broken)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, the columns in keep, the counts, base_failed, kept, broken (names of broken rules).

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: base_failed is false and no
    rule is broken. A null text counts as empty, an empty text fails by length. Each row stands alone, so repeated rows and
    shared or null doc_ids get the same verdict each. Columns not named are ignored. No rows give no rows.
    """
    m = docs.select("doc_id", *keep, measures(F.col("text")).alias("_m"))
    long = lambda c: F.col(f"_m.{c}").cast("long")
    out = m.select(
        "doc_id", *keep, long("w.n_words").alias("n_words"), long("word_chars").alias("word_chars"), long("n_symbols").alias("n_symbols"), long("l.dup").alias("n_dup_lines"),
        long("w.n_repeat_words").alias("n_repeat_words"), long("w.n_stop").alias("n_stop"), long("n_marks").alias("n_marks"), long("l.n").alias("n_lines"),
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("broken", compile_rules(rules))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select("doc_id", *keep, *names, (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"), "n_stop", "n_marks", "n_lines", "broken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_BROKEN = ",\n    ".join(
    f"CASE WHEN n_words > 0 AND ({' OR '.join([f'({r.measure}) < {r.low}'] * (r.low is not None) + [f'({r.measure}) > {r.high}'] * (r.high is not None))}) THEN '{r.name}' WHEN n_words = 0 AND '{r.name}' = 'length' THEN 'length' END"
    for r in RULES
)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
often AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM often) GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(words, lambda x: x IN ({_STOP})))::BIGINT AS n_stop,
    len(regexp_extract_all(t, '[!?]'))::BIGINT AS n_marks, len(lines)::BIGINT AS n_lines
  FROM w LEFT JOIN rep USING (r)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {_BROKEN}) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, n_stop, n_marks, n_lines, broken FROM b
"""
