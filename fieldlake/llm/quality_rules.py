"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

measures() adds the counts, and verdict() compiles the rules, each a ratio of
two counts with bounds, into one Boolean column. A text's repeated windows are
found by sorting its window hashes inside the row, so no row leaves its task
and nothing is shuffled.

Defined results: null or wordless text has 0 in all counts and fails the base
rule. Very long texts take time n log n. Equal rows are judged alike. Columns
that have a name of this module's are replaced in the result of measures();
all others pass. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word pattern, the symbols, and frequent function words of four languages.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = ("the of and to in is was that for with", "der die und den von zu das mit für ist", "de la le et les des en un une est", "de la que el en y los del las un")


@dataclass(frozen=True)
class Rule:
    """low <= above / below <= high, both given as whole hundredths; a text whose `below` is 0 passes."""

    name: str
    above: str
    below: str
    low: int | None = None
    high: int | None = None


#: The threshold table; bounds in hundredths.
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols to words", "n_symbols", "n_words", high=10),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=50),
    Rule("stop words to words", "n_stop_words", "n_words", low=2),
)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, also where body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+."""
    return F.filter(F.split(F.translate(text, SPACE[1:], " " * len(SPACE[1:])), " "), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words in those 3-word windows that are found twice or more."""

    def windows(w: Column) -> Column:
        return F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))

    def repeated(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        return F.filter(F.transform(s, lambda x, k: F.when(same(x, F.get(s, k + 1)) | (k > 0) & same(x, F.get(s, F.greatest(k - 1, F.lit(0)))), x["i"])), lambda i: i.isNotNull())

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    return let(words, lambda w: let(F.sort_array(windows(w)), lambda s: let(F.sort_array(repeated(s)), covered)))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_stop_words, n_repeat_words (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    solid = F.translate(text, SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    stops = F.array(*[F.lit(w) for w in sorted({w for x in STOP_WORDS for w in x.split()})])
    lowered = F.filter(F.split(F.lower(F.translate(text, SPACE[1:] + ".,;:!?", " " * 11)), " "), lambda w: F.array_contains(stops, w))
    out = {
        "n_words": F.size(word_list(text)),
        "word_chars": F.length(solid),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_stop_words": F.size(lowered),
        "n_repeat_words": repeat_words(word_list(text)),
    }
    return docs.withColumns({k: v.cast("long") for k, v in out.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules hold."""
    out = F.lit(True)
    for r in rules:
        above, below = 100 * F.col(r.above), F.col(r.below)
        for held in ([above >= r.low * below] if r.low is not None else []) + ([above <= r.high * below] if r.high is not None else []):
            out = out & ((below == 0) | held)
    return out


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures, base_failed and kept."""
    return measures(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same verdict in DuckDB's SQL over `documents`, by unnesting words."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for x in STOP_WORDS for w in x.split()}))
    held = " and ".join(f"({r.below} = 0 or 100 * {r.above} {sign} {bound} * {r.below})" for r in rules for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None)
    return rf"""
with base as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
    list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D.,;:!?]'), lambda x: x in ({stops})) as s
  from documents
), placed as (
  select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from base
), windows as (
  select doc_id, i, x || ' ' || lead(x, 1) over v || ' ' || lead(x, 2) over v as g from placed window v as (partition by doc_id order by i)
), repeated as (
  select doc_id, i, count(*) over (partition by doc_id, g) as n from windows where g is not null
), covered as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from repeated where n > 1) group by doc_id
), measured as (
  select b.doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(len(s) as bigint) as n_stop_words, cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from base b left join covered c on b.doc_id is not distinct from c.doc_id
), failed as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {held} as kept from failed"""
