"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Each rule is a measure, a bound below and a bound above; measures are expressions over whole-text
counts. ``compile_rules`` turns the table into one boolean expression, so new rules are data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, text_or_empty

#: Frequent function words of the corpus's languages (fixed values).
STOP_WORDS = {
    "en": "the of and to in a is that for it on was with be as by this are at from".split(),
    "es": "de la que el en y a los se del las un por con una su para es al lo".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par sur pas au".split(),
}
#: (measure, least, most); None: no bound.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("symbol_ratio", None, 0.10),
    ("stop_ratio", 0.05, None),
    ("mean_word_chars", 2.0, 12.0),
    ("dup_line_ratio", None, 0.5),
    ("upper_ratio", None, 0.5),
)
MEASURES: dict[str, Callable[[], Column]] = {
    "symbol_ratio": lambda: F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
    "stop_ratio": lambda: F.col("n_stop") / F.greatest(F.col("n_words"), F.lit(1)),
    "mean_word_chars": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "dup_line_ratio": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "upper_ratio": lambda: F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
}
_POSITION_BITS = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included.

    Windows are sorted by (hash, position) packed in a long; neighbours with the same hash and the same
    words mark their positions. Should two different windows have the same hash, or a text have over a
    million words, the windows themselves are sorted instead, so the count is exact.
    """
    same = lambda w, p, q: (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))
    window_hash = lambda w, p: F.xxhash64(F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))
    mask = (1 << _POSITION_BITS) - 1
    position = lambda x: x.bitwiseAND(F.lit(mask).cast("long")).cast("int")
    high = lambda x: F.shiftright(x, _POSITION_BITS)

    def covered(marked: Column) -> Column:
        """Of ascending positions, the words that the windows there cover."""
        return let(marked, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n"), x.alias("at")), lambda acc: acc["n"])).cast("long")

    def by_hash(w: Column) -> Column:
        packed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda p: F.shiftleft(window_hash(w, p), _POSITION_BITS).bitwiseOR(p.cast("long")))

        def inner(s: Column) -> Column:
            clash = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda k: (high(F.get(s, k)) == high(F.get(s, k - 1))) & ~same(w, position(F.get(s, k)), position(F.get(s, k - 1))))
            near = lambda x, k, d: F.coalesce(high(x) == high(F.get(s, k + d)), F.lit(False))
            marked = F.sort_array(F.transform(F.filter(s, lambda x, k: near(x, k, 1) | near(x, k, -1)), position))
            return F.when(F.size(s) < 2, F.lit(0).cast("long")).when(clash, by_words(w)).otherwise(covered(marked))

        return let(F.sort_array(packed), inner)

    def by_words(w: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda p: F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c"), p.alias("p")))
        key = lambda x: F.struct(x["a"], x["b"], x["c"])

        def inner(s: Column) -> Column:
            near = lambda x, k, d: F.coalesce(key(x) == key(F.get(s, k + d)), F.lit(False))
            return covered(F.sort_array(F.transform(F.filter(s, lambda x, k: near(x, k, 1) | near(x, k, -1)), lambda x: x["p"])))

        return let(F.array_sort(rows), inner)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).when(F.size(words) > mask, by_words(words)).otherwise(by_hash(words))


def compile_rules(rules=RULES, measures=MEASURES) -> Column:
    """True where every rule holds."""
    verdict = F.lit(True)
    for name, least, most in rules:
        value = measures[name]()
        if least is not None:
            verdict = verdict & (value >= least)
        if most is not None:
            verdict = verdict & (value <= most)
    return verdict


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` and other counts, a row per input row.

    A null or empty text has no words: all counts are 0, it fails the base rule and is not kept. Ids
    repeat as they do in the input; columns besides the two named are ignored.
    """
    words = F.filter(F.split("t", f"[{ASCII_SPACE}]+"), lambda x: x != "")
    stop = sorted({w for own in STOP_WORDS.values() for w in own})

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop"))

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{ASCII_SPACE}]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    counted = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("t")).select(
        "id", let(words, of_words).alias("w"), of_lines.alias("l"), (F.length("t") - count(f"[{ASCII_SPACE}]")).cast("long").alias("word_chars"), count("[#*$%&|<>]").alias("n_symbols"), count(r"\p{Lu}").alias("n_upper")
    )
    flat = counted.select("id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_stop", "l.n_lines", "n_upper")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"), "n_stop", "n_lines", "n_upper")


def _sql_rules() -> str:
    measures = {
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "stop_ratio": "n_stop / greatest(n_words, 1)",
        "mean_word_chars": "word_chars / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "upper_ratio": "n_upper / greatest(word_chars, 1)",
    }
    return " and ".join(f"{measures[name]} {sign} {bound}::double" for name, least, most in RULES for sign, bound in ((">=", least), ("<=", most)) if bound is not None)


#: The same rows in DuckDB; ``_r`` tells rows of equal ids apart.
ORACLE_SQL = rf"""
with d as materialized (select row_number() over () as _r, doc_id, coalesce(text, '') as t from documents),
w as materialized (select *, list_filter(regexp_split_to_array(t, '[{ASCII_SPACE}]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{ASCII_SPACE}]')) as l from d),
words as materialized (select _r, unnest(w) as a, unnest(range(len(w))) as p from w where len(w) > 2),
windows as (select _r, p, a, lead(a, 1) over o as b, lead(a, 2) over o as c from words window o as (partition by _r order by p)),
again as (select _r, p from (select *, count(*) over (partition by _r, a, b, c) as n from windows where c is not null) where n > 1),
covered as (select _r, count(distinct p + k) as n from again, (select unnest([0, 1, 2]) as k) group by _r),
counted as (
  select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words, len(list_filter(w, lambda x: lower(x) in ({", ".join(repr(x) for x in sorted({x for own in STOP_WORDS.values() for x in own}))}))) as n_stop, len(l) as n_lines, len(regexp_extract_all(t, '\p{{Lu}}')) as n_upper
  from w left join covered using (_r)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_sql_rules()} as kept, n_stop, n_lines, n_upper from failed
"""
