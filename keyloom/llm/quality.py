"""Quality rules, line first: lines are judged by punctuation, navigation and boilerplate rules, failing lines
go, and a document that loses too much of its text is rejected. Only built-in expressions are used.

Defined results: a null text counts as empty (all counts 0, base_failed, not kept); blank lines are neither judged nor
counted; a null doc_id is carried along; repeated rows are each judged; extra columns are kept by `clean` and
dropped by `measure`. A very long text or line is judged whole, within one row; every line pattern is linear in the line. Windows of words
that occur equally often all count, each word once.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, own_columns, spare, whole_text

SPACES = r"[\x09-\x0D\x20]+"
NOT_SPACE = r"[^\x09-\x0D\x20]"
#: A line has to end in one of these, closing quotes, brackets and white space may follow: stops of many scripts, and the letters of
#: Thai and Lao, which are written without stops.
STOPS = ".!?:;…。！？．｡；：।॥؟۔՞։።፧၊။៕ก-໿"
CLOSING = r"\x22')\]»”’›）」』】》*#$%&"
TERMINAL = f"[{STOPS}][{CLOSING}]*$"
CLOSERS = f"^[{CLOSING}]+$"
BLANKS = " \t\x0b\x0c\r"
#: Four or more items in a row divided by single bars, dots or arrows, and four or more words in a row that end in doubled exclamation
#: marks. Only lines with so many marks are searched; a search starts at the first mark, so it doesn't go back. A » divides nothing in
#: lines that also hold «.
ITEMS = 4
DIVIDERS = "|›·•"
NAVIGATION = f"[^{DIVIDERS}»][{DIVIDERS}»]([^{DIVIDERS}»]+[{DIVIDERS}»]){{3}}"
NAVIGATION_OF_QUOTES = f"[^{DIVIDERS}][{DIVIDERS}]([^{DIVIDERS}]+[{DIVIDERS}]){{3}}"
SHOUTING = r"[^\x09-\x0D\x20]!!(\x20|$)([^\x09-\x0D\x20]+!!(\x20|$)){3}"
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "terms of use", "terms of service", "privacy policy",
    "accept cookies", "accept all cookies", "enable javascript", "lorem ipsum", "click here", "subscribe to our", "sign up for our",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookies akzeptieren", "tous droits réservés", "politique de confidentialité", "accepter les cookies",
    "todos los derechos reservados", "política de privacidad", "aceptar cookies", "aceptar las cookies", "все права защищены", "版权所有", "無断転載",
)


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: most of a line's characters that may be symbols, in percent
    max_symbol_percent: int = 8
    #: most of the word characters that may go with failing lines, in percent
    max_lost_percent: int = 50


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _repeat_words(words: Column) -> Column:
    """Words covered by five-word windows whose 64-bit hash occurs twice or more in the same text."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.when(i == 0, F.lit(5)).otherwise(F.least(F.lit(5), p - F.get(starts, i - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g).cast("long")

    def repeated(marked: Column) -> Column:
        same = lambda e, j: F.coalesce(e["h"] == F.get(marked, j)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(marked, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["p"]))

    def marked(h: Column) -> Column:
        key = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.struct(key(i).alias("h"), i.alias("p"))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    count = bind(bind(bind(hashes, marked), repeated), covered)
    return F.when(F.size(words) >= 6, count).otherwise(F.lit(0).cast("long"))


def _line_keeps(line: Column, rules: QualityRules) -> Column:
    size = F.length(line)
    marks = F.length(F.regexp_replace(line, f"[^#*$%&|<>»{DIVIDERS}]+", ""))  # few lines have any: the others need no second look
    symbols = F.length(F.regexp_replace(line, r"[^#*$%&|<>]+", ""))
    bars = F.length(F.regexp_replace(line, f"[^»{DIVIDERS}]+", ""))
    shouts = (size - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    bare = F.rtrim(line, F.lit(BLANKS))
    end = F.right(bare, F.lit(12))  # most lines end in a few closers at most
    navigation = line.rlike(NAVIGATION) & (~F.contains(line, F.lit("«")) | line.rlike(NAVIGATION_OF_QUOTES))
    return (
        (end.rlike(TERMINAL) | (end.rlike(CLOSERS) & bare.rlike(TERMINAL)))
        & ((marks == 0) | (((bars < ITEMS) | ~navigation) & (symbols * 100 <= size * rules.max_symbol_percent)))
        & ((shouts < ITEMS) | ~line.rlike(SHOUTING))
        & ~bind(F.lower(line), lambda low: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in BOILERPLATE]))
    )


def with_rules(docs: DataFrame, rules: QualityRules = QualityRules(), name: str = "_q") -> DataFrame:
    """`docs` with one struct column: the counts, the verdict and the text that is left."""
    text = whole_text()

    def judge(lines: Column, words: Column) -> Column:
        n = F.size(words)
        good = F.filter(lines, lambda x: _line_keeps(x, rules))

        def verdict(good: Column) -> Column:
            left = F.length(F.regexp_replace(F.array_join(good, " "), SPACES, ""))
            chars = F.length(F.array_join(words, ""))

            def out(repeat: Column) -> Column:
                failed = (n < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n)
                return F.struct(
                    n.cast("long").alias("n_words"),
                    chars.cast("long").alias("word_chars"),
                    F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                    repeat.alias("n_repeat_words"),
                    failed.alias("base_failed"),
                    (~failed & ((chars - left) * 100 <= chars * rules.max_lost_percent)).alias("kept"),
                    F.size(lines).cast("long").alias("n_lines"),
                    (F.size(lines) - F.size(good)).cast("long").alias("n_lines_failed"),
                    F.array_join(good, "\n").alias("clean_text"),
                )

            return bind(_repeat_words(words), out)

        return bind(good, verdict)

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    judged = bind(_words(text), lambda w: bind(lines, lambda x: judge(x, w)))
    return docs.select("*", F.explode(F.array(judged)).alias(name))  # no filter is pushed below it, which would judge twice


def measure(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: its counts and the verdict."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_failed"]
    return with_rules(docs.select("doc_id", "text"), rules).select("doc_id", *[F.col("_q")[n].alias(n) for n in names])


def clean(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, without their failing lines; the columns of `docs`."""
    (name,) = spare(docs, "_q")
    judged = with_rules(docs, rules, name).filter(F.col(name)["kept"])
    put = {"text": F.col(name)["clean_text"]}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.length(F.col(name)["clean_text"]).cast("long")
    return judged.withColumns(put).select(*own_columns(docs))


#: DuckDB SQL for the base columns and the verdict under the default rules.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS ls
  FROM documents),
w AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM d WHERE len(ws) >= 5),
v AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS k FROM w),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM v) WHERE c > 1),
c AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + j AS p FROM r, range(0, 5) AS o(j)) GROUP BY rid),
g AS (
  SELECT *, list_filter(ls, lambda x: regexp_matches(rtrim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[.!?:;…。！？．｡；：।॥؟۔՞։።፧၊။៕{LETTERS}][\x22''\)\]»”’›）」』】》*#$%&]*$')
      AND NOT regexp_matches(x, '([^\x09-\x0D\x20]+!!( |$)){4}')
      AND NOT (regexp_matches(x, '[^|›·•»][|›·•»]([^|›·•»]+[|›·•»]){3}') AND (NOT contains(x, '«') OR regexp_matches(x, '[^|›·•][|›·•]([^|›·•]+[|›·•]){3}')))
      AND NOT regexp_matches(lower(x), 'all rights reserved|licensed under|released under|terms of (use|service)|privacy policy|accept (all )?cookies|enable javascript|lorem ipsum|click here|subscribe to our|sign up for our'
        || '|alle rechte vorbehalten|datenschutzerklärung|cookies akzeptieren|tous droits réservés|politique de confidentialité|accepter les cookies'
        || '|todos los derechos reservados|política de privacidad|aceptar (las )?cookies|все права защищены|版权所有|無断転載')
      AND length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) * 100 <= length(x) * 8) AS ok
  FROM d),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(ok))::BIGINT AS n_lines_failed,
    length(regexp_replace(array_to_string(ok, ' '), '[\x09-\x0D\x20]+', '', 'g')) AS left_chars
  FROM g LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (word_chars - left_chars) * 100 <= word_chars * 50) AS kept,
  n_lines, n_lines_failed
FROM m
""".replace("{LETTERS}", "\u0e01-\u0eff")  # Thai and Lao
