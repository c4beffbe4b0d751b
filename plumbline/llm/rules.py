r"""Quality rules: a table of thresholds compiled into one projection.

Measures of a text (counts of words, symbols, lines, repeats) are columns of
built-in functions; every rule is a ratio of two of them and its bounds; the
table becomes one boolean expression.  No user function, join or shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of the word contract, symbols, and frequent words of English, French, German and Spanish.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in a is that it for on was be with as this by at are from "
    "de la le et les des en un une du que pour dans est qui sur "
    "der die das und ist den von zu mit nicht ein eine auf dem im "
    "el los las y se por con no su al una del lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if ``scale * top`` is above ``most * bottom`` or below ``least * bottom``.

    Bounds are whole numbers (per ``scale``) so that every engine decides alike.
    """

    name: str
    top: str
    bottom: str
    scale: int = 1000
    least: int | None = None
    most: int | None = None

    def failed(self) -> Column:
        top, bottom = F.col(self.top) * self.scale, F.col(self.bottom)
        bad = F.lit(False)
        if self.least is not None:
            bad = bad | (top < bottom * self.least)
        if self.most is not None:
            bad = bad | (top > bottom * self.most)
        return bad

    def sql(self) -> str:
        parts = [f"{self.top} * {self.scale} < {self.bottom} * {self.least}"] * (self.least is not None)
        parts += [f"{self.top} * {self.scale} > {self.bottom} * {self.most}"] * (self.most is not None)
        return "(" + " OR ".join(parts or ["false"]) + ")"


#: The base verdict: too short, or mostly repeated three-word windows.
BASE = (Rule("few words", "n_words", "one", 1, least=50), Rule("repeated windows", "n_repeat_words", "n_words", 100, most=50))
#: Production thresholds.
RULES = (
    Rule("symbols in words", "n_symbols", "word_chars", 1000, most=60),
    Rule("mean word length", "word_chars", "n_words", 10, least=25, most=120),
    Rule("stop words", "n_stop_words", "n_words", 1000, least=60),
    Rule("repeated lines", "n_dup_lines", "n_lines", 1000, most=300),
    Rule("capital words", "n_capital_words", "n_words", 1000, most=300),
)


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """The id and the counts that rules refer to, one row for each row; a null text has none of anything.

    ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_stop_words, n_capital_words, one``.  A line counts if it has a word.
    Words of capitals only count from two letters on.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.filter(F.split(text, SPACE_CLASS), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = base.withColumn("windows", F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("i")))))
    # In sorted order a window occurs again if a neighbour equals it.
    same = windows.withColumn("same", F.zip_with("windows", F.slice("windows", 2, F.greatest(F.size("windows"), F.lit(1))), lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))))
    again = same.withColumn("again", F.sort_array(F.filter(F.transform("windows", lambda x, j: F.when(F.get("same", j) | ((j > 0) & F.coalesce(F.get("same", j - 1), F.lit(False))), x["i"])), lambda i: i.isNotNull())))
    gaps = F.zip_with("again", F.slice("again", 2, F.greatest(F.size("again"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return again.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0), lambda s, x: s + x).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(list(stop_words)))).cast("long").alias("n_stop_words"),
        F.size(F.filter("words", lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) >= 2))).cast("long").alias("n_capital_words"),
        F.lit(1).cast("long").alias("one"),
    )


def failed(rules: tuple[Rule, ...]) -> Column:
    """The table as one expression: whether any rule fails."""
    bad = F.lit(False)
    for rule in rules:
        bad = bad | rule.failed()
    return bad


def judge(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for every row; repeated rows each, none for an empty table."""
    found = measure(docs, id_column, text_column).withColumn("base_failed", failed(base))
    return found.withColumn("kept", ~F.col("base_failed") & ~failed(rules)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "n_capital_words")


def oracle(table: str = "documents", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, stop_words: list[str] = STOP_WORDS) -> str:
    """The same in DuckDB's SQL."""
    stops = ", ".join(f"'{w}'" for w in stop_words)
    spaces = " || ".join(f"chr({ord(c)})" for c in SPACES)
    return f"""
    WITH base AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: translate(x, {spaces}, '') <> '') AS lines
      FROM {table}),
    windows AS (
      SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
      FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS i FROM base WHERE len(words) >= 3)),
    again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
    covered AS (SELECT rid, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
    counts AS (
      SELECT doc_id, 1 AS one, len(words)::BIGINT AS n_words, length(translate(body, {spaces}, ''))::BIGINT AS word_chars,
             (length(body) - length(translate(body, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda w: lower(w) IN ({stops})))::BIGINT AS n_stop_words,
             len(list_filter(words, lambda w: upper(w) = w AND lower(w) <> w AND length(w) >= 2))::BIGINT AS n_capital_words
      FROM base LEFT JOIN covered USING (rid)),
    judged AS (SELECT *, {" OR ".join(r.sql() for r in base)} AS base_failed FROM counts)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT ({" OR ".join(r.sql() for r in rules)}) AS kept, n_lines, n_stop_words, n_capital_words
    FROM judged"""
