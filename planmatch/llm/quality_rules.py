"""Line-first cleaning of documents by rules, in DataFrame expressions only.

Every line is judged by itself: punctuation rules (runs of ``!!`` or symbol characters in many of its
words), navigation rules (bars between its words) and boilerplate rules (fixed phrases of page furniture).
Lines that fail are removed; a document that loses too many of its words, or fails the base rules, is rejected.

Defined results: null text counts as empty; an empty text has no words and is rejected; repeated rows are judged
each by itself; an empty table gives an empty table; other columns are passed on untouched by ``clean_lines``,
and its own columns replace any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.names import unused

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture; a line of at most 25 words that holds one fails.
BOILERPLATE = r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept cookies|enable javascript|click here|skip to content|sign up for our newsletter|share on (facebook|twitter))"
WINDOW = 8


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once: a lambda variable, where a plain reference would be inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_words(text: Column) -> Column:
    """Words of each line: array of arrays, as split at line feeds, without empty words."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.array_remove(F.split(line, WHITE, -1), ""))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words covered by windows of ``window`` words that occur at least twice in the array.

    Windows are compared by the 64-bit hash of their words' hashes. Texts without a repeated window leave after one
    hash-set pass; others sort (hash, position) and add up the covered stretches: n log n at most.
    """

    def marked(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(p: Column) -> Column:
            n = F.size(p)
            same = F.filter(
                p,
                lambda x, i: ((i > 0) & (x["h"] == F.get(p, i - 1)["h"])) | ((i < n - 1) & (x["h"] == F.get(p, i + 1)["h"])),
            )
            return let(
                F.array_sort(F.transform(same, lambda x: x["i"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda a, k: F.when(k == F.size(at) - 1, F.lit(window)).otherwise(F.least(F.lit(window), F.get(at, k + 1) - a))),
                    F.lit(0).cast("long"),
                    lambda s, x: s + x,
                ),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), marked))
    )


def failing(line: Column, n_words: Column, max_marks: float, max_symbols: float) -> Column:
    """Whether a line with words fails one of the line rules."""
    marks = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    bars = F.length(line) - F.length(F.translate(line, "|", ""))
    punctuation = (marks > max_marks * n_words) | (symbols > max_symbols * n_words)
    navigation = (bars >= 2) & (bars * 100 > n_words * 15)
    return punctuation | navigation | ((n_words <= 25) & line.rlike(BOILERPLATE))


def clean_lines(
    docs: DataFrame, text: str = "text", max_marks: float = 0.3, max_symbols: float = 0.5, max_lost: float = 0.5, min_words: int = 20, only_kept: bool = False
) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, n_lost_words, kept.

    ``kept``: the base rules hold and at most ``max_lost`` of the words are in lines that fail. ``clean_text``: the lines
    that pass, joined by line feeds, lines without words included as they are. ``only_kept`` leaves out rejected rows; it
    costs nothing more, where a filter on ``kept`` would be pushed down and evaluate all rules twice.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "n_lost_words", "kept"]
    rest = [c for c in docs.columns if c.lower() not in own]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    def stats(t: Column, lines: Column, lw: Column) -> Column:
        def judged(fails: Column) -> Column:
            return F.struct(
                F.size(F.flatten(lw)).cast("long").alias("n_words"),
                F.length(F.regexp_replace(t, WHITE, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                let(
                    F.filter(lines, lambda x, i: F.size(F.get(lw, i)) > 0), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")
                ).alias("n_dup_lines"),
                let(F.flatten(lw), lambda w: repeat_words(w)).alias("n_repeat_words"),
                F.array_join(F.filter(lines, lambda x, i: ~F.get(fails, i)), "\n").alias("clean_text"),
                F.aggregate(
                    F.zip_with(lw, fails, lambda w, f: F.when(f, F.size(w)).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x
                ).alias("n_lost_words"),
            )

        fails = F.zip_with(lines, lw, lambda line, w: (F.size(w) > 0) & failing(line, F.size(w), max_marks, max_symbols))
        return let(fails, judged)

    whole = let(body, lambda t: let(F.split(t, "\n", -1), lambda lines: let(line_words(t), lambda lw: stats(t, lines, lw))))
    failed = lambda x: (x["n_words"] < min_words) | (x["n_repeat_words"] * 100 > x["n_words"] * 30)
    lost = lambda x: x["n_lost_words"] > x["n_words"] * max_lost
    if only_kept:
        whole = F.explode(let(whole, lambda x: F.filter(F.array(x), lambda y: ~failed(y) & ~lost(y))))
    (found,) = unused([*rest, *own], "found")
    out = docs.select(*[F.col(f"`{c}`") for c in rest], whole.alias(found))
    s = F.col(found)
    return out.select(*[F.col(f"`{c}`") for c in rest], f"{found}.*", failed(s).alias("base_failed"), (~failed(s) & ~lost(s)).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words"
    )


#: The operator over a table ``{docs}``: its columns, and the text of the lines that pass.
SQL_STATS = r"""
d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from {docs}),
l as (select rid, unnest(range(len(a))) as ln, unnest(a) as line from (select rid, string_split(text, chr(10)) as a from d)),
lw as (select rid, ln, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from l),
lj as (select *, len(w) as nw, (length(line) - length(replace(line, '!!', ''))) / 2.0 as marks,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) as sym, length(line) - length(replace(line, '|', '')) as bars from lw),
lf as (select *, nw > 0 and (marks > 0.3 * nw or sym > 0.5 * nw or (bars >= 2 and bars * 100 > nw * 15) or (nw <= 25 and regexp_matches(line,
    '(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|accept cookies|enable javascript|click here|skip to content|sign up for our newsletter|share on (facebook|twitter))'))) as fails from lj),
g as (select rid, sum(nw)::bigint as n_words, (count(*) filter (nw > 0) - count(distinct line) filter (nw > 0))::bigint as n_dup_lines,
    sum(case when fails then nw else 0 end)::bigint as n_lost_words, string_agg(line, chr(10) order by ln) filter (not fails) as clean_text,
    flatten(list(w order by ln)) as w from lf group by rid),
win as (select rid, i, array_to_string(w[i + 1:i + 8], ' ') as s from (select rid, w, unnest(range(len(w) - 7)) as i from g where len(w) >= 8)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, s) as c from win) where c >= 2),
cov as (select rid, sum(least(8, coalesce(lead_i - i, 8)))::bigint as n_repeat_words from
    (select rid, i, lead(i) over (partition by rid order by i) as lead_i from rep) group by rid),
s as (select d.rid, d.doc_id, n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(clean_text, '') as clean_text, n_lost_words
    from d join g using (rid) left join cov using (rid)),
quality as (select *, (n_words < 20 or n_repeat_words * 100 > n_words * 30) as base_failed from s)
"""
SQL = (
    "with "
    + SQL_STATS.replace("{docs}", "documents")
    + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
    "(not base_failed and n_lost_words <= n_words * 0.5) as kept, n_lost_words from quality"
)
