"""Quality rules per document, and verdicts on whole hosts from their documents' failures.

Only DataFrame functions. Words are runs of characters other than white space; a null text has none.
Each document gets its counts in its own row: nothing is exploded, so no text or word is shuffled.
For each rule the share of failing documents of a host is shrunk by an empirical beta prior, fitted by moments to
the rates of all hosts, so that a host with three documents is not judged by them alone; a host whose shrunk
rate stands out from that of all documents takes all its documents with it. Documents without a host are judged alone.
``keep_good`` also rejects each document that breaks a rule itself.
A text of any length is counted in one row. An empty table gives an empty result; ties and repeated rows are
counted row by row; a null id is carried along; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm import tables
from heliograph.sources import storage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 5  # of the characters of words
MAX_DUP_LINE_PERCENT = 50  # of the lines that are not blank
MIN_WORD_CHARS, MAX_WORD_CHARS = 3, 10  # on average
HOST_ODDS = 4.0  # a host fails a rule when the odds of its shrunk rate are this many times the odds of all documents
MIN_HOST_RATE = 0.2  # and its shrunk rate is at least this
SYMBOLS = "[#*$%&|<>]+"
WINDOW = 3


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def rule_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without its text and with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Windows of three words are compared by 64-bit hash inside one text. Only texts in which some window
    comes twice are sorted; the words that repeated windows cover are then counted from their positions.
    """
    keep = [F.col(c) for c in docs.columns if c != text_column]
    text = tables.whole_text(text_column)
    with_lists = docs.select(
        *keep,
        F.filter(F.split(text, tables.SPACES), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\x09-\\x0D]")).alias("_lines"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    starts = F.slice("_words", F.lit(1), F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0)))
    hashed = with_lists.select(
        *keep,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            starts, lambda w, i: F.xxhash64(w, *[F.get(F.col("_words"), i + F.lit(n)) for n in range(1, WINDOW)])
        ).alias("_windows"),
    )
    counts = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = hashed.select(
        *counts,
        F.when(
            repeats,
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ).alias("_sorted"),
    )
    sorted_windows = F.col("_sorted")
    doubled = F.filter(
        sorted_windows,
        lambda x, i: _same(F.get(sorted_windows, i - 1)["h"], x["h"]) | _same(F.get(sorted_windows, i + 1)["h"], x["h"]),
    )
    placed = ordered.select(*counts, F.sort_array(F.transform(doubled, lambda x: x["at"])).alias("_at"))
    places = F.col("_at")
    covered = F.aggregate(
        F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return placed.select(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """Too short, or more than half of its words inside repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


RULES = {
    "symbols_failed": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars",
    "lines_failed": f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines",
    "length_failed": f"word_chars < {MIN_WORD_CHARS} * n_words OR word_chars > {MAX_WORD_CHARS} * n_words",
}


def host_rates(rows: DataFrame, host_column: str = "host", failed: str = "base_failed") -> DataFrame:
    """Per host: n_docs, n_failed, the mean rate of all hosts and the failure rate shrunk by the beta prior of all hosts.

    The prior has the documents' mean rate m and the variance v of host rates around it, each host
    weighted by its documents: strength k = m(1-m)/v - 1. Without spread (one host, or all alike) the
    prior outweighs every host; a k that is not positive leaves the rates as they are.
    """
    hosts = storage.checkpoint(
        rows.filter(F.col(host_column).isNotNull())
        .groupBy(host_column)
        .agg(F.count("*").alias("n_docs"), F.count_if(failed).alias("n_failed"))
    )
    mean = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m")).scalar()
    spread = hosts.withColumn("_m", mean).agg(
        F.max("_m").alias("m"),
        (F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - F.col("_m"), 2)) / F.sum("n_docs")).alias("v"),
    )
    prior = spread.select(
        F.struct(
            "m",
            F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(0.0))).alias("k"),
        ).alias("prior")
    ).scalar()
    shrunk = hosts.withColumn("_prior", prior)
    rate = (F.col("n_failed") + F.col("_prior.m") * F.col("_prior.k")) / (F.col("n_docs") + F.col("_prior.k"))
    return shrunk.withColumn("host_rate", F.coalesce(rate, F.col("_prior.m"))).withColumn("mean_rate", F.col("_prior.m")).drop("_prior")


def verdicts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """One row per document: its counts, a column for each rule, the rules that its host fails, and whether it is kept.

    A host fails a rule when the odds of its shrunk rate are ``HOST_ODDS`` times the odds of all documents and the
    rate is ``MIN_HOST_RATE`` at least. A document is kept when it passes the base rule and its host fails none.
    """
    narrow = docs.select(
        F.col(id_column).alias("doc_id"), F.col(host_column).alias("host"), F.col(text_column).alias("text")
    )
    rules = {"base_failed": base_failed()} | {name: F.expr(rule) for name, rule in RULES.items()}
    rows = storage.checkpoint(rule_counts(narrow).withColumns(rules))
    bad = None
    for name in rules:
        rates = host_rates(rows, failed=name)
        # rate / (1 - rate) >= HOST_ODDS * mean / (1 - mean), without dividing.
        apart = F.col("host_rate") * (1 - F.col("mean_rate")) >= HOST_ODDS * F.col("mean_rate") * (1 - F.col("host_rate"))
        found = rates.filter(apart & (F.col("host_rate") >= MIN_HOST_RATE)).select("host", F.lit(name).alias("rule"))
        bad = found if bad is None else bad.union(found)
    hosts = storage.checkpoint(bad.groupBy("host").agg(F.sort_array(F.collect_list("rule")).alias("host_failed")))
    judged = rows.join(hosts, "host", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("host_failed").isNull())


def passed() -> Column:
    """Kept, and no rule broken by the document itself: what the pipeline asks for."""
    good = F.col("kept")
    for name in RULES:
        good = good & ~F.col(name)
    return good


def keep_good(docs: DataFrame, **columns) -> DataFrame:
    """The documents that pass, with all their columns."""
    keyed, row = tables.with_row_key(docs, columns.get("id_column", "doc_id"))
    judged = verdicts(keyed, **(columns | {"id_column": row}))
    return tables.without_rows(keyed, row, judged.filter(~passed()).select(F.col("doc_id").alias(row)))
