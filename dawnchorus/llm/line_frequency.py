"""Operator 3, quality rules: cross-document line frequency (DataFrame functions only).

Lines are normalised (lower case, runs of digits as one 0, no white space) and
hashed.  For each host and line the distinct documents are
counted; a line that stands in more than ``max_documents`` of them and in more
than ``max_share`` of the host's documents is removed, and a document that keeps
less than ``least_left`` of its word characters is rejected as depleted.  Copies of one
text must not make its own lines look like boilerplate, so documents are told apart by
a hash of their whole list of normalised lines: copies count once, near copies count
each, and documents without a line do not count.

Beside it stand rules on the document alone: too few words, or too many words in
repeated 8-word windows.

The texts are read once; what is counted and joined are line hashes.

Defined results: a null text has no words and fails the word rule; null and empty
hosts form one group; lines without a word take no part; repeated rows are judged
apart, and all are returned; an empty table gives an empty result.  Other columns
of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.common import SPACE, hash60, materialize, rest, space_words, spaced

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules (see the module)."""

    least_words: int = 20
    most_repeated_percent: int = 30
    max_documents: int = 10
    max_share: float = 0.02
    least_left: float = 0.3


def bare_line(line: Column) -> Column:
    """The line without ASCII white space."""
    return F.replace(spaced(line), F.lit(" "), F.lit(""))


def line_key(host: Column, bare: Column) -> Column:
    """Hash of a host and a line in lower case, each run of digits as one 0."""
    return hash60(F.concat(host, F.lit("\n"), F.regexp_replace(F.lower(bare), "[0-9]+", "0")))


def with_windows(frame: DataFrame, words: str = "words", windows: str = "windows") -> DataFrame:
    """Put in place of the words the hashes of all windows of 8: of pairs, of pairs of pairs, of those.

    Each step is a column of its own, as an expression that holds the step below
    twice would be computed twice.
    """
    frame = frame.withColumn(windows, F.zip_with(words, rest(F.col(words), 2), lambda a, b: F.xxhash64(a, b)))
    reach = 2
    while reach < WINDOW:
        frame = frame.withColumn(windows, F.zip_with(windows, rest(F.col(windows), reach + 1),
                                                     lambda a, b: F.xxhash64(a, b)))
        reach *= 2
    return frame.withColumn(windows, F.slice(windows, 1, F.greatest(F.size(windows) - (WINDOW - 1), F.lit(0)))).drop(words)


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window found twice or more in the text, by the windows' 64-bit hashes.

    Only a text that has fewer distinct windows than windows goes through the sort.
    """
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(x: Column, j: Column, sorted_: Column) -> Column:
        before = (j > 0) & (F.get(sorted_, j - 1)["h"] == x["h"])
        return before | F.coalesce(F.get(sorted_, j + 1)["h"] == x["h"], F.lit(False))

    # Each stage is bound by a one-element transform, so it is computed once.
    starts = F.transform(F.array(order), lambda s: F.array_sort(
        F.filter(F.transform(s, lambda x, j: F.when(twice(x, j, s), x["i"])), lambda p: p.isNotNull())))
    total = F.transform(starts, lambda p: F.aggregate(F.transform(
        p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.get(total, F.lit(0))).cast("long")


def document_facts(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: the counts of its own rules, and its lines (key, word characters)."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        space_words(body).alias("words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"))
    counted = split.select(
        "rid", "doc_id", "host", F.size("words").cast("long").alias("n_words"), "n_symbols", "words",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", bare_line).alias("bare"))
    keyed = with_windows(counted).select(
        "rid", "doc_id", "host", "n_words", "n_symbols", "n_dup_lines", "windows",
        F.transform("bare", lambda x: F.struct(line_key(F.col("host"), x).alias("key"),
                                               F.length(x).alias("chars"))).alias("lines"))
    return keyed.select(
        "rid", "doc_id", "host", "n_words",
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("word_chars"),
        "n_symbols", "n_dup_lines", repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.when(F.size("lines") > 0, F.xxhash64(F.transform("lines", lambda x: x["key"]))).alias("document"), "lines")


def frequent_lines(facts: DataFrame, limits: Limits) -> DataFrame:
    """Keys of lines above the limits, and in how many distinct documents of their host they stand."""
    lines = facts.select("host", "document", F.explode("lines").alias("line"))
    counts = (lines.groupBy(F.col("line.key").alias("key")).agg(
        F.count_distinct("document").alias("n_documents"), F.first("host").alias("host"))
        .filter(F.col("n_documents") > limits.max_documents))
    hosts = facts.groupBy("host").agg(F.count_distinct("document").alias("host_documents"))
    return (counts.join(hosts, "host")
            .filter(F.col("n_documents") > limits.max_share * F.col("host_documents"))
            .select("key", "n_documents"))


def apply_quality_rules(docs: DataFrame, limits: Limits | None = None, text: str = "text", host: str = "source",
                        doc_id: str = "doc_id") -> DataFrame:
    """One row per document: the counts, base_failed, the characters of words in removed lines, and kept."""
    limits = limits or Limits()
    # One row per document with line hashes; written once, it fixes the row ids.
    facts = materialize(document_facts(docs, text, host, doc_id), "line-facts")
    frequent = frequent_lines(facts, limits)
    removed = (facts.select("rid", F.explode("lines").alias("line"))
               .join(frequent, F.col("line.key") == F.col("key"))
               .groupBy("rid").agg(F.sum("line.chars").alias("removed_chars")))
    base = ((F.col("n_words") < limits.least_words)
            | (100 * F.col("n_repeat_words") > limits.most_repeated_percent * F.col("n_words")))
    gone = F.coalesce(F.col("removed_chars"), F.lit(0).cast("long"))
    depleted = (gone > 0) & ((F.col("word_chars") - gone) < limits.least_left * F.col("word_chars"))
    return (facts.drop("lines", "document").join(removed, "rid", "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), (~base & ~depleted).alias("kept"), gone.alias("removed_chars")))
