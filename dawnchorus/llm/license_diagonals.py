"""Operator 2, license scans by diagonal voting (DataFrame functions only).

Every rolling k-gram of a document's words is hashed and joined to the positions
of the same hash in the license templates.  A hit at document word ``d`` and
template word ``t`` votes for the diagonal ``d - t``: the place where the template
would start.  Votes are added up per document, template and diagonal;
neighbouring diagonals (words put in or left out) are merged, and a span is
verified when it covers enough of its template and holds the template's telling
words, which part it from its kin (Attribution from Attribution-NonCommercial, GPL
from LGPL and AGPL).  Verified spans that meet in the document compete: a place
counts for the best of them alone (coverage, then length, then the order of the
templates), and a span is accepted when the places left to it still cover enough.
A *phrase* counts only where all its words stand consecutively: all its k-grams on
one diagonal; phrases do not compete.

The templates are a fixed list (a few hundred positions, checked), so their side
of the join is broadcast; only hits and one row per document leave a task.

Defined results: a null text has no words; a document shorter than k words has no
hits; repeated rows are scanned apart and each is returned; an empty table gives
an empty result.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.llm.common import fast_lower, materialize, rest

#: What separates words: ASCII characters other than letters and digits.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Template positions that are broadcast at most.
MOST_POSITIONS = 20_000


@dataclass(frozen=True)
class Template:
    """exact: a phrase, which counts only word by word.  telling: at least k consecutive words of
    the text, all of whose k-grams a span must hold."""

    label: str
    text: str
    exact: bool = False
    telling: str = ""

    def telling_positions(self, k: int) -> list[int]:
        words, telling = self.text.split(), self.telling.split()
        if not telling:
            return []
        starts = [i for i in range(len(words) - len(telling) + 1) if words[i:i + len(telling)] == telling]
        if len(telling) < k or len(starts) != 1:
            raise ValueError(f"telling words stand once in their template and are at least {k}: {self.telling}")
        return list(range(starts[0], starts[0] + len(telling) - k + 1))


PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)


def creative_commons() -> tuple[Template, ...]:
    """The notices of the six licenses that ask for attribution, in the wording of their versions."""
    kinds = ("", "sharealike", "noncommercial", "noderivatives", "noncommercial sharealike", "noncommercial noderivatives")
    short = {"sharealike": "sa", "noncommercial": "nc", "noderivatives": "nd"}
    return tuple(
        Template("-".join(["cc-by", *(short[w] for w in kind.split())]),
                 " ".join(f"this work is licensed under a creative commons attribution {kind} {version} license".split()),
                 telling=" ".join(f"commons attribution {kind} {version.split()[0]}".split()))
        for kind in kinds for version in ("4 0 international", "3 0 unported", "2 0 generic"))


#: Wording of public licenses and of the notices that name them.
LICENSES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
                    "and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except "
                         "in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met"),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to "
                      "endorse or promote products derived from this software without specific prior written permission"),
    Template("bsd-4", "all advertising materials mentioning features or use of this software must display the "
                      "following acknowledgement"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
                    "is hereby granted provided that the above copyright notice and this permission notice appear in "
                    "all copies"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
                    "gnu general public license as published by the free software foundation",
             telling="the gnu general public license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3",
             telling="the gnu general public license"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the "
                     "gnu lesser general public license as published by the free software foundation",
             telling="gnu lesser general"),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the "
                     "gnu affero general public license as published by the free software foundation",
             telling="gnu affero general"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of "
                      "the mpl was not distributed with this file you can obtain one at"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring "
                    "rights to this work"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to "
                          "copy modify publish use compile sell or distribute this software"),
    *creative_commons(),
)


def words_of(text: Column) -> Column:
    """The words in lower case; only those of ASCII letters are compared with templates."""
    return F.array_remove(F.split(fast_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def rolling_hashes(words: Column, k: int) -> Column:
    """Hash of every k consecutive words, folded from the left over shifted copies of the array."""
    folded = F.transform(words, lambda w: F.xxhash64(w))
    for shift in range(2, k + 1):
        folded = F.zip_with(folded, rest(words, shift), lambda h, w: F.xxhash64(h, w))
    return F.slice(folded, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def template_positions(spark, templates: Sequence[Template], k: int = K) -> DataFrame:
    """One row per template and k-gram: tpl, hash, tpos."""
    rows = []
    for number, template in enumerate(templates):
        words = template.text.split()
        rows += [(number, i, words[i:i + k]) for i in range(len(words) - k + 1)]
    if len(rows) > MOST_POSITIONS:
        raise ValueError(f"at most {MOST_POSITIONS} template positions are broadcast; given {len(rows)}")
    frame = spark.createDataFrame(rows, "tpl int, tpos int, gram array<string>")
    return frame.select("tpl", "tpos", rolling_hashes(F.col("gram"), k)[0].alias("hash"))


def gram_hits(docs: DataFrame, templates: Sequence[Template], k: int = K, text: str = "text",
              doc_id: str = "doc_id") -> DataFrame:
    """Per document one row without template (it carries the word count) and one per hit."""
    worded = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"),
                         words_of(F.col(text)).alias("words"))
    hashed = worded.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), F.concat(
        F.array(F.lit(None).cast("long")), rolling_hashes(F.col("words"), k)).alias("hashes"))
    grams = hashed.select("rid", "doc_id", "n_words", F.posexplode_outer("hashes").alias("place", "hash"))
    positions = template_positions(docs.sparkSession, templates, k)
    return (grams.join(F.broadcast(positions), "hash", "left")
            .filter("place = 0 or tpl is not null")
            .select("rid", "doc_id", "n_words", "tpl", "tpos", (F.col("place") - 1 - F.col("tpos")).alias("diagonal")))


def vote_spans(hits: DataFrame, templates: Sequence[Template], k: int = K, gap: int = 3,
               least_coverage: float = 0.7) -> DataFrame:
    """Verified spans: rid, tpl, label, exact, start (first word), coverage, accepted.

    Votes of one diagonal are distinct template positions, at most a template's
    length, so the sets that are collected are small whatever a document repeats.
    Spans compete place by place: one group holds a place's templates, no pairs are made.
    """
    sizes = F.array(*[F.lit(max(len(t.text.split()) - k + 1, 1)) for t in templates])
    exact = F.array(*[F.lit(t.exact) for t in templates])
    label = F.array(*[F.lit(t.label) for t in templates])
    telling = F.array(*[F.array(*[F.lit(i) for i in t.telling_positions(k)]).cast("array<int>") for t in templates])
    of = lambda values: F.get(values, F.col("tpl"))
    votes = (hits.filter("tpl is not null").groupBy("rid", "tpl", "diagonal")
             .agg(F.collect_set("tpos").alias("seen")))
    along = Window.partitionBy("rid", "tpl").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > gap) | F.lag("diagonal").over(along).isNull()
    islands = votes.withColumn("island", F.sum(F.when(of(exact) | apart, 1).otherwise(0)).over(
        along.rowsBetween(Window.unboundedPreceding, 0)))
    members = islands.select("rid", "tpl", "island", "diagonal", F.explode("seen").alias("tpos"))
    told = F.when(F.array_contains(of(telling), F.col("tpos")), F.col("tpos"))
    spans = (members.groupBy("rid", "tpl", "island")
             .agg(F.count_distinct("tpos").alias("covered"), F.count_distinct(told).alias("told"),
                  F.min(F.col("diagonal") + F.col("tpos")).alias("start"))
             .withColumn("coverage", F.col("covered") / of(sizes))
             .withColumn("verified", F.when(of(exact), F.col("coverage") == 1.0).otherwise(
                 (F.col("coverage") >= least_coverage) & (F.col("told") == F.size(of(telling))))))
    rivals = spans.filter(F.col("verified") & ~of(exact)).select("rid", "tpl", "island", "coverage", "covered")
    best = F.max(F.struct("coverage", "covered", -F.col("tpl"), -F.col("island"), "tpos")).alias("best")
    won = (members.join(rivals, ["rid", "tpl", "island"])
           .groupBy("rid", F.col("diagonal") + F.col("tpos")).agg(best)
           .groupBy("rid", (-F.col("best.col3")).alias("tpl"), (-F.col("best.col4")).alias("island"))
           .agg(F.count_distinct("best.tpos").alias("won")))
    holds = F.coalesce(F.col("won") / of(sizes) >= least_coverage, F.lit(False))
    return spans.join(won, ["rid", "tpl", "island"], "left").select(
        "rid", "tpl", of(label).alias("label"), of(exact).alias("exact"), "start", "coverage",
        (F.col("verified") & (of(exact) | holds)).alias("accepted"))


def scan_licenses(docs: DataFrame, phrases: Sequence[Template] = PHRASES, licenses: Sequence[Template] = LICENSES,
                  text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: word count, phrase places, labels and the best coverage.

    Returns doc_id, n_words, n_base, first_word, last_word (of the phrases' places),
    base_labels (of phrases), labels (of phrases and templates), score, and spans:
    the accepted (label, start, coverage).
    """
    for template in phrases:
        if len(template.text.split()) < K:
            raise ValueError(f"a phrase has at least {K} words: {template.text}")
    templates = [*phrases, *licenses]
    # Small beside the texts; as a written table it fixes the row ids and is scanned twice.
    hits = materialize(gram_hits(docs, templates, text=text, doc_id=doc_id), "license-hits")
    spans = vote_spans(hits, templates)
    place = F.col("exact") & F.col("accepted")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_doc = spans.groupBy("rid").agg(
        F.sum(place.cast("long")).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(place, F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("accepted"), F.col("label"))).alias("labels"),
        F.max(F.when(~F.col("exact") | F.col("accepted"), F.col("coverage"))).alias("score"),
        F.collect_set(F.when(F.col("accepted"), F.struct("label", "start", "coverage"))).alias("spans"))
    docs_only = hits.filter("tpl is null").select("rid", "doc_id", "n_words")
    return docs_only.join(by_doc, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
