"""License scans by diagonal voting, in DataFrame operations only.

Every rolling k-gram of every text is hashed and joined to the positions of the same k-grams in the templates; a second
hash, of the words themselves, must agree too. Hits that keep the same offset between text and template lie on one
diagonal; their counts are votes. Neighbouring diagonals, as an inserted or dropped word makes them, are merged into one
span, which is verified: it must cover enough of the template, or hold a long passage of it nearly whole.

Templates are the texts in ``license_texts``, whose file names begin with the label, and the usual short statements, made
by rule from names of licenses.
"""

from __future__ import annotations

from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.llm.text import named

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 5
#: Diagonals that are at most so many words apart are one span.
MERGE_WORDS = 8
#: A span is verified if it has this share of the template's k-grams, or so many, in at most so many words for each.
MIN_COVERAGE = 0.5
MIN_VOTES, MOST_WORDS = 40, 1.5
#: k-grams that templates may have, as they are broadcast.
MOST_GRAMS = 1_000_000

# Phrases, and the names and wordings that short statements are made of, with the labels they stand for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NAMES = {
    "mit": ("MIT",),
    "apache": ("Apache",),
    "bsd": ("BSD",),
    "isc": ("ISC",),
    "mpl": ("Mozilla Public",),
    "gpl": ("GNU General Public",),
    "lgpl": ("GNU Lesser General Public",),
    "agpl": ("GNU Affero General Public",),
}
STATEMENTS = ("{} under the {} License", "{} under the terms of the {} License")
VERBS = ("licensed", "released", "distributed", "available", "published", "provided")
COMMONS = ("Attribution", "Attribution-ShareAlike", "Attribution-NonCommercial", "Attribution-NoDerivatives", "Attribution-NonCommercial-ShareAlike", "Attribution-NonCommercial-NoDerivatives")
COMMONS_SHORT = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
COMMONS_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
NOTICES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain "
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
    ),
    "mit": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
}


def statements() -> dict[str, tuple[str, ...]]:
    """The usual short statements: a verb, a form and a name; and the six Creative Commons licenses in their versions."""
    out = {label: tuple(form.format(verb, name) for form in STATEMENTS for verb in VERBS for name in names) for label, names in NAMES.items()}
    long = [f"under {article} Creative Commons {name} {version}" for article in ("a", "the") for name in COMMONS for version in COMMONS_VERSIONS]
    return out | {"cc": (*long, *[f"under CC {name} {version}" for name in COMMONS_SHORT for version in COMMONS_VERSIONS])}


def license_texts() -> dict[str, tuple[str, ...]]:
    """The whole licenses in the files beside this module."""
    out: dict[str, tuple[str, ...]] = {}
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        label = file.stem.split("-")[0]
        out[label] = (*out.get(label, ()), file.read_text(encoding="utf-8"))
    return out


@cache
def templates() -> dict[str, tuple[str, ...]]:
    found = license_texts(), NOTICES, statements()
    return {label: tuple(text for each in found for text in each.get(label, ())) for label in sorted({label for each in found for label in each})}


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_array(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _hashes(words: str) -> Column:
    return F.transform(F.col(words), lambda w: F.xxhash64(w))


def _grams(words: str, size: int, *more: Column) -> Column:
    """The k-grams of an array column: hash of the words' ``hashes``, hash of the words, and further fields."""
    starts = F.sequence(F.lit(0), F.size(words) - size)

    def gram(k: Column) -> Column:
        at = [k + i for i in range(size)]
        return F.struct(F.xxhash64(*[F.get(F.col("hashes"), i) for i in at]).alias("gram"), F.hash(*[F.get(F.col(words), i) for i in at]).alias("check"), *more)

    rolled = F.transform(starts, gram)
    return F.when(F.size(words) >= size, rolled).otherwise(F.filter(F.array(gram(F.lit(0))), lambda _: F.lit(False)))


def template_grams(spark: SparkSession, listed: dict[str, tuple[str, ...]], size: int) -> DataFrame:
    """(known, known_check, passage, label, at, passage_grams). As large as the templates, which are a parameter."""
    if sum(len(text.split()) for texts in listed.values() for text in texts) > MOST_GRAMS:
        raise ValueError(f"templates have more than {MOST_GRAMS} words")
    rows = [(k, label, text) for k, (label, text) in enumerate((label, text) for label, texts in listed.items() for text in texts)]
    frame = spark.createDataFrame(rows, "passage int, label string, text string")
    frame = frame.withColumn("words", word_array(F.translate("text", _UPPER, _UPPER.lower())))
    # A passage shorter than a k-gram can't be found by one.
    frame = frame.where(F.size("words") >= size).withColumn("hashes", _hashes("words"))
    flat = frame.select("passage", "label", (F.size("words") - size + 1).alias("passage_grams"), F.posexplode(_grams("words", size)).alias("at", "x"))
    return flat.select(F.col("x.gram").alias("known"), F.col("x.check").alias("known_check"), "passage", "label", "at", "passage_grams")


def _stands(words: str, parts: list[str]):
    """Whether the parts stand one after another from a place on."""
    return lambda place: reduce(lambda a, b: a & b, [F.get(F.col(words), place + i) == part for i, part in enumerate(parts)])


def _phrase_places(words: str, lowered: str) -> dict[str, Column]:
    """Per phrase the places where its words stand one after another. Texts without its last word are not walked."""
    out = {}
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        walk = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), _stands(words, parts))
        there = F.col(lowered).contains(parts[0]) & F.col(lowered).contains(parts[-1]) & (F.size(words) >= len(parts))
        out[label] = F.when(there, walk).otherwise(F.array().cast("array<int>"))
    return out


def scan(docs: DataFrame, listed: dict[str, tuple[str, ...]] | None = None, size: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the best span, for each row.

    Null and empty texts have no words, no labels ('') and score 0. score is the share of a template passage that the
    best verified span covers, and at least 0.5 where there is one or a phrase stands. Rows that repeat are scanned each
    on its own. Texts are walked once: each row of the exploded table is a k-gram and nothing else of its text, but for
    one per text, at 0, that has no k-gram and carries its base columns. Work is in proportion to a text's length.
    """
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    base = named(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), lowered.alias("lowered"))
    # One-row generators, so that words and hashes are made once and not wherever they are used.
    base = base.select("row", "doc_id", "lowered", F.explode(F.array(word_array(F.col("lowered")))).alias("words"))
    places = _phrase_places("words", "lowered")
    labels = F.concat_ws(",", F.array_sort(F.array_compact(F.array(*[F.when(F.size(p) > 0, label) for label, p in places.items()]))))
    info = F.struct("doc_id", F.size("words").cast("bigint").alias("n_words"), F.concat(*places.values()).alias("starts"), labels.alias("base_labels"))
    base = base.select("row", "words", F.explode(F.array(F.struct(_hashes("words").alias("hashes"), info.alias("base")))).alias("x")).select("row", "words", "x.hashes", "x.base")
    head = F.struct(F.lit(None).cast("bigint").alias("gram"), F.lit(None).cast("int").alias("check"), F.col("base").alias("base"))
    nothing = F.when(F.lit(False), F.col("base")).alias("base")
    rows = base.select("row", F.posexplode(F.concat(F.array(head), _grams("words", size, nothing))).alias("place", "x")).select("row", "place", "x.gram", "x.check", "x.base")
    known = template_grams(docs.sparkSession, templates() if listed is None else listed, size)
    # Which hits are of the same words is looked at after the join, as texts without any must stay.
    hits = rows.join(F.broadcast(known), F.col("gram") == F.col("known"), "left").where((F.col("place") == 0) | (F.col("check") == F.col("known_check")))
    flat = hits.select(
        "row",
        "passage",
        "base",
        "label",
        "passage_grams",
        "at",
        (F.col("place") - 1 - F.col("at")).alias("diagonal"),
        (F.col("place") - 1).alias("start"),
    )
    diagonals = flat.groupBy("row", "passage", "diagonal").agg(
        F.first("base", ignorenulls=True).alias("base"),
        F.first("label").alias("label"),
        F.first("passage_grams").alias("passage_grams"),
        F.collect_set("at").alias("covered"),
        F.count("at").alias("votes"),
        F.min("start").alias("begins"),
        F.max("start").alias("ends"),
    )
    in_order = Window.partitionBy("row", "passage").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > MERGE_WORDS, F.lit(True))
    merged = diagonals.withColumn("new", apart.cast("int")).withColumn("span", F.sum("new").over(in_order))
    spans = merged.groupBy("row", "passage", "span").agg(
        F.first("base", ignorenulls=True).alias("base"),
        F.first("label").alias("label"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("covered")))) / F.first("passage_grams")).alias("coverage"),
        F.sum("votes").alias("votes"),
        F.min("begins").alias("begins"),
        (F.max("ends") + size).alias("ends"),
    )
    long = (F.col("votes") >= MIN_VOTES) & (F.col("ends") - F.col("begins") <= MOST_WORDS * F.col("votes"))
    verified = (F.col("coverage") >= MIN_COVERAGE) | long
    best = F.max(F.when(verified, F.struct("coverage", "label", "begins", "ends")))
    per_text = spans.groupBy("row").agg(F.first("base", ignorenulls=True).alias("base"), F.collect_set(F.when(verified, F.col("label"))).alias("found"), best.alias("best"))
    n_base = F.size("base.starts").cast("bigint")
    base_list = F.array_remove(F.split("base.base_labels", ","), "")
    return per_text.select(
        "base.doc_id",
        "base.n_words",
        n_base.alias("n_base"),
        F.array_min("base.starts").cast("bigint").alias("first_word"),
        F.array_max("base.starts").cast("bigint").alias("last_word"),
        "base.base_labels",
        F.concat_ws(",", F.array_sort(F.array_union(base_list, F.col("found")))).alias("labels"),
        F.greatest(F.coalesce(F.col("best.coverage"), F.lit(0.0)), F.when((n_base > 0) | F.col("best").isNotNull(), 0.5).otherwise(0.0)).alias("score"),
        F.col("best.begins").cast("bigint").alias("span_begins"),
        F.col("best.ends").cast("bigint").alias("span_ends"),
    )
