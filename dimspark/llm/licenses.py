"""License scans by diagonal voting.

One pass over a text hashes all its rolling three-word grams and keeps those whose hash a template
has; they are joined by hash, then word by word, with their positions in templates. A match votes
for a diagonal, the difference of both positions; neighbouring diagonals (words put in or left
out) are merged, and a merged span is verified by aligning its matches: the share of the
template's grams that follow each other in the same order in a stretch not much longer than the
template, each counted once. Short templates, whose grams an edit of one word can break all, are also looked for
word by word around a word that tells them from others; such spans have no share. The base phrases are templates of one gram; "cc by" is a gram of two words.

DataFrame functions only; the templates are a constant of this module (or the caller's
argument) and are broadcast. Hot passages meet no shuffle before they are counted.

Defined results: a null text is an empty one, without words; a text of one word has no
grams; an empty table gives no rows; rows that agree in doc_id and text share one result;
only doc_id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimspark.llm.common import read_table, settle, text_key

#: Words, once A-Z are in lower case: runs of digits, small letters and whatever is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same pattern with each character named, which the regular expressions of the JVM look up in a table.
WORD_NAMED = "[^" + "".join(rf"\x{c:02X}" for c in range(128) if not (chr(c).isdigit() or chr(c).islower())) + "]+"
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Label and wording of license statements, fixed values.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the BSD License"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution"),
    ("public-domain", "dedicated to the public domain"),
)
SLACK, LEAST_SHARE, MOST_STRETCH = 2, 0.75, 1.5
#: Templates of up to so many grams differ from each other by a word or two: all their grams must be there,
#: or, with words put in, left out or changed, those of the words below that tell them from others.
SHORT_GRAMS = 9
#: Label: the words without which a short template is not meant. The rarest comes first.
TELLING: dict[str, tuple[str, ...]] = {
    "mit": ("mit",), "apache-2.0": ("apache", "2"), "bsd": ("bsd",), "gpl-3.0": ("gnu", "general", "3"), "gpl-2.0": ("gnu", "general", "2"), "lgpl": ("lesser",),
    "cc-by-4.0": ("cc", "by", "4"), "cc-by-nc-4.0": ("cc", "by", "nc", "4"), "cc-by-sa-4.0": ("cc", "by", "sa", "4"), "cc-by": ("creative", "commons", "attribution"), "public-domain": ("domain", "public"),
}
#: Words that make another license of one that does not have them.
OTHERS = ("lesser", "library", "affero", "nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike")


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def _gram_hash(a: Column, b: Column, c: Column) -> Column:
    return F.when((a == "cc") & (b == "by"), F.xxhash64(a, b)).otherwise(F.xxhash64(a, b, c))


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(t_hash, a, b, c, template, label, place, grams, words, base): a row for each gram of each template."""
    rows = []
    listed = [(label, text, True) for label, text in BASE.items()] + [(label, text, False) for label, text in templates]
    for number, (label, text, base) in enumerate(listed):
        w = words_of(text)
        if base:
            grams = [(0, (w + [None])[:3])]
        else:
            grams = [(i, w[i : i + 3] if w[i : i + 2] != ["cc", "by"] else ["cc", "by", None]) for i in range(len(w) - 2)]
        rows += [(*g, number, label, i, len(grams), len(w), base) for i, g in grams]
    made = spark.createDataFrame(rows, "a string, b string, c string, template int, label string, place int, grams int, words int, base boolean")
    return made.withColumn("t_hash", _gram_hash(F.col("a"), F.col("b"), F.col("c")))


def lower_ascii(text: Column) -> Column:
    """A text with A-Z, and no other letters, in lower case; the fast function where a text has no others."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))


def short_templates(templates) -> list[tuple]:
    """(anchor, label, words, the anchor's place, places of telling words, words of others) of each short template."""
    short = []
    for label, text in templates:
        words = words_of(text)
        tell = TELLING.get(label, ())
        if len(words) - 2 <= SHORT_GRAMS and tell and set(tell) <= set(words):
            short.append((tell[0], label, words, words.index(tell[0]), [words.index(x) for x in tell], [x for x in OTHERS if x not in words]))
    return short


def match_words(docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, n_words, hits (grams whose hash a template has) and near (windows around telling words) of each row."""
    known = [r["t_hash"] for r in template_grams(docs.sparkSession, templates).select("t_hash").distinct().collect()]
    short = short_templates(templates)
    before = max((x[3] for x in short), default=0) + SLACK
    width = before + max((len(x[2]) for x in short), default=0) + SLACK
    worded = docs.select(F.col(doc_id).alias("doc_id"), text_key(doc_id, text).alias("key"), F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD_NAMED), F.lit(0)).alias("w"))
    w = lambda i: F.get("w", i)
    gram = lambda i: F.xxhash64(w(i), w(i + 1), w(i + 2)).isin(known) | ((w(i) == "cc") & (w(i + 1) == "by"))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 2), gram)
    hits = F.when(F.size("w") > 1, F.transform(places, lambda i: F.struct(i.alias("pos"), w(i).alias("x"), w(i + 1).alias("y"), w(i + 2).alias("z"))))
    begin = lambda i: F.greatest(i - before, F.lit(0))
    anchors = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: w(i).isin(sorted({x[0] for x in short})))
    near = F.when(F.size("w") > 0, F.transform(anchors, lambda i: F.struct(i.alias("pos"), begin(i).alias("begin"), F.slice("w", begin(i) + 1, width).alias("v"))))
    return worded.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), hits.alias("hits"), near.alias("near"))


def edited_spans(matched: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(key, label, first, last): short templates with a share of LEAST_SHARE of their words, each within SLACK of its place.

    Places are counted from a template's first telling word. All telling words must be there, and
    between the first and last word no word of OTHERS that the template does not have.
    """
    short = short_templates(templates)
    known = F.broadcast(matched.sparkSession.createDataFrame(short, "anchor string, label string, t array<string>, place int, tell array<int>, others array<string>"))
    at = matched.select("key", F.explode("near").alias("n")).select("key", "n.pos", F.col("n.begin").alias("base"), F.col("n.v").alias("v"))
    begin = F.greatest(F.col("pos") - F.col("place") - SLACK, F.lit(0))
    window = F.slice("v", begin - F.col("base") + 1, F.col("pos") - F.col("place") + F.size("t") + SLACK - begin)
    near = at.join(known, F.get("v", F.col("pos") - F.col("base")) == F.col("anchor")).select("key", "label", "t", "tell", "others", begin.alias("begin"), (F.col("pos") - F.col("place")).alias("diagonal"), window.alias("v"))
    hits = F.expr(f"transform(sequence(0, size(t) - 1), i -> filter(sequence(0, size(v) - 1), j -> v[j] = t[i] and abs(begin + j - diagonal - i) <= {SLACK}))")
    near = near.withColumn("hits", hits).withColumns({"held": F.expr("size(filter(hits, h -> size(h) > 0))"), "low": F.expr("array_min(transform(hits, h -> array_min(h)))"), "high": F.expr("array_max(transform(hits, h -> array_max(h)))")})
    good = (F.col("held") >= LEAST_SHARE * F.size("t")) & F.expr("forall(tell, i -> size(hits[i]) > 0)") & F.expr("not arrays_overlap(slice(v, low + 1, high - low + 1), others)")
    return near.where(good).select("key", "label", (F.col("begin") + F.col("low")).alias("first"), (F.col("begin") + F.col("high")).alias("last"))


def spans_of(matched: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(key, label, base, first, last, share, verified): merged and verified spans of `match_words`, positions in words."""
    grams = matched.select("key", F.explode("hits").alias("h")).select("key", "h.*").withColumn("hash", _gram_hash(F.col("x"), F.col("y"), F.col("z")))
    known = F.broadcast(template_grams(matched.sparkSession, templates))
    same = (F.col("hash") == F.col("t_hash")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")) & (F.col("c").isNull() | (F.col("z") == F.col("c")))
    votes = grams.join(known, same).groupBy("key", "template", "label", "base", "grams", "words", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    step = F.expr("diagonal - lag(diagonal) over (partition by key, template order by diagonal)")
    fresh = F.when(F.col("base") | step.isNull() | (step > SLACK), 1).otherwise(0)
    chained = votes.withColumn("fresh", fresh).withColumn("span", F.expr("sum(fresh) over (partition by key, template order by diagonal rows between unbounded preceding and current row)"))
    matches = F.collect_list(F.transform("places", lambda p: F.struct(p.alias("place"), (p + F.col("diagonal")).alias("pos"))))
    merged = chained.groupBy("key", "template", "label", "base", "grams", "words", "span").agg(F.array_sort(F.flatten(matches)).alias("m"))
    ordered = "aggregate(m, struct(-1 as place, -1 as pos, 0 as n), (a, x) -> if(x.place > a.place and x.pos > a.pos, struct(x.place as place, x.pos as pos, a.n + 1 as n), a), a -> a.n)"
    merged = merged.withColumns({"first": F.expr("array_min(m.pos)"), "last": F.expr("array_max(m.pos)"), "share": F.expr(f"{ordered} / grams")})
    fits = (F.col("last") - F.col("first") + 3) <= F.col("words") * MOST_STRETCH + SLACK
    enough = F.col("share") >= F.when(F.col("grams") <= SHORT_GRAMS, 1.0).otherwise(LEAST_SHARE)
    spans = merged.select("key", "label", "base", "first", "last", "share", (F.col("base") | (enough & fits)).alias("verified"))
    edited = edited_spans(matched, templates).select("key", "label", F.lit(False).alias("base"), "first", "last", F.lit(None).cast("double").alias("share"), F.lit(True).alias("verified"))
    return spans.unionByName(edited)


def find_spans(docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return spans_of(match_words(docs, templates, doc_id, text), templates)


def scan(docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    matched = settle(match_words(docs, templates, doc_id, text))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = spans_of(matched, templates).groupBy("key").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("verified")).alias("labels"), F.max("share").alias("score"),
    )
    return matched.select("doc_id", "key", "n_words").join(settle(found), "key", "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
