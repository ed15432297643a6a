"""Licence texts in files through a positional index of rare licence words.

DataFrame functions only.  Each file's index maps the licence words it holds to their positions.
Licence words are ranked by their document frequency over all files: a template is looked up by its
``RARE`` words of highest IDF and by the words of its mandatory key phrases.  Their postings, each shifted by the
word's place in the template, are intersected, so only starts at which every one of them stands in its
relative position stay; key phrases are verified among them word by word.  All of it is
inside the row of the file: nothing but the document frequencies is shuffled.

A base phrase is a template whose words are all mandatory.  ``n_base`` counts every place, ``base_labels`` are
their labels, ``labels`` adds those of the longer templates.  ``score`` is 1 where a template or phrase
is verified, else half of the largest IDF share of a template's rare words that the file holds.

Edge cases: null and empty texts have 0 words, no labels (empty strings), null first and last words and
score 0.  Lower-casing is Unicode's; no character other than A-Z changes a base word by it.  Repeated rows give
repeated results; texts are scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of highest IDF by which a template is looked up.
RARE = 4


@dataclass(frozen=True)
class Template:
    """``text`` in lower case; every phrase of ``keys`` must stand in a match, where the text has it."""

    label: str
    text: str
    keys: tuple[str, ...] = field(default=())
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def mandatory(self) -> dict[int, str]:
        """Place in the template of each word that must be there."""
        words, out = self.words, {}
        for key in [self.text] if self.base else self.keys:
            k = key.split()
            for at in range(len(words) - len(k) + 1):
                if words[at : at + len(k)] == k:
                    out |= dict(enumerate(k, at))
                    break
            else:
                raise ValueError(f"{self.label}: no place for {key!r}")
        return out


BASE = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)

#: Opening words and usual notices of public licences; a file may hold any of a label's.
TEMPLATES = (
    *BASE,
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-notice", "licensed under the gnu general public license", ("gnu general public license",)),
    Template("gpl-program", "you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("distribute this software for any purpose",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
)


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def word_idf(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """IDF of the licence words over all files; at most one row per word reaches the driver."""
    held = F.array_intersect(_words(text), F.array(*[F.lit(w) for w in vocabulary]))
    counts = docs.select(F.explode(F.array_union(held, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    n = found.pop("", 0)
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) + 1e-9 for w in vocabulary}


def _looked_up(template: Template, idf: dict[str, float]) -> dict[int, str]:
    """Places and words whose postings are intersected: mandatory ones and the rarest."""
    ranked = sorted(enumerate(template.words), key=lambda p: (-idf[p[1]], p[0]))
    return dict(sorted((template.mandatory() | dict(ranked[:RARE])).items()))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per file: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and
    ``places``, an array of (label, start)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    idf = word_idf(docs, vocabulary, text)
    looked = {t: _looked_up(t, idf) for t in templates}
    indexed = sorted({w for ws in looked.values() for w in ws.values()})

    rows = docs.select(F.col(id_col).alias("id"), _words(text).alias("words"))
    # The file's index: (word, position) of licence words, in the order of positions.
    marked = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("p")))
    rows = rows.select("id", F.size("words").alias("n_words"), F.filter(marked, lambda s: s["w"].isin(indexed)).alias("index"))

    def shifted(word: str, by: int) -> Column:
        return F.transform(F.filter("index", lambda s: s["w"] == word), lambda s: s["p"] - F.lit(by))

    def starts(template: Template) -> Column:
        found = None
        for at, word in sorted(looked[template].items(), key=lambda p: -idf[p[1]]):
            mine = shifted(word, at)
            found = mine if found is None else F.array_intersect(found, mine)
        return F.array_distinct(found)

    def labelled(label: str, at: Column) -> Column:
        return F.transform(at, lambda p: F.struct(F.lit(label).alias("label"), p.alias("start")))

    held = F.array_distinct(F.transform("index", lambda s: s["w"]))
    empty = F.expr("CAST(array() AS array<struct<label:string,start:int>>)")
    places, base, shares = [], [], []
    for template in templates:
        found = labelled(template.label, starts(template))
        places.append(found)
        if template.base:
            base.append(found)
        words = sorted(set(looked[template].values()))
        total = sum(idf[w] for w in words)
        shares.append(sum((F.when(F.array_contains("held", w), idf[w] / total).otherwise(0.0) for w in words), F.lit(0.0)))
    some = F.size("index") > 0
    rows = rows.withColumn("held", held)
    rows = rows.select(
        "id",
        "n_words",
        F.when(some, F.concat(*places)).otherwise(empty).alias("places"),
        F.when(some, F.concat(*base)).otherwise(empty).alias("base"),
        F.when(some, F.greatest(*shares)).otherwise(F.lit(0.0)).alias("share"),
    )

    def labels(of: str) -> Column:
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"]))))

    first = F.array_min(F.transform("base", lambda s: s["start"])).cast("long")
    last = F.array_max(F.transform("base", lambda s: s["start"])).cast("long")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        first.alias("first_word"),
        last.alias("last_word"),
        labels("base").alias("base_labels"),
        labels("places").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("share") * 0.5).alias("score"),
        "places",
    )
