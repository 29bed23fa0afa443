r"""License scans by a positional index of rare tokens.

Every license template is a row of words. Counted over all texts, its rarest
words (those of highest inverse document frequency) go into an index: word ->
(template, position). A text looks up those of its words that the index holds;
each hit says where the template would begin, and hits of one template that
agree on the beginning are intersected. Half of a template's rare words in
place make a candidate, which is taken if each of the template's mandatory
phrases stands where the template has it, give or take ``SLACK`` words (a
name put in between moves what follows). Beside the templates, short base
phrases label a text wherever their words stand consecutively.

One pass counts the template words' documents (at most one number per
template word reaches the driver); the other does all the rest inside the row,
with DataFrame functions: hits are sorted by template and beginning, and runs
of equal ones counted, n log n in the hits of a text. Nothing is shuffled or
joined, so no text or word is hot; the index is as large as the templates.

Words are maximal runs of characters other than ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``
after lower-casing A-Z. Inverse document frequency falls as the number of
documents grows, so words are ranked by that number, ties by code point; words
of no document come first.

Defined results: a null text counts as empty (no words, no labels, score 0);
repeated rows are judged alike, row by row, and each counts as a document;
empty tables give empty results; long texts are read whole. Other columns are
passed through in ``row``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mkpulse.llm.common import bind, packed, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words of a template in the index, and how far a mandatory phrase may have moved.
RARE, SLACK = 5, 8

#: Phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A license text or notice, the label it gives, and the phrases of it that a match must hold."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Identifiers of licenses that files name in one line.
SPDX = ("mit", "isc", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "mpl-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "cc-by-4.0",
        "cc-by-sa-4.0", "cc-by-nc-4.0", "cc0-1.0", "unlicense")

#: Usual license notices and the opening terms of license texts, in words.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
             " you may obtain a copy of the license at", ("apache license version 2 0", "except in compliance with the license")),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"
             " basis without warranties or conditions of any kind either express or implied", ("distributed on an as is basis",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
             " the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"
             " that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
             " conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
             " derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software"
             " foundation either version", ("terms of the gnu general public license", "free software foundation")),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free"
             " software foundation either version", ("gnu lesser general public license",)),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free"
             " software foundation either version", ("gnu affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed"
             " with this file you can obtain one at", ("mozilla public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
             ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
             ("creative commons attribution noncommercial",)),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
             ("waived all copyright and related or neighboring rights",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    *(Template(i, f"spdx license identifier {i.replace('-', ' ').replace('.', ' ')}", (f"identifier {i.replace('-', ' ').replace('.', ' ')}",)) for i in SPDX),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def document_counts(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> dict[str, int]:
    """Of each template word: the number of texts that hold it."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    if not vocabulary:
        return {}
    held = F.array_distinct(F.filter(words_of(text_of(F.col(f"`{text}`"))), lambda w: w.isin(vocabulary)))
    found = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()  # at most one row per template word
    return dict.fromkeys(vocabulary, 0) | {r.w: r["count"] for r in found}


def rare_words(counts: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE) -> list[list[str]]:
    """The ``rare`` words of each template that the fewest documents hold."""
    return [sorted(set(t.text.split()), key=lambda w: (counts[w], w))[:rare] for t in templates]


def places(words: list[str], phrase: list[str]) -> list[int]:
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _struct(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _phrase_places(w: Column, hits: Column, phrases: list[str], counts: dict[str, int]) -> Column:
    """(phrase number, start) of every place where a base phrase's words stand consecutively, in order of number and start."""
    def of(n: int, parts: list[str]) -> Column:
        at = min(range(len(parts)), key=lambda i: (counts.get(parts[i], 0), -i))  # looked for by its rarest word
        own = F.filter(hits, lambda h: (h["w"] == parts[at]) & (h["i"] >= at)
                       & (F.slice(w, F.greatest(h["i"] - at + 1, F.lit(1)), len(parts)) == _strings(parts)))
        return F.transform(own, lambda h: _struct(p=F.lit(n), i=h["i"] - at))

    found = [of(n, p.split()) for n, p in enumerate(phrases)]
    return F.concat(*found) if found else F.array().cast("array<struct<p:int,i:int>>")


def _matches(w: Column, hits: Column, templates: tuple[Template, ...], rare: list[list[str]], slack: int) -> Column:
    """(template, start, share of its rare words in place) of every template whose mandatory phrases are there."""
    postings: dict[str, list[Column]] = {}
    for n, (t, words) in enumerate(zip(templates, rare, strict=True)):
        for at, word in enumerate(t.text.split()):
            if word in words:
                postings.setdefault(word, []).append(_struct(t=F.lit(n), at=F.lit(at)))
    if not postings:
        return F.array().cast("array<struct<t:int,o:int,share:double>>")
    index = F.create_map(*[c for word, p in postings.items() for c in (F.lit(word), F.array(*p))])
    # the most places of a template that its rare words can take
    full = F.array(*[F.lit(sum(x in r for x in t.text.split())) for t, r in zip(templates, rare, strict=True)])
    keys = F.array(*[F.array(*[_struct(at=F.lit(at), words=_strings(key.split())) for key in t.keys
                               for at in places(t.text.split(), key.split())[:1]]) for t in templates])
    begins = F.sort_array(F.flatten(F.transform(
        F.filter(hits, lambda h: h["w"].isin(list(postings))),
        lambda h: F.transform(index[h["w"]], lambda p: _struct(t=p["t"], o=h["i"] - p["at"])))))

    def candidates(s: Column) -> Column:
        """Runs of equal (template, beginning) in sorted order."""
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return bind(first, lambda f: F.filter(
            F.transform(f, lambda i, j: _struct(t=F.get(s, i)["t"], o=F.get(s, i)["o"], n=F.coalesce(F.get(f, j + 1), F.size(s)) - i)),
            lambda c: 2 * c["n"] >= F.get(full, c["t"])))

    def there(c: Column, key: Column) -> Column:
        """The phrase's words stand within ``slack`` of their place."""
        begin = c["o"] + key["at"]
        return F.exists(F.sequence(F.lit(-slack), F.lit(slack)),
                        lambda d: (begin + d >= 0) & (F.slice(w, F.greatest(begin + d + 1, F.lit(1)), F.size(key["words"])) == key["words"]))

    taken = bind(begins, lambda s: F.filter(candidates(s), lambda c: F.forall(F.get(keys, c["t"]), lambda key: there(c, key))))
    return F.transform(taken, lambda c: _struct(t=c["t"], o=c["o"], share=F.least(F.lit(1.0), c["n"] / F.get(full, c["t"]))))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None, text: str = "text",
         rare: int = RARE, slack: int = SLACK) -> DataFrame:
    """row, n_words, base (phrase and start of each place), matches (label, start and share of each template found)."""
    for t in templates:
        if not t.keys or any(not places(t.text.split(), k.split()) for k in t.keys):
            raise ValueError(f"template {t.label}: each needs mandatory phrases, and they must stand in its text")
    phrases = PHRASES if phrases is None else phrases
    names = list(phrases)
    counts = document_counts(docs, templates, text)
    seldom = rare_words(counts, templates, rare)
    wanted = sorted({x for p in names for x in p.split()} | {x for r in seldom for x in r})
    labels = _strings([t.label for t in templates])

    def of(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(wanted), _struct(w=x, i=i))), lambda h: h.isNotNull())
        return bind(hits, lambda h: _struct(n_words=F.size(w).cast("long"), base=_phrase_places(w, h, names, counts),
                                            matches=_matches(w, h, templates, seldom, slack)))

    found = packed(docs).select("row", bind(words_of(text_of(F.col(f"row.`{text}`"))), of).alias("found"))
    return found.select(
        "row", "found.n_words",
        F.transform("found.base", lambda b: _struct(phrase=F.get(_strings(names), b["p"]), start=b["i"].cast("long"))).alias("base"),
        F.transform("found.matches", lambda m: _struct(label=F.get(labels, m["t"]), start=m["o"].cast("long"), share=m["share"])).alias("matches"))


def verdicts(found: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """row, n_words, n_base, first_word, last_word, base_labels, labels (distinct, sorted, comma-joined), score (best share of a template; 0: none)."""
    phrases = PHRASES if phrases is None else phrases
    names = F.create_map(*[F.lit(x) for p in phrases.items() for x in p]) if phrases else F.create_map(F.lit(""), F.lit(""))
    base = F.transform("base", lambda b: names[b["phrase"]])
    own = F.transform("matches", lambda m: m["label"])
    starts = F.transform("base", lambda b: b["start"])

    def listed(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    return found.select("row", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(F.concat(base, own)).alias("labels"),
                        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"))
