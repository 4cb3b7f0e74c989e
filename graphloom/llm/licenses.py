"""Licence scans: a trained paragraph classifier, in DataFrame operations.

Paragraphs are scored by logistic regression over word one- and two-grams, one
class for each family and one for *unknown*. A line that does not end a sentence
goes on in the next, so wrapped text is read as it was written. The weights are
fitted on the driver from the templates below and look-alikes; the temperature
and the acceptance threshold come from other sentences of the same families and
other look-alikes. In Spark the weights are one small table that the grams are
joined to. A family is confirmed only if the paragraph also shares enough grams
with a template of it.

Paragraphs that cannot be confirmed are not scored: a confirmed one holds most
word pairs of a template, so it holds one of any words that touch the others;
``cues`` picks such words.
"""

from __future__ import annotations

import json
import random
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentences by which each family is recognised.
TEMPLATES = {
    "agpl": (
        "licensed under the gnu affero general public license version 3",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        "you must offer all users interacting with it remotely through a computer network an opportunity to receive the corresponding source",
    ),
    "apache": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
    ),
    "bsd": (
        "released under the bsd 3 clause license",
        "licensed under the bsd 2 clause simplified license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "cc-by": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "available under the cc by license"),
    "cc-by-nc": (
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "shared under cc by nc for noncommercial use only",
    ),
    "cc-by-sa": ("licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license", "text is available under the creative commons attribution sharealike license"),
    "cc0": ("released into the public domain under cc0 1 0", "dedicated to the public domain under the creative commons zero waiver", "to the extent possible under law the author has waived all copyright and related rights"),
    "epl": ("licensed under the eclipse public license version 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "isc": ("released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("licensed under the gnu lesser general public license version 3", "under the terms of the gnu lgpl", "this library is free software under the gnu lesser general public license"),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"),
    "proprietary": ("all rights reserved", "proprietary and confidential unauthorized copying of this file is strictly prohibited", "no part of this document may be reproduced without prior written permission"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"),
}
#: Other sentences of the families, for calibration only.
CALIBRATION = {
    "agpl": ("this service is distributed under the gnu affero general public license v3",),
    "apache": ("this project is licensed under the terms of the apache license version 2 0", "see the license for the specific language governing permissions under the apache license"),
    "bsd": ("this code is distributed under the bsd 3 clause license", "use in source and binary forms with or without modification are permitted"),
    "cc-by": ("the photo is licensed under a creative commons attribution 4 0 license", "published under cc by 4 0"),
    "cc-by-nc": ("the text is under a creative commons attribution noncommercial license", "published under cc by nc 4 0"),
    "cc-by-sa": ("content is licensed under creative commons attribution sharealike", "published under cc by sa 4 0"),
    "cc0": ("placed in the public domain under creative commons zero", "data released under cc0 1 0"),
    "epl": ("the plugin is available under the eclipse public license 2 0",),
    "gpl": ("the tool is free software under the terms of the gnu general public license", "licensed under the gnu general public license version 2"),
    "isc": ("the package is distributed under the isc license",),
    "lgpl": ("the library is licensed under the gnu lesser general public license",),
    "mit": ("this project is licensed under the mit license", "permission is hereby granted free of charge to any person"),
    "mpl": ("the file is under the terms of the mozilla public license 2 0",),
    "proprietary": ("copyright acme all rights reserved", "confidential and proprietary unauthorized copying is prohibited"),
    "unlicense": ("free and unencumbered software released into the public domain",),
}
UNKNOWN = "unknown"
CLASSES = (*TEMPLATES, UNKNOWN)
#: Look-alikes that belong to no family: for training, and for calibration.
INNOCENT = (
    "you need a driving license to rent a car here", "the licensed premises close at ten tonight", "copyright law is taught on mondays",
    "ask for permission before you enter the garden", "the fishing licence costs twelve a year", "his license plate was found near the river",
    "permission to land was granted at noon", "she lost her nursing license last spring", "a poetic licence is never revoked",
    "the data were redistributed among the shards", "proprietary sauces are sold by the kitchen", "the gpl is debated in the public library",
    "version 2 0 of the software was released under pressure", "the public domain of the park is open", "no license was mentioned in the general terms",
    "the eclipse was seen by the public at noon", "free of charge for any person under twelve", "the apache people lived in the mountains", "all rights come with duties and all seats are reserved",
    "the software was written in the library and the source of the river is north", "terms and conditions of the sale are printed on the form", "you may use the file to open the door",
)
INNOCENT_CALIBRATION = (
    "the bar has a license to sell wine", "with your permission we will copy the letter by hand", "the public may enter the domain of the king for free",
    "the source of the law is the general will", "he published a work on the commons of england", "this program of the theatre starts at eight", "the rights of the child are reserved for a later chapter",
    "a copy of the notice hangs in the hall", "mozilla and apache are names of projects", "the new version is free for everyone", "distribution of the mail is done by noon", "her driving licence expired in may",
)
#: Share of look-alikes that may pass as a family on the calibration draw.
FALSE_SHARE = 0.005
#: Share of a template's word pairs that a confirmed paragraph holds. Sentences of
#: more than ``LONG`` words are compared in pieces, so that a part of one suffices.
TEMPLATE_SHARE = 0.6
LONG, PIECE = 12, 10
#: Words of prose, which make poor cues.
COMMON = frozenset("a all an and any are as be by for from has in into is it its law made may must not of on only or part see shall should such that the this to under use used with you your work name above text".split())


def _grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _draw(seed: int, families: dict, innocent: tuple, each: int = 40) -> list[tuple[list[str], int]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["on", "er", "the", "ti", "la", "en", "es", "an", "or", "is", "ed", "und", "que"]) for _ in range(r.randint(1, 4)))
    out = []

    def bent(sentence: str) -> list[str]:
        words = sentence.split()
        if len(words) > 12:
            n = r.randint(8, len(words))
            at = r.randint(0, len(words) - n)
            words = words[at : at + n]
        words = [w for w in words if len(words) < 8 or r.random() > 0.06]
        before, after = ([word() for _ in range(r.choice([0, 0, 1, 3, 12]))] for _ in range(2))
        return before + words + after

    for c, family in enumerate(CLASSES):
        for _ in range(each * (6 if family == UNKNOWN else 1)):
            out.append((bent(r.choice(innocent if family == UNKNOWN else families[family])), c))
    return out


@lru_cache(maxsize=1)
def fit() -> tuple[dict[str, np.ndarray], np.ndarray, float, float]:
    """(gram weights, intercepts, temperature, least probability)."""
    train, check = _draw(1, TEMPLATES, INNOCENT), _draw(2, CALIBRATION, INNOCENT_CALIBRATION)
    known = Counter(g for words, _ in train for g in _grams(words))
    vocab = {g: i for i, g in enumerate(sorted(g for g, n in known.items() if n >= 3))}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocab)))
        for i, (words, _) in enumerate(rows):
            for g in _grams(words):
                if g in vocab:
                    x[i, vocab[g]] = 1
        return x

    x, y = matrix(train), np.array([c for _, c in train])
    w, b = np.zeros((len(vocab), len(CLASSES))), np.zeros(len(CLASSES))
    target = np.eye(len(CLASSES))[y]
    for _ in range(300):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) / len(y)
        w -= 2.0 * (x.T @ g + 1e-4 * w)
        b -= 2.0 * g.sum(0)
    z, truth = matrix(check) @ w + b, np.array([c for _, c in check])

    def loss(t):
        q = z / t
        q = q - q.max(1, keepdims=True)
        return -(q[np.arange(len(truth)), truth] - np.log(np.exp(q).sum(1))).mean()

    temperature = min(np.linspace(0.2, 3, 57), key=loss)
    q = np.exp((z - z.max(1, keepdims=True)) / temperature)
    q = (q / q.sum(1, keepdims=True))[:, :-1].max(1)
    false = np.sort(q[truth == len(CLASSES) - 1])
    least = max(0.5, float(false[int(np.ceil(len(false) * (1 - FALSE_SHARE))) - 1]))
    return {g: w[i] for g, i in vocab.items()}, b, float(temperature), least


def weights_table(spark: SparkSession) -> DataFrame:
    """``(gram, w0, w1, ...)``: a few hundred rows, from one literal."""
    weights, _, _, _ = fit()
    data = json.dumps([{"gram": g, "w": list(map(float, w))} for g, w in weights.items()])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(data), "array<struct<gram:string,w:array<double>>>")).alias("r"))
    return rows.select("r.gram", *[F.get("r.w", i).alias(f"w{i}") for i in range(len(CLASSES))])


def _pairs(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} & set(fit()[0]))


@lru_cache(maxsize=1)
def pieces() -> dict[str, list[list[str]]]:
    """The word pairs of each piece of each family's templates."""
    out: dict[str, list[list[str]]] = {}
    for family, sentences in TEMPLATES.items():
        for words in map(str.split, sentences):
            starts = [0] if len(words) <= LONG else sorted({*range(0, len(words) - PIECE, PIECE // 2), len(words) - PIECE})
            size = len(words) if len(words) <= LONG else PIECE
            out.setdefault(family, []).extend(p for i in starts if (p := _pairs(words[i : i + size])))
    return out


@lru_cache(maxsize=1)
def cues() -> tuple[str, ...]:
    """Words of which every paragraph that is confirmed holds at least one.

    Those of a piece touch more of its pairs than a confirmed paragraph may lack.
    """
    chosen: set[str] = set()
    for piece in sorted((p for some in pieces().values() for p in some), key=len):
        touched = lambda word=None: sum(bool({*chosen, word} & set(p.split())) for p in piece)  # noqa: E731, B023
        while touched() <= (1 - TEMPLATE_SHARE) * len(piece):
            rest = sorted({w for p in piece for w in p.split()} - chosen)
            chosen.add(max(rest, key=lambda w: (touched(w) > touched(), w not in COMMON, len(w) >= 5, touched(w), len(w), w)))
    return tuple(sorted(chosen))


def _has_cue(low: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(c)) for c in cues()))


def _paragraphs(low: Column) -> Column:
    """Lines, each joined to the one before it unless that ends a sentence or is blank."""
    return F.split(F.regexp_replace(low, r"([^.!?:;\s])[ \t]*\r?\n(?=[ \t]*+[^\s])", "$1 "), r"\r?\n", -1)


def _words(low: Column) -> Column:
    return F.array_remove(F.split(low, r"[^\p{L}\p{N}]+"), "")


def classify_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, paragraph, family, probability, template, confirmed)`` of candidates.

    Candidates are the paragraphs that hold a cue. ``paragraph`` counts them from 0
    and ``template`` is the share of grams in common with the nearest template of
    the predicted family. Families below the calibrated probability are
    ``unknown`` and never confirmed. Null and empty texts have none, nor has a
    null key; equal paragraphs of equal place under one key count once. Extra
    columns are ignored, whatever their names; an empty table gives no row.
    """
    _, intercepts, temperature, least = fit()
    low = docs.select(F.col(f"`{key}`").alias("key"), F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("low")).where("key is not null")
    lines = (
        low.where(_has_cue(F.col("low")))
        .select("key", F.posexplode(_paragraphs(F.col("low"))).alias("paragraph", "line"))
        .where(_has_cue(F.col("line")))
        .distinct()
    )
    words = lines.select("key", "paragraph", "line", _words(F.col("line")).alias("w"))
    two = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    grams = words.select("key", "paragraph", "line", F.explode_outer(F.array_distinct(F.concat("w", two))).alias("gram"))
    n = len(CLASSES)
    joined = grams.join(F.broadcast(weights_table(docs.sparkSession)), "gram", "left")  # the table is part of the code
    summed = joined.groupBy("key", "paragraph", "line").agg(
        *[(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)) + float(intercepts[i])).alias(f"z{i}") for i in range(n)],
        F.collect_set(F.when(F.col("w0").isNotNull(), F.col("gram"))).alias("grams"),
    )
    top = F.greatest(*[F.col(f"z{i}") for i in range(n)])
    total = sum((F.exp((F.col(f"z{i}") - top) / temperature) for i in range(n)), F.lit(0.0))
    best = F.greatest(*[F.struct(F.col(f"z{i}").alias("z"), F.lit(c).alias("c")) for i, c in enumerate(CLASSES[:-1])])
    prob = F.exp((best["z"] - top) / temperature) / total
    near = F.lit(0.0)
    for family, some in pieces().items():
        shares = [F.size(F.array_intersect("grams", F.array(*map(F.lit, p)))) / len(p) for p in some]
        near = F.when(F.col("family") == family, F.greatest(*shares) if len(shares) > 1 else shares[0]).otherwise(near)
    out = summed.select("key", "paragraph", "grams", F.when(prob >= least, best["c"]).otherwise(F.lit(UNKNOWN)).alias("family"), prob.alias("probability"))
    out = out.withColumn("template", near)
    return out.select(
        F.col("key").alias(key), "paragraph", "family", "probability", "template",
        ((F.col("family") != UNKNOWN) & (F.col("template") >= TEMPLATE_SHARE)).alias("confirmed"),
    )


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_candidates, n_confirmed, families, probability)`` for every row.

    ``families`` are the confirmed ones, sorted and comma-joined (empty: none);
    ``probability`` is that of the surest candidate, 0 without one. Null and
    empty texts have no candidate. Rows of equal key count as one document whose
    equal lines at equal places count once; a null key has no candidate.
    """
    found = classify_paragraphs(docs, key, text).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.max("probability").alias("probability"),
    )
    out = docs.select(key).join(found, key, "left")
    return out.select(
        key,
        F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
    )
