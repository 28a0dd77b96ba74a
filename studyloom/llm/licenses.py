"""License notices by MinHash bands over text windows, verified by exact shingle containment.

Templates are grouped by length. A text is cut, per group, into overlapping windows long enough that every stretch of a template's length lies whole in one.
A window that holds a template has at least a known Jaccard similarity with it, and the number of one-row bands is chosen so that the
chance to share none is below a bound; so a window and a template that meet in a band are a candidate. Candidates are verified: the share of the
template's word 5-grams in the window must be three quarters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows
from .jaccard import mix, ngram_hashes, ngrams, word_hashes

#: Shingle length, containment, and the notices looked for (public license texts and their usual short forms).
NGRAM, NUM, DEN = 5, 75, 100
TEMPLATES = {
    "mit-short": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
           "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case; punctuation inside a word stays, at its ends it does not."""
    return [w.encode() for w in WORD.findall((text or "").lower())]


def bands_needed(similarity: float, miss: float) -> int:
    """How many bands of one row make the chance to share none at this similarity at most ``miss``."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity))


@dataclass
class Group:
    """Templates of like length: shingle length, window and step in shingles, a seed per band, and each template's minima by band."""

    gram: int
    window: int
    step: int
    seeds: np.ndarray
    names: list[str]
    shingles: list[np.ndarray]
    minima: np.ndarray


def groups_of(templates: dict[str, str], miss: float = 1e-4) -> list[Group]:
    """Groups whose longest template is at most twice the shortest; templates under five words are one whole shingle of their own length."""
    sized: dict[tuple, list[str]] = {}
    for name, text in templates.items():
        n = len(words_of(text))
        if n:
            sized.setdefault((min(n, NGRAM), int(math.log2(max(1, n - NGRAM + 1)))), []).append(name)
    out = []
    for (gram, _), names in sorted(sized.items()):
        shingles = [np.unique(ngram_hashes(words_of(templates[n]), gram)) for n in names]
        longest, shortest = max(map(len, shingles)), min(map(len, shingles))
        step = max(1, longest // 2)
        window = longest + step
        # three quarters of the shortest template, alone in a full window
        least = (NUM * shortest / DEN) / (window + (DEN - NUM) * shortest / DEN)
        seeds = mix(np.arange(1, bands_needed(least, miss) + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        minima = np.array([[(s * seed).min() for s in shingles] for seed in seeds], np.uint64)
        out.append(Group(gram, window, step, seeds, names, shingles, minima))
    return out


def scan(texts: list[str | None], groups: list[Group]) -> list[dict[str, tuple[float, int]]]:
    """For each text, the templates found: the best containment, and the number of the first word of its window, the first of equals.

    Texts stand end to end, each padded to whole steps with its last shingle, so that windows start at the same places of a text whatever stands beside it.
    """
    hashed = [word_hashes(words_of(t)) for t in texts]
    found: list[dict[str, tuple[float, int]]] = [{} for _ in texts]
    for g in groups:
        own = [ngrams(h, g.gram) if len(h) >= g.gram else h[:0] for h in hashed]
        padded = [np.concatenate([h, np.repeat(h[-1:], -len(h) % g.step)]) for h in own]
        begins = np.cumsum([0, *map(len, padded)])
        everything = np.concatenate(padded) if padded else np.zeros(0, np.uint64)
        if not len(everything):
            continue
        steps = -(-g.window // g.step)
        near: set[tuple[int, int]] = set()
        for seed, minima in zip(g.seeds, g.minima):
            part = (everything * seed).reshape(-1, g.step).min(axis=1) if g.step > 1 else everything * seed
            least = part.copy()
            for k in range(1, min(steps, len(part))):
                np.minimum(least[:-k], part[k:], out=least[:-k])
            for t, m in enumerate(minima):
                near.update((int(i), t) for i in np.flatnonzero(least == m))
        for i, t in sorted(near):
            at = i * g.step
            d = int(np.searchsorted(begins, at, "right")) - 1
            first = at - int(begins[d])
            inside = own[d][first:first + steps * g.step]
            share = float(np.isin(g.shingles[t], inside).sum() / len(g.shingles[t]))
            if share * DEN >= NUM and share > found[d].get(g.names[t], (0.0, 0))[0]:
                found[d][g.names[t]] = (share, first)
    return found


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", miss: float = 1e-4) -> DataFrame:
    """Rows (doc_id, license, containment, word): a template found in a document and the window where it is most complete, the first of equals.

    Case and punctuation at word ends do not count. Null and empty texts match nothing; repeated rows match alike. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(groups_of(TEMPLATES if templates is None else templates, miss))  # as large as the templates given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows(batches):
            out: list[list] = [[], [], [], []]
            for r, found in zip(some, scan([r["text"] for r in some], held.value)):
                for name, (share, word) in sorted(found.items()):
                    for c, v in zip(out, (r["doc_id"], name, share, word)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.float64(), pa.int64()))], ["doc_id", "license", "containment", "word"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, license string, containment double, word long")
