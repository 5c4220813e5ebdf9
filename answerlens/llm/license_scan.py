"""License scans: normalised text compared to licence templates by Dice coefficient over word bigrams.

A template of n words is compared to every stretch of n words of a document, and to a whole document that is shorter.
Sizes bound the coefficient: a document too short for the threshold drops the template, and so does one with too few
places where a bigram of the template stands; such places, counted with prefix sums, then bound each stretch. Only
stretches that pass are compared exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.llm.decontaminate import Vocabulary, words_of
from answerlens.llm.shared import arrow_map, as_bytes, extended, free_name

LEAST_DICE = 0.8

# Published notices and short licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


@dataclass
class Template:
    name: str
    words: int
    kinds: np.ndarray  # distinct bigrams
    counts: np.ndarray


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least, vocabulary = least, {}
        numbers = {name: [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text.encode())] for name, text in sorted(templates.items())}
        self.vocabulary, self.base = Vocabulary(vocabulary), len(vocabulary) + 1
        self.templates = []
        for name, n in numbers.items():
            if len(n) > 1:
                bag = sorted(Counter(a * self.base + b for a, b in zip(n, n[1:], strict=False)).items())
                self.templates.append(Template(name, len(n), np.array([k for k, _ in bag]), np.array([c for _, c in bag])))

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[str, float, int, int]]]:
        """Words of a text, and (template, dice, first word, words) of the best stretch for each template that fits.

        The first of equally good stretches counts.
        """
        words = words_of(text) if text else []
        n = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        if len(n) < 2:
            return len(n), []
        known = n > 0
        pairs = np.where(known[1:] & known[:-1], n[:-1] * self.base + n[1:], -1)
        places = np.flatnonzero(pairs >= 0)
        if not len(places):
            return len(n), []
        found = []
        for t in self.templates:
            width = min(t.words, len(n))
            sizes = width - 1 + t.words - 1
            need = self.least * sizes / 2 - 1e-9
            if width - 1 < need or len(places) < need:
                continue
            own = places[np.isin(pairs[places], t.kinds)]
            if len(own) < need:
                continue
            hits = np.zeros(len(pairs) + 1, np.int64)
            hits[own + 1] = 1
            hits = np.cumsum(hits)
            starts = np.flatnonzero(hits[width - 1 :] - hits[: len(hits) - width + 1] >= need)
            if not len(starts):
                continue
            common = np.zeros(len(starts), np.int64)
            for kind, count in zip(t.kinds.tolist(), t.counts.tolist(), strict=True):
                at = np.searchsorted(own[pairs[own] == kind], np.stack([starts, starts + width - 1]))
                common += np.minimum(at[1] - at[0], count)
            best = int(np.argmax(common))
            if common[best] >= need:
                found.append((t.name, 2 * int(common[best]) / sizes, int(starts[best]), width))
        return len(n), found


def license_scan(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST_DICE, keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per input row: its columns (or `keep`), then n_words, licenses, license; underscores if taken.

    licenses: an array of (name, dice, first_word, n_words), by name, of the best stretch for every template with a
    coefficient of `least` or more; license: the name of the best (the first by name of equals), null if there is none.
    Words as in decontamination: ASCII letters and digits and non-ASCII characters, A-Z lower-cased. Null and empty texts
    have none. Repeated rows give repeated results; an empty table gives an empty one. Templates of one word are ignored.
    """
    kept = df.columns if keep is None else list(keep)
    names: list[str] = []
    for wanted in ("n_words", "licenses", "license"):
        names.append(free_name(wanted, kept + names))
    source = df.select(*kept, F.col(text).alias(free_name("whole_text", kept)))
    scanner = Scanner(TEMPLATES if templates is None else templates, least)
    kind = pa.list_(pa.struct([("name", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.scan(t) for t in as_bytes(batch.column(len(kept)))]
            rows = [[dict(zip(("name", "dice", "first_word", "n_words"), m, strict=True)) for m in f] for _, f in found]
            best = [max(f, key=lambda m: m[1])[0] if f else None for _, f in found]
            new = [pa.array([n for n, _ in found], pa.int64()), pa.array(rows, kind), pa.array(best, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[*batch.schema.names[: len(kept)], *names])

    return arrow_map(source, run, extended(df.select(*kept), *zip(names, ("long", "array<struct<name:string,dice:double,first_word:long,n_words:long>>", "string"), strict=True)))
