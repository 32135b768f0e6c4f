"""License notices found in whole texts.

Shingles of five words are hashed in order. For a template of n shingles a text is cut into blocks of
n, and every two neighbouring blocks are a window, so each occurrence lies whole in some window. Under
each of BANDS permutations (bands of one row) a window's minimum is compared with the template's.
Retrieved windows are verified: the share of the template's distinct shingles that the window holds.

The multiplications are one-to-one, so a minimum equals the template's only if the window holds the
template's smallest shingle of that band. Bands are therefore evaluated for windows that hold one of
these shingles; all other windows meet in no band.

A window that holds a share c of a template has a similarity of at least c / 3 (its 2n shingles, those
of the template not counted twice): at 0.75 it meets the template in no band with probability under
(1 - 0.25) ** 64 = 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.minhash import _POW, WORDS, mix, word_hashes

BANDS = 64
CONTAINMENT = 0.75
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Notices by license. Full texts lie in license_texts; a full text that isn't there is known by a passage of its own (-passage).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-short": "Licensed under Apache 2.0.",
    "Apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "GPL-3.0-v3": "Licensed under the GNU General Public License v3.0.",
    "GPL-3.0-short": "Licensed under GPL-3.0.",
    "GPL-3.0-spdx": "SPDX-License-Identifier: GPL-3.0",
    "GPL-2.0": "Licensed under the GNU General Public License, version 2.0.",
    "GPL-2.0-v2": "Licensed under the GNU General Public License v2.0.",
    "GPL-2.0-short": "Licensed under GPL-2.0.",
    "GPL-2.0-spdx": "SPDX-License-Identifier: GPL-2.0",
    "LGPL-3.0": "GNU Lesser General Public License, version 3.",
    "LGPL-3.0-v3": "Licensed under the GNU Lesser General Public License v3.0.",
    "LGPL-3.0-short": "Licensed under LGPL-3.0.",
    "LGPL-3.0-spdx": "SPDX-License-Identifier: LGPL-3.0",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-short": "Licensed under LGPL-2.1.",
    "LGPL-2.1-spdx": "SPDX-License-Identifier: LGPL-2.1",
    "LGPL-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-v3": "Licensed under the GNU Affero General Public License v3.0.",
    "AGPL-3.0-short": "Licensed under AGPL-3.0.",
    "AGPL-3.0-spdx": "SPDX-License-Identifier: AGPL-3.0",
    "AGPL-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "AGPL-3.0-passage": "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-plain": "Licensed under the Mozilla Public License 2.0.",
    "MPL-2.0-short": "Licensed under MPL 2.0.",
    "MPL-2.0-spdx": "SPDX-License-Identifier: MPL-2.0",
    "ISC": "Released under the ISC License.",
    "ISC-licensed": "Licensed under the ISC License.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "BSD": "Released under the BSD License.",
    "BSD-licensed": "Licensed under the BSD License.",
    "BSD-2-Clause-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "BSD-3-Clause-passage": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "EPL-2.0": "Licensed under the Eclipse Public License, Version 2.0.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "EPL-2.0-spdx": "SPDX-License-Identifier: EPL-2.0",
    "EPL-passage": "The accompanying program is provided under the terms of this Eclipse Public License (\"Agreement\"). Any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement.",
    **{f"CC-{k}-4.0" + "-short" * (k in ("BY", "BY-SA")): f"Licensed under CC {k} 4.0." for k in _CC},
    **{f"CC-{k}-4.0-notice": f"This work is licensed under a Creative Commons {v} 4.0 International License." for k, v in _CC.items() if k not in ("BY", "BY-SA")},
    **{f"CC-{k}-4.0-spdx": f"SPDX-License-Identifier: CC-{k}-4.0" for k in _CC},
    **{f"CC-{k}-4.0-passage": f"terms and conditions of this Creative Commons {v} 4.0 International Public License" for k, v in _CC.items()},
    **{f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")},
}
FOUND = "doc_id long, n_licenses long, licenses string, best double, spans array<struct<license:string,first_word:long,containment:double>>"
_rng = np.random.default_rng(509)
_A = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_PLAIN = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def shingle_run(text: str | None) -> np.ndarray:
    """Hashes of the five-word shingles in order, punctuation read as space; none for fewer words."""
    w = word_hashes((text or "").encode().translate(_PLAIN))
    n = len(w) - WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(WORDS):
        h += w[j : j + n] * _POW[j + 1]
    return mix(h)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.sets = {k: np.unique(s) for k, t in templates.items() if len(s := shingle_run(t))}
        self.low = {k: ((s[:, None] ^ _B) * _A).min(axis=0) for k, s in self.sets.items()}
        # the smallest shingles of the bands, sorted, each with the templates that it is smallest in
        lowest: dict[int, list[str]] = {}
        for k, s in self.sets.items():
            for h in np.unique(s[((s[:, None] ^ _B) * _A).argmin(axis=0)]).tolist():
                lowest.setdefault(h, []).append(k)
        self.lowest = np.array(sorted(lowest), np.uint64)
        self.named = [lowest[h] for h in self.lowest.tolist()]

    def retrieve(self, run: np.ndarray) -> set[tuple[str, int]]:
        """(template, window) pairs that share a band."""
        if not len(self.lowest):
            return set()
        at = np.minimum(np.searchsorted(self.lowest, run), len(self.lowest) - 1)
        windows: set[tuple[str, int]] = set()
        for p in np.flatnonzero(self.lowest[at] == run).tolist():
            for k in self.named[at[p]]:
                n = len(self.sets[k])
                last = max(-(-len(run) // n) - 2, 0)
                windows.update((k, x) for x in (p // n - 1, p // n) if 0 <= x <= last)
        found: set[tuple[str, int]] = set()
        for k, x in windows:
            n = len(self.sets[k])
            low = ((run[x * n : (x + 2) * n, None] ^ _B) * _A).min(axis=0)
            if (low == self.low[k]).any():
                found.add((k, x))
        return found

    def scan(self, text: str | None, least: float) -> list[tuple[str, int, float]]:
        """(template, first word, containment) of each template's best verified window, by name."""
        run = shingle_run(text)
        if not len(run):
            return []
        best: dict[str, tuple[float, int]] = {}
        for k, x in self.retrieve(run):
            s = self.sets[k]
            n = len(s)
            window = run[x * n : (x + 2) * n]
            inside = np.isin(window, s)
            share = len(np.unique(window[inside])) / n
            if share >= least:
                hit = (share, -(x * n + int(inside.argmax())))
                best[k] = max(best.get(k, hit), hit)
        return [(k, -at, share) for k, (share, at) in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_licenses, licenses (names joined by commas), best (containment), spans of every row.

    A template is contained if a window of two of its lengths holds at least the share `least` of
    its distinct shingles; ties keep the first window. Templates and texts of fewer than five words match
    nothing, as do null and empty texts (best 0). Rows are independent: repeated rows get equal values, an
    empty table gives no rows, other columns are ignored. The templates are a list that the caller gives
    and do not grow with the documents.
    """
    known = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(known)
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]))
        for b in batches:
            got = [s.scan(t, least) for t in b.column("text").to_pylist()]
            spans = [[{"license": k, "first_word": at, "containment": c} for k, at, c in g] for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array([len(g) for g in got], pa.int64()), pa.array([",".join(k for k, _, _ in g) for g in got], pa.string()),
                    pa.array([max((c for _, _, c in g), default=0.0) for g in got], pa.float64()), pa.array(spans, kind),
                ],
                [x.split()[0] for x in FOUND.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
