"""License scan by conditional compression.

Blocks of a document that mention licensing are candidates. A candidate is compressed plainly and with
each template as a raw zstandard dictionary; the template that saves the largest share wins. A winner is
confirmed by its exact wording: the words of the template's best matching stretch and those of the
block are aligned, and what was inserted, deleted or replaced is reported. The scan is one pass over
the documents; templates are a fixed, small table.

Defined cases: null and empty texts have no blocks; a block no template explains is reported without a
license; equal blocks are reported each; rows that repeat a doc_id are scanned one by one; further
columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The customary wordings of the notices.
TEMPLATES = {
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
MENTION = "licen[cs]e|licensed|copyright|copyleft|redistribut|permission is hereby|public domain|all rights reserved"
MENTIONED = re.compile(MENTION, re.I)
LEAST_SAVING = 0.35  # of the plainly compressed size, without the frame
LEAST_WORDING = 0.85  # of the template's words, in order
FRAME = 13  # bytes of a compressed frame around nothing


class Scanner:
    def __init__(self):
        self.plain = self.compressor(None)
        self.templates = [(name, text, self.compressor(text)) for name, texts in TEMPLATES.items() for text in texts]
        self.seen: dict[str, tuple] = {}

    @staticmethod
    def compressor(text: str | None) -> zstandard.ZstdCompressor:
        given = {"dict_data": zstandard.ZstdCompressionDict(text.lower().encode() + b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if text else {}
        return zstandard.ZstdCompressor(level=19, write_checksum=False, write_content_size=False, write_dict_id=False, **given)

    def ranked(self, block: str) -> list[tuple[float, str, str]]:
        """(share saved, license, template) of all templates, best first; ties by name."""
        raw = block.lower().encode()
        whole = max(1, len(self.plain.compress(raw)) - FRAME + 4)
        out = [((len(self.plain.compress(raw)) - len(c.compress(raw))) / whole, name, text) for name, text, c in self.templates]
        return sorted(out, key=lambda x: (-x[0], x[1], x[2]))

    def judged(self, block: str) -> tuple[str | None, float, float, list[str]]:
        """(license or None, share saved, share of the template's words kept, differences)."""
        if block not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            self.seen[block] = self._judged(block)
        return self.seen[block]

    def _judged(self, block: str) -> tuple[str | None, float, float, list[str]]:
        best = (None, 0.0, 0.0, [])
        for saving, name, text in self.ranked(block)[:3]:
            kept, differences = wording(block, text)
            if saving >= LEAST_SAVING and kept >= LEAST_WORDING and (best[0] is None or kept > best[2]):
                best = (name, saving, kept, differences)
            elif best[0] is None and saving > best[1]:
                best = (None, saving, kept, [])
        return best


def words_of(text: str) -> list[str]:
    return re.findall(r"[\w./-]*\w", text.lower())


def wording(block: str, template: str) -> tuple[float, list[str]]:
    """Share of the template's words that the block has in order, and the edits between the two."""
    a, b = words_of(template), words_of(block)
    codes = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    while codes and codes[0][0] == "insert":  # what stands around the notice is not part of it
        codes = codes[1:]
    while codes and codes[-1][0] == "insert":
        codes = codes[:-1]
    kept = sum(i2 - i1 for op, i1, i2, _, _ in codes if op == "equal")
    return kept / max(1, len(a)), [f"{op}: {' '.join(a[i1:i2])} -> {' '.join(b[j1:j2])}" for op, i1, i2, j1, j2 in codes if op != "equal"]


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring lines that mention licensing, as character offsets."""
    start = end = None
    at = 0
    for line in text.split("\n"):
        if MENTIONED.search(line):
            if start is None:
                start = at
            end = at + len(line)
        elif start is not None:
            yield start, end
            start = None
        at += len(line) + 1
    if start is not None:
        yield start, end


def license_blocks(docs: DataFrame) -> DataFrame:
    """One row per candidate block: doc_id, start, end (characters), license (null: none fits), saving, wording, differences."""
    names = ["doc_id", "start", "end", "license", "saving", "wording", "differences"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            some = batch.filter(pc.match_substring_regex(batch.column(1), MENTION, ignore_case=True))
            rows = []
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                for a, b in blocks(text):
                    rows.append((doc, a, b, *scanner.judged(text[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, start long, end long, license string, saving double, wording double, differences array<string>")
