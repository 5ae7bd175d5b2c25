"""License scans by conditional compression.

Candidate blocks are runs of lines that hold a cue word (license, copyright, warranty, ...), with up to two
lines without one between. In a block, the places of a template's words that are rarest there give windows of about
its length; a window is compressed alone and with the template as a zstandard raw-content dictionary, and the
templates are ranked by how much smaller it gets. They are confirmed, in rank order, by their exact wording: the
template's words are aligned with the window's, and a template wins if at most MOST_MISSING of its words are missing,
none of them a name, a number or a version. Missing and foreign words inside the alignment are reported.

One pass over the documents; no shuffle; the templates are part of this module.

Defined results: null and empty texts have no blocks; repeated rows each get a row; ties in rank go to the first
template by id; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ._common import with_struct

#: Wording of public license notices and of the statements that name them.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0-statement": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-statement": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-statement": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
CUE = re.compile(r"licen[sc]|copyright|warrant|redistribut|permission|public domain|\bcc[ -]by\b|\bcc0\b|\bgpl\b|free software", re.I)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
GAP, LEVEL, LEAST_GAIN, MOST_MISSING = 2, 9, 0.15, 0.1
#: Words that tell one template from another; where one of them is missing or replaced, the wording is another license's.
NAMES = {"affero", "apache", "bsd", "by", "cc", "cc0", "creative", "eclipse", "gpl", "isc", "lesser", "library", "mit", "mozilla", "nc", "nd", "neither", "sa"}

FINDING = StructType([StructField("license", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("gain", DoubleType()), StructField("missing", StringType()), StructField("foreign", StringType())])
FOUND = StructType([StructField("n_blocks", LongType()), StructField("findings", ArrayType(FINDING))])
ARROW = pa.struct([("n_blocks", pa.int64()), ("findings", pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gain", pa.float64()), ("missing", pa.string()), ("foreign", pa.string())])))])


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of candidate blocks (code points)."""
    if not CUE.search(text):
        return []
    out: list[list[int]] = []  # start, end, number of the last line with a cue
    at = 0
    for i, line in enumerate(text.split("\n")):
        if CUE.search(line):
            if out and i - out[-1][2] <= GAP + 1:
                out[-1][1:] = [at + len(line), i]
            else:
                out.append([at, at + len(line), i])
        at += len(line) + 1
    return [(a, b) for a, b, _ in out]


class Matcher:
    def __init__(self) -> None:
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.given = []
        for name, text in sorted(TEMPLATES.items()):
            d = zstandard.ZstdCompressionDict(self.norm(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            words = [w.lower() for w in WORD.findall(text)]
            self.given.append((name, words, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))

    @staticmethod
    def norm(text: str) -> bytes:
        return " ".join(text.lower().split()).encode("utf-8", "replace")

    def block(self, text: str) -> list[tuple[str, int, int, float, str, str]]:
        """Confirmed findings in a block, places relative to it."""
        places = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text)]
        have = [w for _, _, w in places]
        at: dict[str, list[int]] = {}
        for i, w in enumerate(have):
            at.setdefault(w, []).append(i)
        ranked = []
        for name, words, c in self.given:
            # Where the template may stand: windows of its length round its words that are rarest in the block. What is compressed is the window, so a long block around it changes nothing.
            if sum(w in at for w in words) < (1 - MOST_MISSING) * len(words):
                continue
            for first, last in self.windows(words, at, len(have)):
                data = self.norm(text[places[first][0] : places[last][1]])
                alone = len(self.plain.compress(data))
                ranked.append(((alone - len(c.compress(data))) / alone, name, first, last, words))
        ranked.sort(key=lambda x: (-x[0], x[1], x[2]))
        taken = [False] * len(have)
        out = []
        for gain, name, first, last, words in ranked:
            free = [i for i in range(first, last + 1) if not taken[i]]
            if gain < LEAST_GAIN or len(free) < (1 - MOST_MISSING) * len(words):
                continue
            got = [b for b in difflib.SequenceMatcher(None, words, [have[i] for i in free], autojunk=False).get_matching_blocks() if b.size]
            if sum(b.size for b in got) < (1 - MOST_MISSING) * len(words):
                continue
            start, end = free[got[0].b], free[got[-1].b + got[-1].size - 1]
            if end - start + 1 > 2 * len(words):
                continue  # its words, but not its wording
            used = {k for b in got for k in range(b.a, b.a + b.size)}
            inside = {i for b in got for i in free[b.b : b.b + b.size]}
            missing = [w for k, w in enumerate(words) if k not in used]
            foreign = [have[i] for i in range(start, end + 1) if i not in inside]
            if any(w in NAMES or w[0].isdigit() for w in missing):
                continue  # another license, or another version of it
            out.append((name, places[start][0], places[end][1], round(gain, 4), " ".join(missing), " ".join(foreign)))
            for i in range(start, end + 1):
                taken[i] = True
        return sorted(out, key=lambda x: (x[1], x[0]))

    @staticmethod
    def windows(words: list[str], at: dict[str, list[int]], n: int) -> list[tuple[int, int]]:
        """Spans of a block's words, of up to twice the template's length each way, round every place where one of its rarest words stands; spans that overlap are one where that stays short."""
        most = max(1, int(MOST_MISSING * len(words))) + 1  # so many of its words cannot all be missing
        rare = sorted({w for w in words if w in at}, key=lambda w: (len(at[w]), w))[:most]
        out: list[list[int]] = []
        for i in sorted(i for w in rare for i in at[w]):
            a, b = max(0, i - len(words) - len(words) // 4), min(n - 1, i + len(words) + len(words) // 4)
            if out and i <= out[-1][1] - len(words):
                continue
            out.append([a, b])
        return [(a, b) for a, b in out]


_MATCHER: list[Matcher] = []


def scan_text(text: str | None) -> dict:
    if not text:
        return {"n_blocks": 0, "findings": []}
    found = blocks(text)
    if found and not _MATCHER:
        _MATCHER.append(Matcher())
    out = []
    for a, b in found:
        for name, s, e, gain, missing, foreign in _MATCHER[0].block(text[a:b]):
            out.append({"license": name, "start": a + s, "end": a + e, "gain": gain, "missing": missing, "foreign": foreign})
    return {"n_blocks": len(found), "findings": out}


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_blocks, and findings (license, start, end, gain, missing, foreign)."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    df = with_struct(df, "f", FOUND, ["text"], lambda col: pa.array([scan_text(t.as_py()) for t in col], ARROW))
    return df.select("doc_id", "f.n_blocks", "f.findings")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_blocks, n_findings, licenses, spans (license:start:end) and differences (license:missing words:foreign words), comma-joined."""
    df = scan(docs, id_col=id_col, text_col=text_col)
    spans = F.transform("findings", lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string")))
    told = F.transform("findings", lambda f: F.concat_ws(":", f["license"], f["missing"], f["foreign"]))
    return df.select("doc_id", "n_blocks", F.array_join(told, ",").alias("differences"), F.size("findings").cast("long").alias("n_findings"), F.array_join(F.array_sort(F.array_distinct(F.col("findings.license"))), ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))
