"""License scans by canonical digest lookup.

A text's canonical form has A-Z lower-cased, lines that begin with a copyright notice removed, each run of characters other
than a-z, 0-9 and those beyond ASCII turned to one space, and equivalent spellings made one. Its SHA-256 is joined by hash with the digests of known
licences, once for the entire text and once for each entire line (for notices that documents carry on a line of their own).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_digests import DIGESTS
from .shared import settle, small_batches

#: Equivalent spellings.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "copyleft": "copyleft",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "noncommercial": "noncommercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

#: Known texts, whole licences and the notices that stand for one.
KNOWN = {
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "MIT (notice)": "Released under the MIT License.",
}

_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {2}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {3} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_NAMES = "Neither the name of the copyright {0} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_UNLICENSE = 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License", "GFDL": "GNU Free Documentation License"}
#: Names that notices give to a licence.
NAMED = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License", "ISC"], "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"], "BSD": ["BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"], "Unlicense": ["Unlicense"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "MPL 1.1", "MPL-1.1"], "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0 Universal", "CC0-1.0"],
} | {f"{k}-{v}": [f"{_GNU[k]}, version {n}" for n in {v, v.removesuffix(".0")}] + [f"{_GNU[k]} v{v}", f"{k} v{v.removesuffix('.0')}", f"{k} {v}", f"{k}-{v}"]
     for k, vs in {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("3.0",), "GFDL": ("1.2", "1.3")}.items() for v in vs} | {
    f"CC-{k.upper()}-{v}": [f"CC {k.upper()} {v}", f"CC-{k.upper()}-{v}", f"Creative Commons {w} {v}", f"Creative Commons {w} {v} International License"]
    for k, w in {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}.items() for v in ("2.0", "3.0", "4.0")}
_VERBS = [f"{a}{b} under " for a in ("", "This work is ", "This software is ", "This project is ") for b in ("licensed", "released", "distributed")] + ["License: "]


def _known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the built-in texts: whole licences with and without a title line, and notices."""
    out = list(KNOWN.items())
    whole = [("MIT", KNOWN["MIT"], ["MIT License", "The MIT License", "The MIT License (MIT)"]), ("ISC", KNOWN["ISC"], ["ISC License", "The ISC License"])]
    for a, b, c in (("", "", ""), ("1. ", "2. ", "3. ")):
        for one in ("HOLDER", "OWNER"):
            whole.append(("BSD-2-Clause", _BSD.format(a, b, "", one), ["BSD 2-Clause License", "The BSD 2-Clause License"]))
            whole += [("BSD-3-Clause", _BSD.format(a, b, c + _NAMES.format(n), one), ["BSD 3-Clause License", "The BSD 3-Clause License"]) for n in ("holder", "holders")]
    for tail in ("", " For more information, please refer to <https://unlicense.org>", " For more information, please refer to <http://unlicense.org/>", " For more information, please refer to <https://unlicense.org/>"):
        whole.append(("Unlicense", _UNLICENSE + tail, ["The Unlicense", "Unlicense"]))
    for i, text, titles in whole:
        out += [(i, text)] + [(i, f"{t}\n{text}") for t in titles]
    for i, names in NAMED.items():
        out += [(f"{i} (notice)", f"{v}{the}{n}") for n in names for v in _VERBS for the in ("", "the ")]
        out.append((f"{i} (notice)", f"SPDX-License-Identifier: {i}"))
        if i.split("-")[0] in _GNU:
            out += [(f"{i} (notice)", f"SPDX-License-Identifier: {i}-{x}") for x in ("only", "or-later")]
    return out


_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = bytes(b if b >= 128 or chr(b).isalnum() or b == 10 else 32 for b in range(256))
_NOTICE = re.compile(rb"^[ \t\r]*(?:\xc2\xa9|\(c\)|copyright(?![a-z]))[^\n]*", re.M)
_SAME = {k.encode(): v.encode() for k, v in EQUIVALENT.items()}


def canonical_lines(text: str) -> list[bytes]:
    """The canonical form of each line, without the empty ones."""
    low = text.encode().translate(_LOW)
    if b"copyright" in low or b"(c)" in low or b"\xc2\xa9" in low:
        low = _NOTICE.sub(b"", low)
    same = _SAME.get
    return [b" ".join([same(w, w) for w in words]) for line in low.translate(_BLANK).split(b"\n") if (words := line.split())]


def canonical(text: str) -> str:
    """The canonical form of a text; empty if nothing is left."""
    return b" ".join(canonical_lines(text)).decode()


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(license_id, sha256) of the known texts; by default, of all built-in ones."""
    rows = [(k, digest(v)) for k, v in (known.items() if known else _known_texts())]
    return spark.createDataFrame(sorted({*rows, *([] if known else [(i, h) for i, h, _ in DIGESTS])}), "license_id string, sha256 string")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, longest: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which known licence each document is, and which it names on lines of their own.

    known(license_id, sha256) are digests of canonical forms; `longest` is the length in bytes of the longest of them (by default, of the built-in ones): longer lines can't be
    known. Returns one row per input row: `id_col`, sha256 (of the entire text's canonical form), license_id (null if none; the least of several),
    line_licenses (sorted ids, comma-joined, empty if none). Null texts count as empty; an empty canonical form matches nothing. Null ids stay null and repeated rows
    count each. An empty table gives no rows; extra columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if known is None:
        known, longest = known_digests(spark), max(*(len(canonical(v).encode()) for _, v in _known_texts()), *(n for _, _, n in DIGESTS))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch], bound=longest or 1 << 62) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                whole, lines = [], []
                for text in part.column("text").to_pylist():
                    split = canonical_lines(text or "")
                    whole.append(hashlib.sha256(b" ".join(split)).hexdigest())
                    lines.append(sorted({hashlib.sha256(x).hexdigest() for x in split if len(x) <= bound}) if "\n" in (text or "") else [])
                yield pa.record_batch([part.column("id"), pa.array(whole, pa.string()), pa.array(lines, pa.list_(pa.string())), pa.array([w == nothing for w in whole])], names=["id", "sha256", "lines", "nothing"])

    kind = rows.schema["id"].dataType.simpleString()
    hashed = settle(rows.mapInArrow(run, f"id {kind}, sha256 string, lines array<string>, nothing boolean").withColumn("row", F.monotonically_increasing_id()), "digests")
    once = known.groupBy("sha256").agg(F.min("license_id").alias("license_id"))
    small = once.count() <= 100_000  # some 10 MB; a longer list is joined by a shuffle
    once = F.broadcast(once) if small else once
    named = hashed.select("row", F.explode("lines").alias("sha256")).join(once, "sha256").groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("line_licenses"))
    out = hashed.drop("lines").join(once, "sha256", "left").join(named, "row", "left")
    return out.select(F.col("id").alias(id_col), "sha256", F.when(~F.col("nothing"), F.col("license_id")).alias("license_id"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))
