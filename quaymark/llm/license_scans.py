"""License scans: whole texts and whole lines, in a canonical form, looked up by digest among known licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beyond so many digests the known licences aren't broadcast.
MAX_BROADCAST_DIGESTS = 100_000
#: Equivalent spellings, applied in this order to texts and known licences alike.
SPELLINGS = (
    ("licence", "license"), ("licenc", "licens"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("acknowledgement", "acknowledgment"),
    ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("behaviour", "behavior"), ("capitalis", "capitaliz"), ("catalogue", "catalog"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("customis", "customiz"), ("favour", "favor"), ("fulfill", "fulfil"), ("honour", "honor"), ("initialis", "initializ"), ("judgement", "judgment"),
    ("labour", "labor"), ("merchantibility", "merchantability"), ("organis", "organiz"), ("per cent", "percent"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
)
#: Names of licences as notices spell them.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense",),
}
NOTICES = ("{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}",
           "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}", "This software is licensed under the {}", "License: {}")
#: Whole texts of short licences.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}
#: Titles that stand above the texts.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",),
    "Unlicense": ("The Unlicense",), "Zlib": ("zlib License", "The zlib License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
}


def canonical_lines(text):
    """Lines of the canonical form: lower case, no copyright lines, every run of other characters than letters and digits one space, equivalent spellings unified;
    empty lines go."""
    out = F.regexp_replace(F.lower(text), r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[ :]*(?:\(c\)|©|[0-9])|\(c\)|©|all rights reserved)[^\n]*$", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    for seen, meant in SPELLINGS:
        out = F.replace(out, F.lit(seen), F.lit(meant))
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def digest(canonical):
    return F.unhex(F.sha2(canonical.cast("binary"), 256))


def built_in() -> list[tuple[str, str]]:
    """(license, text): notices, and whole texts without and with a title."""
    notices = [(name, form.format(spelled)) for name, spellings in NAMES.items() for spelled in spellings for form in NOTICES]
    return notices + [(name, above + text) for name, text in TEXTS.items() for above in ("", *(f"{title}\n" for title in TITLES[name]))]


def known_licenses(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """(license, text) of the built-in notices and texts, and of extra rows with these columns: a table of the long licences' texts."""
    known = spark.createDataFrame(built_in(), "license string, text string")
    return known if extra is None else known.unionByName(extra.select("license", "text"))


def license_digests(known: DataFrame) -> DataFrame:
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    return known.select(whole.alias("whole"), "license").where("whole <> '' and license is not null").groupBy(digest(F.col("whole")).alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST_DIGESTS) -> DataFrame:
    """(doc_id, n_lines, text_sha256, license, notices) of every row.

    n_lines counts the lines of the canonical form and text_sha256 is its digest in hex (null if it has none, as for null and empty texts). license: the known
    licence whose canonical text is the whole text, else null. notices: the sorted licences whose canonical text is a whole line. Rows of the same id and the
    same canonical text get the same result; repeated rows stay. The lines of a text are summed up in the partition that reads it, before the one shuffle.
    """
    lookup = license_digests(known)
    if lookup.count() <= max_broadcast:
        lookup = F.broadcast(lookup)
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(canonical_lines(F.col(text)), F.array().cast("array<string>")).alias("lines"))
    whole = F.when(F.size("lines") > 0, digest(F.array_join("lines", " ")))
    units = lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), whole.alias("whole"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("lines"))).alias("line"))
    units = units.withColumn("digest", F.when(F.col("line").isNull(), F.col("whole")).otherwise(digest(F.col("line"))))
    is_text = F.col("line").isNull()
    found = (
        units.join(lookup, "digest", "left")
        .groupBy("doc_id", "n_lines", "whole")
        .agg(
            F.max(F.when(is_text, F.col("license"))).alias("license"),
            F.array_sort(F.collect_set(F.when(~is_text, F.col("license")))).alias("notices"),
            F.count_if(is_text).alias("copies"),
        )
    )
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return found.select("doc_id", "n_lines", F.lower(F.hex("whole")).alias("text_sha256"), "license", "notices", copies.alias("copy")).drop("copy")
