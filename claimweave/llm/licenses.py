"""License scans (operator 1): sentence-rule recognition. DataFrame functions only.

Texts are cut into sentences, normalised to lower-case letters and digits, and looked up among known
license sentences. These are cut in the same way: one that has an end inside (as in "v. 2.0.") is found
where all its pieces follow one another. A text's identifiers, in order, are then matched against license rules, each an
ordered sequence of identifiers that must follow one another. Sentences that aren't known lie between
identifiers without harm; a known sentence of another kind parts a sequence. A match that lies inside
a longer one of the same text is left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimweave.llm.common import text_id, written

# Known license sentences by identifier, and the ordered rules over them.
SENTENCES = {
    "mit-title": ["The MIT License", "MIT License", "The MIT License (MIT)"],
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice-kept": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "apache2-notice": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-run-on": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache2-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "cc-by-nc4-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "Released under CC BY-NC 4.0."],
    "cc-by4-notice": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "Released under CC BY 4.0."],
    "cc-by-sa4-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "bsd-as-is": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "bsd-liability": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "gpl2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl2-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."],
    "lgpl21-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "agpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "epl2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0."],
    "cc0-notice": ["Licensed under CC0 1.0.", "This work is licensed under CC0 1.0.", "Released under CC0 1.0."],
    "bsd3-notice": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "This project is licensed under the BSD 3-Clause License."],
    "mpl2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v.2.0."],
}
RULES = {
    "MIT/full": ("MIT", ["mit-grant", "mit-notice-kept", "as-is"]),
    "MIT/titled": ("MIT", ["mit-title", "mit-grant", "mit-notice-kept", "as-is"]),
    "MIT/notice": ("MIT", ["mit-notice"]),
    "MIT/whole": ("MIT", ["mit-grant", "mit-notice-kept", "as-is", "mit-liability"]),
    "MIT/whole-titled": ("MIT", ["mit-title", "mit-grant", "mit-notice-kept", "as-is", "mit-liability"]),
    "ISC/full": ("ISC", ["isc-grant", "isc-as-is"]),
    "GPL-2.0/header": ("GPL-2.0-or-later", ["gpl2-later", "gpl-warranty"]),
    "GPL-2.0/header-only": ("GPL-2.0-only", ["gpl2-only", "gpl-warranty"]),
    "LGPL-2.1/header": ("LGPL-2.1-or-later", ["lgpl21-later", "lgpl-warranty"]),
    "LGPL-3.0/header": ("LGPL-3.0-or-later", ["lgpl3-later", "gpl-warranty"]),
    "AGPL-3.0/header": ("AGPL-3.0-or-later", ["agpl3-later", "gpl-warranty"]),
    "EPL-2.0/notice": ("EPL-2.0", ["epl2-notice"]),
    "Unlicense/full": ("Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    "BSL-1.0/notice": ("BSL-1.0", ["boost-notice"]),
    "CC0-1.0/notice": ("CC0-1.0", ["cc0-notice"]),
    "BSD-2-Clause/whole": ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"]),
    "BSD-3-Clause/whole": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability"]),
    "BSD-3-Clause/notice": ("BSD-3-Clause", ["bsd3-notice"]),
    "Apache-2.0/header": ("Apache-2.0", ["apache2-notice", "apache2-copy", "apache2-as-is"]),
    "Apache-2.0/header-run-on": ("Apache-2.0", ["apache2-notice", "apache2-run-on"]),
    "Apache-2.0/notice": ("Apache-2.0", ["apache2-notice"]),
    "GPL-3.0/notice": ("GPL-3.0-only", ["gpl3-notice"]),
    "GPL-3.0/header": ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    "CC-BY-NC-4.0/notice": ("CC-BY-NC-4.0", ["cc-by-nc4-notice"]),
    "CC-BY-4.0/notice": ("CC-BY-4.0", ["cc-by4-notice"]),
    "CC-BY-SA-4.0/notice": ("CC-BY-SA-4.0", ["cc-by-sa4-notice"]),
    "BSD-2-Clause/full": ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    "BSD-3-Clause/full": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    "MPL-2.0/notice": ("MPL-2.0", ["mpl2-notice"]),
}
_CUES = ["licens", "licenc", "redistribut", "warrant", "permission", "copyright notice", "software"]  #: every known sentence has one
#: Ends of sentences: . ! ? or : before white space, and lines with nothing but white space or comment marks.
_ENDS = r"(?<=[.!?:])\s+|\n[ \t\r#*/;%-]*\n\s*"


def normal(text: str) -> str:
    """A sentence as it is looked up."""
    return re.sub(r"[^\w]+", " ", text.lower(), flags=re.ASCII).strip()


def pieces_of(text: str) -> tuple[str, ...]:
    """A known sentence as scan cuts it."""
    return tuple(p for p in map(normal, re.split(_ENDS, text, flags=re.ASCII)) if p)


def known_sentences(spark: SparkSession, sentences: dict[str, list[str]] | None = None) -> DataFrame:
    """(sid, wording, piece, pieces, key): the pieces of the known sentences as they are looked up."""
    rows = []
    for sid, texts in (sentences or SENTENCES).items():
        for wording, cut in enumerate(sorted({pieces_of(x) for x in texts})):
            rows += [(sid, wording, piece, len(cut), key) for piece, key in enumerate(cut)]
    values = ", ".join(f"('{s}', {v}, {p}, {n}, '{k}')" for s, v, p, n, k in rows)
    return spark.sql(f"select * from values {values} as t(sid, wording, piece, pieces, key)")


def scan(docs: DataFrame, sentences: dict[str, list[str]] | None = None, rules: dict | None = None) -> DataFrame:
    """Documents (doc_id, text, ...) -> doc_id, license, rule, n_sentences, matches: a row per document and license.

    rule is the longest rule matched, n_sentences its length, matches how often rules of the license
    match. Sentences end at . ! ? or : before white space and at lines that are empty or hold comment marks only. Every text
    is cut a second time with all line ends as sentence ends, and the cut that finds more counts.
    Null and empty texts match nothing. Rows with equal doc_id and text are one document; others are documents
    of their own, also where their doc_id is null or repeated. Of rules that match equally many sentences the
    last by name is told. Other columns are ignored; an empty table gives no rows. Texts are scanned whole.
    """
    spark, rules = docs.sparkSession, rules or RULES
    known = F.broadcast(known_sentences(spark, sentences))  # a fixed list
    cues = [c for c in _CUES if any(c in normal(x) for xs in (sentences or SENTENCES).values() for x in xs)]
    if any(not any(c in normal(x) for c in cues) for xs in (sentences or SENTENCES).values() for x in xs):
        cues = [""]  # sentences of the caller's own: every text is cut
    cued = docs.select(F.struct("doc_id", *text_id()).alias("d"), "text").where(F.col("text").rlike("(?i)" + "|".join(cues)))
    # two cuts of the text: by sentence ends, lines joined; and by lines as well
    marked = f"regexp_replace(text, '{_ENDS}', '\\u0001')".replace("\\", "\\\\").replace("\\\\u0001", "\\u0001")
    pieces = lambda t: f"transform(filter(transform(split({t}, '\\u0001'), s -> trim(regexp_replace(lower(s), '[^a-z0-9_]+', ' '))), k -> k <> ''), (k, i) -> struct(i as i, k as key))"
    lined = r"regexp_replace(text, '(?<=[.!?:])\\s+|\\n\\s*', '\u0001')"
    ways = f"transform({pieces(lined)}, x -> struct(1 as way, x.i as i, x.key as key)), transform({pieces(marked)}, x -> struct(2 as way, x.i as i, x.key as key))"
    cut = cued.selectExpr("d", f"explode(concat({ways})) as x").select("d", "x.*")
    found = cut.join(known, "key").select("d", "way", (F.col("i") - F.col("piece")).alias("i"), "sid", "wording", "piece", "pieces").distinct()
    whole = found.groupBy("d", "way", "i", "sid", "wording", "pieces").agg(F.count("*").alias("n")).where("n = pieces")
    hits = written(whole.select("d", "way", "i", "sid").distinct(), "hits")
    hits = hits.withColumn("at", F.row_number().over(W.partitionBy("d", "way").orderBy("i", "sid")) - 1)
    flat = ", ".join(f"('{rule}', '{lic}', {k}, {len(ids)}, '{sid}')" for rule, (lic, ids) in rules.items() for k, sid in enumerate(ids))
    steps = F.broadcast(spark.sql(f"select * from values {flat} as t(rule, license, step, steps, sid)"))
    runs = hits.join(steps, "sid").groupBy("d", "way", "rule", "license", "steps", (F.col("at") - F.col("step")).alias("first_sentence")).agg(F.count("*").alias("n"))
    full = runs.where("n = steps").withColumn("last", F.col("first_sentence") + F.col("steps") - 1)
    inner = full.alias("a").join(full.alias("b"), ["d", "way"]).where("b.steps > a.steps and b.first_sentence <= a.first_sentence and b.last >= a.last").select("d", "way", F.col("a.rule"), F.col("a.first_sentence")).distinct()
    outer = full.join(inner, ["d", "way", "rule", "first_sentence"], "left_anti")
    # of the two cuts, the one that finds a license in more sentences
    told = outer.groupBy("d", "license", "way").agg(F.max_by("rule", F.struct("steps", "rule")).alias("rule"), F.max("steps").alias("n_sentences"), F.count("*").alias("matches"))
    best = told.groupBy("d", "license").agg(F.max_by(F.struct("rule", "n_sentences", "matches"), F.struct("n_sentences", "matches", -F.col("way"))).alias("x"))
    return best.select("d.doc_id", "license", "x.rule", "x.n_sentences", "x.matches")
