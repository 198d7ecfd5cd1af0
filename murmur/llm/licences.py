"""Licence scans by canonical digests.

A text is brought to a canonical form, in which case, punctuation, copyright lines and equivalent spellings no longer
show; its digest is looked up among those of known licences by a hash join. Both the entire text and each of its lines,
which may be a licence's entire notice, are looked up. Everything is DataFrame expressions.
"""

from __future__ import annotations

import pkgutil
import textwrap

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Steps of the canonical form, in order: pattern and replacement ($n: a group), valid for Java and RE2 alike; lines are
#: in lower case. Fixed values; the spellings follow the equivalences that licence matching guidelines publish.
LINES = (
    # copyright lines, and list or comment marks before a line
    (r"^[ \t>#*/;%|!-]*(?:copyright|\(c\)|©)[^\n]*$", ""),
    (r"^[ \t>#*/;%|!-]*all rights reserved[^\n]*$", ""),
    (r"https?://(?:www\.)?", ""),
)
#: Words of licences' own sentences that follow "copyright", where a line break may put it first.
OWN_WORDS = r"(?:and|or|in|is|to|of|on|for|holders?|owners?|owned|notices?|laws?|licen[cs]es?|interests?|statements?|acts?|protection|rights?|treaty|treaties|status|infringement|claims?)"
_HEAD, _YEAR = r"^[ \t>#*/;%|!-]*", r"(?:[12][0-9]{3}|[<\[{])"
#: The copyright line that the operator drops, for Java, in a line as it is written: copyright, then (c), a year or a name
#: (or nothing); (c), then copyright, a year or only a name. The first of LINES, which the SQL has, takes every line that
#: begins with one of these words, and with it words of licences.
NOTICE = (
    rf"{_HEAD}(?:©|(?i:copyright)[ \t:,]*(?:(?i:\(c\)|©|&copy;|copyright)|\r?$|{_YEAR}|(?:(?i:by|the)[ \t]+)*(?!(?i:{OWN_WORDS})\b)\p{{Lu}})"
    rf"|(?i:\(c\))[ \t]*(?:(?i:copyright)[ \t:,]*(?:(?i:\(c\)|by)|{_YEAR}|\p{{Lu}})|{_YEAR}|(?i:by[ \t]+)?(?:\p{{Lu}}[^ \t]*[ \t]*|(?:and|of|the|for)[ \t]+){{1,8}}$))"
)
#: What must be in a line for one of LINES to apply.
LINE_MARKS = ("copyright", "(c)", "©", "all rights reserved", "http")
MARKS = (
    (r"[^\p{L}\p{N}]+", " "),
)
SPELLINGS = (
    (r"\b(licen|offen|defen|preten)ce", "$1se"),
    (r"\bpractis", "practic"),
    (r"\b(author|capital|categor|custom|emphas|fulfil|general|initial|internal|local|maxim|minim|neutral|normal|optim|organ|real|recogn|special|standard|summar|util)is(e|ed|es|er|ers|ing|ation|ations)\b", "$1iz$2"),
    (r"\banalys(e|ed|es|ing)\b", "analyz$1"),
    (r"\b(catalog|analog|dialog)ue", "$1"),
    (r"\b(favo|hono|labo|colo|behavio|neighbo)ur", "$1r"),
    (r"\b(cent|calib|met)re\b", "$1er"),
    (r"\b(cancel|label|model|signal|travel)l(ed|ing)\b", "$1$2"),
    (r"\b(acknowledg|judg)ement", "$1ment"),
    (r"\bartefact", "artifact"),
    (r"\bprogramme\b", "program"),
    (r"\bwhilst\b", "while"),
    (r"\bfulfill", "fulfil"),
    (r"\bwilful", "willful"),
    (r"\bper cent\b", "percent"),
    (r"\b(sub|non|re) (licens|commercial|distribut)", "$1$2"),
    (r"\bcopyright owner", "copyright holder"),
)
#: Whether any of SPELLINGS applies; all begin at a word.
SPELT = r"\b(?:" + "|".join(p.removeprefix(r"\b") for p, _ in SPELLINGS) + ")"

#: Known licences: SPDX identifier and a text or notice that stands for it. Texts are the licences' own words.
TEXTS = (
    ("MIT", """
        The MIT License (MIT)
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE."""),
    ("ISC", """
        ISC License
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """
        This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
        copyright interest in the software to the public domain. We make this dedication for the benefit of the public
        at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
        For more information, please refer to <https://unlicense.org>"""),
    ("WTFPL", """
        DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
        TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
        0. You just DO WHAT THE FUCK YOU WANT TO."""),
)
#: One-line notices: the names a licence goes by, each put into every frame.
FRAMES = (
    "{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "This software is licensed under the {}", "This project is licensed under the {}",
    "This code is released under the {}", "License: {}", "SPDX-License-Identifier: {}",
)
NAMES = {
    "Apache-2.0": ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT", "MIT License"),
    "ISC": ("ISC", "ISC License"),
    "0BSD": ("0BSD", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause License", "New BSD License"),
    "GPL-2.0-only": ("GPL-2.0-only", "GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0-only": ("GPL-3.0-only", "GNU General Public License, version 3", "GNU General Public License v3.0"),
    "LGPL-2.1-only": ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"),
    "LGPL-3.0-only": ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    "AGPL-3.0-only": ("AGPL-3.0-only", "GNU Affero General Public License, version 3"),
    "MPL-2.0": ("MPL-2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("EPL-2.0", "Eclipse Public License, Version 2.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0-1.0", "CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    "CC-BY-NC-SA-4.0": ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    "WTFPL": ("WTFPL",),
    "Zlib": ("Zlib", "zlib License"),
}


def known_texts() -> list[tuple[str, str]]:
    """Licence and text for all of TEXTS and NAMES in FRAMES: a few hundred, whatever is scanned."""
    return [(k, textwrap.dedent(v).strip()) for k, v in TEXTS] + [(k, f.format(n)) for k, names in NAMES.items() for n in names for f in FRAMES]

#: Titles with which short texts are published; each of TEXTS and PUBLISHED is known with each and without.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
}
#: Texts published as files, in licence_texts: file, licence, where the text begins without its title, and where the
#: advice on using it begins, which many copies leave out.
PUBLISHED = (
    ("Apache-2.0", "Apache-2.0", ("TERMS AND CONDITIONS FOR USE",), ("APPENDIX: How to apply", "END OF TERMS AND CONDITIONS")),
    ("BSD-3-Clause", "BSD-3-Clause", ("Redistribution and use",), ()),
    ("CC-BY-SA-4.0", "CC-BY-SA-4.0", ("Creative Commons Corporation", "Creative Commons Attribution-ShareAlike 4.0 International Public", "By exercising the Licensed Rights"), ("Creative Commons is not a party to its public",)),
    ("CC0-1.0", "CC0-1.0", ("CC0 1.0 Universal", "CREATIVE COMMONS CORPORATION", "Statement of Purpose"), ()),
    ("GPL-2.0-only", "GPL-2.0-only", ("Everyone is permitted", "Preamble"), ("How to Apply These Terms", "END OF TERMS AND CONDITIONS")),
    ("GPL-2.0-only.spdx", "GPL-2.0-only", ("Everyone is permitted", "Preamble"), ("How to Apply These Terms", "END OF TERMS AND CONDITIONS")),
    ("GPL-3.0-only", "GPL-3.0-only", ("Everyone is permitted", "Preamble"), ("How to Apply These Terms", "END OF TERMS AND CONDITIONS")),
    ("LGPL-2.1-only", "LGPL-2.1-only", ("Everyone is permitted", "Preamble"), ("How to Apply These Terms", "END OF TERMS AND CONDITIONS")),
    ("LGPL-3.0-only", "LGPL-3.0-only", ("Everyone is permitted", "This version of the GNU Lesser"), ()),
    ("MPL-2.0", "MPL-2.0", ("1. Definitions",), ()),
    ("WTFPL", "WTFPL", ("Everyone is permitted", "0. You just"), ()),
    ("Zlib", "Zlib", ("This software is provided",), ()),
)


def published_texts() -> list[tuple[str, str]]:
    """Licence and text for all of TEXTS and PUBLISHED, with their titles and without, with the advice on use and without."""
    out = []
    for k, v in TEXTS:
        lines = textwrap.dedent(v).strip().split("\n")
        body = "\n".join(lines[1:] if lines[0] in TITLES.get(k, ()) else lines)
        out += [(k, body)] + [(k, f"{t}\n{body}") for t in TITLES.get(k, ())]
        if k == "Unlicense":  # copies without the link
            out += [(k, body[: body.index("For more information")])]
    for name, k, begins, ends in PUBLISHED:
        text = pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode("utf-8").replace("\f", "\n").strip()
        cuts = [0, *[text.index(b) for b in begins]]
        for end in [len(text), *[text.index(e) for e in ends]]:
            out += [(k, text[b:end]) for b in cuts]
        out += [(k, f"{t}\n{text[cuts[1]:]}") for t in TITLES.get(k, ())]
    return out


def _replaced(text: Column, steps) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def _line_form(line: Column) -> Column:
    """A line in lower case, letters and digits parted by single blanks, empty if it is a copyright line."""
    low = F.lower(line)
    marked = F.contains(low, F.lit(LINE_MARKS[0]))
    for m in LINE_MARKS[1:]:
        marked = marked | F.contains(low, F.lit(m))
    kept = F.when(marked, F.when(line.rlike(NOTICE), "").otherwise(_replaced(low, LINES[1:]))).otherwise(low)
    return F.trim(_replaced(kept, MARKS))


def with_forms(df: DataFrame, text: Column) -> DataFrame:
    """df with __whole, the canonical form of the text, and __lines, those of its lines that have any.

    The form is in lower case, without copyright lines, letters and digits parted by single blanks, with one spelling
    for equivalent ones. Lines are brought to it once; the whole is their join, but spelt as a whole."""
    some = lambda xs: F.filter(xs, lambda x: x != "")
    df = df.withColumn("__plain", some(F.transform(F.split(text, "\n"), _line_form)))
    df = df.withColumn("__joined", F.array_join("__plain", " "))
    df = df.withColumn("__spelt", F.col("__joined").rlike(SPELT))
    whole = F.when(F.col("__spelt"), _replaced(F.col("__joined"), SPELLINGS)).otherwise(F.col("__joined"))
    lines = F.when(F.col("__spelt"), F.transform("__plain", lambda x: _replaced(x, SPELLINGS))).otherwise(F.col("__plain"))
    return df.withColumn("__whole", whole).withColumn("__lines", lines).drop("__plain", "__joined", "__spelt")


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest and license of the known texts; of several with one digest, the first by name."""
    listed = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in texts or known_texts() + published_texts()])
    rows = spark.range(1, numPartitions=1).select(F.inline(listed))
    return with_forms(rows, F.col("text")).where("__whole != ''").groupBy(F.sha2("__whole", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licences: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256, license (of the entire text, or null), notices (licences of its lines, sorted, comma-
    joined, each once) and n_notices (lines that are one).

    licences: digest, license, each digest once; Spark broadcasts them if they are small, as known() is. Every row gives
    a row, whatever it repeats: the lines that match are counted back by a number that each row gets while it is read.
    A null text is empty, its digest that of the empty form, which is no licence. An empty table gives no rows.
    """
    forms = with_forms(docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), F.col("text"))
    rows = forms.select("__row", "doc_id", F.sha2("__whole", 256).alias("canonical_sha256"), F.transform("__lines", lambda x: F.sha2(x, 256)).alias("lines"))
    units = rows.select("__row", "doc_id", "canonical_sha256", F.posexplode(F.concat(F.array("canonical_sha256"), "lines")).alias("place", "digest"))
    found = units.join(licences, "digest", "left").where((F.col("place") == 0) | F.col("license").isNotNull())
    line = F.col("place") > 0
    return found.groupBy("__row", "doc_id", "canonical_sha256").agg(
        F.max(F.when(~line, F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license")))), ",").alias("notices"),
        F.count(F.when(line, F.lit(1))).alias("n_notices"),
    ).drop("__row")


def op1_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), written(known(spark), "licences"))


def _sql() -> str:
    """The same in SQL, but for the texts of published_texts() and for NOTICE, in whose place it has the first of LINES."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"lower({x})"
        for pattern, to in (*LINES, *MARKS):
            out = f"regexp_replace({out}, {quote('(?m)' + pattern)}, {quote(to)}, 'g')"
        out = f"trim({out})"
        for pattern, to in SPELLINGS:
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(to.replace('$', chr(92)))}, 'g')"
        return out

    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known_texts())
    return f"""
with listed(license, text) as (values {values}),
known as (select sha256({form('text')}) as digest, min(license) as license from listed group by 1),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text, sha256({form("coalesce(text, '')")}) as canonical_sha256 from documents),
lines as (select r, unnest(string_split(text, chr(10))) as line from docs),
hits as (
  select r, string_agg(distinct license, ',' order by license) as notices, count(*) as n_notices
  from (select *, sha256({form('line')}) as digest from lines where line <> '') join known using (digest) group by 1
)
select docs.doc_id, docs.canonical_sha256, license, coalesce(notices, '') as notices, coalesce(n_notices, 0) as n_notices
from docs left join known on canonical_sha256 = digest left join hits using (r)
"""


OP1_SQL = _sql()
