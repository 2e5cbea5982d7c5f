"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to two canonical forms: lower case, everything but letters and digits as single spaces, equivalent
spellings as one; in the first form lines with copyright notices are left out, in the second nothing is. A notice is a mark (copyright,
(c), ©) with a second mark, a year or a placeholder after it, or "all rights reserved" alone on its line; clauses that merely
begin with "copyright" or "(c)" stay. The SHA-256 digests of both forms are joined with those of known licences and notices, also
in both forms. So a text is found under any holder's notice, and, as the second form does not see lines, however a text with its own notice is wrapped.
Entire texts are looked up, and each line as a text of its own, since notices stand alone on a line. The known
list is a catalogue, by default the texts, titled texts and notices below; it is bounded (digests and names only), hence
broadcast. Texts that two licences share have both names, joined by commas.

Defined results: a null or empty text has no licence, as has one whose canonical form is empty; repeated rows get equal
results; an empty table gives no rows; a very long text is looked up whole, like any other. Other columns play no part.
"""

from __future__ import annotations

from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import read, text_of

# Public licence texts and usual one-line notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Files of license_texts by identifier.
FILES = {"Apache-2.0": "Apache-2.0", "Artistic-1.0": "Artistic", "BSD-3-Clause": "BSD", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
# Titles that stand above the texts.
TITLES = {
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "Zero Clause BSD License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
LAST_TERM = "END OF TERMS AND CONDITIONS"
NOTICES = [
    ("0BSD", ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", ISC),
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Unlicense", UNLICENSE),
]


def _catalogue() -> list[tuple[str, str]]:
    """(license, text): notices and texts, without the numbers of their clauses too, under each usual title, and full texts with and without what follows their terms."""
    known = list(NOTICES) + [("ISC", ISC.replace("and/or distribute", "and distribute"))]
    known += [("Unlicense", f"{UNLICENSE}\nFor more information, please refer to <{scheme}://unlicense.org/>") for scheme in ("http", "https")]
    known += [(name, text.replace("\n1. ", "\n").replace("\n2. ", "\n").replace("\n3. ", "\n")) for name, text in known if text.startswith(BSD_HEAD)]
    known += [(name, f"{title}\n{text}") for name, text in known if len(text) > 400 for title in TITLES.get(name, [])]
    for name, file in FILES.items():
        text = resources.files(__package__).joinpath("license_texts", file).read_text("utf-8")
        known.append((name, text))
        if LAST_TERM in text:
            known.append((name, text[: text.index(LAST_TERM) + len(LAST_TERM)]))
    return known


KNOWN = _catalogue()
# Equivalent spellings, as words of the canonical form.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
]
# What marks a notice; a line feed ends a line, nothing else.
MARK = r"(?:copyright|\(c\)|©|&copy;)"
DATED = r"[<\[{(]?(?:(?:19|20)\d\d|yyyy|years?|dates?)\b"
NOTICE_LINE = rf"^[^\p{{L}}\p{{N}}\n]*(?:{MARK}[ \t,:]*(?:{MARK}|{DATED})[^\n]*|all rights reserved[^\p{{L}}\p{{N}}\n]*)$"
OTHER = r"[^\p{L}\p{N}]+"


def _spelled(low: Column) -> Column:
    """Words by single spaces, in one spelling. Spellings are only looked for where the text has one of them."""
    plain = F.trim(F.regexp_replace(low, OTHER, " "))
    spelled = reduce(lambda c, p: F.regexp_replace(c, rf"\b{p[0]}\b", p[1]), EQUIVALENT, plain)
    return F.when(plain.rlike(r"\b(?:" + "|".join(a for a, _ in EQUIVALENT) + r")\b"), spelled).otherwise(plain)


def canonical(text: Column) -> Column:
    """The form without notices."""
    return _spelled(F.regexp_replace(F.lower(text), "(?md)" + NOTICE_LINE, ""))


def complete(text: Column) -> Column:
    """The form with all lines; null where it is the same, as the text has no notice."""
    return F.when(F.lower(text).rlike("(?md)" + NOTICE_LINE), _spelled(F.lower(text)))


def default_catalogue(spark: SparkSession) -> DataFrame:
    """(license, text) as a local table."""
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN) + " AS k(license, text)")


def _forms(text: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(canonical(text), complete(text))))


def known_digests(catalogue: DataFrame) -> DataFrame:
    rows = catalogue.select("license", F.explode(_forms(F.col("text"))).alias("canonical")).where("canonical != ''")
    return rows.select("license", F.sha2("canonical", 256).alias("digest")).groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("license"))


#: By the first word of a spelling in canonical form, the first words that it may have had before.
SPELLED = {b.split()[0]: sorted({x.split()[0] for x, y in EQUIVALENT if y.split()[0] == b.split()[0]}) for _, b in EQUIVALENT}


def first_words(catalogue: DataFrame) -> DataFrame:
    """(first): words with which a line must begin to be in the catalogue, in all spellings."""
    before = F.create_map(*[x for k, v in SPELLED.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    first = F.regexp_extract("form", r"^[\p{L}\p{N}]+", 0)
    words = catalogue.select(F.explode(_forms(F.col("text"))).alias("form")).select(first.alias("w")).select(F.explode(F.concat(F.array("w"), F.coalesce(F.try_element_at(before, F.col("w")), F.array().cast("array<string>")))).alias("first"))
    return words.where("first != ''").distinct()


def scan(docs: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """doc_id, text_license (of the entire text, or null), line_licenses (of single lines, in order of name, or empty), n_license_lines, text_digest. catalogue: (license, text), some thousand rows at most."""
    catalogue = default_catalogue(docs.sparkSession) if catalogue is None else catalogue
    known, firsts = F.broadcast(known_digests(catalogue)), F.broadcast(first_words(catalogue))
    rows = docs.select("doc_id", text_of(docs).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("tag"))
    # a row of a repeated document must not count its lines twice: lines are gathered once for each (doc_id, text)
    lines = rows.select("doc_id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("first", F.regexp_extract(F.lower("line"), r"[\p{L}\p{N}]+", 0))
    # most lines begin with a word with which no entry begins: they need no canonical form
    lines = lines.join(firsts, "first", "left_semi").select("doc_id", "tag", "at", F.explode(_forms(F.col("line"))).alias("form")).withColumn("digest", F.sha2("form", 256))
    hits = lines.join(known, "digest").dropDuplicates(["doc_id", "tag", "at"]).groupBy("doc_id", "tag").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"), F.count("*").alias("n"))
    whole = rows.select("doc_id", "tag", F.sha2(canonical(F.col("text")), 256).alias("text_digest"), F.sha2(complete(F.col("text")), 256).alias("complete_digest"))
    for digest in ("text_digest", "complete_digest"):
        whole = whole.join(known.select(F.col("digest").alias(digest), F.col("license").alias(f"{digest}_license")), digest, "left")
    whole = whole.withColumn("text_license", F.coalesce("text_digest_license", "complete_digest_license"))
    found = whole.alias("w").join(hits.alias("h"), F.col("w.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("w.tag") == F.col("h.tag")), "left")
    return found.select("w.doc_id", "text_license", F.coalesce("names", F.lit("")).alias("line_licenses"), F.coalesce("n", F.lit(0)).alias("n_license_lines"), "text_digest")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_words(lines: str) -> str:
    """From a list of lower-case lines to the canonical form: runs of letters and digits, in one spelling."""
    words = rf"array_to_string(regexp_extract_all(array_to_string({lines}, chr(10)), '[\p{{L}}\p{{N}}]+'), ' ')"
    return reduce(lambda c, p: rf"regexp_replace({c}, '\b{p[0]}\b', '{p[1]}', 'g')", EQUIVALENT, words)


#: A line is a notice if, decoration and marks taken off its head, marks were two or a date follows; or if nothing but the three words is on it.
_SQL_NOTICE = r"""(
  regexp_matches(x, '^[^\p{L}\p{N}]*(copyright|\(c\)|©|&copy;)[ \t,:]*(copyright|\(c\)|©|&copy;)')
  OR regexp_matches(x, '^[^\p{L}\p{N}]*(copyright|\(c\)|©|&copy;)[ \t,:]*[<\[{(]?(19[0-9][0-9]|20[0-9][0-9]|yyyy|year|years|date|dates)\b')
  OR array_to_string(regexp_extract_all(x, '[\p{L}\p{N}]+'), ' ') = 'all rights reserved' AND regexp_matches(x, 'all rights reserved'))"""
_SQL_LINES = "string_split(lower({0}), chr(10))"


def _sql_forms(column: str) -> str:
    lines = _SQL_LINES.format(column)
    return f"list_distinct([{_sql_words(f'list_filter({lines}, lambda x: NOT {_SQL_NOTICE})')}, {_sql_words(lines)}])"


OP4_SQL = f"""
WITH raw(license, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}
), forms AS (
  SELECT license, unnest({_sql_forms("text")}) AS form FROM raw
), known AS (
  SELECT sha256(form) AS digest, string_agg(DISTINCT license, ',' ORDER BY license) AS license FROM forms WHERE form <> '' GROUP BY form
), lines AS (
  SELECT doc_id, row_number() OVER () AS pos, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
), hits AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS names, count(DISTINCT pos) AS n
  FROM (SELECT doc_id, pos, sha256(unnest({_sql_forms("line")})) AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id
), whole AS (
  SELECT doc_id, {_sql_forms("coalesce(text, '')")} AS forms, sha256({_sql_words(f"list_filter({_SQL_LINES.format(chr(39).join(['coalesce(text, ', '', ')']))}, lambda x: NOT {_SQL_NOTICE})")}) AS text_digest FROM documents
), found AS (
  SELECT doc_id, first(license ORDER BY pos) AS license FROM (SELECT doc_id, unnest(forms) AS form, generate_subscripts(forms, 1) AS pos FROM whole) JOIN known ON digest = sha256(form) GROUP BY doc_id
)
SELECT whole.doc_id, found.license AS text_license, coalesce(hits.names, '') AS line_licenses,
       coalesce(hits.n, 0) AS n_license_lines, whole.text_digest
FROM whole LEFT JOIN found USING (doc_id) LEFT JOIN hits USING (doc_id)
"""
