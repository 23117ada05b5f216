"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent spellings no longer matter) and the SHA-256 of the
whole form is looked up among the digests of known licences. Each document is looked up as a whole, and so is each of its lines, since
notices stand on lines of their own; a document says what it is and which notices it holds.

A whole text whose digest is not known is looked up once more by its bare form, among the bare digests of whole licences (licence_digests.py):
titles, 'all rights reserved', comment marks, list numbers, who is named in a BSD clause and the publisher's address are no part of it, and
of the lines that begin with 'copyright' only statements (a year, (c), a bracket or a name follows) go. Column digest is the canonical one.

Licences within a longer file are found by their one-line notices alone. Only lines that start with the same letters as a known text are brought to the canonical form.
The known texts are a fixed table of some dozen rows, so its broadcast has a size bound; hot documents and lines never meet in a shuffle.

Defined results: null, empty and white texts have no digest and match nothing; a match on a line counts once per line; repeated rows each
get their row; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licence_digests import BARE

# Texts of public licences and their usual notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT (notice)": "Released under the MIT license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
}

#: Steps of the canonical form after lower-casing: pattern, replacement, and strings of which each match holds one (none: always tried).
#: Both Java and RE2 read the patterns alike.
STEPS = [
    (r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*", r"\n", ("copyright", "(c)", "©")),
    (r"https?://", " ", ("://",)),
    (r"[^\p{L}\p{N}]+", " ", ()),
    (r"\blicence(s|d)?\b", r"license\1", ("licence",)),
    (r"\bsub license", "sublicense", ("sub license",)),
    (r"\bcopyright (owner|holder)s?\b", "copyright holder", ("copyright owner", "copyright holder")),
    (r"\bnon infring", "noninfring", ("non infring",)),
    (r"\backnowledgement", "acknowledgment", ("acknowledgement",)),
]

#: No step changes the first letters of a form's first word, this many at most, but for a protocol that goes.
START_LETTERS, PROTOCOL = 3, "htt"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _step(text: Column, pattern: str, to: str, held: tuple[str, ...]) -> Column:
    to = to.replace("\\1", "$1").replace("\\n", "\n")
    if not held:
        return F.regexp_replace(text, pattern, to)
    return _once(text, lambda x: F.when(reduce(or_, [F.contains(x, F.lit(h)) for h in held]), F.regexp_replace(x, pattern, to)).otherwise(x))


def canonical(text: Column) -> Column:
    return F.trim(reduce(lambda out, step: _step(out, *step), STEPS, F.lower(text)))


#: Lines that state a copyright, behind comment marks, in Java's patterns.
STATEMENT = (
    r"(?m)^[^\p{L}\p{N}\n(©]*(?:(?i:portions )?(?i:copyright)[ \t]*(?:[,:]?[ \t]*(?:\([cC]\)|©|&copy;|[0-9]{4}|[<\[{]|(?i:by)\b)"
    r"|[ \t](?!(?:Holder|Owner|Notice|Law|Licen[cs]e|Act|And|Or|In|Of|To|The|Treaty|Interest))\p{Lu}\p{Ll})|\([cC]\)[ \t]*(?:(?i:copyright)|©|[0-9]{4})|©)[^\n]*"
)
COMMENT_WORD = r"(?m)^[ \t]*(?:dnl|rem|REM)[ \t]"
_CLAUSE, _SHORT = "(?:[023]|zero|two|three) clause", "(?:mit|x11|expat|isc|zlib|0bsd)"

#: Steps of the bare form after the canonical ones, as in STEPS.
BARE_STEPS = [
    (r"(?:^| )all rights reserved(?= |$)", "", ("all rights reserved",)),
    (rf"^ ?(?:the )?(?:unlicense|(?:{_SHORT}|zlib libpng|bsd(?: {_CLAUSE})?|{_CLAUSE} bsd|(?:new|modified|revised|simplified|freebsd) bsd|bsd {_CLAUSE} (?:new or revised|simplified)) license(?: (?:{_SHORT}|(?:bsd )?{_CLAUSE}(?: license)?))?) ", "", ()),
    (r"(^| )[0-9a-c] (?=redistributions |neither the name )", r"\1", ("redistributions",)),
    (r"neither the names? of .{1,100}? nor the names of (?:its|any|their) contributors", "neither the name of the copyright holder nor the names of its contributors", ("nor the names of",)),
    (r"(?:51 franklin st|59 temple pl|675 mass ave).{1,60}? usa(?= |$)", "", ("51 franklin", "59 temple", "675 mass")),
    (r" +", " ", ()),
]

#: Each known bare form holds one of these, and no step makes one where there was none.
BARE_WORDS = ("licens", "licenc", "permission", "redistribut", "public domain")


def bare_digest(text: Column) -> Column:
    """The digest of the bare form; null where nothing is left or no known bare form can be."""
    stated = F.regexp_replace(F.regexp_replace(text, COMMENT_WORD, ""), STATEMENT, "")
    form = F.trim(reduce(lambda out, step: _step(out, *step), BARE_STEPS, F.trim(reduce(lambda out, step: _step(out, *step), STEPS[1:], F.lower(stated)))))
    hashed = _once(form, lambda x: F.when(x != "", F.sha2(x, 256)))
    return _once(F.lower(text), lambda low: F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in BARE_WORDS]), hashed))


def digest(text: Column) -> Column:
    """The digest of the canonical form; null where nothing is left."""
    return _once(canonical(text), lambda form: F.when(form != "", F.sha2(form, 256)))


def start(line: Column) -> Column:
    """The first letters of a line's first word: lines whose canonical forms are equal have the same, but for those that begin with a protocol."""
    return F.regexp_extract(F.lower(line), rf"^[^\p{{L}}\p{{N}}]*+([\p{{L}}\p{{N}}]{{1,{START_LETTERS}}})", 1)


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """licence, digest, start: one row per known text."""
    texts = spark.createDataFrame([*known.items()], "licence string, text string")
    return texts.select("licence", digest(F.col("text")).alias("digest"), start(canonical(F.col("text"))).alias("start"))


def bare_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """bare, bare_licence: one row per known text and per whole licence of licence_digests.py."""
    texts = spark.createDataFrame([*known.items()], "bare_licence string, text string").select(bare_digest(F.col("text")).alias("bare"), "bare_licence")
    return texts.union(spark.createDataFrame([*BARE.items()], "bare string, bare_licence string")).dropDuplicates(["bare"])


def scan(units: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """units with digest and licence (null if unknown): the entire text of each is looked up. known is small and fixed."""
    return units.withColumn("digest", digest(F.col(text))).join(F.broadcast(known.select("digest", "licence")), "digest", "left")


def scan_documents(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, licence of the whole text, notices (licences of single lines, joined by '|' in order of lines), n_notices."""
    rows = docs.select("doc_id", F.col("text"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"))
    lines = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line", "unit"))
    starts = known.select("start").union(known.sparkSession.createDataFrame([(PROTOCOL,)], "start string")).distinct()
    lines = lines.withColumn("start", start(F.col("unit"))).join(F.broadcast(starts), "start", "left_semi")
    hits = scan(lines, known, "unit").where("licence is not null").select("doc_id", "text_key", "line", "licence").distinct()
    by_doc = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).agg(F.sort_array(F.collect_list(F.struct("line", "licence"))).alias("found"))
    whole = scan(rows, known).withColumn("bare", F.when(F.col("licence").isNull(), bare_digest(F.col("text"))))
    whole = whole.join(F.broadcast(bare_digests(known.sparkSession)), "bare", "left").select("doc_id", "text_key", "digest", F.coalesce("licence", "bare_licence").alias("licence"))
    out = whole.join(by_doc, whole["doc_id"].eqNullSafe(by_doc["hit_id"]) & (F.col("text_key") == F.col("hit_key")), "left")
    names = F.coalesce(F.col("found.licence"), F.array().cast("array<string>"))
    return out.select("doc_id", "digest", "licence", F.array_join(names, "|").alias("notices"), F.size(names).alias("n_notices"))


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"), known_digests(spark))


def _sql_form(text: str) -> str:
    out = f"lower({text})"
    for pattern, to, _ in STEPS:
        to = f"'{to}'" if "\\n" not in to else "chr(10)"
        pattern = pattern.replace("\\n", "\n")
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    return f"trim({out}, ' ')"


def _sql_digest(text: str) -> str:
    return f"case when {_sql_form(text)} <> '' then sha256({_sql_form(text)}) end"


SQL = f"""
with k as (select licence, {_sql_digest("text")} as digest from (values {", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in KNOWN.items())}) v(licence, text)),
d as (select doc_id, {_sql_digest("text")} as digest, string_split(text, chr(10)) as lines from documents),
u as (select doc_id, unnest(lines) as unit, generate_subscripts(lines, 1) as line from d),
h as (select doc_id, string_agg(licence, '|' order by line) as notices, count(*)::int as n_notices
      from (select doc_id, line, {_sql_digest("unit")} as digest from u) join k using (digest) group by doc_id)
select d.doc_id, d.digest, k.licence, coalesce(h.notices, '') as notices, coalesce(h.n_notices, 0)::int as n_notices
from d left join k on d.digest = k.digest left join h on d.doc_id = h.doc_id
"""
