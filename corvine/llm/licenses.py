"""License scans by canonical digests.

A text is brought to a canonical form by native expressions: lower case, lines that only state a copyright dropped,
everything but letters and digits as word breaks, equivalent spellings as one. The digest of the whole canonical text, and
of each of its lines, is hash-joined to the digests of known license texts and notices, which are made by the same
expressions. Only digests are joined, never texts; what matches is few rows, and the known table is broadcast only if
Spark finds it small.

Defined results: a null text is an empty one; an empty canonical text matches nothing; rows that repeat a document are scanned
one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import read, written

#: Words behind 'copyright' that begin no holder's name: with them a line is a part of a wrapped licence text.
NO_HOLDER = "notices?|holders?|owners?|laws?|licen[cs]es?|licen[cs]ors?|statements?|statutes?|and|or|in|on|of|is|to|as|for|with|by law|that|this|permission|disclaimers?|interests?|status|claims?|protections?|treaty|treaties|acts?|rights?|date|terms?|ownership|information|under|applies|if|does|resulting|doctrines?|restrictions?|assignments?|works?|permissions?|exceptions?|limitations?"
#: Lines that only state a copyright, before lowering: the word with a sign, a year, a place holder or a bare name behind it.
COPYRIGHT = (
    r"^[^\p{L}\p{N}]*(?:(?i:all rights reserved)|©|\((?i:c)\)\s*(?:(?i:copyright)|©|[\[<{]|\d{4})"
    r"|(?i:copyright)[\s:,]*(?:$|©|\((?i:c)\)|[\[<{]|\d{4}|(?!(?i:" + NO_HOLDER + r")\b)(?:(?i:by|the)\s+)*(?!(?i:" + NO_HOLDER + r")\b)\p{Lu}))"
)
#: The same for SQL, whose patterns can't look ahead: a line is dropped by the first, or by the second and not the third.
SQL_COPYRIGHT = tuple(
    r"^[^\p{L}\p{N}]*" + x
    for x in (
        r"((?i:all rights reserved)|©|\((?i:c)\)\s*((?i:copyright)|©|[\[<{]|\d{4})|(?i:copyright)[\s:,]*($|©|\((?i:c)\)|[\[<{]|\d{4}))",
        r"(?i:copyright)[\s:,]*((?i:by|the)\s+)*\p{Lu}",
        r"(?i:copyright)[\s:,]*((?i:by|the)\s+)*(?i:" + NO_HOLDER + r")\b",
    )
)
#: Spellings that count as one (fixed values).
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("noninfringement", "non  infringement"),
    ("noncommercial", "non  commercial"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("wilful", "willful"),
    ("https", "http"),
    ("v2", "version  2"),
    ("v3", "version  3"),
)
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MAY_USE = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_DISCLAIMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_HOLDERS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole texts and one-line notices of well-known licenses (fixed values).
KNOWN = (
    ("MIT", "text", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "text", "ISC License\n\n" + _MAY_USE + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _DISCLAIMS),
    ("0BSD", "text", "BSD Zero Clause License\n\n" + _MAY_USE + ".\n\n" + _DISCLAIMS),
    ("BSD-2-Clause", "text", "BSD 2-Clause License\n\n" + _REDISTRIBUTION + "\n\n" + _HOLDERS),
    ("BSD-3-Clause", "text", "BSD 3-Clause License\n\n" + _REDISTRIBUTION + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _HOLDERS),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "notice", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
)


#: Digests of the canonical forms of further whole texts, as they are published (fixed values).
DIGESTS = (
    ("MIT", "b394918a083200adf8c5061924bc22de28062756b62d30b8e876d73b78acef8e"),  # without its title
    ("MIT", "af1716b199e1387a1d7c9da7d827c72dcc9508ff1be0e437b94dd4141a9a9573"),  # "The MIT License (MIT)"
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
)
#: Licenses that an SPDX line may name, and what else the name may end with.
SPDX = "MIT ISC 0BSD BSD-2-Clause BSD-3-Clause Apache-2.0 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-ND-4.0 Unlicense Zlib BSL-1.0 WTFPL GFDL-1.2 GFDL-1.3 Artistic-2.0".split()
GNU_ENDS = ("-only", "-or-later", "+")
#: Lines of standard headers, beside those of ``KNOWN``.
HEADERS = (
    *[(name, "notice", f"SPDX-License-Identifier: {name}{end}") for name in SPDX for end in ("", *(GNU_ENDS if "GPL" in name or "GFDL" in name else ()))],
    ("Apache-2.0", "notice", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def canonical_line(line: Column) -> Column:
    """One lower-case line in canonical form; the words stand between two spaces each until all spellings are done."""
    line = F.concat(F.lit("  "), F.regexp_replace(line, r"[^\p{L}\p{N}]+", "  "), F.lit("  "))
    for one, other in SPELLINGS:
        line = F.replace(line, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(F.regexp_replace(line, " +", " "))


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, without copyright lines and empty ones."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    lines = F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(COPYRIGHT)))
    return F.filter(F.transform(lines, lambda x: canonical_line(F.lower(x))), lambda x: x != "")


def digested(texts: DataFrame) -> DataFrame:
    """Replaces ``text`` by digest (of the whole canonical text, null if that is empty) and line_digests."""
    lines = texts.withColumn("c_lines", canonical_lines(F.col("text"))).drop("text")
    digest = F.when(F.size("c_lines") > 0, F.sha2(F.array_join("c_lines", " "), 256))
    return lines.select("*", digest.alias("digest"), F.transform("c_lines", lambda x: F.sha2(x, 256)).alias("line_digests")).drop("c_lines")


def known_digests(spark: SparkSession, known=KNOWN + HEADERS, digests=DIGESTS) -> DataFrame:
    """(license, kind, known_digest) of (license, kind, text): kind ``text`` matches whole texts, ``notice`` whole lines; and of digests."""
    made = digested(spark.createDataFrame(list(known), "license string, kind string, text string")).select("license", "kind", F.col("digest").alias("known_digest"))
    return made.unionByName(spark.createDataFrame([(a, "text", b) for a, b in digests], "license string, kind string, known_digest string"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, digest, license (of the whole text, or null), notices (licenses of its lines), n_notices."""
    docs = written(digested(docs.select("doc_id", "text").withColumn("l_row", F.monotonically_increasing_id())), "licenses")
    texts = known.filter("kind = 'text'").groupBy("known_digest").agg(F.min("license").alias("license"))
    notices = known.filter("kind = 'notice'").groupBy("known_digest").agg(F.min("license").alias("notice"))
    lines = docs.select("l_row", F.posexplode("line_digests").alias("at", "line_digest"))
    found = lines.join(notices, lines["line_digest"] == notices["known_digest"])
    found = found.groupBy("l_row").agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"), F.count_distinct("at").alias("n_notices"))
    out = docs.join(texts, docs["digest"] == texts["known_digest"], "left")
    out = out.join(found, "l_row", "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), known_digests(spark))


def _sql_line(x: str) -> str:
    out = f"'  ' || regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || '  '"
    for one, other in SPELLINGS:
        out = f"replace({out}, ' {one} ', ' {other} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _sql_lines(text: str) -> str:
    stated, named, other = (f"regexp_matches(x, {_sql_text(p)})" for p in SQL_COPYRIGHT)
    lines = f"list_filter(string_split(coalesce({text}, ''), chr(10)), lambda x: NOT ({stated} OR ({named} AND NOT {other})))"
    return f"list_filter(list_transform({lines}, lambda x: {_sql_line('lower(x)')}), lambda x: x <> '')"


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE = f"""
WITH known(license, kind, text) AS (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)}, {_sql_text(c)})" for a, b, c in KNOWN + HEADERS)}
), k AS (
  SELECT license, kind, sha256(array_to_string({_sql_lines("text")}, ' ')) AS kd FROM known
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({_sql_text(a)}, 'text', {_sql_text(b)})" for a, b in DIGESTS)})
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_sql_lines("text")} AS ls FROM documents
), n AS (
  SELECT r, array_to_string(list_sort(list_distinct(list(license))), ',') AS notices, count(DISTINCT line_no) AS n
  FROM (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM d) JOIN (SELECT kd, min(license) AS license FROM k WHERE kind = 'notice' GROUP BY kd) ON sha256(line) = kd
  GROUP BY r
), w AS (
  SELECT r, doc_id, CASE WHEN len(ls) > 0 THEN sha256(array_to_string(ls, ' ')) END AS digest FROM d
)
SELECT w.doc_id, w.digest, t.license, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices
FROM w LEFT JOIN n USING (r) LEFT JOIN (SELECT kd, min(license) AS license FROM k WHERE kind = 'text' GROUP BY kd) t ON w.digest = t.kd
"""
