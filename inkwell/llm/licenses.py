"""License scan by canonical digests.

Texts are brought to a canonical form (case, punctuation, white space, copyright lines, equivalent spellings) and the
digest of a whole text is looked up among the digests of known licenses by a hash join, that of each line among the
one-line notices in place. The known table is fixed and small whatever the corpus, nothing is shuffled. Only texts that have
a word which every known text has are brought to the canonical form.

Null is an empty text; empty texts match nothing. One row per row: repeated and null ids have rows of their own.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_WARRANTY}"""
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "This work is licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License", "MIT License"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License", "Licensed under the BSD 3-Clause License"),
    **{f"CC-{k.replace(' ', '-')}-4.0": tuple(f"{a} under {c}" for a in ("Licensed", "This work is licensed", "Released") for c in (f"CC {k} 4.0", f"a CC {k} 4.0 license")) for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    "CC0-1.0": ("Released under CC0 1.0", "Licensed under CC0 1.0"),
}
KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": (_MIT, "MIT License\n\n" + _MIT, "The MIT License\n\n" + _MIT, "The MIT License (MIT)\n\n" + _MIT),
    "ISC": tuple(h + "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY for h in ("", "ISC License\n\n")),
    "0BSD": tuple(h + "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY for h in ("", "BSD Zero Clause License\n\n")),
    "BSD-2-Clause": tuple(h + _BSD + _BSD_END for h in ("", "BSD 2-Clause License\n\n")),
    "BSD-3-Clause": tuple(h + _BSD + _BSD_3 + _BSD_END for h in ("", "BSD 3-Clause License\n\n")),
}
#: Long licences by the length and digest of their canonical form: as published, and up to, with and without, the end of their terms.
DIGESTS = (
    ("Apache-2.0", 9757, "88a60b0e813b2dd0f167ec17fe0aae1381b938d4991fdb8ac6d755d36f6d9926"),
    ("Apache-2.0", 8743, "4dd13786c18cd3a5fa4fdf021faaee762d35a63f17ff0e8354b48c8edd4b950d"),
    ("Apache-2.0", 8715, "915df904ae71727b3441742cceace133cbbd6d4e657643c0a8d4388681a5f3b4"),
    ("GPL-1.0", 11698, "ce5422a3a937932130d8b0c889bfd02dd1666e316cc57291f48a9554009f6941"),
    ("GPL-1.0", 9411, "8252f882d326b2c5f96479c3142ac0465bebea0e9cd5eaa60b48b88a6ee4fcdd"),
    ("GPL-1.0", 9383, "5d32a146e9387e4dbdb412ce375432fb9478f59eb67cc8f0569303dfd349e1da"),
    ("GPL-2.0", 17105, "c8efdfb9467fd07eeb3d0a514f420991a287cac282844664339645b5a45305d4"),
    ("GPL-2.0", 14471, "1fa2715b29ab987de0fdb0baf05277e215313e6b06980f76660d234150051e47"),
    ("GPL-2.0", 14443, "1099c04778013b26818b96ef64cc1d32ade750d72118cad8231e03c398780fe3"),
    ("GPL-3.0", 33252, "7fb251d0ae81ee8bd915f61d7154d53929bed6e4e25046c75051d9612f661ea3"),
    ("GPL-3.0", 30814, "7693470ead0b4c76369625333774f3d8d97a69b35b9e865ad15f2bded441eba4"),
    ("GPL-3.0", 30786, "52385985fded8114e6559c1f2adb6ab1498d8885c4f0fc28cb54dcf160d98150"),
    ("LGPL-2.0", 23928, "8c3756769b0dc706e04263d284c4623c7f08aa95e1f02b9c59989d3e15b39881"),
    ("LGPL-2.0", 22138, "c9d8524b89297ab8d97269f2f893b332c503ad7ff21ccf8ae6beaeade3b4da55"),
    ("LGPL-2.0", 22110, "d3a6459c9a1672a6e53e61dd7f62c1e4a99264430c8ccba93fe780f8e3882186"),
    ("LGPL-2.1", 25018, "cb1fc6f69f8e28593537a71d361551719f62e6229bb726a61da42d0e5bd3f980"),
    ("LGPL-2.1", 23229, "90dce7158b9133af8e4876f1836103c1b7f2daf3bbb7f0c9cd4b3604b66ac5b3"),
    ("LGPL-2.1", 23201, "c556e22c5ee51c0eab15522f971430331532cedf8dee817d838eb1521e8ef713"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22313, "09b525d4e8abb011986bcd243645c7c52882f4bb9ff0dc349a45284ab256482e"),
    ("MPL-2.0", 14268, "d31aef4f38d92e3bb1b05710d1106de37a2511502a7ce31645d91a2c133f6696"),
    ("GFDL-1.2", 19579, "ac6f9094db2f5659e7315d53872a929f0bd28f3367df3dbd4e45c018d608d9d5"),
    ("GFDL-1.3", 22014, "d327aefdd2db796b259823267121e6b7f4b1ce1fd653b211ce89da8d8dbeb10a"),
    ("CC0-1.0", 6691, "2c38e82767e063fea47333138707c2860484ca66d24e87df718722c86e7fc5e7"),
    ("Artistic-1.0-Perl", 5806, "d1ce9579b2c8d32b706b421d9c42208152298e00849e57ce7da8e906ed3802f2"),
)
for _k, _v in _NOTICES.items():
    KNOWN[_k] = KNOWN.get(_k, ()) + _v

# Steps of the canonical form: (pattern, replacement), alike in Java, RE2 and Python.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u201c\u201d\u2018\u2019\u2013\u2014", "abcdefghijklmnopqrstuvwxyz\"\"''--"
STEPS = (
    (r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|\x{a9}|all rights reserved)[^\n]*", "\n"),
    (r"[\x{00}-\x{09}\x{0b}-\x{2f}\x{3a}-\x{60}\x{7b}-\x{7f}\x{a0}]+", " "),
    (r" *\n[ \n]*", "\n"),
    (r"\b(sub ?)?licen[cs](e|es|ed|ing|ee|ees)\b", "{1}license"),
    (r"\bsub license\b", "sublicense"),
    (r"\b(non) (commercial|infringement)\b", "{1}{2}"),
    (r"\b(version|ver|v) ?([0-9])", "version {2}"),
    (r"\bbusiness interruptions\b", "business interruption"),
)
# A licence's own words may be wrapped before "copyright notice" or "copyright holder"; such lines aren't statements.
STATEMENT = (r"(^|\n)[^a-z0-9\n]*(copyright(?![^a-z0-9]+(?:notices?|holders?|owners?)\b(?! *:))|\(c\)|\x{a9}|all rights reserved)[^\n]*", "\n")


def _python_steps():
    return [(re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", r"\\x\1", p), re.A), r.replace("{1}", r"\1").replace("{2}", r"\2")) for p, r in (STATEMENT, *STEPS[1:])]


def canonical(text: str) -> str:
    """The canonical form, lines kept apart."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    for p, r in _python_steps():
        text = p.sub(lambda m, r=r: m.expand(r) if m.re.groups and r != "\n" else r, text)
    return text.strip(" \n")


def known_digests() -> list[tuple[str, str, int, bool]]:
    """(digest, license, length, whether a single line) of every known text, once each."""
    out = {}
    for name, texts in KNOWN.items():
        for t in texts:
            c = canonical(t)
            flat = c.replace("\n", " ")
            out.setdefault(hashlib.sha256(flat.encode()).hexdigest(), (name, len(flat), "\n" not in c))
    for name, size, digest in DIGESTS:
        out.setdefault(digest, (name, size, False))
    return [(d, *v) for d, v in sorted(out.items())]


def canonical_column(text):
    c = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    for p, r in (STATEMENT, *STEPS[1:]):
        c = F.regexp_replace(c, p, r.replace("{1}", "$1").replace("{2}", "$2"))
    return F.trim(c, F.lit(" \n"))


def _maybe(text):
    """Whether a text may hold anything known: a superset of what the canonical form would tell, and far cheaper."""
    low = F.lower(text)
    return low.contains("licen") | low.contains("permi") | (low.contains("cc") & text.rlike(r"(?i)under[^a-z0-9]+cc"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, license (of the whole text, null if none), n_lines (lines that are a known notice), notices.

    notices joins the distinct licenses of such lines in order, '' without.
    """
    known = known_digests()
    whole = F.broadcast(docs.sparkSession.createDataFrame([(d, n) for d, n, _, _ in known], "__digest string, license string"))
    notices = [(d, n, s) for d, n, s, one in known if one]
    names = F.create_map(*(F.lit(x) for d, n, _ in notices for x in (d, n)))
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.when(_maybe(text), canonical_column(text)).alias("__c"))
    digest = F.when(F.length("__c").isin(sorted({s for _, _, s, _ in known})), F.sha2(F.translate("__c", "\n", " "), 256))
    lines = F.filter(F.split("__c", "\n", -1), lambda x: F.length(x).isin(sorted({s for _, _, s in notices})))
    rows = rows.select("__id", digest.alias("__digest"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("__lines"))
    rows = rows.withColumn("__found", F.filter("__lines", lambda x: x.isin([d for d, _, _ in notices])))
    said = F.array_join(F.array_sort(F.array_distinct(F.transform("__found", lambda x: F.element_at(names, x)))), ",")
    joined = rows.join(whole, "__digest", "left")
    return joined.select(F.col("__id").alias(id_col), "license", F.coalesce(F.size("__found"), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(said, F.lit("")).alias("notices"))


def license_sql() -> str:
    """The same over `documents` for DuckDB."""

    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    c = f"translate(coalesce(text, ''), {quoted(UPPER)}, {quoted(LOWER)})"
    # RE2 can't look ahead: the words that don't make a statement are marked before and restored after that step.
    marks = [(r"copyright([^a-z0-9]+(?:notices?|holders?|owners?)\b)", "copywrong{1}"), (r"copywrong([^a-z0-9]+(?:notices?|holders?|owners?) *:)", "copyright{1}")]
    for p, r in (*marks, STEPS[0], ("copywrong", "copyright"), *STEPS[1:]):
        c = f"regexp_replace({c}, {quoted(p)}, {('chr(10)' if r == chr(10) else quoted(r.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')))}, 'g')"
    values = ", ".join(f"({quoted(d)}, {quoted(n)}, {'true' if one else 'false'})" for d, n, _, one in known_digests())
    return f"""
WITH known(digest, name, one) AS (VALUES {values}),
c AS (SELECT doc_id, trim({c}, ' ' || chr(10)) AS c FROM documents),
units AS (SELECT doc_id, true AS whole, sha256(replace(c, chr(10), ' ')) AS digest FROM c
          UNION ALL SELECT doc_id, false, sha256(u) FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS u FROM c) WHERE length(u) < 200),
found AS (SELECT doc_id, max(name) FILTER (WHERE whole) AS license, count(*) FILTER (WHERE NOT whole) AS n_lines,
                 coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE NOT whole), '') AS notices
          FROM units JOIN known USING (digest) GROUP BY doc_id)
SELECT doc_id, license, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(notices, '') AS notices FROM documents LEFT JOIN found USING (doc_id)"""
