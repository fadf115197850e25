"""Licence scan by sentences: normalised sentences to known sentence ids, id sequences to ordered licence rules.

A text is split into sentences as a reader has them: comment signs at the start of lines go, a line's end inside a
sentence is a blank, and a sentence ends at `.!?:` before white space, at a blank line and before a list mark. What is no known sentence as a whole is tried line by line, as notices stand between unfinished
lines of prose. In a sentence, the holder's name in the fixed places of known notices and the opening of
"... is licensed under the ..." are levelled. A rule is an ordered list of sentence ids with any known or unknown
sentences between them.

Scale: native columns only, one pass, no shuffle; sentence and rule tables are literals of the plan, of fixed size.
Every known sentence has one of a few plain words (`TRIGGERS`, `OPENERS`; the tests hold every sentence to it); texts and
sentences without any of them are passed over unsplit.

Defined cases: a null or empty text has no sentences and no licence; a text of any length is split whole; sentences
that are not known are passed over; of several rules that match, the first in order names the licence and all are
listed; repeated rows are judged each by itself; further columns pass through, whatever their names.
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.llm.common import fresh

# -- fixed values ----------------------------------------------------------------------------------------------------

#: Sentences of public licences and notices.
SENTENCES = {
    "mit_title": "MIT License",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit0_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "ncsa_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit_as_is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "as_is": 'The software is provided "as is", without warranty of any kind, express or implied',
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "x11_name": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc_grant_and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd0_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd_terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_as_is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "apache_title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache_terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache_notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache_comply": "You may not use this file except in compliance with the License",
    "apache_at": "You may obtain a copy of the License at",
    "apache_url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache_unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mpl_title": "Mozilla Public License Version 2.0",
    "mpl_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "epl_title": "Eclipse Public License - v 2.0",
    "epl_notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0/",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib_origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "boost_title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost_grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "unlicense_domain": "This is free and unencumbered software released into the public domain",
    "unlicense_free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "wtfpl_title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "postgresql_grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "artistic_terms": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed",
    "cddl_notice": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")',
    "mspl_title": "Microsoft Public License (Ms-PL)",
    "mspl_governs": "This license governs use of the accompanying software",
    "psf_between": 'This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated documentation',
    "beer_title": 'THE BEER-WARE LICENSE" (Revision 42)',
    "beer_retain": "As long as you retain this notice you can do whatever you want with this stuff",
    "cc0_title": "CC0 1.0 Universal",
    "cc0_dedicated": "This work has been dedicated to the public domain",
    "cc0_extent": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "reserved": "All rights reserved",
    "prohibited": "Unauthorized copying of this file, via any medium is strictly prohibited",
    "confidential": "Proprietary and confidential",
}
#: The GNU licences: id, name, version, date of the full text's title.
_GNU = [
    ("GPL-2.0", "General Public License", "2", "June 1991"), ("GPL-3.0", "General Public License", "3", "29 June 2007"), ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"), ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"), ("GFDL-1.3", "Free Documentation License", "1.3", "3 November 2008"),
]
#: Creative Commons: code, name, kind of use.
_CC = [("BY", "Attribution", "open"), ("BY-SA", "Attribution-ShareAlike", "copyleft"), ("BY-ND", "Attribution-NoDerivatives", "restricted"), ("BY-NC", "Attribution-NonCommercial", "restricted"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "restricted"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "restricted")]
_CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
#: Names after "licensed under", beside each licence's id: licence, kind of use, names.
NAMES = [
    ("MIT", "open", ("MIT", "Expat")), ("Apache-2.0", "open", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0")), ("BSD-2-Clause", "open", ("BSD 2-Clause", "Simplified BSD")),
    ("BSD-3-Clause", "open", ("BSD 3-Clause", "New BSD", "Modified BSD")), ("ISC", "open", ("ISC",)), ("Zlib", "open", ("zlib",)), ("BSL-1.0", "open", ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("MPL-2.0", "copyleft", ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0")), ("EPL-2.0", "copyleft", ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0")),
    ("EUPL-1.2", "copyleft", ("EUPL, Version 1.2", "European Union Public Licence 1.2", "EUPL 1.2")), ("OFL-1.1", "open", ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1")), ("Artistic-2.0", "open", ("Artistic License 2.0",)),
    ("Unlicense", "open", ("Unlicense",)), ("CC0-1.0", "open", ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal")), ("CDDL-1.0", "copyleft", ("Common Development and Distribution License 1.0",)), ("PostgreSQL", "open", ("PostgreSQL",)),
]
#: Ordered rules, longer sequences first: licence, kind of use, sentences in order, others may stand between them.
_TEXT_RULES = [
    ("X11", "open", ("mit_grant", "mit_notice", "x11_name")),
    ("MIT", "open", ("mit_title", "mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", "open", ("mit_grant", "mit_notice")),
    ("BSD-4-Clause", "open", ("bsd_terms", "bsd_source", "bsd_binary", "bsd_advert")),
    ("BSD-3-Clause", "open", ("bsd_terms", "bsd_source", "bsd_binary", "bsd_names")),
    ("NCSA", "open", ("ncsa_grant",)),
    ("BSD-2-Clause", "open", ("bsd_terms", "bsd_source", "bsd_binary")),
    ("Apache-2.0", "open", ("apache_title", "apache_terms")),
    ("Apache-2.0", "open", ("apache_notice", "apache_at", "apache_url")),
    ("Apache-2.0", "open", ("apache_notice",)),
    ("Apache-2.0", "open", ("under-Apache-2.0", "apache_comply", "apache_copy")),
    ("MPL-2.0", "copyleft", ("mpl_notice", "mpl_copy")),
    ("MPL-2.0", "copyleft", ("mpl_title",)),
    ("Zlib", "open", ("zlib_as_is", "zlib_grant", "zlib_origin")),
    ("Unlicense", "open", ("unlicense_domain", "unlicense_free")),
    ("MIT-0", "open", ("mit0_grant", "mit_as_is")),
    ("0BSD", "open", ("bsd0_grant",)),
    ("ISC", "open", ("isc_grant",)),
    ("ISC", "open", ("isc_grant_and",)),
    ("EPL-2.0", "copyleft", ("epl_notice",)),
    ("EPL-2.0", "copyleft", ("epl_title",)),
    ("BSL-1.0", "open", ("boost_title", "boost_grant")),
    ("WTFPL", "open", ("wtfpl_title",)),
    ("PostgreSQL", "open", ("postgresql_grant",)),
    ("Artistic-2.0", "open", ("artistic_terms",)),
    ("CDDL-1.0", "copyleft", ("cddl_notice",)),
    ("MS-PL", "open", ("mspl_title", "mspl_governs")),
    ("PSF-2.0", "open", ("psf_between",)),
    ("Beerware", "open", ("beer_title", "beer_retain")),
    ("CC0-1.0", "open", ("cc0_extent",)),
    ("CC0-1.0", "open", ("cc0_title",)),
    ("CC0-1.0", "open", ("cc0_dedicated",)),
]
_LAST_RULES = [("proprietary", "restricted", ("prohibited", "confidential")), ("proprietary", "restricted", ("reserved",))]
#: Every known sentence holds one of these words, or one of the openers before "under".
TRIGGERS = (
    "licen", "permi", "copyright", "warrant", "redistribut", "domain", "unencumbered", "anyone", "eclipse", "cc0", "misrepresented", "reserved", "proprietary", "unauthorized", "advertising", "conditions", "mozilla", "consortium", "liable", "beer", "stuff", "creative",
)
OPENERS = ("released", "distributed", "available", "published", "provided")

# -- normal form: the same replacements in Spark, in SQL and in Python ---------------------------------------------------

_MARK, _LINE = "\u0001", "\u0002"
#: Where a text is cut first; what follows sees one piece at a time.
_CUT = r"[.!?][\"')\]]*[ \t\r\n]+|\n[ \t\r]*\n"
_TO_SENTENCES = [
    (r"\r\n?", "\n"),
    (r"\n[ \t]*(?:[#/*;%|]|--|<!-)[#/*;%!<>|-]*[ \t]*", "\n"),  # comment signs
    (r"spdx-license-identifier:[ \t]*([a-z0-9.+-]+)", f"{_MARK}under $1{_MARK}"),
    (r"\n[ \t]*\n[ \t\n]*", _MARK),
    (f"[\\n{_MARK}][ \\t]*(?:\\(?(?:[0-9]{{1,2}}|[a-z]|[ivx]{{1,4}})[.)]|[-•])[ \\t]+", _MARK),  # list marks
    (r"free software:", "free software"),
    (r":[ \t\n]+", _MARK),
    (r"(permission is hereby granted|permission to use, copy|redistribution and use in source|licensed under the apache license, version)", f"{_MARK}$1"),  # behind a copyright line in texts without line ends
    (r"[.!?][\"')\]]*[ \t\n]+", _MARK),
    (r"\n", _LINE),
    (f"[^a-z0-9{_MARK}{_LINE}]+", " "),
]
_IN_SENTENCE = [
    (r" https ", " http "),
    (r"provided by .+ as is", "provided by holder as is"),
    (r"in no event shall .+ be liable", "in no event shall holder be liable"),
    (r"neither the name of .+ nor the names of (?:its |any |the )?contributors", "neither the name of holder nor the names of contributors"),
    (r"^.{1,80} is free software you can redistribute", "this program is free software you can redistribute"),
    (r"^(?:(?:this|the|these) (?:[a-z]+ ){1,6}(?:is|are|may be) (?:also |hereby |made |being )?)?(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the terms of )?(?:the |an? )?", "under "),
    (r"^(under .+) licen[cs]e$", "$1"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    """The normal form of one sentence."""
    out = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()
    for pattern, by in _IN_SENTENCE:
        out = re.sub(pattern, by.replace("$1", r"\1"), out)
    return out


def _known() -> dict[str, str]:
    out = {normal(text): k for k, text in SENTENCES.items()}
    for spdx, name, version, date in _GNU:
        out[normal(f"GNU {name} Version {version}, {date}")] = f"title-{spdx}"
        free = f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
        out[normal(f"{free}; either version {version} of the License, or (at your option) any later version")] = f"free-{spdx}"
        out |= {normal(f"{free}; version {version}{more}"): f"free-{spdx}" for more in ("", " of the License", " only")}
    for spdx, _, names in all_names():
        out |= {normal(f"licensed under {x}{more}"): f"under-{spdx}" for x in (*names, spdx) for more in ("", " License")}
    return out


def all_names() -> list[tuple[str, str, tuple[str, ...]]]:
    out = [*NAMES]
    for spdx, name, version, _ in _GNU:
        short = spdx.split("-")[0]
        forms = {f"{lead}{name}{sep}{v}" for lead in ("GNU ", "") for sep in (", ", " ") for v in (f"version {version}", f"v{version}", f"version {version} or later", f"v{version}.0")} | {f"{lead}{short}{sep}{version}" for lead in ("GNU ", "") for sep in (" ", " v", "v", " version ")}
        out.append((spdx, "copyleft", (*sorted(forms), f"{spdx}-only", f"{spdx}-or-later", f"{spdx}+")))
    for code, name, use in _CC:
        for v in _CC_VERSIONS:
            kind = "International" if v == "4.0" else "Unported"
            out.append((f"CC-{code}-{v}", use, (f"CC {code} {v}", f"Creative Commons {name} {v}", f"Creative Commons {name} {v} {kind}", f"Creative Commons {name} {v} {kind} Public License")))
    return out


KNOWN = _known()
RULES = [*_TEXT_RULES, *((g[0], "copyleft", (f"{k}-{g[0]}",)) for g in _GNU for k in ("title", "free")), *((spdx, use, (f"under-{spdx}",)) for spdx, use, _ in all_names()), *_LAST_RULES]


def rule_pattern(ids: tuple[str, ...]) -> str:
    """A regular expression over comma-joined sentence ids: these ids in order, any others between them."""
    return "(?:^|,)" + ",(?:.*,)?".join(x.replace(".", "[.]") for x in ids) + "(?:,|$)"


# -- columns ---------------------------------------------------------------------------------------------------------


def _replaced(value: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        value = F.regexp_replace(value, pattern, by)
    return value


def may_hold(text: Column) -> Column:
    """Whether a text in lower case has any trigger: plain searches, a pattern only where its words occur."""
    some = lambda words: reduce(operator.or_, (text.contains(w) for w in words))
    under = text.contains("under") & some(OPENERS) & text.rlike(f"(?:{'|'.join(OPENERS)})[^a-z0-9]+under")
    return some(TRIGGERS) | under


def known_sentences(text: Column) -> Column:
    """The ids of a text's known sentences, in order."""
    ids = F.create_map(*(F.lit(x) for kv in KNOWN.items() for x in kv))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    id_of = lambda s: F.when(may_hold(s) | s.startswith("under "), F.element_at(ids, _replaced(F.trim(s), _IN_SENTENCE)))
    whole = lambda s: F.regexp_replace(s, f"[ {_LINE}]+", " ")
    lines = lambda s: F.when(s.contains(_LINE), F.filter(F.transform(F.split(s, _LINE), id_of), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    ids_of = lambda s: let(id_of(whole(s)), lambda k: F.when(k.isNotNull(), F.array(k)).otherwise(F.when(may_hold(s), lines(s)).otherwise(F.array().cast("array<string>"))))
    flat = lambda piece: _replaced(F.concat(F.lit("\n"), F.translate(piece, _UPPER, _LOWER), F.lit("\n")), _TO_SENTENCES)
    pieces = F.filter(F.split(text, _CUT), lambda x: let(F.lower(x), may_hold))  # lower() once, not in each search
    found = F.flatten(F.flatten(F.transform(pieces, lambda x: F.transform(F.split(flat(x), _MARK), ids_of))))
    return let(F.lower(text), lambda low: F.when(may_hold(low), found).otherwise(F.array().cast("array<string>")))


def scan_licenses(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with sentence_ids (comma-joined), rules (numbers of all that match, from 1), license and use of the first; and the names of the columns."""
    name = {k: fresh(k, docs.columns) for k in ("sentence_ids", "rules", "license", "use")}
    said, rules = F.col(name["sentence_ids"]), F.col(name["rules"])
    # out of a generator of one row, so that the ids are found once and not again in each rule
    out = docs.select("*", F.explode(F.array(F.array_join(known_sentences(F.col(f"`{text_col}`")), ","))).alias(name["sentence_ids"]))
    fits = [F.when(said.rlike(rule_pattern(r[2])), k) for k, r in enumerate(RULES, 1)]
    out = out.withColumn(name["rules"], F.when(said == "", F.array().cast("array<int>")).otherwise(F.array_compact(F.array(*fits))))
    pick = lambda at: F.get(F.array(*(F.lit(r[at]) for r in RULES)), F.get(rules, 0) - 1)
    return out.withColumns({name["license"]: pick(0), name["use"]: pick(1)}), name


def digest(docs: DataFrame) -> DataFrame:
    out, _ = scan_licenses(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return out.select("doc_id", "sentence_ids", F.array_join(F.transform("rules", lambda x: x.cast("string")), ",").alias("rules"), "license", "use")


# -- SQL: sentences and rules as tables that are joined, over all texts and without the trigger ---------------------------


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_replaced(value: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        value = f"regexp_replace({value}, {_quoted(pattern.replace(_MARK, chr(92) + 'x01').replace(_LINE, chr(92) + 'x02'))}, {_sql_text(by.replace('$1', chr(92) + '1'))}, 'g')"
    return value


def _sql_text(x: str) -> str:
    return " || ".join({_MARK: "chr(1)", _LINE: "chr(2)", "\n": "chr(10)"}.get(p) or _quoted(p) for p in re.split(f"([{_MARK}{_LINE}\n])", x) if p) or "''"


ORACLE = f"""
WITH known(said, id) AS (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in KNOWN.items())}),
rule(k, license, use, pattern) AS (VALUES {', '.join(f'({k}, {_quoted(r[0])}, {_quoted(r[1])}, {_quoted(rule_pattern(r[2]))})' for k, r in enumerate(RULES, 1))}),
texts AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(coalesce(text, ''), {_quoted(_CUT)}) AS p FROM documents),
pieces AS (SELECT r, unnest(p) AS t, generate_subscripts(p, 1) AS k FROM texts),
flat AS (SELECT r, k, string_split({_sql_replaced(f"chr(10) || translate(t, '{_UPPER}', '{_LOWER}') || chr(10)", _TO_SENTENCES)}, chr(1)) AS t FROM pieces),
said AS (SELECT r, unnest(t) AS s, k * 1000000 + generate_subscripts(t, 1) AS i FROM flat),
whole AS (SELECT r, i, s, k.id FROM (SELECT *, {_sql_replaced("trim(regexp_replace(s, '[ ' || chr(2) || ']+', ' ', 'g'))", _IN_SENTENCE)} AS n FROM said) x LEFT JOIN known k ON k.said = x.n),
lines AS (SELECT r, i, unnest(string_split(s, chr(2))) AS s, generate_subscripts(string_split(s, chr(2)), 1) AS j FROM whole WHERE id IS NULL),
ids AS (SELECT r, i, 0 AS j, id FROM whole WHERE id IS NOT NULL UNION ALL SELECT r, i, j, k.id FROM (SELECT *, {_sql_replaced('trim(s)', _IN_SENTENCE)} AS n FROM lines) x JOIN known k ON k.said = x.n),
joined AS (SELECT r, string_agg(id, ',' ORDER BY i, j) AS sentence_ids FROM ids GROUP BY r),
hits AS (SELECT j.r, string_agg(u.k::VARCHAR, ',' ORDER BY u.k) AS rules, min(u.k) AS first FROM joined j JOIN rule u ON regexp_matches(j.sentence_ids, u.pattern) GROUP BY 1)
SELECT f.doc_id, coalesce(j.sentence_ids, '') AS sentence_ids, coalesce(h.rules, '') AS rules, u.license, u.use
FROM texts f LEFT JOIN joined j ON f.r = j.r LEFT JOIN hits h ON f.r = h.r LEFT JOIN rule u ON u.k = h.first
"""
