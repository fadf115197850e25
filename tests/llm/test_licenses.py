import re
import textwrap

import duckdb
import pytest

from codexlake.llm import licenses as L

MIT = """MIT License

Copyright (c) 2024 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_HEADER = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
BSD3 = """Copyright (c) 2011, The Example Project
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Example, Inc nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY EXAMPLE AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
MPL = """Mozilla Public License Version 2.0
==================================

1. Definitions
--------------

1.1. "Contributor"
    means each individual or legal entity that creates, contributes to
    the creation of, or owns Covered Software.
"""
GPL3_HEADER = """Foo is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

Foo is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL3 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
LICENCES = [
    ("MIT", MIT), ("Apache-2.0", APACHE_HEADER), ("Apache-2.0", APACHE), ("BSD-3-Clause", BSD3), ("MPL-2.0", MPL_HEADER), ("MPL-2.0", MPL), ("GPL-3.0", GPL3_HEADER), ("GPL-3.0", GPL3), ("Zlib", ZLIB), ("ISC", ISC), ("Unlicense", UNLICENSE),
    ("BSD-2-Clause", re.sub(r"3\. Neither.*?permission\.\n\n", "", BSD3, flags=re.S)), ("LGPL-2.1", GPL3_HEADER.replace("GNU General", "GNU Lesser General").replace("software: you", "software; you").replace("version 3", "version 2.1")),
    ("AGPL-3.0", GPL3_HEADER.replace("GNU General", "GNU Affero General")), ("CC-BY-4.0", "This work is licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-3.0", "This article is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License."), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\n"), ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"),
    ("MIT", "The code is released under the MIT license."), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file)"), ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."), ("proprietary", "Copyright 2021 Foo. All rights reserved."),
]
TEXTS = [
    (1, "Some prose.\nReleased under the MIT License.\nMore"), (2, "Licensed under the Apache License, Version 2.0. And on."), (3, "ALL RIGHTS RESERVED!\r\nLicensed under CC BY-NC 4.0."),
    (4, None), (5, ""), (6, "Licensed under the Apache License, Version 2.0\nYou may not use this file except in compliance with the License.\nUnknown line\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    (7, "not licensed under cc by 4.0 at all"), (1, "Released under the MIT License."), (8, "é " * 5000 + "\nThis work is licensed under the GNU General Public License, version 3."), (9, "All rights reserved.\n" * 20_000 + "#*" * 20_000 + "\n" * 50_000 + "\n" + MIT),
    (10, "unfinished prose\nLicensed under CC BY-NC 4.0.\nand more"), (11, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + "Permission is hereby granted."),
]


def notices():
    for spdx, text in LICENCES:
        yield spdx, text
        yield spdx, " ".join(text.split()) if "Apache License\n" not in text and "GENERAL PUBLIC LICENSE\n" not in text and "====" not in text and "SPDX" not in text else text  # in one line
        yield spdx, textwrap.indent(text, "# ", lambda _: True)
        yield spdx, "/*\n" + textwrap.indent(text, " * ", lambda _: True) + " */\nint main() {}\n"
        yield spdx, text.replace("\n", "\r\n")


@pytest.fixture(scope="module")
def rows(spark):
    texts = TEXTS + [(100 + k, t) for k, (_, t) in enumerate(notices())]
    docs = spark.createDataFrame([(*x, 0) for x in texts], "doc_id long, text string, license int")
    return texts, docs, [tuple(r) for r in L.digest(docs).orderBy("doc_id", "sentence_ids").collect()]


def test_real_licences_and_headers(rows):
    by = {r[0]: r for r in rows[2]}
    wrong = [(spdx, text, by[100 + k][1:4]) for k, (spdx, text) in enumerate(notices()) if by[100 + k][3] != spdx]
    assert not wrong, wrong[:3]
    assert len({r[0] for r in L.RULES}) > 30


def test_lines_among_prose(rows):
    texts, docs, got = rows
    by = {r[0]: r for r in got}
    assert len(got) == len(texts)
    assert by[1][3] == "MIT" and by[3][1] == "reserved,under-CC-BY-NC-4.0" and by[3][3:] == ("CC-BY-NC-4.0", "restricted") and by[10][3] == "CC-BY-NC-4.0"
    assert by[6][3:] == ("Apache-2.0", "open") and by[4][1:] == ("", "", None, None) and by[5][1:] == ("", "", None, None) and by[7][3] is None and by[8][4] == "copyleft" and by[9][3] == "MIT" and by[11][1:4] == ("mit_notice", "", None)
    assert L.digest(docs.limit(0)).count() == 0


def test_sql(rows):
    texts, _, got = rows
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert sorted(c.sql(L.ORACLE).fetchall(), key=str) == sorted(got, key=str)


def test_every_sentence_has_a_trigger():
    for said in L.KNOWN:
        assert said.startswith("under ") or any(t in said for t in L.TRIGGERS), said
    openers = re.search(r"\(\?:(licen[^)]*)\) under", next(p for p, by in L._IN_SENTENCE if by == "under "))[1].split("|")
    assert all("licen" in o or o in L.OPENERS for o in openers)
