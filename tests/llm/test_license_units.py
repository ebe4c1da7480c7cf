"""Statements over several lines or within a paragraph, and whole licence files."""

import pytest

from clusterlake.llm import licenses

CODE = "\n".join(f"    value_{k} = compute_{k}(alpha_{k}, beta_{k})" for k in range(60))
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.\n"
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
FILES = licenses.__dict__.get("whole_licenses", dict)()
MIT = FILES.get("MIT", "").replace("<year> <copyright holders>", "2019 Some One and Others")


def commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.splitlines())


CASES = [
    ("mpl header", commented(MPL, "#") + "\n\n" + CODE, "MPL-2.0", False),
    ("gpl header", commented(GPL, " *") + "\n" + CODE, "GPL-3.0", False),
    ("paragraph", "Kiwa ro temu salla ivo denta. Released under the MIT License. Orrin fel mako tuste pirra one soltu vando mirre.", "MIT", False),
    ("wrapped", "Kiwa ro temu salla ivo denta. Released\nunder the MIT\nLicense. Orrin fel mako tuste pirra one soltu vando.", "MIT", False),
    ("mit file", MIT, "MIT", True),
    ("gpl file", FILES.get("GPL-3.0"), "GPL-3.0", True),
    ("apache file", FILES.get("Apache-2.0"), "Apache-2.0", True),
    ("mpl file", FILES.get("MPL-2.0"), "MPL-2.0", True),
    ("bsd file", FILES.get("BSD-3-Clause"), "BSD-3-Clause", True),
    ("bsd2 file", FILES.get("BSD-2-Clause"), "BSD-2-Clause", True),
    ("isc file", FILES.get("ISC", "").replace("<year> <owner>", "2021, Some One <one@example.org>"), "ISC", True),
    ("unlicense file", FILES.get("Unlicense"), "Unlicense", True),
    ("lgpl file", FILES.get("LGPL-3.0"), "LGPL-3.0", True),
    ("cc0 file", FILES.get("CC0-1.0"), "CC0-1.0", True),
    ("by-sa file", FILES.get("CC-BY-SA-4.0"), "CC-BY-SA-4.0", True),
    ("lgpl header", commented(GPL.replace("GNU\nGeneral", "GNU\nLesser General").replace("GNU General", "GNU Lesser General").replace("This program", "This library"), "//") + "\n" + CODE, "LGPL-3.0", False),
    ("agpl header", commented(GPL.replace("GNU General", "GNU Affero General").replace("GNU\nGeneral", "GNU\nAffero General"), "//") + "\n" + CODE, "AGPL-3.0", False),
    ("by", "Kiwa ro temu salla. This work is licensed under a Creative Commons Attribution 4.0 International License. Orrin fel mako tuste.", "CC-BY-4.0", False),
    ("by-sa", "Kiwa ro temu salla. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Orrin fel mako.", "CC-BY-SA-4.0", False),
    ("by-nc", "Kiwa ro temu salla. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. Orrin fel.", "CC-BY-NC-4.0", False),
    ("epl", "/*\n * This program and the accompanying materials are made available under\n * the terms of the Eclipse Public License 2.0 which is available at\n * https://www.eclipse.org/legal/epl-2.0/\n */\n" + CODE, "EPL-2.0", False),
    ("cc0", "# SPDX-License-Identifier: CC0-1.0\n" + CODE, "CC0-1.0", False),
    ("short notice", "Released under the MIT License.\nkiwa ro temu", "MIT", False),
    ("none", CODE, None, None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, name, text) for k, (name, text, _, _) in enumerate(CASES)]
    return {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_case(found, case):
    name, _, license_, is_file = case
    assert (found[name]["own"], found[name]["is_file"]) == (license_, bool(is_file))
