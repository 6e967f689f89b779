"""Licence notices as files hold them: wrapped, behind comment signs, and as SPDX tags."""

import textwrap

from tunelode.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def wrapped(*ids):
    return "\n\n".join(textwrap.fill(licenses.SENTENCES[i][0], 72) for i in ids)


def behind(sign, text):
    return "\n".join(sign + line for line in text.split("\n"))


def scanned(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(r.licenses, r.n_unmatched) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_wrapped_and_commented_notices(spark):
    mit = wrapped("MITGrant", "MITNotice", "MITNoWarranty", "MITLiability")
    bsd = wrapped("BSDGrant") + "\n\n" + "\n".join(f"{i}. {wrapped(s)}" for i, s in enumerate(("BSDSource", "BSDBinary", "BSDEndorse"), 1))
    notices = {"[MIT]": mit, "[BSD-3-Clause]": bsd, "[ISC]": wrapped("ISCGrant"), "[Apache-2.0]": APACHE, "[GPL-3.0-or-later]": GPL}
    want, texts = [], []
    for name, text in notices.items():
        for form in (text, behind("# ", text), behind("// ", text), "/*\n" + behind(" * ", text) + "\n */", behind("dnl ", text), text.replace("\n", "\r\n"), f"code\n\n{text}\n\nmore code"):
            want.append((name, 0))
            texts.append(form)
    assert scanned(spark, texts) == want


def test_paragraphs_and_unknown_lines_stay_apart(spark):
    cut = textwrap.fill(licenses.SENTENCES["ISCGrant"][0], 72).replace("\n", "\n\n", 1)
    assert [x[0] for x in scanned(spark, [cut, "The MIT\n\nLicense", "not MIT License\nhere", "MIT License\nand so on"])] == ["", "", "", "[MIT]"]
    long = "Permission " + "=" * 100_000 + "\n" * 1000 + " license"
    assert scanned(spark, [long]) == [("", 2)]


def test_spdx_tags(spark):
    tags = {
        "// SPDX-License-Identifier: MIT": "[MIT]", "/* SPDX-License-Identifier: GPL-2.0+ */": "[GPL-2.0-or-later]", "# SPDX-License-Identifier: GPL-2.0": "[GPL-2.0-only]",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "[MIT][Apache-2.0]", "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note OR GPL-3.0-or-later": "[GPL-2.0-only][GPL-3.0-or-later]",
        "dnl SPDX-License-Identifier: ISC": "[ISC]", "SPDX-License-Identifier: Nobody-1.0": "",
    }
    assert scanned(spark, tags) == [(v, int(v == "")) for v in tags.values()]
