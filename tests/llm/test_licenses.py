"""Canonical forms and the scan."""

import re
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from voxward.llm import licenses
from voxward.llm.license_digests import DIGESTS
from voxward.llm.licenses import LICENSES, canonical, scan_licenses


def test_same_form_for_the_same_terms(documents):
    mit = dict(LICENSES[:1])["MIT"]
    shouted = "The MIT text:\n" + mit
    changed = mit.replace("<year> <holders>", "2021-2024 Some Body, all rights reserved").replace('"', "“").replace("Software", "SOFTWARE").replace("MIT License", "MIT Licence")
    rows = [
        (1, changed), (2, shouted), (3, "intro\n  RELEASED under the MIT licence!\nbody\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0"),
        (4, "Licensed under CC BY-NC 3.0."), (5, None), (6, ""), (None, "Released under the MIT License."), (None, "x"),
        (7, "word\n" * 100_000 + "Licensed under the Apache License, Version 2.0."), (8, "licence " * 50_000), (4, "Released under the ISC License."),
        (9, "Licensed under the Apache License, v. 2.0"),
    ]
    got = sorted(((r.doc_id, r.n_notices, r.licenses, r.whole_license) for r in scan_licenses(documents(rows)).collect()), key=str)
    assert got == sorted([
        (1, 0, "MIT", "MIT"), (2, 0, "", None), (3, 3, "CC-BY-NC-4.0,MIT", None), (4, 1, "ISC", "ISC"), (4, 1, "ISC", "ISC"), (5, 0, "", None),
        (6, 0, "", None), (None, 1, "MIT", "MIT"), (None, 1, "MIT", "MIT"), (7, 1, "Apache-2.0", None), (8, 0, "", None),
        (9, 1, "Apache-2.0", "Apache-2.0"),
    ], key=str)
    assert scan_licenses(documents([])).count() == 0


def test_own_table_of_licenses(spark, documents):
    known = spark.createDataFrame([("A", "Own license text"), ("B", "own LICENCE text.")], "license string, text string")
    assert scan_licenses(documents([(1, "Own licence, text")]), known).first().whole_license == "A"
    with pytest.raises(ValueError):
        scan_licenses(documents([]), spark.createDataFrame([("A", "free to use")], "license string, text string"))


def wrapped(text, width, mark=""):
    return "\n".join(textwrap.fill(part, width, initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False) for part in text.split("\n"))


def test_wrapped_at_any_width(documents):
    """At some widths a line of terms starts with the word copyright."""
    names = {i: name for i, (name, text) in enumerate(LICENSES) if len(text) > 500}
    rows = [
        (1000 * i + width, wrapped(LICENSES[i][1].replace("<year> <holders>", holder), width, mark))
        for i in names for width, mark, holder in [(w, "# " if w % 2 else "", "2020 A Body" if w % 3 else "<year> <holders>") for w in range(30, 130)]
    ]
    assert any(line.strip("# ").lower().startswith("copyright holders") for _, text in rows for line in text.split("\n"))
    assert {r.doc_id: r.whole_license for r in scan_licenses(documents(rows)).collect()} == {i: names[i // 1000] for i, _ in rows}


def test_lines_of_ownership(spark):
    gone = [
        "Copyright 2020 Some Body", "Copyright (c) Some Body", "(c) 2020 Some Body", "© Some Body", "# Copyright: Some Body", "Copyright The Foo Authors",
        "COPYRIGHT © 2020-2024 X", "Copyright [yyyy] [name of copyright owner]", "(C) Copyright Some Body", "All rights\nreserved.",
    ]
    stay = [
        "COPYRIGHT HOLDERS BE LIABLE", "copyright notice and this permission", "copyright, patent, trademark", "(c) You must retain", "copyright license to reproduce",
        "copyright and related rights", "copyright\nnotice", "copyrighted work",
    ]
    forms = dict(spark.createDataFrame([(t,) for t in gone + stay], "t string").select("t", canonical(F.col("t"))).collect())
    assert [forms[t] for t in gone] == [""] * len(gone)
    assert [forms[t].split() for t in stay] == [re.sub(r"[^a-z ]+", " ", t.lower()).split() for t in stay]


def test_whole_public_texts(documents):
    """BSD as published, and the long texts where this machine has them, as they are and wrapped anew."""
    parts = [
        "BSD 3-Clause License", "Copyright (c) 2021, Some Body\nAll rights reserved.", licenses._BSD_HEAD,
        *(f"{k}. {c}" for k, c in enumerate(licenses._BSD_CLAUSES, 1)), licenses._BSD_END,
    ]
    rows, want = [(1, wrapped("\n\n".join(parts), 79)), (2, wrapped("\n".join(parts[1:5] + parts[6:]), 60, "# "))], ["BSD-3-Clause", "BSD-2-Clause"]
    files = {
        "Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only",
        "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0",
    }
    for name, license in files.items():
        if (path := Path("/usr/share/common-licenses", name)).exists():
            text = path.read_text()
            rows += [(len(rows) + 1, text), (len(rows) + 2, "\n".join(line.strip() for line in text.split("\n")).upper())]
            want += [license, license]
    assert [r.whole_license for r in scan_licenses(documents(rows)).orderBy("doc_id").collect()] == want
    assert scan_licenses(documents([(1, rows[0][1][:-60])])).first().whole_license is None
    assert set(files.values()) <= {name for name, _ in DIGESTS}
