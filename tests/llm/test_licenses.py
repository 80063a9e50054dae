from textorbit.llm import licenses

from .conftest import PROSE


def test_whole_texts_and_lines(spark):
    mit = licenses.LICENSES["MIT"]
    commented = "\n".join("# " + line for line in mit.replace("<year> <copyright holders>", "2019 A. Person").split("\n"))
    spelled = mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace("MIT LICENSE", "MIT LICENCE").replace('"', "“")
    rows = [
        (1, mit),
        (2, commented),
        (3, spelled),
        (4, mit.replace("free of charge", "for a fee")),
        (5, PROSE + "\nReleased under the MIT licence"),
        (6, "  licensed UNDER the Apache License -- version 2.0  \n(c) 2020 Some One"),
        (7, "Licensed under CC BY-NC 4.0.\nx\nLicensed under CC BY-NC 4.0\n; SPDX-License-Identifier: GPL-3.0"),
        (8, licenses.LICENSES["Zlib"] + "\nAll rights reserved."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as unit", "3 as line")
    got = {r.doc_id: (r.license_id, r.notices, r.n_notices) for r in licenses.scan_licenses(docs).collect()}
    assert got == {
        1: ("MIT", "", 0),
        2: ("MIT", "", 0),
        3: ("MIT", "", 0),
        4: (None, "", 0),
        5: (None, "MIT", 1),
        6: ("Apache-2.0", "Apache-2.0", 1),
        7: (None, "CC-BY-NC-4.0,GPL-3.0", 3),
        8: ("Zlib", "", 0),
    }


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.license_id, r.notices, r.n_notices) == (None, "", 0) for r in rows)
    assert licenses.scan_licenses(no_docs).count() == 0


def test_no_python_in_the_plan(documents):
    plan = licenses.scan_licenses(documents)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_common_licenses_and_their_usual_forms(spark):
    from pathlib import Path

    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0"}
    names |= {"LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    files = {name: Path("/usr/share/common-licenses", name) for name in names}
    rows = [(f.read_text(), names[n], "", 0) for n, f in files.items() if f.exists()]
    if rows and files["Apache-2.0"].exists():  # its appendix holds the header line
        rows[0] = (rows[0][0], "Apache-2.0", "Apache-2.0", 1)
    for i, text in licenses.LICENSES.items():
        body = text.removeprefix("MIT License\n")
        rows += [(f"{title}\n\n{body}", i, "", 0) for title in ("", *licenses.TITLES[i])]
    rows += [(f"// SPDX-License-Identifier: {i}\nx", None, i, 1) for i in licenses.SPDX]
    rows += [("SPDX-License-Identifier: GPL-2.0-or-later\nx", None, "GPL-2.0", 1)]
    rows += [('# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not', None, "Apache-2.0", 1)]
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.notices, r.n_notices) for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}
    known = [tuple(r) for r in licenses.known_digests(spark, licenses.LICENSES, licenses.NOTICES).collect()]
    assert len(known) == len(set(known))
