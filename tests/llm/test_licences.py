import hashlib
import pkgutil
import re
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from murmur.llm import licences

from .helpers import awkward, frame, saved


def form(spark, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").transform(lambda d: licences.with_forms(d, F.col("t"))).orderBy("i").select("__whole").collect()]


def test_canonical_forms(spark):
    a, b, c = form(
        spark, "Copyright (c) 2020 Me\nThe  LICENCE -- is «authorised»; sub-license whilst non-commercial.\n(C) You\nAll rights reserved.",
        "the license is authorized sublicense while noncommercial", "# Copyright 1999\n * the license is authorised: SUBLICENSE, while non commercial",
    )
    assert a == b == c
    assert form(spark, "copyright", "  ", "Colour of the programme's centre") == ["", "", "color of the program s center"]


def test_whole_texts_and_lines(spark):
    known = licences.known(spark)
    mit = next(v for k, v in licences.TEXTS if k == "MIT")
    rows = [
        (1, "Copyright 2021 Somebody\n" + mit.upper().replace('"', "'"), None, None, None, None, None), (2, mit + " And more.", None, None, None, None, None),
        (3, "some text\nLicensed under the Apache License, Version 2.0.\nmore\nreleased under the MIT licence\nLicensed under the apache licence version 2.0", None, None, None, None, None),
        (4, "Licensed under CC BY-NC 4.0.", None, None, None, None, None), (5, "I was licensed under the Apache License, Version 2.0, they say", None, None, None, None, None),
    ]
    got = {r.doc_id: (r.license, r.notices, r.n_notices) for r in licences.scan(frame(spark, rows), known).collect()}
    assert got == {1: ("MIT", "", 0), 2: (None, "", 0), 3: (None, "Apache-2.0,MIT", 3), 4: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), 5: (None, "", 0)}


def test_every_known_text_is_found(spark):
    texts = licences.known_texts()
    rows = [(i, t, None, None, None, None, None) for i, (_, t) in enumerate(texts)]
    got = {r.doc_id: r.license for r in licences.scan(frame(spark, rows), licences.known(spark)).collect()}
    assert all(got[i] == k for i, (k, _) in enumerate(texts))


def test_awkward_rows(spark, tmp_path):
    got = licences.op1_licences(spark, saved(spark, tmp_path)).collect()
    rows = [(r[0], hashlib.sha256(f.encode()).hexdigest()) for r, f in zip(awkward(), form(spark, *[r[1] or "" for r in awkward()]), strict=True)]
    assert Counter((r.doc_id, r.canonical_sha256) for r in got) == Counter(rows)
    assert all(r.license is None for r in got)
    assert licences.op1_licences(spark, saved(spark, tmp_path, [])).count() == 0


def test_published_texts_in_any_wrapping(spark):
    """Full texts as published, wrapped anew at two widths, with and without title and copyright line."""
    texts = {k: pkgutil.get_data("murmur.llm", f"licence_texts/{k}.txt").decode() for k in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "BSD-3-Clause", "Zlib", "WTFPL")}
    body = {k: textwrap.dedent(v).strip().split("\n") for k, v in licences.TEXTS}
    mit, free = "\n".join(body["MIT"][1:]), " ".join(body["Unlicense"])
    cases = list(texts.items())
    cases += [("MIT", mit), ("MIT", "MIT License\n\nCopyright (c) 2024 Some Body\n\n" + mit), ("Unlicense", "\n".join(body["Unlicense"]))]
    cases += [("Unlicense", free.replace("author or authors ", "author or authors\n").replace("copyright interest in the ", "copyright interest in the\n"))]
    cases += [("Unlicense", textwrap.fill(free, w)) for w in (60, 72, 79)]
    cases += [("Apache-2.0", "Copyright 2024 Some Body\n\n" + texts["Apache-2.0"]), ("Apache-2.0", texts["Apache-2.0"].split("   APPENDIX")[0])]
    # a break before every "copyright" and every "(c)" of the terms puts them first on a line
    terms = texts["Apache-2.0"][texts["Apache-2.0"].index("TERMS AND") : texts["Apache-2.0"].index("END OF TERMS")]
    cases += [("Apache-2.0", re.sub(r"[ \n]+(copyright|\(c\))", r"\n\1", terms, flags=re.I))]
    rows = [(i, t, None, None, None, None, None) for i, (_, t) in enumerate(cases)]
    got = {r.doc_id: r.license for r in licences.scan(frame(spark, rows), licences.known(spark)).collect()}
    assert [(i, got[i]) for i in got if got[i] != cases[i][0]] == []


def test_only_notices_are_copyright_lines(spark):
    dropped = ["Copyright (c) 2020 Me", "copyright 1999", "# Copyright: The Authors", "© somebody", "(c) 2001 me", "(C) Some Body and Others", "Copyright Some Body", "COPYRIGHT [yyyy] [name]"]
    kept = ["copyright interest in the software", "COPYRIGHT HOLDERS AND CONTRIBUTORS", "(c) You must retain, in the Source form", "Copyright License. Subject to the terms", "copyright treaty adopted"]
    assert form(spark, *dropped) == [""] * len(dropped)
    assert "" not in form(spark, *kept)


def test_every_row_gives_a_row(spark, tmp_path):
    """Repeated rows, texts that differ in punctuation alone under one id, and rows without an id."""
    line = "Licensed under the Apache License, Version 2.0"
    rows = [(i, t, None, None, None, None, None) for i, t in [(1, line), (1, line), (1, line + "."), (None, line), (None, line), (2, f"a\n{line}\n{line}!")]]
    got = licences.op1_licences(spark, saved(spark, tmp_path, rows)).collect()
    assert Counter((r.doc_id, r.license, r.n_notices) for r in got) == Counter({(1, "Apache-2.0", 1): 3, (None, "Apache-2.0", 1): 2, (2, None, 2): 1})
