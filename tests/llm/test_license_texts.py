"""Whole licence texts: longer ones by digest, notices of any shape, texts on one line."""

from pathlib import Path

import pytest

from docloom.llm import licenses

FOLDER = Path("/usr/share/common-licenses")
NAMED = {"BSD": "BSD-3-Clause", "Artistic": "Artistic-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.license for r in sorted(licenses.scan(docs).collect(), key=lambda r: r.doc_id)]


@pytest.mark.skipif(not FOLDER.exists(), reason="no licence texts on this machine")
def test_longer_texts_by_digest(spark):
    files = [p for p in sorted(FOLDER.iterdir()) if NAMED.get(p.name, p.name) in licenses.DIGESTS]
    texts = [p.read_text(encoding="utf-8", errors="replace") for p in files]
    names = [NAMED.get(p.name, p.name) for p in files]
    assert set(names) == set(licenses.DIGESTS)
    assert found(spark, texts) == names
    spaced = [t.replace(",", " ,").replace("  ", " ") for t in texts]
    assert found(spark, spaced) == names
    assert found(spark, [t + "\none more condition" for t in texts]) == [None] * len(texts)


def test_notices_of_many_shapes(spark):
    mit, bsd = licenses.TEXTS["MIT"], licenses.TEXTS["BSD-3-Clause"]
    one_line = " ".join(mit.split())
    heads = [
        "Copyright (c) Some Holder\n", "Copyright © The Holders of Things\n\n", "(c) 2001-2003 A and B <a@b.c>\n* Copyright (C) 1999 Other\n# Copyright 2020 C\n",
        "The MIT License (MIT)\nCopyright (c) 2019\n", "MIT License\n\nCopyright (c) 2011 X. All rights reserved.\n\n",
    ]
    assert found(spark, [head + mit for head in heads]) == ["MIT"] * len(heads)
    # on one line with its notice, only the notice goes
    assert found(spark, [f"Copyright (c) 2019 Someone. {one_line}", one_line, bsd, f"(c) Holder\n{bsd}"]) == ["MIT", "MIT", "BSD-3-Clause", None]
    # words of the licence that speak of copyright stay
    assert found(spark, [mit.replace("The above copyright notice and", "The"), mit[:-20], "", None]) == [None] * 4
