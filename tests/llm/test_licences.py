"""Licence notices: wrapped texts, the gate against scoring every line, strangers, odd rows."""
import textwrap

import pytest

from rankspark.llm import licences

SCHEMA = "doc_id long, text string, w string, row long, lines string, family string, line int, guess int"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
STRANGE = "Covered by the Zanzibar Source Charter: permission to copy this software is granted to members of the guild under the terms of the charter."


def wrapped(text, width, lead=""):
    return "\n".join(lead + line for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""]))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "l", "f", 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    plain = [(i, f"Moro kata {i} tasa pilu nemi. Pilu tasa moro nemi {i}.\nSecond line kata {i} nemi tasa\nThe version of all this is in any source {i}") for i in range(80)]
    rows = plain + [(100, "Intro moro.\n\n" + wrapped(MIT, 75) + "\n\nkata tasa"), (101, wrapped(BSD, 72, " * ")), (102, "kata\n" + wrapped(GPL, 70, "# ") + "\ntasa"),
                    (103, wrapped(MIT, 40)), (104, STRANGE), (105, "Released under the MIT License.\nmoro kata\nLicensed under CC BY 4.0."), (105, "Released under the MIT License.\nmoro kata\nLicensed under CC BY 4.0."),
                    (106, None), (107, ""), (108, "\n\n \n"), (None, "All rights reserved."), (109, "kata moro " * 60_000 + "\nReleased under the MIT License.\n" + "tasa\n" * 20_000)]
    df = docs(spark, rows)
    return df, licences.fit(df)


def test_wrapped_notices_and_strangers(corpus):
    df, model = corpus
    got = licences.scan(df, model).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.paragraph, r.family))
    assert all({f for _, f in found[i]} >= {k} for i, k in ((100, "MIT"), (101, "BSD"), (102, "GPL"), (103, "MIT")))
    assert all({f for _, f in found[i]} <= {k, "unknown"} for i, k in ((100, "MIT"), (101, "BSD"), (102, "GPL"), (103, "MIT")))
    assert {f for _, f in found.get(104, [])} <= {"unknown"}
    assert sorted(found[105]) == [(0, "MIT"), (0, "MIT"), (2, "CC-BY"), (2, "CC-BY")]
    assert found[None] == [(0, "proprietary")] and found[109] == [(1, "MIT")]
    assert not set(found) & {*range(80), 106, 107, 108}
    assert all(0 <= r.probability <= 1 and r.lines >= 1 for r in got)


def test_gate_loses_nothing(corpus):
    df, model = corpus
    assert len(model.gate) > 5
    assert sorted(map(str, licences.scan(df, model).collect())) == sorted(map(str, licences.scan(df, model, gated=False).collect()))


def test_empty_table(spark):
    assert licences.scan(docs(spark, [])).collect() == []


def test_unknown_class_parts_left_out_families(corpus):
    """The calibrated curve rises with the probability and with the template's share."""
    _, model = corpus
    _, probability, share = model.known
    assert probability > 0 and share > 0
