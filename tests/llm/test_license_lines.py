"""Licence notices written after the forms, names and cues of the classifier were fixed."""

import pytest

from pathwright.llm import licenses

#: line, families, whether it must not be confirmed
LINES = [
    ("This crate is licensed under MIT OR Apache-2.0.", "apache-2.0,mit"), ("// SPDX-License-Identifier: GPL-2.0-only OR BSD-3-Clause", "bsd,gpl-2.0"), ("Dual-licensed under the MPL-2.0 and the GPL v3.", "gpl-3.0,mpl-2.0"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "apache-2.0,mit"), ("All code in this folder is released under the zlib License.", "zlib"), ("The fonts are covered by the Apache License, Version 2.0.", "apache-2.0"),
    ("You may use these icons under the CC BY 4.0 license.", "cc-by"), ("Photos: licensed under CC BY-SA 3.0.", "cc-by-sa"), ("Slides are published under CC BY-NC-SA 4.0.", "cc-by-nc"), ("Data released under CC0 1.0.", "cc0"),
    ("# License: MIT", "mit"), ("License: BSD-2-Clause", "bsd"), ("license: ISC", "isc"), ("# SPDX-License-Identifier: EUPL-1.2", "eupl"), ("/* SPDX-License-Identifier: MPL-2.0 */", "mpl-2.0"), ("-- SPDX-License-Identifier: Unlicense", "unlicense"),
    ("This module is distributed under the GNU Lesser General Public License v2.1.", "lgpl"), ("This tool is provided under the AGPLv3.", "agpl-3.0"), ("Published under the Eclipse Public License 2.0.", "epl"), ("The compiler is licensed under GPLv3.", "gpl-3.0"),
    ("Released to everyone under the WTFPL.", "wtfpl"), ("The library is available under the Boost Software License.", "bsl-1.0"), ("Modules are licensed under the CDDL.", "cddl"), ("Distributed under the terms of the Artistic License 2.0.", "artistic-2.0"),
    ("Lizenziert unter der Apache License, Version 2.0.", "apache-2.0"), ("Der Quelltext steht unter der GPLv3.", "gpl-3.0"), ("Dieses Werk ist lizenziert unter der CC BY-SA 4.0.", "cc-by-sa"), ("Lizenz: MIT", "mit"), ("Ce projet est distribué sous licence GPLv2.", "gpl-2.0"),
    ("Le code est sous la licence Apache 2.0.", "apache-2.0"), ("Publié sous licence MPL-2.0.", "mpl-2.0"), ("El programa se publica bajo la licencia MIT.", "mit"), ("Licencia: GPLv3", "gpl-3.0"), ("Este texto se distribuye bajo la licencia CC BY 4.0.", "cc-by"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.", "isc"), ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "bsd"),
    ("to deal in the Software without restriction, including without limitation the rights to use, copy, modify", "mit"), ("This Source Code Form is subject to the terms of the Mozilla Public License.", "mpl-2.0"), ("Licensed under 0BSD.", "0bsd"), ("(c) 2021 by the authors. All rights reserved.", "all-rights-reserved"),
    ("Licensed under the Frobnicate Public License, version 3.", "unknown"), ("Released under the terms of the Acme License.", "unknown"), ("Distributed under the Quux Free License.", "unknown"),
    ("The Mozilla Foundation opened an office in Berlin.", "none"), ("He studied at MIT before he joined the company.", "none"), ("Her driving licence was renewed in March.", "none"), ("The Boost of the new engine surprised the drivers.", "none"), ("A public library lends books without a fee.", "none"),
    ("The GNU project was announced in 1983.", "none"), ("Apache was founded by a group of developers.", "none"), ("The committee discussed how licenses are granted to bars.", "none"), ("We ate at the Creative Commons cafe.", "none"), ("The eclipse was visible over the public park.", "none"),
    ("Some lawyers say that the MIT License is short.", "none"), ("Two articles compare the GPLv2 with newer texts.", "none"), ("The union of European cities met in June.", "none"), ("The artist has an artistic license to lie.", "none"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "doc_id long, text string")).collect()
    return {r.doc_id: ((r.families or licenses.NONE), r.confirmed) for r in rows}


def test_precision_and_recall(found):
    """Of named families; prose that names a licence may be found, but unconfirmed."""
    told = [(y, *found[i]) for i, (_, y) in enumerate(LINES)]
    named = lambda y: y not in (licenses.NONE, licenses.UNKNOWN)
    right = sum(named(y) and f == y for y, f, _ in told)
    wrong = [(LINES[i][0], f) for i, (y, f, c) in enumerate(told) if c and f != y]
    sure = sum(c for y, f, c in told)
    print(f"right {right} of {sum(named(y) for y, _, _ in told)} named lines; confirmed {sure}, of them wrong {wrong}; others found {[(LINES[i][0], f) for i, (y, f, c) in enumerate(told) if f != y]}")
    assert right / sum(named(y) for y, _, _ in told) >= 0.9
    assert (sure - len(wrong)) / sure >= 0.9
