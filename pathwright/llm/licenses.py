"""Licence scans: a trained paragraph classifier, an unknown class, and templates that confirm what it says.

Paragraphs are runs of lines up to a blank one. Within them a notice may be wrapped: lines are joined up to one that ends a
sentence, or beside a line that is a confirmed notice by itself. A joined unit is judged as a whole; a unit that is none still
counts by its lines. A paragraph counts each family once, at the first line of its first unit.

Units get the softmax of a sparse logistic regression over the presence of word uni- and bigrams, fitted by the driver on
the TEMPLATES, on shortened forms of them, on notices of licences with made-up names (those of a template with its telling words
replaced), on sentences that only sound alike, and on plain prose. Its temperature is calibrated on forms kept aside. A notice of
a family whose probability stays below CERTAIN is `unknown`; a prediction is confirmed if the unit holds at least CONFIRM of the
words of one of the family's templates, and as large a part of that template's telling words (those that at most TELLING families
use), and, unless that template is a passage of LONG words or more, if it names the family word for word where a licence is granted (CUE)
or says little else (BARE); a name beside one of the words BESIDE needs no template where a licence is granted. A unit that grants several families joined by `or`, `and` or `with` counts each one that it names. Grams of PLAIN words alone are no features, and `none` has the largest bias: a text without another known word is none, and
is not scored. Scoring is by column expressions only.

Defined results: a null or empty text has no notices (counts 0, empty lists, null best family). Texts and lines of any length are
read whole. Of equal probabilities the family that sorts first counts; of equally likely notices the first is the best. Every row
gives one row, repeated rows too."""

from __future__ import annotations

import functools
import json
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

CERTAIN, CONFIRM, BARE = 0.5, 0.6, 0.6
LONG = 8
#: How notices grant a licence, in four languages, and what joins two of them.
CUE = (
    r"\b(?:re|dual-|sub)?licen[sc]ed\b|spdx|licen[sc]e(?: identifier)?\s*:|\b(?:released|distributed|published|available|redistributed|redistribute it|provided|use it|issued|offered|shared|usable)\b.{0,40}\bunder\b|\b(?:covered|governed) by\b"
    r"|subject to|terms of|rights (?:are )?reserved|permission|waived|dedicated|unencumbered|lizen[zs]iert|lizenz\s*:|\bunter der\b|sous (?:la )?licen[cs]e|licencia\s*:|bajo (?:la |una )?licencia"
)
BESIDE = ("license", "licence", "lizenz", "licencia", "identifier")
JOINED = r"\b(?:or|and|with|oder|und|ou|et|o|y)\b|/"
TELLING = 3
#: A word that more families than this use says nothing of a family.
FEW = 5
NONE, UNKNOWN = "none", "unknown"

#: Words of any prose, and numbers.
PLAIN = frozenset(
    "a about after all also an and any are as at be been but by can code content data do every file following for form from had has have he her here his i if in into is it its list may more new no not note of on one only or other our out page"
    " part person see she so some such than that the their them there these they this time to under up use was we were what when which who will with without work you your der die das und von zu ein ist den mit de la el en que le les et un une 0 1 2 3 4 5 6 7 8 9".split()
)

#: Short forms of common licence notices by family.
TEMPLATES = {
    "0bsd": ["Licensed under the BSD Zero Clause License.", "SPDX-License-Identifier: 0BSD", "0BSD", "Zero-Clause BSD"],
    "agpl-3.0": ["This program is free software under the GNU Affero General Public License, version 3.", "Licensed under the GNU AGPL v3.0.", "SPDX-License-Identifier: AGPL-3.0-or-later", "Distributed under AGPLv3.", "AGPL-3.0", "AGPLv3", "GNU Affero General Public License", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "all-rights-reserved": ["Copyright by the author, all rights reserved worldwide.", "No part of this may be reproduced without permission. All rights reserved.", "Copyright holder. All rights are reserved.", "all rights reserved"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license.", "Apache License 2.0", "Apache-2.0", "Apache License Version 2.0, January 2004", "This file is distributed under the terms of the Apache License."],
    "artistic-2.0": ["Distributed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0", "This is free software under the same terms as Perl, the Artistic License.", "Artistic-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause", "BSD-2-Clause", "Licensed under the two clause BSD license.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Boost Software License 1.0", "Boost License"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Content is available under CC BY 3.0.", "CC-BY-4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC BY-NC-SA 4.0 for noncommercial use.", "Shared under CC BY-NC 3.0.", "CC-BY-NC-4.0", "CC BY-NC-ND"],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "CC-BY-SA-3.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.", "Dedicated to the public domain under CC0.", "CC0-1.0"],
    "cddl": ["Licensed under the Common Development and Distribution License, version 1.0.", "SPDX-License-Identifier: CDDL-1.0", "CDDL 1.1", "CDDL"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License v1.0.", "EPL-1.0", "Eclipse Public License"],
    "eupl": ["Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2", "Licensed under the EUPL.", "EUPL"],
    "gpl-2.0": ["This program is free software under the GNU General Public License, version 2.", "Licensed under the GPL v2.", "SPDX-License-Identifier: GPL-2.0-only", "Distributed under GPLv2.", "GPL-2.0", "GPLv2", "GPL version 2", "This file is under version 2 of the GNU General Public License.", "as published by the Free Software Foundation; either version 2 of the GNU General Public License, or at your option any later version"],
    "gpl-3.0": ["This program is free software under the terms of the GNU General Public License, version 3 or later.", "Licensed under the GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Distributed under GPLv3.", "GPL-3.0", "GPLv3", "GPL version 3", "This file is under version 3 of the GNU General Public License.", "GNU General Public License v3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or at your option any later version"],
    "isc": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC", "ISC License"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-only", "Released under LGPL 2.1 or later.", "Distributed under LGPLv3.", "LGPL-3.0", "LGPLv3", "GNU Lesser General Public License"],
    "mit": ["Released under the terms of the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction.", "SPDX-License-Identifier: MIT", "MIT License", "MIT licensed", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "MPL 2.0", "Mozilla Public License"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released under the Unlicense.", "Unlicense"],
    "wtfpl": ["Do What The Fuck You Want To Public License.", "SPDX-License-Identifier: WTFPL", "Released under the WTFPL.", "WTFPL"],
    "zlib": ["This software is provided as-is, without any express or implied warranty; permission is granted to anyone to alter it and redistribute it freely.", "SPDX-License-Identifier: Zlib", "Licensed under the zlib License."],
    "unknown": ["Licensed under the terms of the licence that came with it.", "Distributed under a custom license, see the license file.", "This is licensed under the house license of the company.", "Released under the Example License.", "Use is subject to license terms.", "See the LICENSE file for the license.", "Licensed to you under the terms of the agreement.", "Distributed under its own license.", "SPDX-License-Identifier: Other-1.0", "Released under the General Sample Public License, version 4.", "This software is licensed, not sold."],
    "none": [
        "The driver had to show a license at the border.", "She got her fishing license last week.", "Copyright law was the topic of the talk.", "Permission is what the child asked for.",
        "The warranty on the car ran out.", "A search warrant was issued by the court.", "He lost his licence after the race.", "The gnu is a large animal of the plains.",
        "The park is in the public domain of the town.", "Redistribution of wealth was debated.", "Their license plate was stolen.", "Poetic license is allowed here.", "They warrant a closer look.", "Her work on copyright is well known.",
        "The Apache helicopter landed near the town.", "An MIT professor gave the first lecture.", "The eclipse was seen by the public.", "Mozilla is a company with many workers.", "The Boost stage of the rocket fell.", "Copyright is a right of authors over their works.",
        "Free software was discussed by the general public.", "The commons were open to sheep.", "Copyright law has long been debated among publishers.", "The foundation granted money to the school.", "The union published a general report.", "Artistic freedom matters to the painter.",
        "He was licensed as a pilot.", "A license is needed to sell wine.", "The terms of the contract were fair.", "Rights of workers were reserved for later talks.", "The city granted permission to build.", "Software costs rise each year.", "The distribution of the files took an hour.", "General Grant read the notice.",
    ],
}


#: Made-up names begin so; they are no features.
MADE = "zq"
#: What licences are called, by family.
NAMES = {
    "0bsd": ["BSD Zero Clause", "Zero-Clause BSD", "0BSD"],
    "agpl-3.0": ["GNU Affero General Public License", "AGPLv3", "GNU AGPL version 3", "AGPL-3.0"], "apache-2.0": ["Apache License, Version 2.0", "Apache 2.0", "Apache-2.0", "Apache"], "artistic-2.0": ["Artistic License 2.0", "Artistic-2.0"],
    "bsd": ["BSD", "3-clause BSD", "BSD 2-Clause", "BSD-3-Clause", "New BSD"], "bsl-1.0": ["Boost Software License", "Boost", "BSL-1.0"], "cc-by": ["CC BY 4.0", "CC-BY 3.0", "Creative Commons Attribution 4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 3.0", "Creative Commons Attribution-NonCommercial 4.0"], "cc-by-nd": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives"], "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0"], "cc0": ["CC0 1.0", "CC0"],
    "cddl": ["CDDL", "Common Development and Distribution License"], "epl": ["Eclipse Public License 2.0", "EPL", "Eclipse Public License, v1.0"], "eupl": ["EUPL", "European Union Public Licence 1.2"],
    "gpl-2.0": ["GNU General Public License, version 2", "GPLv2", "GPL version 2", "GNU GPL v2", "GPL-2.0", "GPL v2"], "gpl-3.0": ["GNU General Public License, version 3", "GPLv3", "GPL version 3", "GNU GPL v3", "GPL-3.0", "GPL v3"],
    "isc": ["ISC", "ISC License"], "lgpl": ["GNU Lesser General Public License", "LGPLv3", "LGPL 2.1", "GNU LGPL version 3", "GNU Lesser General Public License v2.1"], "mit": ["MIT", "MIT License", "Expat MIT"], "mpl-2.0": ["Mozilla Public License 2.0", "MPL", "MPL-2.0"], "unlicense": ["Unlicense"], "wtfpl": ["WTFPL"], "zlib": ["zlib", "zlib License"],
}
#: How notices name a licence, and how prose uses the same words.
FRAMES = [
    "Licensed under the {}.", "Licensed under the {} license.", "Released under {}.", "Distributed under the terms of the {} license.", "This project is available under the {} license.", "This file is part of a project licensed under {}.", "You may use it under the terms of the {}.", "{} licensed",
    "License: {}", "SPDX-License-Identifier: {}", "Published under {}", "The code is under the {} license.", "Covered by the {}.", "Code released under the {} license, see file.", "Available under the {} Public License.", "This software is licensed under the {} Software License, Version 1.0.", "subject to the terms of the {} License",
    "Lizenziert unter der {}-Lizenz.", "Der Code steht unter der Lizenz {}.", "Ce programme est distribué sous la licence {}.", "Publié sous licence {}", "Este programa se distribuye bajo la licencia {}.", "Publicado bajo licencia {}",
]
PROSE = [
    "The {} lost its license in 1990.", "A {} license costs 40 dollars.", "His {} license expired in May.", "Version 3 of the {} was released under protest.", "The {} was distributed to 30 people.", "They reserved all seats of the {}.", "The public {} waited under the roof.", "The software of the {} was sold.", "He was licensed to {}.", "The license plate of the {} was new.",
    "The copyright of {} songs ran out.", "She had permission to {} there.", "All rights of the {} were discussed.", "The identifier of the {} is a number.", "The terms of the {} were fair.", "A general of the {} spoke to the public.", "The {} commons lie in the creative quarter.", "The source of the {} is a spring.", "The {} of the foundation was free.", "They reserved a {} with all rights of guests.",
]


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams_of(text: str) -> set[str]:
    w = words_of(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


@functools.cache
def telling() -> dict[str, set[str]]:
    """The words of each template that tell its family, by template."""
    return {t: {w for w in words_of(t) if _users()[w] <= TELLING and w not in PLAIN} for f, texts in TEMPLATES.items() if f not in (NONE, UNKNOWN) for t in texts}


@functools.cache
def phrases() -> dict[str, list[str]]:
    """What names each family word for word, between spaces: names, and templates shorter than a passage, without the words that grant."""
    grants = {"licensed", "distributed", "released", "shared", "available", "spdx"}
    short = lambda f: [t for t in TEMPLATES[f] if len(words_of(t)) <= 5 and words_of(t)[0] not in grants and words_of(t)[-1] != "licensed"]
    return {f: sorted({f" {' '.join(words_of(t))} " for t in [*NAMES.get(f, []), *short(f)]}) for f in TEMPLATES if f not in (NONE, UNKNOWN)}


@functools.cache
def _users() -> Counter:
    """How many families use a word."""
    return Counter(w for f, texts in TEMPLATES.items() if f not in (NONE, UNKNOWN) for w in {w for t in texts for w in words_of(t)})


def _forms() -> list[tuple[str, str]]:
    """The templates, and forms of them with words left out or other words around."""
    rng = random.Random(5)
    filler = "the of and work text file part see page author note this here some by was with from code data list".split()
    out = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = t.split()
            out += [(family, t)] * 2
            for _ in range(6):
                kept = [x for x in w if rng.random() > 0.12 or len(w) < 4] or w
                around = rng.choices(filler, k=rng.randint(0, 5)), rng.choices(filler, k=rng.randint(0, 5))
                out.append((family, " ".join([*around[0], *kept, *around[1]])))
    syllables = "ba ce di fo gu ka le mi no pu ra se ti vo xu".split()
    made = lambda: MADE + "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    for family, texts in TEMPLATES.items():
        for t in texts:
            own = {w for w in words_of(t) if _users()[w] <= FEW and w not in PLAIN}
            if family not in (NONE, UNKNOWN) and 0 < len(own) <= 4 and len(own) < len(set(words_of(t))):  # the same notice of a licence that nobody knows
                name = made()
                out.append((UNKNOWN, " ".join(name if set(words_of(w)) & own else w for w in re.split(r"[\s-]+", t))))
    for family, names in NAMES.items():
        for name in names:
            out += [(family, f.format(name)) for f in FRAMES]
    out += [(UNKNOWN, FRAMES[k % len(FRAMES)].format(made())) for k in range(20 * len(FRAMES))]
    out += [(NONE, PROSE[k % len(PROSE)].format(made())) for k in range(16 * len(PROSE))]
    shared = sorted(w for w, n in _users().items() if n > FEW and w not in PLAIN)
    plain = sorted(PLAIN)
    for i in range(900):  # prose, two thirds of it with words that several families share
        words = rng.choices(plain, k=rng.randint(1, 40 if i % 2 else 8)) + rng.choices(shared, k=i % 3)
        rng.shuffle(words)
        out.append((NONE, " ".join(words)))
    return out


@functools.cache
def keys() -> list[str]:
    """The known words that are not plain: without one of them a text is no notice."""
    return sorted({w for _, t in _forms() for w in words_of(t) if not w.startswith(MADE)} - PLAIN)


@functools.cache
def fit() -> tuple[list[str], dict[str, list[float]], list[float]]:
    """Families, weights by gram, biases; the temperature is already in them."""
    families = sorted(TEMPLATES)
    forms = _forms()
    grams = sorted({g for f, t in forms if f != NONE for g in grams_of(t)} | {g for t in TEMPLATES[NONE] for g in grams_of(t)})
    grams = [g for g in grams if not PLAIN.issuperset(g.split()) and not any(w.startswith(MADE) for w in g.split())]
    place = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(forms), len(grams) + 1), np.float32)
    for i, (_, t) in enumerate(forms):
        x[i, [place[g] for g in grams_of(t) if g in place]] = 1
        x[i, -1] = 1
    y = np.array([families.index(f) for f, _ in forms])
    aside = np.arange(len(forms)) % 5 == 3
    target = np.eye(len(families))[y]
    none = families.index(NONE)
    weight = np.where(y == none, 0.5, 1.0)[~aside].astype(np.float32)[:, None]
    w, squares = np.zeros((x.shape[1], len(families)), np.float32), np.float32(0)
    seen, want = x[~aside], target[~aside].astype(np.float32)
    for _ in range(300):
        z = seen @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = seen.T @ (weight * (p - want)) / np.float32(len(seen))
        squares = squares + g * g
        w -= np.float32(0.5) * g / np.sqrt(squares + np.float32(1e-10))
        w = np.sign(w) * np.maximum(0, np.abs(w) - np.float32(5e-4))  # lasso keeps the model sparse
        w[-1] = np.minimum(w[-1], w[-1, none])  # a text without a gram is none
    z = x[aside] @ w
    grid = np.exp(np.linspace(np.log(0.3), np.log(3), 40))

    def loss(t: float) -> float:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return float(-np.log(np.maximum(1e-12, (p / p.sum(axis=1, keepdims=True))[np.arange(len(z)), y[aside]])).mean())

    w /= min(grid, key=loss)
    w = w.astype(float)
    rows = {g: w[i].round(5).tolist() for g, i in place.items() if np.abs(w[i]).max() >= 0.15}
    return families, rows, w[-1].round(5).tolist()


def classify(paragraph: Column) -> Column:
    """struct<family, score, confirmed, also> of a paragraph; also: further families that it grants."""
    families, weights, bias = fit()
    known = F.from_json(F.lit(json.dumps(list(weights))), "array<string>")
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,array<double>>")
    templates = {f: [{"all": sorted(set(words_of(t))), "told": sorted(telling()[t])} for t in texts] for f, texts in TEMPLATES.items() if f not in (NONE, UNKNOWN)}
    shapes = F.from_json(F.lit(json.dumps(templates)), "map<string,array<struct<all:array<string>,told:array<string>>>>")
    words = F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)).otherwise(a))
    found = F.array_intersect(F.concat(words, pairs), known)
    z = F.aggregate(found, F.from_json(F.lit(json.dumps(bias)), "array<double>"), lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))
    names = F.array(*[F.lit(f) for f in families])

    named = F.from_json(F.lit(json.dumps(phrases())), "map<string,array<string>>")
    said = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    grant, joined = F.lower(paragraph).rlike(CUE), F.lower(paragraph).rlike(JOINED)
    holds = lambda ps, text: F.exists(ps, lambda p: F.contains(text, p))

    def judge(z: Column) -> Column:
        top = F.array_max(z)
        score = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda a, b: a + F.exp(b - top))
        family = F.element_at(names, F.array_position(z, top).cast("int"))
        enough = lambda t: F.size(F.array_intersect(t, words)) >= F.ceil(F.size(t) * F.lit(CONFIRM))
        own = F.try_element_at(named, family)
        alike = F.coalesce(F.exists(F.try_element_at(shapes, family), lambda t: enough(t["all"]) & enough(t["told"])), F.lit(False))
        passage = F.coalesce(F.exists(F.try_element_at(shapes, family), lambda t: (F.size(t["all"]) >= LONG) & enough(t["all"]) & enough(t["told"])), F.lit(False))
        bare = F.exists(own, lambda p: F.contains(said, p) & (F.size(F.split(F.trim(p), " ")) >= F.size(words) * F.lit(BARE)))
        beside = F.exists(own, lambda p: functools.reduce(lambda a, b: a | b, [F.contains(said, F.concat(F.lit(" " + w), p)) | F.contains(said, F.concat(p, F.lit(w + " "))) for w in BESIDE]))
        held = passage | F.coalesce((grant & holds(own, said) & (alike | beside)) | (alike & bare), F.lit(False))
        sure = (score >= CERTAIN) | (family == NONE)
        others = F.filter(F.map_keys(named), lambda f: (f != family) & holds(F.element_at(named, f), said))
        also = F.when(~family.isin(NONE, UNKNOWN) & grant & joined, others).otherwise(F.array().cast("array<string>"))
        # a unit that names several families is sure of the one it names
        sure = sure | (F.size(also) > 0)
        return F.struct(F.when(sure, family).otherwise(F.lit(UNKNOWN)).alias("family"), score.alias("score"), (sure & held & ~family.isin(NONE, UNKNOWN)).alias("confirmed"), also.alias("also"))

    return F.transform(F.array(z), judge)[0]


def _gate() -> str:
    """A pattern of the texts that hold one of keys(), by their beginnings."""
    by: dict[str, list[str]] = {}
    for w in keys():
        by.setdefault(w[0], []).append(w[1:])
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")(?![a-z0-9])"


def _runs(items: Column, begins) -> Column:
    """array of arrays: items cut before each one for which begins(previous, item); the first begins a run."""
    first = F.filter(F.transform(items, lambda x, i: F.when((i == 0) | begins(F.get(items, i - 1), x), i)), lambda i: i.isNotNull())
    return let(first, lambda at: F.transform(at, lambda i, k: F.slice(items, i + 1, F.coalesce(F.get(at, k + 1), F.size(items)) - i)))


def _parted(a: Column, b: Column) -> Column:
    """Whether line b does not go on with what line a says."""
    whole = F.coalesce(a["is"]["confirmed"] | b["is"]["confirmed"], a["is"]["confirmed"], b["is"]["confirmed"], F.lit(False))
    return a["p"].rlike(r"[.!?][\s\"')\]*/#-]*$") | (whole & ~b["p"].rlike(r"^[^\p{L}\p{N}]*\p{Ll}"))


def _notices(lines: Column, par: Column) -> Column:
    """array<struct<par, at, is>> of a unit: what it is as a whole, and confirmed lines of other families; if it is none, what its lines are."""
    notice = lambda at, x: F.struct(par.alias("par"), at.alias("at"), x.alias("is"))
    held = F.filter(lines, lambda x: F.coalesce(x["is"]["family"] != NONE, F.lit(False)))
    own = F.transform(held, lambda x: notice(x["at"], x["is"]))
    joined = F.array(notice(F.get(lines, F.lit(0))["at"], classify(F.array_join(F.transform(lines, lambda x: x["p"]), " "))))
    both = let(joined, lambda j: F.when(F.get(j, F.lit(0))["is"]["family"] == NONE, own).otherwise(F.concat(j, F.filter(own, lambda x: x["is"]["confirmed"]))))
    return F.when(F.size(lines) == 1, own).otherwise(both)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_notices, families (distinct, sorted), notices (line:family), best_family, best_score, confirmed of each row."""
    text, gate = F.coalesce(F.col("text"), F.lit("")), _gate()
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    empty = lambda x: F.trim(F.translate(x["p"], "\r\t", "  ")) == ""
    lines = F.transform(F.split(text, "\n"), lambda p, i: F.struct(i.alias("at"), p.alias("p"), F.lower(p).rlike(gate).alias("key")))
    none = F.array().cast("array<struct<at:int,p:string,key:boolean>>")
    df = df.select("doc_id", F.when(F.lower(text).rlike(gate), lines).otherwise(none).alias("lines"))
    paragraphs = F.transform(_runs(F.col("lines"), lambda a, b: empty(a) & ~empty(b)), lambda run: F.filter(run, lambda x: ~empty(x)))
    df = df.select("doc_id", F.filter(paragraphs, lambda run: F.exists(run, lambda x: x["key"])).alias("runs"))
    judged = lambda run: F.transform(run, lambda x: F.struct(x["at"].alias("at"), x["p"].alias("p"), x["key"].alias("key"), F.when(x["key"], classify(x["p"])).alias("is")))
    df = df.select("doc_id", F.transform("runs", judged).alias("runs"))
    units = F.flatten(F.transform("runs", lambda run, par: F.transform(_runs(run, _parted), lambda unit: F.struct(par.alias("par"), unit.alias("unit")))))
    df = df.select("doc_id", F.filter(units, lambda x: F.exists(x["unit"], lambda y: y["key"])).alias("units"))
    df = df.select("doc_id", F.flatten(F.transform("units", lambda x: _notices(x["unit"], x["par"]))).alias("all"))
    further = lambda x: F.transform(x["is"]["also"], lambda f: F.struct(x["par"].alias("par"), x["at"].alias("at"), F.struct(f.alias("family"), x["is"]["score"].alias("score"), x["is"]["confirmed"].alias("confirmed"), F.array().cast("array<string>").alias("also")).alias("is")))
    df = df.select("doc_id", F.flatten(F.transform("all", lambda x: F.concat(F.array(x), further(x)))).alias("all"))
    # a paragraph counts a family once
    df = df.select("doc_id", F.array_sort(F.transform("all", lambda x: F.struct(x["par"].alias("par"), x["is"]["family"].alias("family"), x["at"].alias("at"), x["is"].alias("is")))).alias("all"))
    once = F.filter("all", lambda x, i: (i == 0) | F.coalesce((F.get("all", i - 1)["par"] != x["par"]) | (F.get("all", i - 1)["family"] != x["family"]), F.lit(True)))
    df = df.select("doc_id", F.array_sort(F.transform(once, lambda x: F.struct(x["at"].alias("at"), x["is"].alias("is")))).alias("found"))
    best = F.array_max(F.transform("found", lambda x: F.struct(x["is"]["score"].alias("score"), (-x["at"]).alias("at"), x["is"]["family"].alias("family"), x["is"]["confirmed"].alias("confirmed"))))
    df = df.withColumn("best", best)
    return df.select(
        "doc_id",
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["is"]["family"]))), ",").alias("families"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["at"], x["is"]["family"])), ",").alias("notices"),
        F.col("best.family").alias("best_family"),
        F.col("best.score").alias("best_score"),
        F.coalesce(F.col("best.confirmed"), F.lit(False)).alias("confirmed"),
    )
