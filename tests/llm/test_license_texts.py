"""Signature sentences of licence texts: real notices, near misses, and gates."""

import random
import re

import pytest
from test_llm_operators import _example

from hyrank.llm import licenses
from hyrank.llm.license_texts import NOTICES

# Public notices as they stand in files, with a label that must be found, and a like text without it.
TEXTS = [
    ("gpl", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by",
     "This program is free of charge; you can redistribute it as you like."),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library.",
     "You should have received a copy of the invoice along with this library."),
    ("agpl", "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
     "Foo is free software: you can ask anyone for it."),
    ("gfdl", "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.", "with no invariant sections of the orbit."),
    ("mit", "to deal in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish",
     "to deal in antiques without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.",
     "The notice shall be included in substantial portions of the meal."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
     "The author disclaims all knowledge of it."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions", "Redistributions of wealth must retain fairness."),
    ("bsd-3-clause", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived",
     "Neither the name of the town nor the names of its streets are known."),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
     "All advertising materials must display the price."),
    ("apache-2.0", "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n", "You may obtain a copy of the license at the town hall."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with",
     "You may not use this door except in emergencies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy", "This form is subject to the terms of the office."),
    ("mpl-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1", "The contents of this file are subject to change."),
    ("epl-1.0", "are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "An eclipse is made public by which"),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License", "common development and distribution costs"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
     "The origin of this cheese must not be misrepresented."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0.", "Distributed under the counter to boost software sales."),
    ("psf-2", "PSF is making Python available to Licensee on an \"AS IS\" basis.", "The zoo is making a python available."),
    ("postgresql", "for any purpose, without fee, and without a written agreement is hereby granted", "without a written agreement nothing is granted"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "Anyone is free to copy the recipe."),
    ("cc0", "https://creativecommons.org/publicdomain/zero/1.0/", "https://creativecommons.org/about"),
    ("cc0", "the person has waived all copyright and related or neighboring rights", "has waived all fees"),
    ("ofl", "with Reserved Font Name Lobster", "with a reserved table"),
    ("wtfpl", "http://www.wtfpl.net/", "the net"),
    ("json", "The Software shall be used for Good, not Evil.", "good, not great"),
    ("public-domain", "The author disclaims copyright to this source code.", "The author disclaims the story."),
    ("eula", "You may not reverse engineer, decompile, or disassemble the product", "She is a reverse engineer."),
    ("proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited", "Unauthorized parking is strictly prohibited"),
    ("ogl", "Contains public sector information licensed under the Open Government Licence v3.0.", "contains public sector jobs"),
]


def labels(text):
    return [s["label"] for s in licenses.scan_text(text)["spans"]]


@pytest.mark.parametrize("label,text,miss", TEXTS)
def test_notices(label, text, miss):
    assert label in labels(text) and licenses.scan_text(text)["score"] >= 0.7
    assert label not in labels(miss)


def test_patterns_are_distinct_and_gated():
    assert len(NOTICES) == len({p for _, _, p in NOTICES}) >= 140
    rng = random.Random(2)
    for label, keyword, p in NOTICES:
        pattern = re.compile(p.replace(" ", r"\s+"), re.A)
        tree = re._parser.parse(pattern.pattern, re.A)
        texts = [x for x in (_example(tree, rng) for _ in range(40)) if pattern.search(x)]
        assert texts, label
        for x in texts:
            one = " ".join(x.split())
            assert keyword in one, (keyword, x)
            # a text with each place of the keyword's last word spoilt is not the sentence
            last = re.split(r"[ /]", keyword)[-1]
            assert not pattern.search(one.replace(last, "qq" + last[1:])), (keyword, one)


def test_ordinary_text_and_long_text():
    assert not labels("A licence to fish is public, and anyone may use the pond, copy the map or change the bait for any purpose.")
    notice = "Permission is hereby granted, free of charge, to any person. "
    got = licenses.scan_text("no rules here, " * 100_000 + notice + "é" * 10 + TEXTS[10][1])
    assert [s["label"] for s in got["spans"]] == ["mit", "apache-2.0"]
    assert got["spans"][0]["start"] == 15 * 100_000
