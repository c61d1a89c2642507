"""Names of licenses in prose, expressions, and notices in one paragraph."""

from test_native import BSD

from quillwatch.llm import licenses

CASES = {
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "Licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License": "CC-BY-NC-SA-3.0",
    "SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only",
    "SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later",
    "// SPDX-License-Identifier: LGPL-2.1+\nint x;": "LGPL-2.1-or-later",
    "Distributed under the MIT License.": "MIT",
    "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
    "licensed under the MIT License - see the [LICENSE](LICENSE) file": None,
    "Licensed under the MIT License - see the LICENSE file": "MIT",
    "Licensed to the Apache Software Foundation (ASF) under one\nor more contributor license agreements.  See the NOTICE file": "Apache-2.0",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying\nfile LICENSE_1_0.txt)": "BSL-1.0",
    "SPDX-License-Identifier: GPL-2.0-only OR MIT": "MIT OR GPL-2.0-only",
    "SPDX-License-Identifier: MIT OR GPL-2.0-or-later": "MIT OR GPL-2.0-or-later",
    "SPDX-License-Identifier: Apache-2.0 OR BSL-1.0": "Apache-2.0 OR BSL-1.0",
    "Released under the 3-Clause BSD License": "BSD-3-Clause",
    " ".join(BSD.split()): "BSD-3-Clause",
    "a+b 1+1 = 2+2": None,
}


def test_wordings(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "k int, text string")
    got = {r["k"]: r["license"] for r in licenses.scan_licenses(df).collect()}
    assert {t: got[k] for k, t in enumerate(CASES)} == CASES


def test_every_sentence_has_one_meaning_and_a_rule():
    meaning = {}
    for identifier, sentence in licenses.SENTENCES:
        assert meaning.setdefault(sentence, identifier) == identifier
    used = {i for _, _, seq in licenses.RULES for i in seq}
    assert {i for i, _ in licenses.SENTENCES} - used <= {"reserved", "as-is", "gpl-hope", "mit-notice", "apache-copy", "bsd-names", "bsd-source", "bsd-binary", "zlib-as-is"}
