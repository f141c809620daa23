"""The table of known licences that the licence query looks up: entire texts and one-line notices.

Texts are those of `licenses` and the files of `license_texts` (SPDX identifier, then a word that tells forms of one
text apart), each as it stands, with its paragraphs unwrapped (lines that start with "copyright" are left out of an
entire text, so the wrapping counts), up to the end of its terms, and with its usual title lines. A GPL text is the
same for "only" and "or later" and is named "only". Notices are SPDX tags, usual sentences and standard header lines.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.licenses import LICENSES, NOTICES

TEXTS = Path(__file__).parent / "license_texts"
END = re.compile(r"^[ \t]*END OF TERMS AND CONDITIONS.*$", re.MULTILINE)
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
}
NAMES = {
    "0BSD": ("BSD Zero Clause License",),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "ISC": ("ISC License",),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
SENTENCES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.", "This software is released under {}.", "This code is licensed under {}.", "This file is licensed under {}.")
#: Identifiers of tags besides those of NAMES.
TAGS = ("AGPL-3.0-or-later", "Artistic-2.0", "BSD-4-Clause", "CDDL-1.0", "EPL-1.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "MIT-0", "MPL-1.1", "NCSA", "OFL-1.1", "PSF-2.0", "Unicode-3.0", "WTFPL")
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may'),
    ("Apache-2.0", "The ASF licenses this file to You under the Apache License, Version 2.0"),
    ("Apache-2.0", 'to you under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'to you under the Apache License, Version 2.0 (the'),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "License, v. 2.0. If a copy of the MPL was not distributed with this"),
    ("MPL-2.0", "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def texts() -> list[tuple[str, str]]:
    """Entire texts in each of their forms: (license, text)."""
    read = [(re.sub(r"(\.spdx)?\.txt$", "", p.name), p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    forms = []
    for name, text in [*LICENSES, *read]:
        end = END.search(text)
        for form in (text, text[: end.end()] if end else text):
            unwrapped = "\n\n".join(" ".join(part.split()) for part in re.split(r"\n\s*\n", form))
            forms += [(name, title + body) for title in ("", *[f"{t}\n\n" for t in TITLES.get(name, ())]) for body in (form, unwrapped)]
    return list(dict.fromkeys(forms))


def notices() -> list[tuple[str, str]]:
    """One-line notices: (license, line)."""
    said = [(i, sentence.format(the + name)) for i, names in NAMES.items() for name in names for the in ("", "the ", "a ") for sentence in SENTENCES]
    tags = [(i, f"SPDX-License-Identifier: {i}") for i in (*NAMES, *TAGS)]
    return list(dict.fromkeys([*NOTICES, *HEADERS, *tags, *said]))


def known_licenses(spark: SparkSession) -> DataFrame:
    """Rows (license, text, whole) for scan_licenses."""
    rows = [(i, t, True) for i, t in texts()] + [(i, t, False) for i, t in notices()]
    return spark.createDataFrame(rows, "license string, text string, whole boolean")
