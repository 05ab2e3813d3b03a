"""Licence texts and notices of the families that `licence_scan` knows, and how training examples are made of them."""

from __future__ import annotations

import random

#: Names and identifiers by family.
NAMES: dict[str, list[str]] = {
    "mit": ["MIT License", "MIT licence", "MIT", "Expat License", "MIT/X11 license"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License", "Apache License v2"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GPL-3.0", "GPL-2.0-only", "GPLv3", "GPLv2 or later", "GNU GPL", "GPL version 2", "GPL-3.0-or-later"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv3", "GNU LGPL", "GNU Library General Public License", "LGPL-3.0-or-later"],
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3", "GNU AGPL", "AGPL-3.0-only"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "3-clause BSD license"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0"],
    "isc": ["ISC License", "ISC licence", "ISC"],
    "unlicense": ["Unlicense", "The Unlicense"],
    "cc0": ["CC0 1.0 Universal", "CC0", "CC0-1.0", "Creative Commons Zero", "Creative Commons CC0 public domain dedication"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0", "CC BY"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike License", "CC BY-NC"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND"],
}

FRAMES = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is released under the {}.", "Distributed under the terms of the {}.",
    "This project is licensed under the {}. See the LICENSE file for details.", "SPDX-License-Identifier: {}", "License: {}", "Published under the {}.", "The content of this page is available under the {}.", "You may redistribute it under the terms of the {}.",
    "Except where otherwise noted, this site is licensed under a {}.", "All code here is covered by the {}.", "Made available under {}.", "Text is available under the {}; additional terms may apply.",
]

#: Paragraphs of the licences themselves and of their standard notices.
TEXTS: dict[str, list[str]] = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."],
    "cc-by": ["This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.", "You must give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "cc-by-sa": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.", "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "cc-by-nc": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.", "You may not use the material for commercial purposes."],
    "cc-by-nd": ["This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nd/4.0/.", "If you remix, transform, or build upon the material, you may not distribute the modified material."],
}

#: Paragraphs that look like notices but name no licence.
DECOYS = [
    "He lost his driver's license and had to take the bus.", "The bar is licensed under the new city rules.", "The record was released under the old label.", "A fishing license is required in all lakes.", "All rights reserved.", "Licensed under the bridge.",
    "The film was released under a different title in France.", "Distributed under the counter for years.", "The general public was not allowed in.", "A public meeting on the general plan is open to all.", "License fees are due in March.", "The version 2.0 of the report is late.",
    "See the file for details.", "This work is done.", "This software is slow and the terms are bad.", "Creative people met in the commons of the college.", "The foundation gave free software classes.", "Permission was granted by the court.", "The attribution of the painting is uncertain.",
    "Apache helicopters flew over the valley.", "Students of MIT released a study under strict embargo.", "Terms and conditions apply.", "Published under her maiden name.", "The work is licensed.", "Made available under pressure.", "Version 3 of the plan, released in May, covers the north.",
    "Use of this site is subject to our terms of service.", "Copyright of the photographs remains with the museum.", "The agency licensed two new clinics under the act.", "Redistribution of wealth was debated in parliament.", "The software is provided to members only.", "This page is licensed to readers of the magazine.",
]

_FILLER = "the of and to in is that it was for on as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def templates() -> list[tuple[str, str, str]]:
    """(family, name, text) of every template: each name in each frame, and the paragraphs."""
    out = []
    for family, names in NAMES.items():
        out += [(family, f"{family}:{n}", frame.format(n)) for n in names for frame in FRAMES]
        out += [(family, f"{family}:text-{k}", t) for k, t in enumerate(TEXTS[family])]
    return out


def examples(background: list[str], seed: int) -> tuple[list[str], list[str]]:
    """Texts and their families ("" is unknown): templates alone, wrapped, embedded in prose, and paragraphs without a licence."""
    r = random.Random(seed)
    prose = [w for p in background for w in p.split()] or _FILLER
    some = lambda lo, hi: " ".join(r.choice(r.choice((prose, _FILLER))) for _ in range(r.randint(lo, hi)))
    texts, family = [], []
    for f, name, t in templates():
        texts.append(t)
        family.append(f)
        texts.append(f"{some(0, 30)} {t} {some(0, 30)}")
        family.append(f)
        words = t.split()
        if ":text-" in name:
            # wrapped at several widths, as lines of a notice are; lines that families share are examples of each
            for width in (9, 11, 13):
                for lo in range(0, len(words), width):
                    if len(words) - lo >= 6:
                        texts.append(" ".join(words[lo : lo + width]))
                        family.append(f)
            for _ in range(6):
                texts.append(f"{some(0, 20)} {t} {some(0, 20)}")
                family.append(f)
    for d in DECOYS:
        for k in range(6):
            texts.append(d if not k else f"{some(0, 20)} {d} {some(0, 20)}")
            family.append("")
    for frame in FRAMES:
        for _ in range(8):
            texts.append(frame.format(some(1, 4)))
            family.append("")
    for p in background:
        texts.append(p)
        family.append("")
    for _ in range(300):
        texts.append(some(3, 60))
        family.append("")
    return texts, family
