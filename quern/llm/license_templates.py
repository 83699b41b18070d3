"""Wording of common licences, as it stands in notices and headers."""

from __future__ import annotations

from itertools import product

# Names under which licences are cited, as (wordings, versions); a name without version has none.
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
NAMES = {
    "MIT": (["MIT License", "MIT licensed", "MIT/X11 License", "Expat License"], []),
    "Apache-2.0": (["Apache License", "Apache Software License", "Apache Public License"], ["2.0", "2"]),
    "GPL-2.0": ([_GNU["GPL"], "General Public License", "GNU GPL", "GPL"], ["2.0", "2"]),
    "GPL-3.0": ([_GNU["GPL"], "General Public License", "GNU GPL", "GPL"], ["3.0", "3"]),
    "LGPL-2.1": ([_GNU["LGPL"], "Lesser General Public License", "GNU LGPL", "LGPL"], ["2.1"]),
    "LGPL-3.0": ([_GNU["LGPL"], "Lesser General Public License", "GNU LGPL", "LGPL"], ["3.0", "3"]),
    "AGPL-3.0": ([_GNU["AGPL"], "Affero General Public License", "GNU AGPL", "AGPL"], ["3.0", "3"]),
    "BSD-2-Clause": (["BSD 2-Clause License", "2-Clause BSD License", "BSD 2-Clause", "2-Clause BSD", "Simplified BSD License", "FreeBSD License"], []),
    "BSD-3-Clause": (["BSD 3-Clause License", "3-Clause BSD License", "BSD 3-Clause", "3-Clause BSD", "New BSD License", "Modified BSD License"], []),
    "MPL-2.0": (["Mozilla Public License", "MPL"], ["2.0", "2"]),
    "ISC": (["ISC License", "ISC licensed"], []),
    "BSL-1.0": (["Boost Software License", "Boost License"], ["1.0", "1"]),
    "EPL-2.0": (["Eclipse Public License", "EPL"], ["2.0"]),
    "Unlicense": (["Unlicense"], []),
    "CC0-1.0": (["CC0", "Creative Commons CC0", "Creative Commons Zero", "Creative Commons Public Domain Dedication"], ["1.0", "1"]),
    **{
        f"CC-{kind}-4.0": ([f"CC {kind}", f"Creative Commons {kind}", f"Creative Commons {name}"], ["4.0", "4"])
        for kind, name in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
            ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}
#: A version as it follows a name; {} is its number.
VERSIONS = ["{}", "v{}", "v. {}", "version {}", "License {}", "License v{}", "License version {}"]


# Grants and headers.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software."
    ),
}

# Paragraphs of the full texts that other licences do not have.
FULL_TEXTS = [
    (
        "Apache-2.0",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a "
        "perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative "
        "Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    (
        "GPL-2.0",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General "
        "Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    (
        "GPL-3.0",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. "
        "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a "
        "program--to make sure it remains free software for all its users.",
    ),
    (
        "MPL-2.0",
        "If it is impossible or undesirable to put the notice in a particular file, then You may include the notice in a location "
        "(such as a LICENSE file in a relevant directory) where a recipient would be likely to look for such a notice.",
    ),
    *(
        (
            key,
            "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this "
            f"{NAMES[key][0][2]} 4.0 International Public License (\"Public License\"). To the extent this Public "
            "License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these "
            "terms and conditions.",
        )
        for key in NAMES if key.startswith("CC-")
    ),
]


def _cited(key: str) -> list[str]:
    names, versions = NAMES[key]
    cited = [f"{n} {form.format(v)}" for n, form, v in product(names, VERSIONS, versions)] if versions else list(names)
    cited += [f"{n}{mark}{v}" for n, v, mark in product(names, versions, ("", "v")) if n.isalnum() and n.isupper()]
    if key.startswith("CC-"):
        bare = names[2].removeprefix("Creative Commons ")
        cited += [f"{name} {end}" for name in (names[2], bare) for end in ("4.0 International", "4.0 International License", "4.0 International Public License")]
    if key == "Apache-2.0":
        cited += ["Apache 2.0 License", "Apache 2 License", "Apache v2.0 License", "Apache v2 License"]
    if key == "CC0-1.0":
        cited += [f"{n} 1.0 Universal" for n in names]
    return cited


def templates() -> list[tuple[str, str]]:
    """(licence, wording): each name in its spellings, its identifier tag, and each text."""
    cited = [(key, name) for key in NAMES for name in _cited(key)]
    tags = [(key, f"SPDX-License-Identifier: {key}{end}") for key in NAMES for end in ("", "-only", "-or-later")]
    return cited + tags + FULL_TEXTS + list(TEXTS.items())
