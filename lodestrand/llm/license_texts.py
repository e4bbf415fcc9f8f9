"""The public wordings of licence notices, headers and short licences.

Of licences too long to be a template, the standard header and the opening passage stand for them. ``must`` are word pairs
that a match has to hold, so that versions and members of one family are told apart.
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    name: str
    text: str
    must: tuple[str, ...] = ()


_PERMISSIVE_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
    "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software. "
)
_FREE = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {family} as published by the Free Software Foundation"
_NO_WARRANTY = (
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the GNU {family} for more details."
)

_TEXTS = [
    Template("MIT", _MIT_GRANT + _PERMISSIVE_DISCLAIMER, ("is hereby", "substantial portions")),
    Template("MIT", _MIT_GRANT, ("is hereby", "substantial portions")),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("provided that",)),
    Template("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE', ("granted the",)),
    Template("BSD-2-Clause", _BSD_GRANT + _BSD_DISCLAIMER, ("binary forms", "distribution this")),
    Template("BSD-3-Clause", _BSD_GRANT + _BSD_NAME + _BSD_DISCLAIMER, ("binary forms", "neither the")),
    Template("BSD-3-Clause", _BSD_GRANT + _BSD_NAME, ("binary forms", "neither the")),
    Template("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ("bsd style",)),
    Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", ("redistribute it",)),
    Template("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered software",)),
    Template("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004", ("public license",)),
    Template("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:', ("or organization",)),
    Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", ("boost software",)),
    Template("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.", ("two paragraphs",)),
    Template("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', ("apache license", "2 0")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license", "2 0")),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ("version 2", "january 2004")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla public", "2 0")),
    Template("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/', ("mozilla public", "1 1")),
    Template("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse public", "2 0")),
    Template("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", ("eclipse public", "v1 0")),
    Template("CDDL-1.0", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.', ("common development",)),
    Template("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.", ("public domain",)),
    Template("CC0-1.0", "CC0 1.0 Universal Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights", ("cc0 1",)),
    Template("GPL-2.0-only", _FREE.format(what="program", mark=";", family="General Public License") + "; version 2 of the License.", ("gnu general", "version 2")),
    Template("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ("gnu general", "version 2")),
    Template("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2.", ("gnu general", "version 2")),
    Template("GPL-2.0-or-later", _FREE.format(what="program", mark=";", family="General Public License") + "; either version 2 of the License, or (at your option) any later version.", ("gnu general", "version 2", "any later")),
    Template("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.", ("gnu general", "version 2", "june 1991")),
    Template("GPL-3.0-only", _FREE.format(what="program", mark=":", family="General Public License") + ", version 3.", ("gnu general", "version 3")),
    Template("GPL-3.0-only", _FREE.format(what="program", mark=":", family="General Public License") + ", version 3 of the License.", ("gnu general", "version 3")),
    Template("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3.", ("gnu general", "version 3")),
    Template("GPL-3.0-or-later", _FREE.format(what="program", mark=":", family="General Public License") + ", either version 3 of the License, or (at your option) any later version.", ("gnu general", "version 3", "any later")),
    Template("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", ("gnu general", "version 3", "june 2007")),
    Template("LGPL-2.1-only", _FREE.format(what="library", mark=";", family="Lesser General Public License") + "; version 2.1 of the License.", ("lesser general", "2 1")),
    Template("LGPL-2.1-or-later", _FREE.format(what="library", mark=";", family="Lesser General Public License") + "; either version 2.1 of the License, or (at your option) any later version.", ("lesser general", "2 1", "any later")),
    Template("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.", ("lesser general", "2 1")),
    Template("LGPL-3.0-only", _FREE.format(what="program", mark=":", family="Lesser General Public License") + ", version 3 of the License.", ("lesser general", "version 3")),
    Template("LGPL-3.0-or-later", _FREE.format(what="program", mark=":", family="Lesser General Public License") + ", either version 3 of the License, or (at your option) any later version.", ("lesser general", "version 3", "any later")),
    Template("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", ("lesser general", "version 3")),
    Template("AGPL-3.0-only", _FREE.format(what="program", mark=":", family="Affero General Public License") + ", version 3 of the License.", ("affero general", "version 3")),
    Template("AGPL-3.0-or-later", _FREE.format(what="program", mark=":", family="Affero General Public License") + ", either version 3 of the License, or (at your option) any later version.", ("affero general", "version 3", "any later")),
    Template("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.", ("affero general", "version 3")),
    Template("proprietary", "All rights reserved.", ("all rights", "rights reserved")),
]

#: Names under which licences are commonly granted in a sentence, and the sentences.
_NAMED = [("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("Apache-2.0", "Apache 2.0"), ("MPL-2.0", "Mozilla Public License 2.0")]
_SENTENCES = ["Licensed under the {name} License.", "Released under the {name} License.", "Distributed under the {name} License.", "Under the terms of the {name} License."]
_CREATIVE = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
_VERSIONS = [("4.0", "International"), ("3.0", "Unported")]


def _by_rule() -> list[Template]:
    """Sentences that grant a named licence, Creative Commons notices, and machine-readable tags."""
    out = []
    for label, name in _NAMED:
        words = name.replace(" License", "").lower().replace("-", " ").replace(".", " ").split()
        must = tuple(f"{a} {b}" for a, b in zip(["the", *words], words, strict=False))
        out += [Template(label, s.format(name=name).replace("License 2.0 License", "License 2.0"), must if "Mozilla" not in name else ("mozilla public", "2 0")) for s in _SENTENCES]
    for code, title in _CREATIVE:
        for version, where in _VERSIONS:
            label, must = f"CC-{code}-{version}", (version.replace(".", " "),)
            out.append(Template(label, f"This work is licensed under a Creative Commons {title} {version} {where} License.", must))
            out.append(Template(label, f"Licensed under CC {code} {version}.", must))
    labels = sorted({t.name for t in _TEXTS + out} - {"proprietary"})
    return out + [Template(x, f"SPDX-License-Identifier: {x}", ("license identifier",)) for x in labels]


TEMPLATES: list[Template] = sorted(_TEXTS + _by_rule())
