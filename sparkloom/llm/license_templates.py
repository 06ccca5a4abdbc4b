"""Wording of licenses: [[ ]] around optional words, {{n}} for up to n words of any kind, | between phrases.

A name that ends in -notice is a short statement of the license; other names are the
license's text, or the notice that the license itself asks to be put in files."""

_GRANT = """Permission is hereby granted, free of charge, | to any person obtaining a copy of this software [[and associated documentation files]] (the "Software"),
to deal in the Software without restriction, | including without limitation the rights to use, copy, modify, | merge, publish, distribute, sublicense, and/or sell copies of the Software, |
and to permit persons to whom the Software is furnished to do so"""
_COPIES = """, subject to the following conditions: | The above copyright notice and this permission notice [[(including the next paragraph)]] | shall be included in all copies or substantial portions of the Software."""
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, | EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF | MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON[[-]]INFRINGEMENT."""
_NO_LIABILITY = """IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY CLAIM, | DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, | TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH | THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_END = f"{_NO_WARRANTY.replace('NON[[-]]INFRINGEMENT', '[[NONINFRINGEMENT]] [[NON-INFRINGEMENT]]')} {_NO_LIABILITY}"

_USE = "Redistribution and use in source and binary forms, | with or without modification, are permitted | provided that the following conditions are met: {{1}}"
_SOURCE = "Redistributions of source code must retain | the above copyright notice, this list of conditions | and the following disclaimer. {{1}}"
_BINARY = "Redistributions in binary form must reproduce | the above copyright notice, this list of conditions | and the following disclaimer in the documentation | and/or other materials provided with the distribution. {{1}}"
_NAMES = "Neither the name of {{12}} nor the names of {{2}} contributors | may be used to endorse or promote products | derived from this software without specific | prior written permission."
_ADVERTISE = "All advertising materials mentioning features or use | of this software must display the following | acknowledgement: This product includes software developed by {{16}} {{1}}"
_AS_IS = """THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND | ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, | BUT NOT LIMITED TO, THE IMPLIED WARRANTIES | OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE | ARE DISCLAIMED.
IN NO EVENT SHALL {{12}} BE LIABLE | FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, | EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT | NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS | OR SERVICES; LOSS OF USE, DATA, OR PROFITS; |
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON | ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, | STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE | OR OTHERWISE) ARISING IN ANY WAY OUT OF | THE USE OF THIS SOFTWARE, EVEN IF | ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_GNU = """{{6}} is free software[[;]] [[:]] you can redistribute it and/or modify it | under the terms of the GNU {name} Public License {as_}published by the Free Software Foundation"""
_GNU_END = """{{6}} is distributed in the hope that it will be useful, | but WITHOUT ANY WARRANTY; without even the implied warranty of | MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. | See the GNU {name} Public License for more details."""


def _gnu(name: str, version: str, later: bool) -> str:
    which = f"; either version {version} of the License, or (at your option) any later version." if later else f"[[;]] version {version} of the License[[.]] [[only]]"
    return f"{_GNU} {which} {_GNU_END}".replace("{name}", name).replace("{as_}", "as ")


def _cc(words: str, code: str) -> str:
    return f"""licensed under [[a]] [[the]] Creative Commons {words} [[4.0]] [[3.0]] [[International]] [[Unported]] [[{code}]] License"""


SHORT = {
    "MIT": f"{_GRANT}{_COPIES} {_MIT_END}",
    "MIT-0": f"{_GRANT}. {_MIT_END}",
    "X11": f"{_GRANT}{_COPIES} {_MIT_END} Except as contained in this notice, the name of {{{{8}}}} shall not be used in advertising | or otherwise to promote the sale, use or other dealings | in this Software without prior written authorization from {{{{8}}}}",
    "JSON": f"{_GRANT}{_COPIES} The Software shall be used for Good, not Evil. {_MIT_END}",
    "NCSA": f"""{_GRANT.replace('deal in', 'deal with')}, subject to the following conditions: {{{{1}}}} Redistributions of source code must retain | the above copyright notice, this list of conditions | and the following disclaimers. {{{{1}}}}
Redistributions in binary form must reproduce | the above copyright notice, this list of conditions | and the following disclaimers in the documentation | and/or other materials provided with the distribution. {{{{1}}}}
Neither the names of {{{{16}}}} nor the names of its contributors may be used | to endorse or promote products derived from this Software | without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software | for any purpose with or without fee is hereby granted, | provided that the above copyright notice and this permission notice | appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND {{8}} DISCLAIMS ALL WARRANTIES | WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES | OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{8}} BE LIABLE |
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES | OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, | WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, | ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software | for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND {{8}} DISCLAIMS ALL WARRANTIES | WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES | OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{8}} BE LIABLE |
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES | OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, | WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, | ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-1-Clause": f"{_USE} {_SOURCE} {_AS_IS}",
    "BSD-2-Clause": f"{_USE} {_SOURCE} {_BINARY} {_AS_IS}",
    "BSD-3-Clause": f"{_USE} {_SOURCE} {_BINARY} {_NAMES} {_AS_IS}",
    "BSD-4-Clause": f"{_USE} {_SOURCE} {_BINARY} {_ADVERTISE} {_NAMES} {_AS_IS}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. | In no event will the author[[s]] be held liable | for any damages arising from the use of this software.
Permission is granted to anyone to use this software | for any purpose, including commercial applications, | and to alter it and redistribute it freely, | subject to the following restrictions: {{1}}
The origin of this software must not be misrepresented; | you must not claim that you wrote the original software. | If you use this software in a product, an acknowledgment | in the product documentation would be appreciated but is not required. {{1}}
Altered source versions must be plainly marked as such, | and must not be misrepresented as being the original software. {{1}} | This notice may not be removed or altered from any source distribution.""".replace("author[[s]]", "[[author]] [[authors]]"),
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization | obtaining a copy of the software and accompanying documentation covered by this license (the "Software") | to use, reproduce, display, distribute, execute, and transmit the Software, |
and to prepare derivative works of the Software, | and to permit third-parties to whom the Software is furnished to do so, all subject to the following: |
The copyright notices in the Software and this entire statement, | including the above license grant, this restriction and the following disclaimer, | must be included in all copies of the Software, in whole or in part, | and all derivative works of the Software, |
unless such copies or derivative works are solely in the form of | machine-executable object code generated by a source language processor.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. | Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, |
either in source code form or as a compiled binary, | for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software | dedicate any and all copyright interest in the software to the public domain. | We make this dedication for the benefit of the public at large |
and to the detriment of our heirs and successors. | We intend this dedication to be an overt act of relinquishment in perpetuity | of all present and future rights to this software under copyright law.""",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, | and changing it is allowed as long as the name is changed. | DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE |
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION {{1}} | You just DO WHAT THE FUCK YOU WANT TO.""",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its documentation | for any purpose, without fee, and without a written agreement is hereby granted, | provided that the above copyright notice and this paragraph
and the following two paragraphs appear in all copies. | IN NO EVENT SHALL {{8}} BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, | OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, | ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION""",
    "HPND": """Permission to use, copy, modify and distribute this software and its documentation | for any purpose [[and without fee]] is hereby granted, | provided that the above copyright notice appear in all copies [[and]] [[,]] that both [[that]] [[the]] copyright notice and this permission notice appear in supporting documentation""",
    "curl": """Permission to use, copy, modify, and distribute this software for any purpose | with or without fee is hereby granted, | provided that the above copyright notice and this permission notice appear in all copies. |
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, | EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF | MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS.""",
    "Beerware": """As long as you retain this notice you can do whatever you want with this stuff. | If we meet some day, and you think this stuff is worth it, | you can buy me a beer in return""",
    "UPL-1.0": """Subject to the condition set forth below, permission is hereby granted to any person | obtaining a copy of this software, associated documentation and/or data (collectively the "Software"), | free of charge and under any and all copyright rights in the Software""",
    "Fair": """Usage of the works is permitted provided that this instrument is retained with the works, | so that any entity that uses the works is notified of this instrument. | DISCLAIMER: THE WORKS ARE WITHOUT WARRANTY.""",
    "FSFAP": """Copying and distribution of this file, with or without modification, | are permitted in any medium without royalty | provided the copyright notice and this notice are preserved. | This file is offered as-is, without any warranty.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); | you may not use this file except in compliance with the License. | You may obtain a copy of the License at {{10}}
Unless required by applicable law or agreed to in writing, | software distributed under the License is distributed on an "AS IS" BASIS, | WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. |
See the License for the specific language governing permissions | and limitations under the License.""",
    "Apache-1.1": f"""{_USE} {_SOURCE} {_BINARY} The end-user documentation included with the redistribution, | if any, must include the following acknowledgment: {{{{30}}}} | Alternately, this acknowledgment may appear in the software itself, | if and wherever such third-party acknowledgments normally appear.""",
    "GPL-2.0-only": _gnu("General", "2", False),
    "GPL-2.0-or-later": _gnu("General", "2", True),
    "GPL-3.0-only": _gnu("General", "3", False),
    "GPL-3.0-or-later": _gnu("General", "3", True),
    "LGPL-2.0-or-later": _gnu("Library General", "2", True),
    "LGPL-2.1-only": _gnu("Lesser General", "2.1", False),
    "LGPL-2.1-or-later": _gnu("Lesser General", "2.1", True),
    "LGPL-3.0-only": _gnu("Lesser General", "3", False),
    "LGPL-3.0-or-later": _gnu("Lesser General", "3", True),
    "AGPL-3.0-only": _gnu("Affero General", "3", False),
    "AGPL-3.0-or-later": _gnu("Affero General", "3", True),
    "GFDL-1.3": """Permission is granted to copy, distribute and/or modify this document | under the terms of the GNU Free Documentation License, Version 1.3 | [[or any later version]] published by the Free Software Foundation""",
    "MPL-1.1": """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); | you may not use this file except in compliance with the License. | You may obtain a copy of the License at {{8}}
Software distributed under the License is distributed on an "AS IS" basis, | WITHOUT WARRANTY OF ANY KIND, either express or implied. | See the License for the specific language governing rights and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. | If a copy of the MPL was not distributed with this file, | You can obtain one at {{8}}""",
    "EPL-1.0": """made available under the terms of the Eclipse Public License v1.0 | which accompanies this distribution, and is available at {{10}}""",
    "EPL-2.0": """made available under the terms of the Eclipse Public License {{1}} 2.0 | which is available at {{10}}""",
    "CDDL-1.0": """The contents of this file are subject to the terms of the | Common Development and Distribution License (the "License"). | You may not use this file except in compliance with the License.""",
    "EUPL-1.2": """Licensed under the EUPL, Version 1.2 [[or]] [[–]] [[as soon they will be approved by the European Commission]] [[–]] [[subsequent versions of the EUPL]] (the "Licence"); | You may not use this work except in compliance with the Licence.""",
    "OFL-1.1": """This Font Software is licensed under the SIL Open Font License, Version 1.1. | This license is copied below, and is also available with a FAQ at {{8}}""",
    "Artistic-2.0": """you can redistribute it and/or modify it under the terms of | [[the]] Artistic License [[(]] [[version]] 2.0""",
    "AFL-3.0": "Licensed under the Academic Free License version 3.0",
    "OSL-3.0": "Licensed under the Open Software License version 3.0",
    "CECILL-2.1": """This software is governed by the CeCILL [[2.1]] license under French law | and abiding by the rules of distribution of free software. | You can use, modify and/or redistribute the software under the terms of the CeCILL license""",
    "MS-PL": """This license governs use of the accompanying software. | If you use the software, you accept this license. | If you do not accept the license, do not use the software.""",
    "PHP-3.01": """This source file is subject to version 3.01 of the PHP license, | that is bundled with this package in the file LICENSE""",
    "Perl": """This {{3}} is free software; you can redistribute it and/or modify it | under the same terms as Perl itself""",
    "Ruby": """You can redistribute it and/or modify it under either the terms of the | 2-clause BSDL [[(see the file BSDL)]], or the conditions below""",
    "ODbL-1.0": """made available under the Open Database License {{8}} | Any rights in individual contents of the database are licensed under the Database Contents License""",
    "Elastic-2.0": """you may not use this file except in compliance with the Elastic License 2.0""",
    "SSPL-1.0": """you can redistribute it and/or modify it under the terms of the | Server Side Public License, version 1, as published by MongoDB""",
    "BUSL-1.1": """Use of this software is governed by the Business Source License | included in the {{4}} file""",
    "CC0-1.0": """To the extent possible under law, {{8}} has waived | all copyright and related or neighboring rights to {{8}}""",
    "PDM-1.0": "This work {{8}} is free of known copyright restrictions",
    "CC-BY": _cc("Attribution", "CC BY 4.0"),
    "CC-BY-SA": _cc("Attribution-ShareAlike", "CC BY-SA 4.0"),
    "CC-BY-ND": _cc("Attribution-NoDerivatives", "CC BY-ND 4.0"),
    "CC-BY-NC": _cc("Attribution-NonCommercial", "CC BY-NC 4.0"),
    "CC-BY-NC-SA": _cc("Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA 4.0"),
    "CC-BY-NC-ND": _cc("Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND 4.0"),
    "MIT-notice": "[[This {{3}} is]] [[Released]] [[Licensed]] under the [[terms of the]] MIT License",
    "BSD-notice": "[[Released]] [[Licensed]] under the [[terms of the]] [[2-clause]] [[3-clause]] BSD [[2-clause]] [[3-clause]] License",
    "Apache-2.0-notice": "[[Licensed under the]] Apache License[[,]] Version 2.0",
    "GPL-notice": "[[This {{3}} is licensed under the]] GNU General Public License[[,]] [[either]] version {{1}}",
    "LGPL-notice": "GNU Lesser General Public License[[,]] [[either]] version {{2}}",
    "AGPL-notice": "GNU Affero General Public License[[,]] [[either]] version {{2}}",
    "MPL-notice": "[[Licensed]] under the [[terms of the]] Mozilla Public License",
    "CC-BY-NC-notice": "[[Licensed]] under [[a]] CC BY-NC [[4.0]]",
    "CC-BY-SA-notice": "[[Licensed]] under [[a]] CC BY-SA [[4.0]]",
    "CC-BY-notice": "[[Licensed]] under [[a]] CC BY 4.0",
    "CC0-notice": "CC0 1.0 Universal",
    "Unlicense-notice": "[[Released]] into the public domain",
    "Proprietary-notice": "All rights reserved. {{6}} No part of this {{3}} may be reproduced",
}
