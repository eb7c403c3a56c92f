"""Known licence sentences and licence rules; data for ``license_scan``.

``SENTENCES``: identifier -> wordings, ``|`` between them.  ``NEUTRAL`` sentences stand in many licences and tell none;
they are passed over, so that rules see the sentences around them side by side.  ``NAMES``: licence -> names, by which a
sentence like "Licensed under the ..." or an SPDX line may refer to it.  ``RULES``, in order: licence and the
identifiers of its sentences, which follow one another.
"""

from __future__ import annotations

import re

_AS_IS = 'PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version"


def _gnu(kind: str, version: str) -> str:
    ways = [f"This {what} is free software{mark} " + _GNU.format(kind, mark2, version) for what in ("program", "library", "file", "software") for mark, mark2 in ((":", ","), (";", ";"))]
    return "|".join(w.replace("GNU  General", "GNU General") for w in ways)


SENTENCES = {
    "MitRef": "Released under the MIT License|Licensed under the MIT License|This project is licensed under the MIT License|This software is released under the MIT License",
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software|The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
    "X11Name": "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium|Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies|Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "ZeroBsdGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Apache2Ref": "Licensed under the Apache License, Version 2.0|Licensed under the Apache License, Version 2.0 (the \"License\")|Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "Apache2Copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0|You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "Apache2AsIs": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "AsfGrant": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "AsfRef": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License|The ASF licenses this file to you under the Apache License, Version 2.0 (the \"License\")",
    "Gpl3Ref": "This work is licensed under the GNU General Public License, version 3|Licensed under the GNU General Public License, version 3",
    "Gpl2Ref": "This work is licensed under the GNU General Public License, version 2|Licensed under the GNU General Public License, version 2",
    "GplFree": _gnu("", "3"),
    "Gpl2Free": _gnu("", "2"),
    "Lgpl2Free": _gnu("Lesser", "2.1") + "|" + _gnu("Library", "2"),
    "Lgpl3Free": _gnu("Lesser", "3"),
    "AgplFree": _gnu("Affero", "3"),
    "GplNoWarranty": "See the GNU General Public License for more details",
    "LgplNoWarranty": "See the GNU Lesser General Public License for more details|See the GNU Library General Public License for more details",
    "AgplNoWarranty": "See the GNU Affero General Public License for more details",
    "LgplRef": "Licensed under the GNU Lesser General Public License, version 2.1|Licensed under the GNU Lesser General Public License, version 3",
    "MplRef": "This Source Code Form is subject to the terms of the Mozilla Public License, v",  # what follows the full stop is a sentence of its own
    "MplCopy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/|If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "Bsd3Grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BsdAdvert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "BsdEndorse": "|".join(f"Neither the name of {a} nor the names of {b} contributors may be used to endorse or promote products derived from this software without specific prior written permission" for a, b in (("the copyright holder", "its"), ("the copyright holders", "its"), ("the University", "its"), ("the author", "its"), ("the project", "its"), ("the organization", "its"), ("the company", "its"), ("the copyright holder", "their"), ("the copyright owner", "its"))),
    "BsdWarranty": f"THIS SOFTWARE IS {_AS_IS}",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BoostGrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "BoostRef": "Distributed under the Boost Software License, Version 1.0",
    "UnlicenseGrant": "This is free and unencumbered software released into the public domain",
    "WtfplGrant": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "EplRef1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution|This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "EplRef2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0|This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",
    "OflRef": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "HpndGrant": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation",
    "PostgresGrant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "CcBy4": "Licensed under CC BY 4.0|This work is licensed under CC BY 4.0|This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CcBySa4": "Licensed under CC BY-SA 4.0|This work is licensed under CC BY-SA 4.0|This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CcByNc4": "Licensed under CC BY-NC 4.0|This work is licensed under CC BY-NC 4.0|This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "Cc0": "Dedicated to the public domain under CC0 1.0|Licensed under CC0 1.0",
    "AllRights": "All rights reserved",
}

_FITNESS = "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
NEUTRAL = [
    *(f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {_FITNESS}" for what in ("program", "library", "file", "software")),
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "This product includes software developed by the University of California, Berkeley and its contributors",
    "See the License for the specific language governing permissions and limitations under the License",
    "See the NOTICE file distributed with this work for additional information regarding copyright ownership",
]

#: Licence -> names, lower-case, without "licence" at the end; the SPDX identifier itself is one.
NAMES = {
    "MIT": "mit|expat|mit x11", "MIT-0": "mit no attribution", "X11": "x11", "ISC": "isc", "0BSD": "zero clause bsd|bsd zero clause|free public 1 0 0", "BSD-2-Clause": "bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd", "BSD-3-Clause": "bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd", "BSD-4-Clause": "bsd 4 clause|4 clause bsd|original bsd", "BSD-3-Clause-Clear": "clear bsd",
    "Apache-1.0": "apache license version 1 0|apache 1 0", "Apache-1.1": "apache license version 1 1|apache software license version 1 1|apache 1 1", "Apache-2.0": "apache license version 2 0|apache 2 0|apache 2|apache license 2 0|apache software license version 2 0|apache license v2 0",
    "GPL-1.0": "gnu general public license version 1|gpl 1", "GPL-2.0": "gnu general public license v2|gnu gpl version 2|gnu gpl v2|gpl v2|gplv2|gpl 2|gnu general public license version 2 0|gpl 2 0 only", "GPL-2.0-or-later": "gnu general public license version 2 or later|gnu general public license v2 or later|gplv2 or later|gpl 2 0 or later|gpl 2 0", "GPL-3.0": "gnu general public license v3|gnu gpl version 3|gnu gpl v3|gpl v3|gplv3|gpl 3|gnu general public license version 3 0|gpl 3 0 only|gpl 3 0", "GPL-3.0-or-later": "gnu general public license version 3 or later|gnu general public license v3 or later|gplv3 or later|gpl 3 0 or later",
    "LGPL-2.0": "gnu library general public license version 2|lgpl 2 0 only|lgpl 2 0|lgpl 2 0 or later", "LGPL-2.1": "gnu lesser general public license version 2 1 only|gnu lesser general public license v2 1|gnu lgpl v2 1|lgpl v2 1|lgplv2 1|lgpl 2 1 only|lgpl 2 1|lgpl 2 1 or later", "LGPL-3.0": "gnu lesser general public license v3|gnu lgpl v3|lgpl v3|lgplv3|lgpl 3 0 only|lgpl 3 0|lgpl 3 0 or later",
    "AGPL-3.0": "gnu affero general public license version 3|gnu affero general public license v3|gnu agpl version 3|gnu agpl v3|agpl v3|agplv3|agpl 3 0 only|agpl 3 0|agpl 3 0 or later", "GFDL-1.3": "gnu free documentation license version 1 3|gfdl 1 3|gfdl 1 3 or later", "GFDL-1.2": "gnu free documentation license version 1 2|gfdl 1 2|gfdl 1 2 or later",
    "MPL-1.0": "mozilla public license version 1 0", "MPL-1.1": "mozilla public license version 1 1|mpl 1 1", "MPL-2.0": "mozilla public license version 2 0|mozilla public license 2 0|mozilla public license v2 0|mpl 2 0|mpl2 0", "NPL-1.1": "netscape public license version 1 1",
    "EPL-1.0": "eclipse public license version 1 0|eclipse public license v1 0|eclipse public license 1 0", "EPL-2.0": "eclipse public license version 2 0|eclipse public license v2 0|eclipse public license 2 0", "EDL-1.0": "eclipse distribution license version 1 0|eclipse distribution license v1 0", "CDDL-1.0": "common development and distribution license version 1 0|cddl", "CDDL-1.1": "common development and distribution license version 1 1", "CPL-1.0": "common public license version 1 0|common public license v1 0", "IPL-1.0": "ibm public license version 1 0", "CPAL-1.0": "common public attribution license version 1 0",
    "Artistic-1.0": "artistic license version 1 0|artistic license 1 0", "Artistic-2.0": "artistic license version 2 0|artistic license 2 0", "EUPL-1.1": "european union public licence v 1 1|european union public licence version 1 1", "EUPL-1.2": "european union public licence v 1 2|european union public licence version 1 2|eupl version 1 2", "CECILL-2.1": "cecill license version 2 1|cecill v2 1", "CECILL-B": "cecill b license|cecill b", "CECILL-C": "cecill c license|cecill c", "OSL-3.0": "open software license version 3 0|open software license v 3 0", "AFL-3.0": "academic free license version 3 0|academic free license v 3 0", "ECL-2.0": "educational community license version 2 0", "LPPL-1.3c": "latex project public license version 1 3c|latex project public license", "OFL-1.1": "sil open font license version 1 1|sil open font license 1 1",
    "Zlib": "zlib|zlib libpng", "libpng-2.0": "libpng version 2", "BSL-1.0": "boost software license version 1 0|boost software license", "Unlicense": "unlicense", "WTFPL": "do what the fuck you want to public license version 2|wtfpl version 2", "BlueOak-1.0.0": "blue oak model license 1 0 0|blue oak model license", "UPL-1.0": "universal permissive license v 1 0|universal permissive license version 1 0", "MulanPSL-2.0": "mulan psl v2|mulan permissive software license version 2", "NCSA": "university of illinois ncsa open source license|ncsa open source license", "PostgreSQL": "postgresql", "Python-2.0": "python software foundation license version 2|psf license", "PHP-3.01": "php license version 3 01|php license v3 01", "Ruby": "ruby", "Vim": "vim", "OpenSSL": "openssl", "curl": "curl", "W3C": "w3c software notice and license|w3c software license", "HPND": "historical permission notice and disclaimer", "Beerware": "beer ware", "JSON": "json", "FTL": "freetype project license|freetype license", "IJG": "independent jpeg group license", "TCL": "tcl tk", "ZPL-2.1": "zope public license version 2 1|zope public license", "Sleepycat": "sleepycat", "QPL-1.0": "q public license version 1 0", "APSL-2.0": "apple public source license version 2 0", "MS-PL": "microsoft public license", "MS-RL": "microsoft reciprocal license", "RPL-1.5": "reciprocal public license version 1 5", "SSPL-1.0": "server side public license version 1|sspl", "BUSL-1.1": "business source license 1 1|business source license version 1 1", "Elastic-2.0": "elastic license 2 0|elastic license version 2 0",
    "CC-BY-3.0": "creative commons attribution 3 0 unported|creative commons attribution 3 0|cc by 3 0", "CC-BY-4.0": "creative commons attribution 4 0|creative commons attribution 4 0 international|cc by 4 0", "CC-BY-SA-3.0": "creative commons attribution sharealike 3 0 unported|creative commons attribution sharealike 3 0|cc by sa 3 0", "CC-BY-SA-4.0": "creative commons attribution sharealike 4 0|creative commons attribution sharealike 4 0 international|cc by sa 4 0", "CC-BY-NC-4.0": "creative commons attribution noncommercial 4 0 international|cc by nc 4 0", "CC-BY-ND-4.0": "creative commons attribution noderivatives 4 0 international|cc by nd 4 0", "CC-BY-NC-SA-4.0": "creative commons attribution noncommercial sharealike 4 0 international|cc by nc sa 4 0", "CC-BY-NC-ND-4.0": "creative commons attribution noncommercial noderivatives 4 0 international|cc by nc nd 4 0", "CC0-1.0": "cc0|cc0 1 0|cc0 1 0 universal|creative commons zero v1 0 universal", "ODbL-1.0": "open database license v1 0|open database license", "ODC-By-1.0": "open data commons attribution license v1 0|open data commons attribution license", "PDDL-1.0": "open data commons public domain dedication and license",
}


def normal(sentence: str) -> str:
    """A-Z lower-cased, everything but letters and digits to single blanks."""
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def reference(licence: str) -> str:
    """The identifier of sentences that refer to a licence by name."""
    return "Ref" + re.sub(r"[^A-Za-z0-9]", "", licence)


#: A sentence, normalised, that refers to a licence by name: what is left of it is the name.
REFERS = r"^(?:(?:this|the) (?:work|file|software|program|project|library|code|package|module|document|repository|dataset) is )?(?:(?:dual |made )?(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?|spdx license identifier )(.+?)(?: licen[sc]e)?$"

NAME_OF = {n: reference(k) for k, v in NAMES.items() for n in {re.sub(r" licen[sc]e$", "", x) for x in [*v.split("|"), normal(k)]}}

RULES = [
    ("Apache-2.0", ("Apache2Ref", "Apache2Copy", "Apache2AsIs")),
    ("Apache-2.0", ("AsfGrant", "AsfRef", "Apache2Copy", "Apache2AsIs")),
    ("Apache-2.0", ("AsfGrant", "AsfRef", "Apache2Copy")),
    ("Apache-2.0", ("AsfGrant", "AsfRef")),
    ("Apache-2.0", ("Apache2Ref", "Apache2Copy")),
    ("Apache-2.0", ("Apache2Ref",)),
    ("Apache-2.0", ("AsfRef",)),
    ("X11", ("MitGrant", "MitNotice", "X11Name")),
    ("MIT", ("MitRef", "MitGrant", "MitNotice")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT", ("MitRef",)),
    ("BSD-4-Clause", ("Bsd3Grant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse", "BsdWarranty")),
    ("BSD-4-Clause", ("Bsd3Grant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse")),
    ("BSD-3-Clause", ("Bsd3Grant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdWarranty")),
    ("BSD-3-Clause", ("Bsd3Grant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("Bsd3Grant", "BsdSource", "BsdBinary", "BsdWarranty")),
    ("BSD", ("Bsd3Grant", "BsdSource", "BsdBinary")),
    ("GPL-3.0-or-later", ("GplFree", "GplNoWarranty")),
    ("GPL-3.0-or-later", ("GplFree",)),
    ("GPL-2.0-or-later", ("Gpl2Free", "GplNoWarranty")),
    ("GPL-2.0-or-later", ("Gpl2Free",)),
    ("LGPL-2.1-or-later", ("Lgpl2Free", "LgplNoWarranty")),
    ("LGPL-2.1-or-later", ("Lgpl2Free",)),
    ("LGPL-3.0-or-later", ("Lgpl3Free", "LgplNoWarranty")),
    ("LGPL-3.0-or-later", ("Lgpl3Free",)),
    ("AGPL-3.0-or-later", ("AgplFree", "AgplNoWarranty")),
    ("AGPL-3.0-or-later", ("AgplFree",)),
    ("GPL-3.0", ("Gpl3Ref", "GplNoWarranty")),
    ("GPL-3.0", ("Gpl3Ref",)),
    ("GPL-2.0", ("Gpl2Ref", "GplNoWarranty")),
    ("GPL-2.0", ("Gpl2Ref",)),
    ("LGPL", ("LgplRef", "LgplNoWarranty")),
    ("LGPL", ("LgplRef",)),
    ("MPL-2.0", ("MplRef", "MplCopy")),
    ("MPL-2.0", ("MplRef",)),
    ("ISC", ("IscGrant",)),
    ("0BSD", ("ZeroBsdGrant",)),
    ("Zlib", ("ZlibGrant",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("BSL-1.0", ("BoostRef",)),
    ("Unlicense", ("UnlicenseGrant",)),
    ("WTFPL", ("WtfplGrant",)),
    ("EPL-1.0", ("EplRef1",)),
    ("EPL-2.0", ("EplRef2",)),
    ("OFL-1.1", ("OflRef",)),
    ("HPND", ("HpndGrant",)),
    ("PostgreSQL", ("PostgresGrant",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC0-1.0", ("Cc0",)),
    ("All-rights-reserved", ("AllRights",)),
    *((k, (reference(k),)) for k in NAMES),
]
