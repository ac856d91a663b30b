"""Signatures of license texts: bodies, headers, links, identifiers, notices and negations.

Each line is one regular expression over lower-cased words with a blank between them; the braces hold the keyword that
gates it. Punctuation is gone before matching, so a link is the row of its words. Alternatives and optional words are
groups that end with their blank.
"""

from __future__ import annotations

# sentences that stand in a license text and name no license
BODIES = {
    "mit": """
        permission is {hereby} granted free of charge to any person obtaining
        to deal in the software without {restriction} including without limitation
        {sublicense} and or sell copies of the software
        to permit persons to whom the software is {furnished} to do so
        the software is provided as is without warranty of any kind {express} or implied including but not limited to
        the above copyright notice and this permission notice shall be included in all copies or substantial portions of the {software}
    """,
    "isc": """
        permission to use copy modify and or {distribute} this software for any purpose with or without fee
        the author {disclaims} all warranties with regard to this software
        {isc} disclaims all warranties
        whatsoever resulting from loss of use data or profits whether in an action of contract {negligence} or other tortious action
    """,
    "bsd": """
        {redistribution} and use in source and binary forms with or without
        {redistributions} of source code must retain the above copyright notice
        {redistributions} in binary form must reproduce the above copyright notice
        {procurement} of substitute goods or services loss of use data or profits
        this software is provided by the (?:copyright holders|regents|authors?|copyright holders and) (?:and )?{contributors} as is
    """,
    "bsd-3": """
        (?:may be used to )?{endorse} or promote products derived from this software without specific prior
        neither the name of (?:the )?(?:copyright holder|author|university|company|organization) nor the names of (?:its|any) {contributors}
    """,
    "bsd-4": """
        all {advertising} materials mentioning features or use of this software must display
    """,
    "apache-2": """
        {perpetual} worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent|except)
        you may not use this file except in {compliance} with the license
        unless required by {applicable} law or agreed to in writing software distributed under the license
        limitations under the license {appendix} how to apply the apache license
    """,
    "gpl": """
        this program is free software you can {redistribute} it and or modify it under the terms of the gnu
        this program is {distributed} in the hope that it will be useful but without
        without even the implied warranty of {merchantability} or fitness for a particular purpose see the gnu general
        you should have {received} a copy of the gnu general public license
        {everyone} is permitted to copy and distribute verbatim copies of this license
        the licenses for most software are {designed} to take away your freedom
    """,
    "gpl-2": """
        activities other than copying distribution and {modification} are not covered by this license
        {copyleft} gnu general public license version 2 june 1991
        version 2 june {1991} copyright c
    """,
    "gpl-3": """
        version 3 29 june {2007} copyright
        to {propagate} a work means to do anything with it
        to {convey} a work means any kind of propagation
        the corresponding source for a work in {object} code form means all the source code needed
    """,
    "lgpl": """
        this library is free software you can {redistribute} it and or modify it under the terms of
        you should have {received} a copy of the gnu (?:lesser|library) general public license
        without even the implied warranty of {merchantability} or fitness for a particular purpose see the gnu lesser
        a program that contains no {derivative} of any portion of the library
    """,
    "agpl-3": """
        you should have {received} a copy of the gnu affero general public license
        {interacting} with it remotely through a computer network
        version 3 19 november {2007}
    """,
    "mpl-2": """
        this source code form is subject to the terms of the {mozilla} public license v 2 0
        if a copy of the {mpl} was not distributed with this file
        {incompatible} with secondary licenses
    """,
    "mpl-1.1": """
        the contents of this file are subject to the {mozilla} public license version 1 1
        software distributed under the license is distributed on an as is {basis} without warranty of any kind either express or implied see
    """,
    "epl-1": """
        this program and the {accompanying} materials are made available under the terms of the eclipse public license v1
        the {accompanying} program is provided under the terms of this eclipse public license
    """,
    "epl-2": """
        this program and the {accompanying} materials are made available under the terms of the eclipse public license 2
    """,
    "cddl-1": """
        the contents of this file are subject to the terms of the {common} development and distribution license
        {common} development and distribution license (?:cddl )?(?:version )?1 0
    """,
    "unlicense": """
        this is free and {unencumbered} software released into the public domain
        anyone is free to copy modify publish use {compile} sell or distribute this software
        the author or authors of this software {dedicate} any and all copyright interest
        {relinquishment} in perpetuity of all present and future rights
    """,
    "zlib": """
        the {origin} of this software must not be misrepresented
        altered source versions must be plainly {marked} as such
        in no event will the authors be held {liable} for any damages arising from the use of this software
    """,
    "bsl-1": """
        {accompanying} documentation covered by this license the software to use reproduce
        unless such copies or derivative works are solely in the form of machine {executable} object code
    """,
    "wtfpl": """
        you just do what the {fuck} you want to
        do what the {fuck} you want to public license
    """,
    "cc0-1": """
        to the extent possible under law (?:the author|the person|[^ ]+) (?:who associated cc0 with this work )?has {waived} all copyright and related
        the person who {associated} cc0 with this work
        the person who {associated} a work with this deed has dedicated the work to the public domain
    """,
    "cc-by": """
        you must give appropriate credit provide a link to the license and {indicate} if changes were made
    """,
    "cc-by-sa": """
        if you {remix} transform or build upon the material you must distribute your contributions under the same license
    """,
    "cc-by-nd": """
        if you {remix} transform or build upon the material you may not distribute the modified material
    """,
    "cc-by-nc": """
        you may not use the material for {commercial} purposes
        primarily intended for or directed towards {commercial} advantage or (?:private )?monetary compensation
    """,
    "ofl-1.1": """
        {reserved} font name
        the fonts and {derivatives} however cannot be released under any other type of license
        font software may be {bundled} redistributed and or sold with any software
    """,
    "artistic-2": """
        this license establishes the terms under which a given free software {package} may be copied
        everyone is permitted to copy and distribute {verbatim} copies of this license document but changing it is not allowed preamble this license establishes
    """,
    "artistic-1": """
        the intent of this document is to state the conditions under which a {package} may be copied
    """,
    "gfdl": """
        with no {invariant} sections
        no front cover texts and no back {cover} texts
        make a manual {textbook} or other functional and useful document free
    """,
    "psf-2": """
        {psf} is making python available to licensee on an as is basis
        python software foundation license {agreement}
        {cnri} open source license agreement
    """,
    "ms-pl": """
        if you {bring} a patent claim against any contributor over patents that you claim are infringed
    """,
    "eupl-1.2": """
        {licensed} under the eupl
        european union public {licence} v 1 2
    """,
    "odbl-1": """
        open data commons open {database} license
        open {database} license odbl
    """,
    "beerware": """
        you can buy me a {beer} in return
        the {beer} ware license
    """,
    "json": """
        the software shall be used for good not {evil}
    """,
    "x11": """
        except as contained in this notice the name of the x {consortium} shall not be used
    """,
    "curl": """
        except as contained in this notice the name of a copyright {holder} shall not be used in advertising
    """,
    "openssl": """
        this product includes software developed by the {openssl} project
        {cryptographic} software written by eric young
    """,
    "ncsa": """
        redistributions of source code must retain the above copyright notice this list of conditions and the following {disclaimers}
        university of illinois {ncsa} open source license
    """,
    "postgresql": """
        permission to use copy modify and distribute this software and its {documentation} for any purpose without fee and without a written
    """,
    "hpnd": """
        permission to use copy modify and distribute this software and its {documentation} for any purpose and without fee is hereby granted
    """,
    "public-domain": """
        (?:is |are )?(?:released |placed |dedicated )(?:in|into|to) the public {domain}
        this (?:work|text|file|code|software|document) is in the public {domain}
    """,
}
# addresses, with their punctuation gone
LINKS = {
    "mit": "{opensource} org licen[sc]es? mit\nspdx org licenses {mit}\n{choosealicense} com licenses mit",
    "isc": "{opensource} org licen[sc]es? isc\nspdx org licenses {isc}\n{choosealicense} com licenses isc",
    "bsd-2": "{opensource} org licen[sc]es? bsd 2 clause\nspdx org licenses {bsd} 2 clause\n{choosealicense} com licenses bsd 2 clause",
    "bsd-3": "{opensource} org licen[sc]es? bsd 3 clause\nspdx org licenses {bsd} 3 clause\n{choosealicense} com licenses bsd 3 clause",
    "apache-2": "{apache} org licenses license 2 0\n{opensource} org licen[sc]es? apache 2 0\nspdx org licenses {apache} 2 0\n{choosealicense} com licenses apache 2 0",
    "apache-1.1": "{apache} org licenses license 1 1",
    "gpl": "{gnu} org licenses gpl (?:html )?\n{gnu} org copyleft gpl (?:html )?",
    "gpl-2": "{gnu} org licenses (?:old licenses )?gpl 2 0\nspdx org licenses {gpl} 2 0\n{opensource} org licen[sc]es? gpl 2 0\n{choosealicense} com licenses gpl 2 0",
    "gpl-3": "{gnu} org licenses gpl 3 0\nspdx org licenses {gpl} 3 0\n{opensource} org licen[sc]es? gpl 3 0\n{choosealicense} com licenses gpl 3 0",
    "lgpl": "{gnu} org licenses lgpl (?:html )?\n{gnu} org copyleft lesser (?:html )?",
    "lgpl-2.1": "{gnu} org licenses (?:old licenses )?lgpl 2 1\nspdx org licenses {lgpl} 2 1\n{opensource} org licen[sc]es? lgpl 2 1",
    "lgpl-3": "{gnu} org licenses lgpl 3 0\nspdx org licenses {lgpl} 3 0\n{opensource} org licen[sc]es? lgpl 3 0",
    "agpl-3": "{gnu} org licenses agpl (?:3 0 )?(?:html )?\nspdx org licenses {agpl} 3 0\n{opensource} org licen[sc]es? agpl 3 0",
    "gfdl": "{gnu} org licenses fdl (?:html )?\n{gnu} org licenses fdl 1 [123]",
    "mpl-2": "{mozilla} org (?:en us )?mpl 2 0\nspdx org licenses {mpl} 2 0\n{opensource} org licen[sc]es? mpl 2 0",
    "mpl-1.1": "{mozilla} org (?:en us )?mpl (?:mpl )?1 1",
    "epl-1": "{eclipse} org legal epl v10\n{opensource} org licen[sc]es? epl 1 0",
    "epl-2": "{eclipse} org legal epl (?:v20|2 0)\n{opensource} org licen[sc]es? epl 2 0",
    "eclipse-distribution-1": "{eclipse} org org documents edl v10",
    "cddl-1": "{opensource} org licen[sc]es? cddl 1 0\nsun com {cddl}",
    "unlicense": "{unlicense} org\nspdx org licenses {unlicense}",
    "wtfpl": "{wtfpl} net\nsam zoy org {wtfpl}",
    "bsl-1": "{boost} org license 1 0 txt\n{opensource} org licen[sc]es? bsl 1 0",
    "zlib": "{zlib} net zlib license\n{opensource} org licen[sc]es? zlib",
    "artistic-2": "{opensource} org licen[sc]es? artistic 2 0\nperlfoundation org {artistic} license 2 0",
    "eupl-1.2": "{opensource} org licen[sc]es? eupl 1 2\njoinup ec europa eu collection eupl {eupl}",
    "ofl-1.1": "scripts sil org {ofl}\n{openfontlicense} org\n{opensource} org licen[sc]es? ofl 1 1",
    "odbl-1": "{opendatacommons} org licenses odbl",
    "odc-by-1": "{opendatacommons} org licenses by",
    "pddl-1": "{opendatacommons} org licenses pddl",
    "cc0-1": "{creativecommons} org publicdomain zero 1 0",
    "public-domain": "{creativecommons} org publicdomain mark 1 0\n{creativecommons} org licenses publicdomain",
    "cc-by": "{creativecommons} org licenses by [1-4] [05]",
    "cc-by-sa": "{creativecommons} org licenses by sa [1-4] [05]",
    "cc-by-nd": "{creativecommons} org licenses by nd [1-4] [05]",
    "cc-by-nc": "{creativecommons} org licenses by nc [1-4] [05]",
    "cc-by-nc-sa": "{creativecommons} org licenses by nc sa [1-4] [05]",
    "cc-by-nc-nd": "{creativecommons} org licenses by nc nd [1-4] [05]",
    "json": "{json} org license (?:html )?",
    "postgresql": "{postgresql} org about licence",
    "openssl": "{openssl} org source license",
    "psf-2": "docs {python} org (?:3 )?license (?:html )?\n{python} org psf license",
}
# identifiers on a line of their own or in the fields of a package description
IDENTIFIERS = {
    "mit": "spdx license {identifier} (?:apache 2 0 |bsd 2 clause |bsd 3 clause |isc |or |and )*mit\nlicense osi {approved} mit license",
    "apache-2": "spdx license {identifier} (?:mit |bsd |gpl |or |and )*apache 2 0\nlicense osi {approved} apache software license",
    "bsd-2": "spdx license {identifier} (?:mit |or |and )*bsd 2 clause",
    "bsd-3": "spdx license {identifier} (?:mit |or |and )*bsd 3 clause",
    "bsd": "license osi {approved} bsd license",
    "0bsd": "spdx license {identifier} 0bsd\nbsd zero {clause}",
    "isc": "spdx license {identifier} isc\nlicense osi {approved} isc license",
    "gpl-2": "spdx license {identifier} (?:mit |or |and )*gpl 2 0 (?:only |or later )?\nlicense osi {approved} gnu general public license v2",
    "gpl-3": "spdx license {identifier} (?:mit |or |and )*gpl 3 0 (?:only |or later )?\nlicense osi {approved} gnu general public license v3",
    "lgpl-2.1": "spdx license {identifier} lgpl 2 1 (?:only |or later )?\nlicense osi {approved} gnu lesser general public license v2",
    "lgpl-3": "spdx license {identifier} lgpl 3 0 (?:only |or later )?\nlicense osi {approved} gnu lesser general public license v3",
    "agpl-3": "spdx license {identifier} agpl 3 0 (?:only |or later )?\nlicense osi {approved} gnu affero general public license v3",
    "mpl-2": "spdx license {identifier} mpl 2 0\nlicense osi {approved} mozilla public license 2 0",
    "epl-1": "spdx license {identifier} epl 1 0",
    "epl-2": "spdx license {identifier} epl 2 0\nlicense osi {approved} eclipse public license 2 0",
    "cddl-1": "spdx license {identifier} cddl 1 0",
    "cc0-1": "spdx license {identifier} cc0 1 0\nlicense {cc0} 1 0 universal",
    "cc-by": "spdx license {identifier} cc by [1-4] [05]",
    "cc-by-sa": "spdx license {identifier} cc by sa [1-4] [05]",
    "cc-by-nc": "spdx license {identifier} cc by nc [1-4] [05]",
    "cc-by-nd": "spdx license {identifier} cc by nd [1-4] [05]",
    "cc-by-nc-sa": "spdx license {identifier} cc by nc sa [1-4] [05]",
    "cc-by-nc-nd": "spdx license {identifier} cc by nc nd [1-4] [05]",
    "unlicense": "spdx license {identifier} unlicense\nlicense osi {approved} the unlicense",
    "wtfpl": "spdx license {identifier} wtfpl",
    "zlib": "spdx license {identifier} zlib\nlicense osi {approved} zlib libpng license",
    "bsl-1": "spdx license {identifier} bsl 1 0\nlicense osi {approved} boost software license",
    "artistic-2": "spdx license {identifier} artistic 2 0\nlicense osi {approved} artistic license",
    "eupl-1.2": "spdx license {identifier} eupl 1 2\nlicense osi {approved} european union public licence",
    "ofl-1.1": "spdx license {identifier} ofl 1 1\nlicense osi {approved} sil open font license",
    "psf-2": "spdx license {identifier} psf 2 0\nlicense osi {approved} python software foundation license",
    "odbl-1": "spdx license {identifier} odbl 1 0",
    "proprietary": "license other {proprietary} license",
    "public-domain": "license public {domain}",
    "elastic-2": "spdx license {identifier} elastic 2 0\n{elastic} license 2 0",
    "sspl-1": "spdx license {identifier} sspl 1 0\nserver side public license (?:version 1 )?{sspl}",
    "busl-1.1": "spdx license {identifier} busl 1 1\n{business} source license 1 1",
}
# rights kept rather than given
NOTICES = {
    "all-rights-reserved": "(?:copyright )?all rights {reserved}",
    "proprietary": """
        {proprietary} and confidential
        {unauthorized} (?:copying|use|reproduction|distribution) (?:or distribution )?(?:of this (?:file|document|work|software) )?(?:via any medium )?is strictly prohibited
        no part of this (?:publication|book|document|work) may be {reproduced}
        may not be {reproduced} (?:or distributed )?without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)
        this (?:software|document) is the confidential and {proprietary} information of
        {trade} secret (?:information )?of
    """,
}
# what a license name that follows does not mean; they take the names inside them away and give no label
NEGATED = (
    "(?:not|never|no longer|isn t|neither|cannot be) (?:be )?(?:licensed |released |distributed |published |available |provided |covered |shared )(?:under|by) (?:the terms of )?(?:an? |the |any )?(?:gnu )?"
)
NEGATIVE_TAILS = """
    {gpl} (?:version |v )?(?:v?[23] )?(?:0 )?(?:license )?
    {gplv2}
    {gplv3}
    {lgpl} (?:version |v )?(?:v?[23] )?(?:[01] )?(?:license )?
    {agpl} (?:version |v )?(?:v?3 )?(?:0 )?
    {gnu} (?:lesser |library |affero )?general public license (?:version |v )?(?:v?[23] )?(?:[01] )?
    {mit} (?:license )?
    {expat} (?:license )?
    {apache} (?:software )?(?:license )?(?:version )?(?:2 )?(?:0 )?
    {bsd} (?:[234] clause )?(?:style )?(?:license )?
    {mozilla} public license (?:version |v )?(?:[12] )?(?:[01] )?
    {mpl} (?:version )?(?:[12] )?(?:[01] )?
    {eclipse} public license (?:version |v )?(?:[12] )?(?:0 )?
    {isc} (?:license )?
    {zlib} (?:license )?
    {unlicense}
    {wtfpl}
    {cc0} (?:1 0 )?(?:universal )?
    {cc} by (?:nc )?(?:sa |nd )?(?:[1-4] [05] )?
    {creative} commons (?:attribution )?(?:non ?commercial )?(?:share ?alike )?(?:no ?derivatives )?(?:[1-4] [05] )?(?:international )?(?:license )?
    {artistic} license (?:version )?(?:2 )?(?:0 )?
    {eupl} (?:version |v )?(?:1 2 )?
    {ofl} (?:version )?(?:1 1 )?
    {boost} software license (?:version )?(?:1 0 )?
"""


def _parts(line: str) -> tuple[str, str, str]:
    """Keyword, what stands before it and after it, each with the blank at its end."""
    before, rest = line.split("{", 1) if not line.startswith("{") else ("", line[1:])
    key, after = rest.split("}", 1)
    after = after.lstrip()
    return key, before, after if not after or after.endswith((")?", ")*")) else after + " "


def signatures() -> list[tuple[str, str, str, str, int]]:
    """label, keyword, before, after, priority; an empty label takes away."""
    out = []
    for table, priority in ((IDENTIFIERS, 96), (LINKS, 92), (BODIES, 85), (NOTICES, 40)):
        for label, lines in table.items():
            for line in filter(None, map(str.strip, lines.split("\n"))):
                key, before, after = _parts(line)
                out.append((label, key, before, after, priority))
    for line in filter(None, map(str.strip, NEGATIVE_TAILS.split("\n"))):
        key, before, after = _parts(line)
        out.append(("", key, NEGATED + before, after, 99))
    return out
