"""Licence texts that the scan looks for."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    """keys: phrases that a file must hold at their places in the text, from a found start on. drift: words by which a file's places may differ
    from the text's, as where names are put in. covered: share of the text's indexed words, weighed by rarity, that must stand in place."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False
    drift: int = 0
    covered: float = 0.0


# Labels, licence phrases, licence texts in lower case without marks, and their key phrases. No word that is looked for has a
# k, whose lower case a character beyond ASCII (the kelvin sign) shares.
PHRASES = [
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("bsd", "bsd license", ("bsd license",)),
    Template("mpl", "mozilla public license", ("mozilla public license",)),
    Template("epl", "eclipse public license", ("eclipse public license",)),
    Template("isc", "isc license", ("isc license",)),
    Template("cc", "creative commons attribution", ("creative commons attribution",)),
]
TEXTS = [
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ("permission is hereby granted", "sublicense and or sell", "without warranty of any"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ("with or without fee is hereby granted", "disclaims all warranties"),
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("licensed under the apache license", "unless required by applicable law"),
    ),
    Template(
        "gpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("under the terms of the gnu general public license", "hope that it will be useful"),
    ),
    Template(
        "lgpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version "
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        ("under the terms of the gnu lesser general public license", "hope that it will be useful"),
    ),
    Template(
        "agpl",
        "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
        ("under the terms of the gnu affero general public license", "hope that it will be useful"),
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed"),
    ),
    Template(
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
        ("under the terms of the eclipse public license",),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        ("alter it and redistribute it freely", "the origin of this software must not be misrepresented"),
    ),
    Template(
        "cc",
        "is licensed under a creative commons attribution license to view a copy of this license visit http creativecommons org licenses by 4 0 or send a letter to creative commons",
        ("licensed under a creative commons attribution",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        ("free and unencumbered software released into the public domain", "dedicate any and all copyright interest"),
    ),
]
TEMPLATES = PHRASES + [t._replace(drift=8, covered=0.6) for t in TEXTS]
# Words of the templates that are too frequent to index. Key phrases are verified with these too.
STOP_WORDS = {
    "a", "all", "an", "and", "any", "appear", "are", "as", "at", "author", "authors", "available", "be", "being", "but", "by", "can", "code", "copies", "copy", "details", "do", "either", "even", "file", "files", "for", "form",
    "free", "from", "held", "hope", "if", "in", "interest", "into", "is", "it", "kind", "later", "law", "laws", "legal", "letter", "made", "marked", "materials", "may", "means", "more", "must", "no", "non", "not", "of", "on", "one", "option", "or",
    "org", "original", "other", "permit", "person", "persons", "program", "provided", "public", "purpose", "see", "send", "shall", "so", "source", "such", "terms", "that", "the", "this", "to", "under", "use", "useful", "version", "view",
    "visit", "was", "which", "whom", "will", "with", "without", "writing", "wrote", "you", "your", "0", "1", "2", "3", "4", "v", "www", "http", "https",
}
