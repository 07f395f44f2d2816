"""DuckDB SQL of the licence scan, with names, sentences and rules of its own."""

# Sentences, names and rules as the operator must know them, and the forms in which a notice names a licence.
LICENCES = r"""
WITH sentence(id, words) AS (VALUES
    ('apache-comply', 'you may not use this file except in compliance with the License'),
    ('apache-copy', 'You may obtain a copy of the License at'),
    ('apache-url', 'http://www.apache.org/licenses/LICENSE-2.0'),
    ('apache-title', 'Apache License Version 2.0, January 2004'),
    ('mit-title', 'The MIT License (MIT)'),
    ('grant', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ('grant-subject', 'and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ('mit-include', 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software'),
    ('mit-as-is', 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
    ('mit-liable', 'IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY'),
    ('isc-grant', 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted'),
    ('isc-and-grant', 'Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted'),
    ('isc-include', 'provided that the above copyright notice and this permission notice appear in all copies'),
    ('bsd-permit', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met'),
    ('bsd-source', 'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer'),
    ('bsd-binary', 'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution'),
    ('bsd-advert', 'All advertising materials mentioning features or use of this software must display the following acknowledgement'),
    ('bsd-names', 'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission'),
    ('gpl-terms', 'you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation'),
    ('lgpl-terms', 'you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation'),
    ('agpl-terms', 'you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation'),
    ('either-2', 'either version 2 of the License, or (at your option) any later version'),
    ('either-21', 'either version 2.1 of the License, or (at your option) any later version'),
    ('either-3', 'either version 3 of the License, or (at your option) any later version'),
    ('gpl-hope', 'is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY'),
    ('gpl2-title', 'GNU GENERAL PUBLIC LICENSE Version 2, June 1991'),
    ('gpl3-title', 'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007'),
    ('lgpl21-title', 'GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999'),
    ('lgpl3-title', 'GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007'),
    ('agpl3-title', 'GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007'),
    ('mpl2-subject', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0'),
    ('mpl11-subject', 'The contents of this file are subject to the Mozilla Public License Version 1.1'),
    ('epl1-made', 'This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0'),
    ('epl2-made', 'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0'),
    ('cddl-subject', 'The contents of this file are subject to the terms of the Common Development and Distribution License'),
    ('unlicense-free', 'This is free and unencumbered software released into the public domain'),
    ('unlicense-anyone', 'Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means'),
    ('wtfpl-just', 'You just DO WHAT THE FUCK YOU WANT TO'),
    ('zlib-grant', 'Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions'),
    ('zlib-origin', 'The origin of this software must not be misrepresented'),
    ('boost-grant', 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software'),
    ('ofl-font', 'This Font Software is licensed under the SIL Open Font License, Version 1.1'),
    ('cc0-waived', 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work'),
    ('rights', 'All rights reserved')
), name(licence, words) AS (VALUES
    ('Apache-2.0', 'Apache License, Version 2.0'), ('Apache-2.0', 'Apache License 2.0'), ('Apache-2.0', 'Apache-2.0'), ('Apache-2.0', 'Apache 2.0 License'), ('Apache-2.0', 'Apache Software License 2.0'),
    ('MIT', 'MIT License'), ('MIT', 'MIT licence'), ('MIT', 'Expat License'),
    ('MIT-0', 'MIT No Attribution License'),
    ('ISC', 'ISC License'),
    ('0BSD', 'BSD Zero Clause License'),
    ('BSD-2-Clause', 'BSD 2-Clause License'), ('BSD-2-Clause', 'Simplified BSD License'), ('BSD-2-Clause', 'FreeBSD License'), ('BSD-2-Clause', '2-clause BSD license'),
    ('BSD-3-Clause', 'BSD 3-Clause License'), ('BSD-3-Clause', 'New BSD License'), ('BSD-3-Clause', 'Modified BSD License'), ('BSD-3-Clause', '3-clause BSD license'),
    ('BSD-4-Clause', 'BSD 4-Clause License'), ('BSD-4-Clause', 'Original BSD License'),
    ('GPL-2.0', 'GNU General Public License, version 2'), ('GPL-2.0', 'GNU General Public License v2.0'), ('GPL-2.0', 'GNU GPL version 2'), ('GPL-2.0', 'GPL v2'), ('GPL-2.0', 'GPLv2'), ('GPL-2.0', 'GPL-2.0'),
    ('GPL-3.0', 'GNU General Public License, version 3'), ('GPL-3.0', 'GNU General Public License v3.0'), ('GPL-3.0', 'GNU GPL version 3'), ('GPL-3.0', 'GPL v3'), ('GPL-3.0', 'GPLv3'), ('GPL-3.0', 'GPL-3.0'),
    ('LGPL-2.1', 'GNU Lesser General Public License, version 2.1'), ('LGPL-2.1', 'GNU Lesser General Public License v2.1'), ('LGPL-2.1', 'LGPL v2.1'), ('LGPL-2.1', 'LGPLv2.1'), ('LGPL-2.1', 'LGPL-2.1'),
    ('LGPL-3.0', 'GNU Lesser General Public License, version 3'), ('LGPL-3.0', 'GNU Lesser General Public License v3.0'), ('LGPL-3.0', 'LGPL v3'), ('LGPL-3.0', 'LGPLv3'), ('LGPL-3.0', 'LGPL-3.0'),
    ('AGPL-3.0', 'GNU Affero General Public License, version 3'), ('AGPL-3.0', 'GNU Affero General Public License v3.0'), ('AGPL-3.0', 'AGPL v3'), ('AGPL-3.0', 'AGPLv3'), ('AGPL-3.0', 'AGPL-3.0'),
    ('MPL-1.1', 'Mozilla Public License, version 1.1'), ('MPL-1.1', 'MPL 1.1'),
    ('MPL-2.0', 'Mozilla Public License, version 2.0'), ('MPL-2.0', 'Mozilla Public License, v. 2.0'), ('MPL-2.0', 'Mozilla Public License 2.0'), ('MPL-2.0', 'MPL 2.0'),
    ('EPL-1.0', 'Eclipse Public License v1.0'), ('EPL-1.0', 'Eclipse Public License, version 1.0'), ('EPL-1.0', 'Eclipse Public License 1.0'),
    ('EPL-2.0', 'Eclipse Public License v2.0'), ('EPL-2.0', 'Eclipse Public License, version 2.0'), ('EPL-2.0', 'Eclipse Public License 2.0'),
    ('CDDL-1.0', 'Common Development and Distribution License, version 1.0'), ('CDDL-1.0', 'CDDL 1.0'),
    ('CDDL-1.1', 'Common Development and Distribution License, version 1.1'), ('CDDL-1.1', 'CDDL 1.1'),
    ('EUPL-1.2', 'European Union Public Licence, version 1.2'), ('EUPL-1.2', 'EUPL 1.2'), ('EUPL-1.2', 'EUPL v1.2'),
    ('Unlicense', 'Unlicense'), ('Unlicense', 'The Unlicense'),
    ('WTFPL', 'Do What The Fuck You Want To Public License'), ('WTFPL', 'WTFPL'),
    ('Zlib', 'zlib License'), ('Zlib', 'zlib/libpng License'),
    ('BSL-1.0', 'Boost Software License, Version 1.0'), ('BSL-1.0', 'Boost Software License 1.0'),
    ('Artistic-2.0', 'Artistic License 2.0'), ('Artistic-2.0', 'Artistic License, version 2.0'),
    ('AFL-3.0', 'Academic Free License version 3.0'), ('AFL-3.0', 'Academic Free License 3.0'),
    ('OSL-3.0', 'Open Software License version 3.0'), ('OSL-3.0', 'Open Software License 3.0'),
    ('MS-PL', 'Microsoft Public License'),
    ('PostgreSQL', 'PostgreSQL License'),
    ('Python-2.0', 'Python Software Foundation License'), ('Python-2.0', 'Python License 2.0'),
    ('NCSA', 'University of Illinois/NCSA Open Source License'), ('NCSA', 'NCSA License'),
    ('OFL-1.1', 'SIL Open Font License, Version 1.1'), ('OFL-1.1', 'SIL Open Font License 1.1'),
    ('SSPL-1.0', 'Server Side Public License, version 1'), ('SSPL-1.0', 'Server Side Public License 1.0'),
    ('BUSL-1.1', 'Business Source License 1.1'),
    ('Elastic-2.0', 'Elastic License 2.0'),
    ('ODbL-1.0', 'Open Database License 1.0'), ('ODbL-1.0', 'Open Data Commons Open Database License v1.0'),
    ('CC0-1.0', 'CC0 1.0 Universal'), ('CC0-1.0', 'CC0 1.0'), ('CC0-1.0', 'CC0'),
    ('CC-BY-4.0', 'CC BY 4.0'), ('CC-BY-4.0', 'Creative Commons Attribution 4.0 International License'),
    ('CC-BY-3.0', 'CC BY 3.0'), ('CC-BY-3.0', 'Creative Commons Attribution 3.0 Unported License'),
    ('CC-BY-SA-4.0', 'CC BY-SA 4.0'), ('CC-BY-SA-4.0', 'Creative Commons Attribution-ShareAlike 4.0 International License'),
    ('CC-BY-SA-3.0', 'CC BY-SA 3.0'), ('CC-BY-SA-3.0', 'Creative Commons Attribution-ShareAlike 3.0 Unported License'),
    ('CC-BY-ND-4.0', 'CC BY-ND 4.0'), ('CC-BY-ND-4.0', 'Creative Commons Attribution-NoDerivatives 4.0 International License'),
    ('CC-BY-NC-4.0', 'CC BY-NC 4.0'), ('CC-BY-NC-4.0', 'Creative Commons Attribution-NonCommercial 4.0 International License'),
    ('CC-BY-NC-SA-4.0', 'CC BY-NC-SA 4.0'), ('CC-BY-NC-SA-4.0', 'Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License'),
    ('CC-BY-NC-ND-4.0', 'CC BY-NC-ND 4.0'), ('CC-BY-NC-ND-4.0', 'Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License')
), rule(licence, ids) AS (VALUES
    ('Apache-2.0', 'apache-comply,apache-copy,apache-url'),
    ('Apache-2.0', 'apache-title'),
    ('MIT', 'mit-title'),
    ('MIT', 'grant,grant-subject,mit-include'),
    ('MIT-0', 'grant,mit-as-is'),
    ('ISC', 'isc-grant,isc-include'),
    ('ISC', 'isc-and-grant,isc-include'),
    ('0BSD', 'isc-grant,mit-as-is'),
    ('BSD-4-Clause', 'bsd-permit,bsd-source,bsd-binary,bsd-advert'),
    ('BSD-3-Clause', 'bsd-permit,bsd-source,bsd-binary,bsd-names'),
    ('BSD-2-Clause', 'bsd-permit,bsd-source,bsd-binary'),
    ('GPL-2.0-or-later', 'gpl-terms,either-2'),
    ('GPL-3.0-or-later', 'gpl-terms,either-3'),
    ('LGPL-2.1-or-later', 'lgpl-terms,either-21'),
    ('LGPL-3.0-or-later', 'lgpl-terms,either-3'),
    ('AGPL-3.0-or-later', 'agpl-terms,either-3'),
    ('GPL-2.0', 'gpl2-title'),
    ('GPL-3.0', 'gpl3-title'),
    ('LGPL-2.1', 'lgpl21-title'),
    ('LGPL-3.0', 'lgpl3-title'),
    ('AGPL-3.0', 'agpl3-title'),
    ('MPL-2.0', 'mpl2-subject'),
    ('MPL-1.1', 'mpl11-subject'),
    ('EPL-1.0', 'epl1-made'),
    ('EPL-2.0', 'epl2-made'),
    ('CDDL-1.0', 'cddl-subject'),
    ('Unlicense', 'unlicense-free'),
    ('Unlicense', 'unlicense-anyone'),
    ('WTFPL', 'wtfpl-just'),
    ('Zlib', 'zlib-grant,zlib-origin'),
    ('BSL-1.0', 'boost-grant'),
    ('OFL-1.1', 'ofl-font'),
    ('CC0-1.0', 'cc0-waived'),
    ('proprietary', 'rights')
), form AS (
    SELECT id, trim(regexp_replace(lower(words), '[^a-z0-9]+', ' ', 'g')) AS form FROM sentence
), spoken AS (
    SELECT lower(licence) || '-notice' AS id, trim(regexp_replace(lower(words), '[^a-z0-9]+', ' ', 'g')) AS form FROM name
), ending(ending, place) AS (VALUES ('', 0), ('-only', 1), ('-or-later', 2)
), licence AS (SELECT licence, row_number() OVER () AS place FROM (SELECT licence, min(rowid) AS r FROM (SELECT licence, row_number() OVER () AS rowid FROM name) GROUP BY licence ORDER BY r)
), tagged AS (
    SELECT licence || ending AS licence, lower(licence || ending) || '-tag' AS id, trim(regexp_replace(lower(licence || ending), '[^a-z0-9]+', ' ', 'g')) AS form, l.place, e.place AS later
    FROM licence l JOIN ending e ON e.ending = '' OR licence LIKE '%GPL%'
), expression AS (
    SELECT '\b(?:' || (SELECT string_agg(form, '|' ORDER BY length(form) DESC, form) FROM form)
        || '|(?:(?:licensed|released|distributed|available|provided|published) under|subject to) (?:(?:the )?terms of the |the )?(?:'
        || (SELECT string_agg(form, '|' ORDER BY length(form) DESC, form) FROM spoken)
        || ')|spdx license identifier (?:' || (SELECT string_agg(form, '|' ORDER BY length(form) DESC, form) FROM tagged) || '))\b' AS e
), doc AS (
    SELECT row_number() OVER () AS r, doc_id,
           lower(regexp_replace(regexp_replace(coalesce(text, ''), '\n[^A-Za-z0-9\n]*\n[^A-Za-z0-9]*', ' ' || chr(1) || ' ', 'g'), '[^A-Za-z0-9\x01]+', ' ', 'g')) AS n
    FROM documents
), likely AS (
    SELECT r, n FROM doc WHERE regexp_matches(n, '\b(?:under|subject|spdx|license|licence|redistribute|redistributions|redistribution|permission|software|copyright|version|rights|copy|public|origin|just|hope|program)\b')
), hit AS (
    SELECT r, unnest(h) AS hit, generate_subscripts(h, 1) AS i FROM (SELECT r, regexp_extract_all(n, e) AS h FROM likely, expression)
), known AS (
    SELECT r, i, coalesce(form.id, spoken.id, tagged.id) AS id
    FROM hit LEFT JOIN form ON hit = form.form
    LEFT JOIN spoken ON regexp_replace(hit, '^(?:[a-z]+ under|subject to) (?:(?:the )?terms of the |the )?', '') = spoken.form AND NOT hit LIKE 'spdx %'
    LEFT JOIN tagged ON hit = 'spdx license identifier ' || tagged.form
), ids AS (
    SELECT r, list(id ORDER BY i) AS ids, ',' || string_agg(id, ',' ORDER BY i) || ',' AS j FROM known GROUP BY r
), every AS (
    SELECT licence, ids, row_number() OVER () AS place, 0 AS later, 0 AS kind FROM rule
    UNION ALL SELECT licence, id, 1000 + place, later, 0 FROM tagged
    UNION ALL SELECT licence, lower(licence) || '-notice', 1000 + place, 3, 1 FROM licence
), shown AS (
    SELECT r, licence, min((place, later, kind)) AS first FROM ids JOIN every ON contains(j, ',' || every.ids || ',') GROUP BY r, licence
), licences AS (SELECT r, string_agg(licence, ',' ORDER BY first) AS licences FROM shown GROUP BY r)
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(licences, '') AS licences, coalesce(len(ids), 0)::BIGINT AS n_sentences
FROM doc LEFT JOIN ids USING (r) LEFT JOIN licences USING (r)
"""
