"""Licence scan: runs of a text against licence templates by Dice coefficient over word bigrams.

For each template the places of a text whose bigram the template has are hits. Hits that follow each
other closely form a run, and the set of all bigrams from a run's first hit to its last is compared
with the template's. So a notice is found on a line of its own, over several paragraphs, inside a
longer line or a longer text. Runs are formed at several widths (the most places from one hit to the
next): narrow ones leave out common words around a notice, the widest still holds together any span
that can reach the coefficient. Templates of which a text has too few bigrams are left out first.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Least Dice coefficient.
LEAST = 0.8
#: Most places from a hit to the next in a run, besides each template's widest.
WIDTHS = (2, 6, 20)

# Public licence texts and notices, by name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License."""),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details."""),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be
        used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details. You should have received a copy of the GNU General Public License
        along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor,
        Boston, MA 02110-1301 USA."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details. You should have received a copy of the GNU General Public License
        along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Lesser General Public License for more details."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        Affero General Public License for more details."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
        altered from any source distribution."""),
)


def bigrams(text: str) -> list[str]:
    """The sorted distinct word bigrams of a template (ASCII)."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def prepared_templates(least: float = LEAST, templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[dict]:
    """name, grams, the least size lo of a set that can reach the coefficient, and the widths of runs."""
    out = []
    for name, text in templates:
        grams = bigrams(text)
        share = least / (2 - least)
        # A span that reaches the coefficient has fewer other bigrams than this.
        widest = math.floor(len(grams) / share - len(grams) + 1e-9) + 1
        out.append({"name": name, "grams": grams, "lo": math.ceil(len(grams) * share - 1e-9),
                    "widths": sorted({min(w, widest) for w in WIDTHS} | {widest})})
    return out


def licences(docs: DataFrame, key: str = "doc_id", least: float = LEAST,
             templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """key, matches: array<struct<shared, dice, name, start, stop>> of the runs that are like a
    template: shared bigrams, coefficient, name, first word and the one after the last.

    ``templates`` are (name, ASCII text of three words or more); long licences can be given too. Runs of
    several widths that are the same span count once. Null texts and those of fewer than two words match
    nothing; repeated rows stand for themselves; texts are read whole. An empty frame gives an empty
    frame. Other columns are not read.
    """
    known = prepared_templates(least, templates)
    lowest = min(t["lo"] for t in known)
    vocabulary = ", ".join(f"'{g}'" for g in sorted({g for t in known for g in t["grams"]}))
    shape = "array<struct<name: string, grams: array<string>, lo: int, widths: array<int>>>"
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    words = F.filter(F.split(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    rows = docs.select(key, words.alias("__words"))
    rows = rows.selectExpr(f"`{key}`", """if(size(__words) > 1, transform(sequence(0, size(__words) - 2),
        i -> concat(__words[i], ' ', __words[i + 1])), array()) AS __grams""")
    rows = rows.selectExpr("*", f"""filter(transform(__grams, (g, i) -> named_struct('g', g, 'i', i)),
        x -> x.g IN ({vocabulary})) AS __hits""")
    rows = rows.selectExpr("*", "array_distinct(__hits.g) AS __seen").withColumn("__known", F.from_json(F.lit(json.dumps(known)), shape))
    rows = rows.selectExpr(f"`{key}`", "__grams", f"""if(size(__seen) < {lowest}, array(), transform(
        filter(__known, t -> size(array_intersect(__seen, t.grams)) >= t.lo),
        t -> named_struct('t', t, 'p', transform(filter(__hits, x -> array_contains(t.grams, x.g)), x -> x.i)))) AS __like""")
    # A run starts at a hit without another close before it, and ends at one without another close after it.
    rows = rows.selectExpr(f"`{key}`", "__grams", """flatten(transform(__like, c -> transform(array_distinct(flatten(
        transform(c.t.widths, d -> filter(arrays_zip(
            filter(c.p, (x, i) -> coalesce(x - get(c.p, i - 1) > d, true)),
            filter(c.p, (x, i) -> coalesce(get(c.p, i + 1) - x > d, true))), r -> r['1'] - r['0'] + 1 >= c.t.lo)))),
        r -> named_struct('t', c.t, 'first', r['0'], 'last', r['1'])))) AS __runs""")
    rows = rows.selectExpr(f"`{key}`", """transform(__runs, r -> named_struct('t', r.t, 'first', r.first, 'last', r.last,
        'g', array_distinct(slice(__grams, r.first + 1, r.last - r.first + 1)))) AS __runs""")
    rows = rows.selectExpr(f"`{key}`", """transform(__runs, r -> named_struct(
        'shared', size(array_intersect(r.g, r.t.grams)), 'size', size(r.g) + size(r.t.grams),
        'name', r.t.name, 'first', r.first, 'last', r.last)) AS __runs""")
    return rows.selectExpr(f"`{key}`", f"""filter(transform(__runs, r -> named_struct('shared', r.shared,
        'dice', 2.0D * r.shared / r.size, 'name', r.name, 'start', r.first, 'stop', r.last + 2)),
        m -> m.dice >= {least}D) AS matches""")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the licence it shares most bigrams with (of equal ones that with the larger
    coefficient, then the first by name), and all."""
    found = licences(table(spark, sf_dir, "documents"))
    best = F.expr("array_min(transform(matches, m -> named_struct('s', -m.shared, 'd', -m.dice, 'name', m.name)))")
    return found.withColumn("best", best).select(
        "doc_id", F.col("best.name").alias("licence"), (-F.col("best.d")).alias("dice"),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.name"))), ",").alias("licences"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    known = ",\n".join(
        f"({number}, {_literal(t['name'])}, [{', '.join(map(_literal, t['grams']))}], {t['lo']}, {t['widths']})"
        for number, t in enumerate(prepared_templates()))
    return f"""
WITH known(t, name, grams, lo, widths) AS (VALUES {known}),
texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (
  SELECT r, list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM texts),
placed AS MATERIALIZED (
  SELECT r, unnest(range(0, len(w) - 1)) AS k,
    unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1),
terms AS (SELECT t, unnest(grams) AS g FROM known),
hits AS (SELECT r, t, k, g FROM placed JOIN terms USING (g)),
spread AS (SELECT t, lo, unnest(widths) AS d FROM known),
cut AS (
  SELECT r, t, d, lo, k, CASE WHEN k - lag(k) OVER (PARTITION BY r, t, d ORDER BY k) <= d THEN 0 ELSE 1 END AS opens
  FROM hits JOIN spread USING (t)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY r, t, d ORDER BY k) AS run FROM cut),
runs AS (
  SELECT DISTINCT r, t, first, last FROM (
    SELECT r, t, min(k) AS first, max(k) AS last FROM numbered GROUP BY r, t, d, run, lo HAVING count(*) >= lo)),
sized AS (
  SELECT r, t, first, last, count(DISTINCT g) AS n FROM runs JOIN placed USING (r) WHERE k BETWEEN first AND last
  GROUP BY r, t, first, last),
sharing AS (
  SELECT r, t, first, last, count(DISTINCT g) AS shared FROM runs JOIN hits USING (r, t) WHERE k BETWEEN first AND last
  GROUP BY r, t, first, last),
matched AS (
  SELECT r, name, shared, 2.0::DOUBLE * shared / (n + len(grams)) AS dice
  FROM sized JOIN sharing USING (r, t, first, last) JOIN known USING (t)),
found AS (
  SELECT r, arg_min(name, (-shared, -dice, name)) AS licence, -min((-shared, -dice, name))[2] AS dice,
    count(*) AS n_matches, list_aggregate(list_sort(list(DISTINCT name)), 'string_agg', ',') AS licences
  FROM matched WHERE dice >= {LEAST} GROUP BY r)
SELECT doc_id, licence, dice, coalesce(n_matches, 0) AS n_matches, coalesce(licences, '') AS licences
FROM texts LEFT JOIN found USING (r)
"""


ORACLE = _sql()
