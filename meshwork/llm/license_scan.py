"""License scans: sentence-rule recognition.

A text is cut into lines at newlines and after . ! ? before white space, without comment leaders.  A line is normalised (lower case,
all but letters and digits as one space).  A line, or several that follow one another without a blank line or a sentence's end between
them (a wrapped notice), is looked up among the known licence sentences; of lines within lines that make the same sentence only the
fewest count.  That makes the text's sequence of sentence identifiers, by where they begin.  How a notice
refers to a licence ("is released under the terms of the") becomes one word first, references to several licences and SPDX expressions
a sentence for each, and what follows a version ("or later") goes.  A rule is an ordered sequence of
identifiers; it matches where its identifiers follow one another, with at most `GAP` other known sentences between two of them.
All of it is expressions on a row: no shuffle.

Defined results: a null or empty text has no sentences, an empty table no rows; known sentences that no rule uses are listed but name no
licence.  Repeated rows have a row each with the same result, as a row's result depends on its text alone; further columns, whatever
their names, aren't read.  Nothing is ranked, so there are no ties.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = 3

# Public licences, by SPDX identifier, and what they are called, normalised
LICENCES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "MIT": ["mit license"],
    "ISC": ["isc license"],
    "BSD": ["bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl v2", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl v3", "gplv3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgplv2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lesser general public license v3 0", "lgplv3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu affero general public license v3", "gnu affero general public license v3 0", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "eclipse public license v 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license v 2 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "Zlib": ["zlib license", "zlib libpng license", "the zlib libpng license"],
    "Artistic-2.0": ["artistic license 2 0", "the artistic license 2 0"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license 1 0"],
    "EUPL-1.2": ["european union public licence v 1 2", "european union public licence 1 2"],
    "PostgreSQL": ["postgresql license", "the postgresql licence"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
}
#: The GNU licences' names, and the dates under their titles
GNU = {"GPL": "general public license", "LGPL": "lesser general public license", "AGPL": "affero general public license"}
DATED = {"GPL-2.0": "version 2 june 1991", "GPL-3.0": "version 3 29 june 2007", "LGPL-2.1": "version 2 1 february 1999", "LGPL-3.0": "version 3 29 june 2007", "AGPL-3.0": "version 3 19 november 2007"}
#: The word that stands for how a notice refers to a licence; a name of "license" may also stand on a line of its own, as a title
REF = "licensedunder"
#: What REF stands for, at the beginning of a sentence
REFERRING = r"(?:(?:this|the) (?:project|work|software|program|file|code|library|package|module) is )?(?:dual )?(?:licensed|released|distributed|available|published|provided) under (?:either )?(?:of )?(?:the )?(?:terms of )?(?:the )?"
#: What may follow the version of a licence
LATER = r"only|or later|or newer|or any later version|or at your option any later version"
TAG = "spdx license identifier"
#: Sentences of the licences' own texts and notices, normalised
TEXTS = {
    "apache2-use": ["you may not use this file except in compliance with the license", "licensedunder apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "apache2-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl21-free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl3-free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-hope": [f"this {x} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose" for x in ("program", "library")],
    "gpl-received": ["you should have received a copy of the gnu general public license along with this program"],
    "lgpl-received": ["you should have received a copy of the gnu lesser general public license along with this library"],
    "agpl-received": ["you should have received a copy of the gnu affero general public license along with this program"],
    "mpl2-subject": [f"this source code form is subject to the terms of the mozilla public license v{x}" for x in ("", " 2 0")],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-liable": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc-grant": [f"permission to use copy modify and{x} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for x in ("", " or")],
    "bsd-redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-name": [f"neither the name of the {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" for x in ("copyright holder", "organization", "university", "project")],
    "bsd-as-is": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "all-rights": ["all rights reserved"],
}


def _slug(name: str) -> str:
    short = name.lower().removesuffix(".0")
    return short if short.startswith("cc") else re.sub(r"-([0-9])", r"\1", short)


def _called(name: str) -> list[str]:
    """A licence's names; those of a GNU licence by rule as well."""
    family, _, version = name.rpartition("-")
    if family not in GNU:
        return LICENCES[name]
    numbers = {version.replace(".", " "), version.removesuffix(".0").replace(".", " ")}
    made = {f"{gnu}{x} {v}{n}" for gnu in ("", "gnu ") for x in (GNU[family], family.lower()) for v in ("version ", "v", "") for n in numbers}
    return [*LICENCES[name], *sorted(made - set(LICENCES[name]))]


def _references() -> dict[str, list[str]]:
    """For each licence, the sentences that name it: ...-ref, and SPDX tags, titles and addresses as ...-tag, ...-title and ...-url."""
    out = {}
    for name in LICENCES:
        slug, spdx, called = _slug(name), re.sub("[^a-z0-9]+", " ", name.lower()), _called(name)
        variants = [spdx, *(f"{spdx} {x}" for x in ("only", "or later") if "GPL" in name)]
        out[f"{slug}-tag"] = [f"{begin} {x}" for begin in (TAG, "license") for x in variants] + [f"license {x}" for x in called if x != spdx]
        out[f"{slug}-ref"] = [f"{REF} {x}" for x in [*called, *([] if spdx in called else [spdx])]]
        family = name.rpartition("-")[0]
        titles = [f"gnu {GNU[family]} {DATED[name]}"] if family in GNU else ["apache license version 2 0 january 2004"] if name == "Apache-2.0" else []
        out[f"{slug}-title"] = [x for x in LICENCES[name] if "licen" in x and x != "unlicense"] + titles
        # Apache's address is part of its notice
        places = [] if name == "Apache-2.0" else [f"www gnu org licenses {spdx}{x}" for x in ("", " html", " en html", " txt")] if family in GNU else [f"creativecommons org licenses {spdx[3:]}"] if spdx.startswith("cc by") else [f"{www}opensource org licenses {spdx}" for www in ("", "www ")]
        out[f"{slug}-url"] = [f"{scheme} {x}" for scheme in ("http", "https") for x in places]
    out["apache2-ref"].append(f"{REF} apache license version 2 0 the license")
    return {name: forms for name, forms in out.items() if forms}


SENTENCES = TEXTS | _references()
#: A licence, the sentences that name it, in this order, and licences that are more exact
RULES = [
    *[(name, [f"{_slug(name)}-{kind}"], ()) for name in LICENCES for kind in ("ref", "tag", "title", "url") if f"{_slug(name)}-{kind}" in SENTENCES],
    ("Apache-2.0", ["apache2-use", "apache2-copy", "apache2-basis"], ()),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-received"], ()),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-received"], ()),
    ("LGPL-2.1-or-later", ["lgpl21-free", "gpl-hope", "lgpl-received"], ()),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope", "lgpl-received"], ()),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope", "agpl-received"], ()),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"], ()),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"], ()),
    ("ISC", ["isc-grant"], ()),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name"], ()),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"], ("BSD-3-Clause",)),
    ("BSD", ["bsd-redistribution"], ("BSD-2-Clause", "BSD-3-Clause")),
    ("All-rights-reserved", ["all-rights"], ()),
]
#: Each known sentence has one of these
MARKS = ("licen", "reserved", "warrant", "permission", "redistribution", "mpl", "gpl", "cc0", "cc by", "cc-by", "in no event", "obtain a copy")
#: Comment leaders that are words; all others have neither letters nor digits
LEADER = r"(?<![^\n])(?:(?:[ \t]*@?(?:dnl|rem)|c)(?=[ \t\r\n]))?[^a-z0-9\n]*"


def _names(text: Column, rules: list) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(_pattern(ids)), F.lit(name)) for name, ids, _ in rules]))


def _pattern(ids: list[str]) -> str:
    return f" {(' (?:[^ ]+ ){0,' + str(GAP) + '}').join(ids)} "


def _wrapped(form: str) -> str:
    return form.replace(" ", "[ \n]")


def _inner(form: str, forms: list[str]) -> str | None:
    """What finds a shorter form of the same sentence on whole lines of its own within the lines of form; None if there is none."""
    shorter = [_wrapped(x) for x in forms if x != form and f" {x} " in f" {form} "]
    return f"(?<![^\n])(?:{'|'.join(shorter)})(?![^\n])" if shorter else None


def _plain(lines: Column) -> Column:
    """Normalised lines with a word for how they refer to licences, and a sentence for each of several licences (four at most)."""
    # words may be on the next line; of a sentence's words at most 12 are looked through
    space, words = "[ \n]", "(?:[ \n][a-z0-9]+)"
    # what a wrapped sentence about "the license" begins a line with is no reference; possessive, so that no part of the phrase is left
    phrase = REFERRING.replace(" ", space).replace(")?", ")?+")
    lines = F.regexp_replace(lines, f"(?<=\n){phrase}(?!licen[sc]e[ \n])(?=[a-z0-9])", f"{REF} ")
    for begin in (REF, TAG):
        for _ in range(3):
            lines = F.regexp_replace(lines, f"(\n{begin}{words}{{1,12}}?){space}(?:or|and){space}(?!later|newer|any later|any\nlater|at your)(?:the{space})?(?=[a-z0-9])", f"$1\n\n{begin} ")
    lines = F.regexp_replace(lines, f"(\n{TAG} [a-z0-9 ]+?) with [a-z0-9 ]+(?=\n)", "$1")
    lines = F.regexp_replace(lines, f"(\n{REF}{words}{{1,12}}?){space}at your option(?=\n)", "$1")
    return F.regexp_replace(lines, f"(\n{REF}{words}{{0,12}}[ \n][a-z0-9]*[0-9]){space}(?:{LATER.replace(' ', space)})(?=\n)", "$1")


def _found(text: Column) -> Column:
    """The identifiers of the known sentences of text (lower case)."""
    # a sentence's end makes an empty line, as a blank line does
    cut = F.regexp_replace(F.regexp_replace(text, LEADER, ""), r"[.!?](?:[ \t]+|[ \t\r]*(?=\n))", "\n\n")
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.regexp_replace(cut, r"[^a-z0-9\n]+", " "), F.lit("\n")), " ?\n ?", "\n")
    lines = _plain(lines)
    forms = sorted(((form, name, _inner(form, all_)) for name, all_ in SENTENCES.items() for form in all_), key=lambda x: (len(x[0]), x[0]))
    begins = "|".join(sorted({_wrapped(" ".join(form.split()[:2])) for form, *_ in forms}))
    # from each line that begins as a known sentence does, as many characters as the longest one has, and the one after it
    starts = F.regexp_extract_all(lines, F.lit(rf"(?<=\n)(?=((?:{begins})[ \n][a-z0-9 \n]{{0,{len(forms[-1][0])}}}))"), F.lit(1))
    # one literal, as the plan would have some thousand otherwise
    known = F.from_json(F.lit(json.dumps([{"form": form, "id": name, "inner": inner} for form, name, inner in forms])), "array<struct<form string, id string, inner string>>")

    def here(start: Column, x: Column) -> Column:
        n = F.length(x["form"])
        least = x["inner"].isNull() | ~F.call_function("rlike", F.substring(start, F.lit(1), n), x["inner"])
        return (F.substring(start, n + 1, F.lit(1)) == "\n") & F.translate(start, "\n", " ").startswith(x["form"]) & least

    return F.flatten(F.transform(starts, lambda start: F.transform(F.filter(known, lambda x: here(start, x)), lambda x: x["id"])))


def scanned(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with sentence_ids and licenses (sorted) in place of text."""
    text = F.lower(F.coalesce("text", F.lit("")))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | text.contains(mark)
    df = docs.select("doc_id", F.when(marked, _found(text)).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    # each identifier has a space of its own on both sides, so that patterns can begin and end with one
    sequence = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" "))
    df = df.withColumn("_all", F.when(F.size("sentence_ids") > 0, _names(sequence, RULES)).otherwise(F.array().cast("array<string>")))
    less = [(name, exact) for name, exact in dict((name, exact) for name, _, exact in RULES).items() if exact]
    # a name goes where a more exact one is found
    blunt = F.array_compact(F.array(*[F.when(F.arrays_overlap("_all", F.array(*map(F.lit, exact))), F.lit(name)) for name, exact in less]))
    return df.withColumn("licenses", F.array_sort(F.array_distinct(F.array_except("_all", blunt)))).drop("_all")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's known licence sentences, in order, and the licences that they name."""
    df = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return df.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"))


def sql() -> str:
    known = ", ".join(f"('{form}', '{name}')" for name, forms in SENTENCES.items() for form in forms)
    rules = ", ".join(f"('{name}', '{_pattern(ids)}')" for name, ids, _ in RULES)
    exact = ", ".join(f"('{name}', '{x}')" for name, _, all_ in RULES for x in all_)
    return rf"""
WITH known(form, id) AS (VALUES {known}), rules(name, pattern) AS (VALUES {rules}), exact(name, better) AS (SELECT DISTINCT * FROM (VALUES {exact})),
d AS (SELECT doc_id, row_number() OVER () AS r, lower(coalesce(text, '')) AS t FROM documents),
s0 AS (SELECT r, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT r, string_split(regexp_replace(t, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM d)),
s AS (SELECT r, i, regexp_replace(regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), '^{REFERRING}', '{REF} '), '^({REF} .*[0-9]) (?:{LATER})$', '\1') AS s FROM s0),
f AS (SELECT r, string_agg(id, ' ' ORDER BY i) AS ids, count(*) AS n FROM s JOIN known ON form = s GROUP BY r),
n AS (SELECT DISTINCT r, name FROM f JOIN rules ON regexp_matches(' ' || ids || ' ', pattern)),
m AS (SELECT r, string_agg(name, ' ' ORDER BY name) AS licenses FROM (SELECT * FROM n ANTI JOIN (SELECT n.r, e.name FROM n JOIN exact e ON e.better = n.name) USING (r, name)) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN f USING (r) LEFT JOIN m USING (r)"""
