"""Licence scans by sentence rules: known sentences become identifiers, ordered rules match their sequences.

All of it is column expressions on one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, normalised as ``normalised`` does, and their identifiers.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2.0",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-header": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache-at": "you may obtain a copy of the license at",
    "apache-url": "http www.apache.org licenses license 2.0",
    "apache-urls": "https www.apache.org licenses license 2.0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ccbync4-notice": "licensed under cc by nc 4.0",
    "ccby4-notice": "licensed under cc by 4.0",
    "ccbysa4-notice": "licensed under cc by sa 4.0",
    "cc0-notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "mpl2-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liable": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",
    "reserved": "all rights reserved",
}

#: Rules in the order in which they are tried, longer ones before their parts: licence, sentences in a row.
RULES = [
    ("Apache-2.0", ["apache-header", "apache-at", "apache-url", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-header", "apache-at", "apache-urls", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-notice", "apache-may-not", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-notice", "apache-may-not"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-keep", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liable"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("CC-BY-SA-4.0", ["ccbysa4-notice"]),
    ("CC-BY-4.0", ["ccby4-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy-http"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope", "agpl-details"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-free"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("EPL-2.0", ["epl2-notice"]),
]
#: Every licence named by its identifier: a sentence and a rule of its own.
for _name in dict.fromkeys(name for name, _ in RULES):
    SENTENCES[f"spdx-{_name.lower()}"] = f"spdx license identifier {_name.lower().replace('-', ' ')}"
    RULES.append((_name, [f"spdx-{_name.lower()}"]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What an end must not be taken for, or must not stand in a sentence, and what it becomes: line ends of other systems,
#: comment marks at the start of a line, the stop of "v. 2".
CLEAN = [("\\r\\n?", "\n"), ("(^|\\n)[\\t ]*(/?\\*+/?|//+|#+|;+|--+|<!--|%+)[\\t ]*", "{1}"), ("([ \\t\\n][vV])\\.[\\t \\n]+([0-9])", "{1} {2}")]
#: A sentence ends at a stop before white space or the end of the text, at a colon at a line's end, and at a blank line.
ENDS = "[.!?]+([\\t-\\r ]+|\\z)|:[\\t ]*\\n|\\n[\\t ]*\\n"


def normalised(sentence: Column) -> Column:
    """A-Z in lower case; letters a-z, digits and inner dots stay, all else is one space."""
    plain = F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9.]+", " ")
    return F.regexp_replace(plain, "^[ .]+|[ .]+$", "")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_known, sentence_ids, licenses, n_unmatched) of every row of ``docs``.

    ``sentence_ids``: the identifiers of the known sentences in order.  ``licenses``: the licences whose rules
    match, in the order of the rules; a rule takes its sentences away from those after it.  ``n_unmatched``: known
    sentences that no rule took.  A line end is a blank inside a sentence, so wrapped texts and comment blocks are
    read; what is no known sentence is read line by line, so that a notice without a stop is known on a line of its own.
    Sentences without a letter or digit are not counted.  Null and empty texts have none; repeated rows give
    repeated results; other columns are ignored.
    """
    known = F.create_map(*[F.lit(x) for name, text in SENTENCES.items() for x in (text, name)])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for pattern, new in CLEAN:
        text = F.regexp_replace(text, pattern, new.format("", "$1", "$2"))
    lines = F.transform("s", lambda x: F.when(x.contains("\n") & F.try_element_at(known, normalised(x)).isNull(), F.split(x, "\n")).otherwise(F.array(x)))
    return _rules(
        docs.select("doc_id", F.split(text, ENDS).alias("s")).select("doc_id", F.flatten(lines).alias("s"))
        .select("doc_id", F.filter(F.transform("s", normalised), lambda x: x != "").alias("s"))
        .select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.filter(F.transform("s", lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull()).alias("ids")))


def _rules(found: DataFrame) -> DataFrame:
    """Rules on the sequence as text: ``|id||id|``; a match leaves a bar, so that its neighbours do not meet."""
    out = found.withColumn("rest", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    for i, (_, ids) in enumerate(RULES):
        chain = "".join(f"<{x}>" for x in ids)
        out = out.withColumns({f"r{i}": F.contains("rest", F.lit(chain)), "rest": F.replace("rest", F.lit(chain), F.lit("|"))})
    named = F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"r{i}"), F.lit(name)) for i, (name, _) in enumerate(RULES)]))), ",")
    return out.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", " ").alias("sentence_ids"), named.alias("licenses"),
                      (F.length("rest") - F.length(F.replace("rest", F.lit("<"), F.lit("")))).cast("long").alias("n_unmatched"))


def sql() -> str:
    """The same scan for DuckDB, from the same tables of sentences and rules."""
    keys = ", ".join(f"'{t}'" for t in SENTENCES.values())
    names = ", ".join(f"'{n}'" for n in SENTENCES)
    clean = "regexp_replace(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    whole = "coalesce(text, '')"
    for pattern, new in CLEAN:
        replacement = new.format("", "\\1", "\\2").replace("\n", "' || chr(10) || '")
        whole = f"regexp_replace({whole}, '{pattern}', '{replacement}', 'g')"
    steps = [
        f"pieces AS (SELECT doc_id, string_split_regex({whole}, '{ENDS}') AS p FROM documents)",
        f"lines AS (SELECT doc_id, flatten([CASE WHEN contains(x, chr(10)) AND NOT list_contains([{keys}], {clean}) THEN string_split(x, chr(10)) ELSE [x] END FOR x IN p]) AS p FROM pieces)",
        f"parts AS (SELECT doc_id, [{clean} FOR x IN p] AS p FROM lines)",
        "docs AS (SELECT doc_id, [x FOR x IN p IF x <> ''] AS s FROM parts)",
        f"ids AS (SELECT doc_id, len(s)::BIGINT AS n_sentences, [([{names}])[list_position([{keys}], x)] FOR x IN s IF list_contains([{keys}], x)] AS ids FROM docs)",
        "step0 AS (SELECT *, list_aggregate(['<' || x || '>' FOR x IN ids], 'string_agg', '') AS rest0 FROM ids)"]
    rest = "coalesce(rest0, '')"
    hits = []
    for i, (name, ids) in enumerate(RULES):
        chain = "".join(f"<{x}>" for x in ids)
        steps.append(f"step{i + 1} AS (SELECT *, contains({rest}, '{chain}') AS r{i}, replace({rest}, '{chain}', '|') AS rest{i + 1} FROM step{i})")
        rest = f"rest{i + 1}"
        hits.append(f"CASE WHEN r{i} THEN '{name}' END")
    last = len(RULES)
    order = list(dict.fromkeys(name for name, _ in RULES))
    picked = ", ".join(f"CASE WHEN list_contains([{', '.join(hits)}], '{name}') THEN '{name}' END" for name in order)
    return f"""WITH {', '.join(steps)}
    SELECT doc_id, n_sentences, len(ids)::BIGINT AS n_known, coalesce(list_aggregate(ids, 'string_agg', ' '), '') AS sentence_ids,
        coalesce(list_aggregate([x FOR x IN [{picked}] IF x IS NOT NULL], 'string_agg', ','), '') AS licenses,
        (len(rest{last}) - len(replace(rest{last}, '<', '')))::BIGINT AS n_unmatched FROM step{last}"""
