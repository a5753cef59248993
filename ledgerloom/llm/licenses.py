"""Licence scan by sentence rules, in DataFrame functions only.

Texts are cut into sentences (at lines without a letter or digit, after lines of a copyright holder, and after . ! ? ; : and white space);
a single line break is white space, and a sentence of several lines is tried whole and by line. Sentences are normalised: lower case, every run of other
characters than letters and digits one space, years and copyright holders' lines aside. A sentence table maps known normalised
sentences to identifiers; one that is cut itself has an identifier for each piece, and rules ask for all of them. The table is fixed and small (its size is checked), so it is broadcast and no text is shuffled. Only the
matched sentences, a few for each document, are grouped into the document's sequence of identifiers. Rules are ordered lists of
identifiers; a rule is met where its identifiers follow one another among the document's known sentences. Rules are tried in
their order, and a sentence that a rule has used is not used by a later one.

Cases: null and empty texts know no sentence; repeated sentences count each time; rows that share an id are one document, its rows' sentences following
one another by text; a null id is an id; documents without a known sentence are not in the result; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

# Known sentences, by identifier, and the rules in the order in which they are tried.
SENTENCES = {
    "apache-grant": "Licensed under the Apache License, Version 2.0",
    "apache-grant-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-ref": "Released under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-short": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
RULES = (
    ("Apache-2.0", ("apache-grant-the", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-short", "mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-grant-the",)),
    ("Apache-2.0", ("apache-grant",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-short",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
)
MOST_SENTENCES = 100_000
SENTENCE_END = r"(?<=[.!?;:])[\x20\x09-\x0D]+"


def normalised(sentence):
    """Lower case; every run of characters that are neither ASCII letters, digits nor outside ASCII is one space; no outer spaces."""
    return F.trim(F.regexp_replace(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def sentences_of(text):
    # A line without a letter or digit is a cut, so one is put after a copyright holder's line.
    text = F.regexp_replace(text, r"(?im)^[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*copyright[\x20\x09]*(?:\(c\)|©|[0-9])[^\n]*$", "$0\n")
    return F.split(text, r"\n[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n|" + SENTENCE_END, -1)


def pieces(sentence: str) -> list:
    """A known sentence cut like the texts."""
    return [p for p in re.split(SENTENCE_END, sentence) if re.search(r"[A-Za-z0-9]", p)]


def piece_id(sid: str, k: int) -> str:
    return f"{sid}+{k + 1}" if k else sid


def known_sentences(spark, sentences: dict = SENTENCES) -> DataFrame:
    if len(sentences) > MOST_SENTENCES:
        raise ValueError(f"{len(sentences)} sentences are too many to broadcast; the bound is {MOST_SENTENCES}")
    rows = [(piece_id(sid, k), piece) for sid, sentence in sentences.items() for k, piece in enumerate(pieces(sentence))]
    return spark.createDataFrame(rows, "sid string, piece string").select("sid", normalised(F.col("piece")).alias("norm")).groupBy("norm").agg(F.min("sid").alias("sid"))


def sentence_hits(docs: DataFrame, sentences: dict = SENTENCES, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, pos, sid): every sentence of every whole text that the table knows."""
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.posexplode(sentences_of(F.col(text_col))).alias("place", "sentence"))
    # The whole sentence first, then its lines where it has several.
    forms = F.when(F.trim(F.col("sentence")).contains("\n"), F.concat(F.array("sentence"), F.split("sentence", "\n", -1))).otherwise(F.array("sentence"))
    rows = rows.select("doc_id", "text_key", "place", F.posexplode(forms).alias("part", "form"), F.regexp_count("sentence", F.lit(r"(?m)^.*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F].*$")).alias("lines")).where("part = 0 or lines > 1")
    rows = rows.select("doc_id", "text_key", (F.col("place").cast("long") * (1 << 31) + F.col("part")).alias("pos"), normalised(F.col("form")).alias("norm")).where("norm <> ''")
    return rows.join(F.broadcast(known_sentences(docs.sparkSession, sentences)), "norm").select("doc_id", "text_key", "pos", "sid")


def match_rules(hits: DataFrame, rules: tuple = RULES, sentences: dict = SENTENCES) -> DataFrame:
    """(doc_id, n_sentences, sids, licenses): the sequence of known sentences and the licences whose rules it meets, each once, sorted."""
    by_doc = hits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("text_key", "pos", "sid"))), lambda x: x["sid"]).alias("sids"))
    # ">a<>b<" is the sequence; what a rule uses becomes "|", so that later rules don't use it and don't reach across it.
    rest = F.concat(F.lit(">"), F.array_join("sids", "<>"), F.lit("<"))
    out, column = [], by_doc.withColumn("__rest", rest)
    for k, (name, sids) in enumerate(rules):
        wanted = ">" + "<>".join(piece_id(s, n) for s in sids for n in range(len(pieces(sentences[s])))) + "<"
        out.append(F.when(F.col(f"__m{k}"), F.lit(name)))
        column = column.withColumn(f"__m{k}", F.col("__rest").contains(wanted)).withColumn("__rest", F.replace("__rest", F.lit(wanted), F.lit("|")))
    return column.select("doc_id", F.size("sids").cast("long").alias("n_sentences"), F.regexp_replace(F.array_join("sids", ","), r"\+[0-9]+", "").alias("sids"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*out)))), ",").alias("licenses"))


def op3_license_sentences(spark, sf_dir: str) -> DataFrame:
    return match_rules(sentence_hits(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    norm = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    cut = "string_split(regexp_replace({}, '([.!?;:])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10))"
    known = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in SENTENCES.items())
    steps, last = [], "seq"
    for k, (_, sids) in enumerate(RULES):
        wanted = _quoted(">" + "<>".join(sids) + "<")
        steps.append(f"r{k} as (select * exclude (rest), contains(rest, {wanted}) as m{k}, replace(rest, {wanted}, '|') as rest from {last})")
        last = f"r{k}"
    names = ", ".join(f"case when m{k} then {_quoted(n)} end" for k, (n, _) in enumerate(RULES))
    return f"""
with s(sid, sentence) as (values {known}),
k as (select norm, min(sid) as sid from (select sid, {norm.format("unnest(" + cut.format("sentence") + ")")} as norm from s) where norm <> '' group by norm),
d as (select doc_id, p as parts, unnest(range(1, len(p) + 1)) as pos from (select doc_id, {cut.format("text")} as p from documents)),
h as (select doc_id, pos, sid from (select doc_id, pos, {norm.format("parts[pos]")} as norm from d) join k using (norm)),
seq as (select doc_id, count(*) as n_sentences, string_agg(sid, ',' order by pos) as sids, '>' || string_agg(sid, '<>' order by pos) || '<' as rest from h group by doc_id),
{", ".join(steps)}
select doc_id, n_sentences, sids, coalesce(array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x is not null))), ','), '') as licenses from {last}
"""


OP3_SQL = _sql()
