"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes its lower-cased words joined by single blanks.  Every rule is a
regular expression over that form with a required keyword (its prefilter), a label and a
priority: 1 license texts and notices, 2 named references, 3 generic mentions.
A detection is dropped when it lies inside one of the same or a higher priority, and a
generic mention also when it spans a detection of a higher priority.  Both passes run over
the sorted intervals of one text and keep only running maxima per priority, so a
text with many detections costs one sort.

Texts without any gate keyword are not matched against the rules at all; the
others only against the rules whose keyword they contain.  Everything happens inside
the row: no shuffle, no Python.

Defined results: a null or empty text has 0 words, 0 places, empty labels and
score 0; repeated rows give equal rows; an empty table gives an empty result; extra
columns are kept by ``scan_licenses`` and ignored by the query.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blendwise.llm.common import fresh, table

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License families: label, keyword that every name contains, names as a regex over normalised words.
FAMILIES = [
    ("mit", "mit", "mit licen[cs]e"), ("mit", "expat", "expat licen[cs]e"), ("x11", "x11", "x11 licen[cs]e"),
    ("apache-2.0", "apache", "apache(?: software)? licen[cs]e (?:version |v ?)?2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)? licen[cs]e (?:version |v ?)?1 1"),
    ("apache-1.0", "apache", "apache(?: software)? licen[cs]e (?:version |v ?)?1 0"),
    ("apache", "apache", "apache(?: software)? licen[cs]e"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)?(?: or later)?"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"), ("agpl", "agpl", "(?:gnu )?agpl(?:v[123])?"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?(?: or later)?"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1(?: or later)?"),
    ("lgpl-2.0", "library", "(?:gnu )?library general public licen[cs]e (?:version |v ?)?2(?: 0)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e"), ("lgpl", "lgpl", "(?:gnu )?lgpl(?:v[23])?"),
    ("gpl-3.0", "general public", "(?:gnu )?general public licen[cs]e (?:version |v ?)?3(?: 0)?(?: or later)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public licen[cs]e (?:version |v ?)?2(?: 0)?(?: or later)?"),
    ("gpl-1.0", "general public", "(?:gnu )?general public licen[cs]e (?:version |v ?)?1(?: 0)?(?: or later)?"),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e"),
    ("gpl-3.0", "gplv3", "(?:gnu )?gplv3"), ("gpl-2.0", "gplv2", "(?:gnu )?gplv2"), ("gpl", "gnu gpl", "gnu gpl"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("0bsd", "bsd", "(?:0bsd|bsd zero clause|zero clause bsd)(?: licen[cs]e)?"), ("bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e (?:version |v ?)?1 1"), ("mpl", "mozilla", "mozilla public licen[cs]e"),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?"), ("epl", "eclipse", "eclipse public licen[cs]e"),
    ("edl-1.0", "eclipse", "eclipse distribution licen[cs]e"), ("cddl", "common development", "common development and distribution licen[cs]e"),
    ("cpl-1.0", "common public", "common public licen[cs]e"), ("eupl", "european union", "european union public licen[cs]e"),
    ("isc", "isc", "isc licen[cs]e"), ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"), ("boost", "boost", "boost software licen[cs]e"),
    ("artistic-2.0", "artistic", "artistic licen[cs]e (?:version )?2(?: 0)?"), ("artistic", "artistic", "artistic licen[cs]e"),
    ("unlicense", "unlicense", "the unlicense"), ("wtfpl", "what the", "do what the \\S+ you want to public licen[cs]e"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"), ("cc-by-4.0", "creative commons", "creative commons attribution 4 0"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1234] 0)?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1234] 0)?"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1234] 0)?"),
    ("cc-by", "creative commons", "creative commons attribution"), ("cc", "creative commons", "creative commons licen[cs]e"),
    ("ofl-1.1", "open font", "(?:sil )?open font licen[cs]e"), ("python-2.0", "python", "python(?: software foundation)? licen[cs]e"),
    ("php-3.01", "php", "php licen[cs]e"), ("ruby", "ruby", "ruby licen[cs]e"), ("openssl", "openssl", "openssl licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"), ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e"),
    ("osl-3.0", "open software", "open software licen[cs]e"), ("afl-3.0", "academic free", "academic free licen[cs]e"),
    ("upl-1.0", "universal permissive", "universal permissive licen[cs]e"), ("odbl", "open database", "open database licen[cs]e"),
    ("vim", "vim", "vim licen[cs]e"), ("qpl", "q public", "q public licen[cs]e"), ("sspl", "server side", "server side public licen[cs]e"),
    ("busl-1.1", "business source", "business source licen[cs]e"), ("jsonlicense", "json", "json licen[cs]e"),
    ("ecl-2.0", "educational", "educational community licen[cs]e"), ("sleepycat", "sleepycat", "sleepycat licen[cs]e"),
    ("intel", "intel", "intel open source licen[cs]e"), ("ibmpl-1.0", "ibm", "ibm public licen[cs]e"),
    ("nasa-1.3", "nasa", "nasa open source agreement"), ("w3c", "w3c", "w3c(?: software)?(?: notice and)? licen[cs]e"),
]

# License texts and notices (priority 1): label, keyword, regex.
NOTICES = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", "without restriction", "to deal in the software without restriction including without limitation the rights to use"),
    ("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "any purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of .{1,80}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "in compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2.0", "apache org", "www apache org licenses license 2 0"),
    ("gpl", "redistribute it", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "version 2", "gnu general public license as published by the free software foundation (?:either )?version 2"),
    ("gpl-3.0", "version 3", "gnu general public license as published by the free software foundation (?:either )?version 3"),
    ("lgpl", "redistribute it", "this library is free software you can redistribute it and or modify it under the terms of the gnu l\\S+ general public license"),
    ("gpl", "gnu org", "www gnu org licenses gpl"), ("lgpl", "gnu org", "www gnu org licenses lgpl"), ("agpl", "gnu org", "www gnu org licenses agpl"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", "boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in|to|into) the public domain"),
    ("cc0-1.0", "waived", "waived all copyright and related or neighboring rights"),
    ("wtfpl", "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("ofl-1.1", "font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("warranty-disclaimer", "warranty", "(?:this|the) software is provided (?:by .{1,60}? )?as is without warranty of any kind"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "reserved", "copyright .{1,60}? all rights reserved"),
]

# Generic mentions (priority 3).
GENERIC = [
    ("license-reference", "under", "(?:licensed|released|distributed|available|published|provided) under (?:\\S+ ){1,8}?licen[cs]e"),
    ("license-reference", "licen", "see (?:the )?licen[cs]e(?: file)?(?: for details)?"),
    ("spdx-reference", "spdx", "spdx licen[cs]e identifier \\S+"),
]

# Every text that a rule matches contains at least one of these (checked over all variants of all patterns in tests).
GATES = ["licen", "copyright", "warranty", "public domain", "spdx", "hereby granted", "gplv", "gnu gpl", "agpl", "lgpl", "bsd",
         "cc0", "creative commons", "redistribut", "confidential", "without restriction", "endorse", "advertising", "nasa"]
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.5}


def rules() -> list[dict]:
    """All rules in order: each family is looked for by its bare name, in a grant and in an SPDX-like tag."""
    out = []

    def add(label, keyword, pattern, priority):
        out.append({"rank": len(out), "label": label, "keyword": keyword, "priority": priority,
                    "pattern": f"(?<= ){pattern}(?= )"})

    for label, keyword, pattern in NOTICES:
        add(label, keyword, pattern, 1)
    for label, keyword, name in FAMILIES:
        add(label, keyword, f"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}", 2)
        add(label, keyword, name, 2)
    for label in dict.fromkeys(x[0] for x in FAMILIES):
        add(label, "spdx", f"spdx licen[cs]e identifier {label.replace('-', ' ').replace('.', ' ')}(?: only| or later)?", 2)
    for label, keyword, pattern in GENERIC:
        add(label, keyword, pattern, 3)
    return out


_RULE = "array<struct<rank:int,label:string,keyword:string,priority:int,pattern:string>>"
# Java form of the separators [\x00-\x2F\x3A-\x60\x7B-\x7F] before A-Z are lower-cased (so A-Z belong to words).
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _blanks(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("bigint")


def _places(norm: Column, phrase: str) -> Column:
    """Struct of the places of a base phrase: number, first and last starting word."""
    k = phrase.count(" ") + 1
    parts = F.split(norm, f"(?<= ){phrase}(?= )", -1)
    n = (F.size(parts) - 1).cast("bigint")
    first = F.when(n > 0, _blanks(F.element_at(parts, 1)) - 1)
    last = F.when(n > 0, _blanks(norm) - 1 - (_blanks(F.element_at(parts, -1)) - 1) - k)
    return F.struct(n.alias("n"), first.alias("first"), last.alias("last"))


CHUNK = 256  # entries of an array that are accumulated one by one


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambda bodies would compute what they name again for every entry."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, zero: Column, kind: str, merge) -> Column:
    """For every entry of an array the merged entries before it.  Chunks are accumulated one by one and then shifted by what
    stands before them, so that the work grows with the entries and not with their square."""
    none = F.expr(f"cast(array() as array<{kind}>)")
    begin = F.expr("cast(array() as array<int>)")

    def scan(xs):
        return F.aggregate(xs, F.struct(zero.alias("at"), none.alias("out")), lambda acc, x: F.struct(
            merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def chunks(v):
        first = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(CHUNK))).otherwise(begin)
        return F.transform(first, lambda i: scan(F.slice(v, i, F.lit(CHUNK))))

    def shifted(cs):
        shifts = scan(F.transform(cs, lambda c: c["at"]))["out"]
        return F.flatten(F.zip_with(cs, shifts, lambda c, s: F.transform(c["out"], lambda x: merge(s, x))))

    return _let(_let(values, chunks), shifted)


def _intervals(norm: Column, rule: Column) -> Column:
    """All matches of one rule as (start, -stop, priority, rank, label), in character offsets."""
    found = F.transform(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)), F.length)
    before = F.transform(F.split(norm, rule["pattern"], -1), F.length)
    sizes = F.filter(F.zip_with(before, found, lambda b, f: F.struct(b.alias("before"), f.alias("found"))), lambda x: x["found"].isNotNull())

    def placed(xs):
        ends = _running(F.transform(xs, lambda x: x["before"] + x["found"]), F.lit(0), "int", lambda a, b: a + b)
        return F.zip_with(xs, ends, lambda x, at: F.struct(
            (at + x["before"]).alias("start"), (-(at + x["before"] + x["found"])).alias("minus_stop"), rule["priority"].alias("priority"),
            rule["rank"].alias("rank"), rule["label"].alias("label")))

    return _let(sizes, placed)


def _outside(found: Column) -> Column:
    """Drop intervals inside another one of the same or a higher priority (sorted by start, longest first)."""
    def kept(xs):
        stops = F.transform(xs, lambda x: F.struct(*[
            F.when(x["priority"] <= p, -x["minus_stop"]).otherwise(F.lit(-1)).alias(f"s{p}") for p in (1, 2, 3)]))
        reach = _running(stops, F.struct(*[F.lit(-1).alias(f"s{p}") for p in (1, 2, 3)]), "struct<s1:int,s2:int,s3:int>",
                         lambda a, b: F.struct(*[F.greatest(a[f"s{p}"], b[f"s{p}"]).alias(f"s{p}") for p in (1, 2, 3)]))
        out = F.zip_with(xs, reach, lambda x, r: F.when(-x["minus_stop"] > F.when(x["priority"] == 1, r["s1"]).when(
            x["priority"] == 2, r["s2"]).otherwise(r["s3"]), x))
        return F.filter(out, lambda x: x.isNotNull())

    return _let(F.array_sort(found), kept)


def _not_spanning(found: Column) -> Column:
    """Drop generic mentions that span a detection of a higher priority; gives (label, priority) pairs."""
    none = F.expr("cast(array() as array<struct<label:string,priority:int>>)")
    by_stop = F.array_sort(F.transform(found, lambda x: F.struct(
        (-x["minus_stop"]).alias("stop"), x["priority"].alias("priority"), x["start"].alias("start"), x["label"].alias("label"))))

    def step(acc, x):
        keep = (x["priority"] < 3) | (acc["start"] < x["start"])
        return F.struct(F.when(x["priority"] < 3, F.greatest(acc["start"], x["start"])).otherwise(acc["start"]).alias("start"),
                        F.when(keep, F.array_union(acc["out"], F.array(F.struct(x["label"].alias("label"), x["priority"].alias("priority")))))
                        .otherwise(acc["out"]).alias("out"))

    return F.aggregate(by_stop, F.struct(F.lit(-1).alias("start"), none.alias("out")), step, lambda a: a["out"])


OUTPUTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus n_words, n_base, first_word, last_word, base_labels, labels (comma-joined, sorted), score.

    Columns of ``df`` are kept; an output whose name is taken gets a number after its name."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    made = [fresh(df, x) for x in OUTPUTS]
    norm, hit, base, det = (fresh(df, x) for x in ("_norm", "_hit", "_base", "_det"))
    n_words, n_base, first_word, last_word, base_labels, labels, score = made
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), _SEPARATORS, " ")), F.lit(" "))
    d = df.withColumn(norm, words)
    d = d.withColumn(n_words, F.when(F.length(norm) > 2, _blanks(F.col(norm)) - 1).otherwise(F.lit(0).cast("bigint")))
    gate = F.lower(F.col(norm)).rlike("|".join(GATES))
    d = d.withColumn(norm, F.when(gate, F.translate(F.col(norm), _UPPER, _LOWER)))
    places = F.array(*[_places(F.col(norm), p) for p in BASE])
    d = d.withColumn(base, F.when(F.col(norm).contains("license"), places))
    table_of_rules = F.from_json(F.lit(json.dumps(rules())), _RULE)
    hits = F.flatten(F.transform(F.filter(table_of_rules, lambda r: F.contains(F.col(norm), r["keyword"])),
                                 lambda r: _intervals(F.col(norm), r)))
    d = d.withColumn(hit, F.when(F.col(norm).isNotNull(), hits))
    d = d.withColumn(det, F.when(F.size(hit) > 0, _not_spanning(_outside(F.col(hit)))))
    zero = F.lit(0).cast("bigint")
    d = d.withColumn(n_base, F.coalesce(F.aggregate(F.col(base), zero, lambda a, x: a + x["n"]), zero))
    d = d.withColumn(first_word, F.array_min(F.transform(F.col(base), lambda x: x["first"])))
    d = d.withColumn(last_word, F.array_max(F.transform(F.col(base), lambda x: x["last"])))
    of_base = F.filter(F.array(*[F.when(F.col(base)[i]["n"] > 0, F.lit(l)) for i, l in enumerate(BASE.values())]), lambda x: x.isNotNull())
    none = F.expr("cast(array() as array<string>)")
    d = d.withColumn(base_labels, F.concat_ws(",", F.array_sort(of_base)))
    of_det = F.coalesce(F.transform(F.col(det), lambda x: x["label"]), none)
    d = d.withColumn(labels, F.concat_ws(",", F.array_sort(F.array_union(of_base, of_det))))
    best = F.array_min(F.transform(F.col(det), lambda x: x["priority"]))
    sure = F.lit(0.0)
    for p, v in sorted(CONFIDENCE.items(), reverse=True):
        sure = F.when(best == p, F.lit(v)).otherwise(sure)
    d = d.withColumn(score, F.greatest(sure, F.when(F.col(n_base) > 0, F.lit(CONFIDENCE[2])).otherwise(F.lit(0.0))))
    return d.select(*kept, *made)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


# The columns that SQL can express (the method's own labels and score cannot): checked against op9_license_scan in tests.
BASE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n_words,
  list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'mit' AND ws[i + 1] = 'license') AS mit,
  list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'apache' AND ws[i + 1] = 'license') AS apache,
  list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license') AS gpl FROM w)
SELECT doc_id, n_words, len(mit) + len(apache) + len(gpl) AS n_base,
  list_min(list_concat(mit, apache, gpl)) - 1 AS first_word, list_max(list_concat(mit, apache, gpl)) - 1 AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM p
"""
