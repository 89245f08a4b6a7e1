"""License scans with DataFrame functions only: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words: ASCII except letters and digits.
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Label and words of the base phrases.
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

#: Rules by hand, in order: label, signature over words joined by blanks.
RULES = [
    # the GNU family
    ("gpl", "gnu general public licen[cs]e"), ("gpl-1.0", "gnu general public licen[cs]e (?:version |v )?1(?: 0)?"), ("gpl-2.0", "gnu general public licen[cs]e (?:version |v )?2(?: 0)?"), ("gpl-3.0", "gnu general public licen[cs]e (?:version |v )?3(?: 0)?"),
    ("gpl-2.0-or-later", "gnu general public licen[cs]e (?:version |v )?2(?: 0)? or (?:any )?later"), ("gpl-3.0-or-later", "gnu general public licen[cs]e (?:version |v )?3(?: 0)? or (?:any )?later"), ("gpl-2.0", "gplv2"), ("gpl-3.0", "gplv3"), ("gpl-2.0", "gpl (?:v |version )?2(?: 0)?"), ("gpl-3.0", "gpl (?:v |version )?3(?: 0)?"),
    ("gpl-2.0-only", "gpl 2 0 only"), ("gpl-3.0-only", "gpl 3 0 only"), ("gpl-2.0-or-later", "gpl 2 0 or later"), ("gpl-3.0-or-later", "gpl 3 0 or later"), ("gpl", "gnu gpl"), ("gpl", "gnu public licen[cs]e"), ("gpl-linking-exception", "classpath exception"), ("gcc-exception", "gcc runtime library exception"),
    ("gpl-or-later", "either version [23] of the licen[cs]e or at your option any later version"), ("gpl-notice", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "gnu lesser general public licen[cs]e"), ("lgpl-2.1", "gnu lesser general public licen[cs]e (?:version |v )?2 1"), ("lgpl-3.0", "gnu lesser general public licen[cs]e (?:version |v )?3(?: 0)?"), ("lgpl-2.0", "gnu library general public licen[cs]e"), ("lgpl", "gnu lgpl"), ("lgpl", "lesser general public licen[cs]e"), ("lgpl-2.1", "lgpl ?v?2 1"), ("lgpl-3.0", "lgpl ?v?3(?: 0)?"), ("lgpl-2.1-or-later", "lgpl 2 1 or later"), ("lgpl-3.0-or-later", "lgpl 3 0 or later"),
    ("agpl", "gnu affero general public licen[cs]e"), ("agpl", "affero general public licen[cs]e"), ("agpl-1.0", "affero general public licen[cs]e (?:version |v )?1(?: 0)?"), ("agpl-3.0", "gnu affero general public licen[cs]e (?:version |v )?3(?: 0)?"), ("agpl-3.0", "agpl ?v?3(?: 0)?"), ("agpl-3.0-or-later", "agpl 3 0 or later"), ("agpl", "gnu agpl"),
    ("gfdl", "gnu free documentation licen[cs]e"), ("gfdl-1.1", "gnu free documentation licen[cs]e version 1 1"), ("gfdl-1.2", "gnu free documentation licen[cs]e version 1 2"), ("gfdl-1.3", "gnu free documentation licen[cs]e version 1 3"), ("gfdl", "gfdl(?: 1 [123])?"), ("gnu-all-permissive", "copying and distribution of this file with or without modification are permitted in any medium"),
    # Apache
    ("apache", "apache licen[cs]e"), ("apache-2.0", "apache licen[cs]e version 2(?: 0)?"), ("apache-2.0", "apache licen[cs]e 2(?: 0)?"), ("apache-1.1", "apache software licen[cs]e (?:version )?1 1"), ("apache-1.0", "apache (?:software )?licen[cs]e (?:version )?1 0"), ("apache", "apache software licen[cs]e"), ("apache-2.0", "apache 2 0"), ("apache-2.0", "apache licen[cs]e org licen[cs]es licen[cs]e 2 0"), ("llvm-exception", "llvm exceptions?"),
    # MIT and kin
    ("mit", "mit licen[cs]e"), ("mit", "permission is hereby granted free of charge to any person obtaining a copy"), ("mit-0", "mit no attribution"), ("mit-0", "mit 0"), ("mit", "expat licen[cs]e"), ("mit-modern", "mit modern variant"), ("x11", "x11 licen[cs]e"), ("x11", "x consortium licen[cs]e"), ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies"), ("mit-warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("isc", "isc licen[cs]e"), ("isc", "permission to use copy modify and or distribute this software for any purpose"), ("isc", "permission to use copy modify and distribute this software for any purpose"), ("hpnd", "historical permission notice and disclaimer"), ("ntp", "ntp licen[cs]e"), ("curl", "curl licen[cs]e"), ("icu", "icu licen[cs]e"), ("unicode", "unicode licen[cs]e(?: agreement)?"), ("unicode-3.0", "unicode licen[cs]e v3"), ("tcl", "tcl(?: tk)? licen[cs]e"), ("fair", "fair licen[cs]e"), ("beerware", "beer ?ware licen[cs]e"), ("blue-oak-1.0.0", "blue oak model licen[cs]e(?: 1 0 0)?"),
    # BSD
    ("bsd", "bsd licen[cs]e"), ("bsd-1-clause", "bsd 1 clause"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-2-clause", "simplified bsd licen[cs]e"), ("bsd-2-clause", "freebsd licen[cs]e"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-3-clause", "new bsd licen[cs]e"), ("bsd-3-clause", "modified bsd licen[cs]e"), ("bsd-3-clause", "revised bsd licen[cs]e"), ("bsd-4-clause", "bsd 4 clause"), ("bsd-4-clause", "original bsd licen[cs]e"), ("bsd-3-clause-clear", "clear bsd licen[cs]e"), ("bsd-protection", "bsd protection licen[cs]e"), ("bsd-2-clause-patent", "bsd 2 clause (?:plus )?patent"), ("bsd", "berkeley software distribution licen[cs]e"), ("0bsd", "0bsd"), ("0bsd", "zero clause bsd"), ("bsd", "three clause bsd"), ("bsd", "two clause bsd"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"), ("bsd-attribution", "redistributions in binary form must reproduce the above copyright notice"), ("bsd-source", "redistributions of source code must retain the above copyright notice"), ("bsd-3-clause", "neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors"), ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    # Mozilla, Eclipse, Sun and other weak copyleft
    ("mpl", "mozilla public licen[cs]e"), ("mpl-1.0", "mozilla public licen[cs]e (?:version |v )?1 0"), ("mpl-1.1", "mozilla public licen[cs]e (?:version |v )?1 1"), ("mpl-2.0", "mozilla public licen[cs]e (?:version |v )?2 0"), ("mpl-1.1", "mpl (?:v )?1 1"), ("mpl-2.0", "mpl (?:v )?2 0"), ("npl-1.1", "netscape public licen[cs]e"), ("epl", "eclipse public licen[cs]e"), ("epl-1.0", "eclipse public licen[cs]e (?:version |v )?1 0"), ("epl-2.0", "eclipse public licen[cs]e (?:version |v )?2 0"), ("epl-1.0", "epl (?:v )?1 0"), ("epl-2.0", "epl (?:v )?2 0"), ("bsd-3-clause", "eclipse distribution licen[cs]e"),
    ("cddl", "cddl"), ("cddl-1.0", "cddl (?:v )?1 0"), ("cddl-1.1", "cddl (?:v )?1 1"), ("cddl", "common development and distribution licen[cs]e"), ("cpl-1.0", "common public licen[cs]e"), ("cpal-1.0", "common public attribution licen[cs]e"), ("ipl-1.0", "ibm public licen[cs]e"), ("eupl", "eupl"), ("eupl-1.1", "eupl (?:v )?1 1"), ("eupl-1.2", "eupl (?:v )?1 2"), ("eupl", "european union public licen[cs]e"), ("spl-1.0", "sun public licen[cs]e"), ("sissl", "sun industry standards source licen[cs]e"), ("apsl-2.0", "apple public source licen[cs]e"), ("ms-pl", "microsoft public licen[cs]e"), ("ms-rl", "microsoft reciprocal licen[cs]e"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"),
    ("cecill", "cecill"), ("cecill-2.1", "cecill (?:v )?2 1"), ("cecill-b", "cecill b"), ("cecill-c", "cecill c"), ("osl-3.0", "open software licen[cs]e(?: (?:v )?3 0)?"), ("afl-3.0", "academic free licen[cs]e(?: (?:v )?3 0)?"), ("nposl-3.0", "non profit open software licen[cs]e"), ("rpl-1.5", "reciprocal public licen[cs]e"), ("qpl-1.0", "q public licen[cs]e"), ("lppl", "latex project public licen[cs]e"), ("lppl-1.3c", "lppl 1 3c"), ("ecl-2.0", "educational community licen[cs]e"), ("mulan-psl-2.0", "mulan psl v2"), ("mulan-psl", "mulan permissive software licen[cs]e"), ("erlpl-1.1", "erlang public licen[cs]e"), ("ngpl", "nethack general public licen[cs]e"), ("watcom-1.0", "sybase open watcom public licen[cs]e"), ("upl-1.0", "universal permissive licen[cs]e"), ("motosoto", "motosoto open source licen[cs]e"), ("nokia", "nokia open source licen[cs]e"), ("catosl-1.1", "computer associates trusted open source licen[cs]e"),
    # Creative Commons
    ("cc-by", "cc by"), ("cc-by-1.0", "cc by 1 0"), ("cc-by-2.0", "cc by 2 0"), ("cc-by-2.5", "cc by 2 5"), ("cc-by-3.0", "cc by 3 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-sa", "cc by sa"), ("cc-by-sa-2.0", "cc by sa 2 0"), ("cc-by-sa-2.5", "cc by sa 2 5"), ("cc-by-sa-3.0", "cc by sa 3 0"), ("cc-by-sa-4.0", "cc by sa 4 0"), ("cc-by-nc", "cc by nc"), ("cc-by-nc-2.0", "cc by nc 2 0"), ("cc-by-nc-3.0", "cc by nc 3 0"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-nd", "cc by nd"), ("cc-by-nd-3.0", "cc by nd 3 0"), ("cc-by-nd-4.0", "cc by nd 4 0"), ("cc-by-nc-sa", "cc by nc sa"), ("cc-by-nc-sa-3.0", "cc by nc sa 3 0"), ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"), ("cc-by-nc-nd", "cc by nc nd"), ("cc-by-nc-nd-3.0", "cc by nc nd 3 0"), ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("cc0-1.0", "cc0"), ("cc0-1.0", "cc0 1 0(?: universal)?"), ("cc0-1.0", "no rights reserved"), ("cc-pdm-1.0", "public domain mark(?: 1 0)?"), ("cc", "creative commons"), ("cc-by", "creative commons attribution"), ("cc-by-4.0", "creative commons attribution 4 0(?: international)?"), ("cc-by-3.0", "creative commons attribution 3 0(?: unported)?"), ("cc-by-sa", "creative commons attribution share ?alike"), ("cc-by-sa-4.0", "creative commons attribution share ?alike 4 0(?: international)?"), ("cc-by-sa-3.0", "creative commons attribution share ?alike 3 0(?: unported)?"), ("cc-by-nc", "creative commons attribution non ?commercial"), ("cc-by-nc-4.0", "creative commons attribution non ?commercial 4 0(?: international)?"), ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?"), ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"), ("cc-zero", "creative commons zero"), ("cc-url", "creativecommons org licen[cs]es by"), ("cc0-1.0", "creativecommons org publicdomain zero"),
    # data and documents
    ("odbl-1.0", "open database licen[cs]e"), ("odbl-1.0", "odbl"), ("odc-by-1.0", "open data commons attribution licen[cs]e"), ("pddl-1.0", "public domain dedication and licen[cs]e"), ("ogl-uk-3.0", "open government licen[cs]e"), ("cdla-permissive", "community data licen[cs]e agreement permissive"), ("cdla-sharing", "community data licen[cs]e agreement sharing"), ("dl-de-by-2.0", "data licen[cs]e germany attribution"), ("opl-1.0", "open publication licen[cs]e"), ("ocl", "open content licen[cs]e"), ("fdl-freebsd", "freebsd documentation licen[cs]e"),
    # public domain and the like
    ("unlicense", "unlicense"), ("unlicense", "free and unencumbered software released into the public domain"), ("public-domain", "public domain"), ("public-domain", "placed in(?:to)? the public domain"), ("wtfpl", "wtfpl"), ("wtfpl", "do what the fuck you want to public licen[cs]e"), ("sax-pd", "sax public domain notice"),
    # single projects
    ("zlib", "zlib licen[cs]e"), ("zlib", "zlib libpng licen[cs]e"), ("libpng", "libpng licen[cs]e"), ("libtiff", "libtiff licen[cs]e"), ("ijg", "independent jpeg group licen[cs]e"), ("bsl-1.0", "boost software licen[cs]e(?: version 1 0| 1 0)?"), ("artistic", "artistic licen[cs]e"), ("artistic-1.0", "artistic licen[cs]e 1 0"), ("artistic-2.0", "artistic licen[cs]e 2 0"), ("clartistic", "clarified artistic licen[cs]e"), ("perl", "same terms as perl itself"), ("python-2.0", "python software foundation licen[cs]e"), ("psf", "psf licen[cs]e"), ("cnri-python", "cnri python licen[cs]e"), ("zpl-2.1", "zope public licen[cs]e"), ("php-3.01", "php licen[cs]e(?: version 3 01)?"), ("zend-2.0", "zend (?:engine )?licen[cs]e"), ("ruby", "ruby licen[cs]e"), ("openssl", "openssl licen[cs]e"), ("ssleay", "ssleay licen[cs]e"), ("postgresql", "postgresql licen[cs]e"), ("sleepycat", "sleepycat licen[cs]e"), ("vim", "vim licen[cs]e"), ("w3c", "w3c software (?:notice and )?licen[cs]e"), ("ncsa", "ncsa open source licen[cs]e"), ("ncsa", "university of illinois ncsa"), ("intel", "intel open source licen[cs]e"), ("xfree86-1.1", "xfree86 licen[cs]e"), ("ftl", "freetype (?:project )?licen[cs]e"), ("imagemagick", "imagemagick licen[cs]e"), ("gl2ps", "gl2ps licen[cs]e"), ("nasa-1.3", "nasa open source agreement"), ("ofl-1.1", "sil open font licen[cs]e(?: version 1 1)?"), ("ofl-1.1", "open font licen[cs]e(?: version 1 1)?"), ("ubuntu-font-1.0", "ubuntu font licen[cs]e"), ("bitstream-vera", "bitstream vera (?:fonts )?(?:copyright|licen[cs]e)"),
    # restricted
    ("sspl-1.0", "server side public licen[cs]e"), ("sspl-1.0", "sspl"), ("busl-1.1", "business source licen[cs]e"), ("elastic-2.0", "elastic licen[cs]e(?: 2 0)?"), ("commons-clause", "commons clause"), ("polyform-noncommercial-1.0.0", "polyform noncommercial licen[cs]e"), ("polyform-small-business-1.0.0", "polyform small business licen[cs]e"), ("confluent-community-1.0", "confluent community licen[cs]e"), ("openrail", "openrail(?: m)?"), ("llama-community", "llama [0-9]+ community licen[cs]e"), ("hippocratic", "hippocratic licen[cs]e"), ("json", "shall be used for good not evil"), ("aladdin", "aladdin free public licen[cs]e"), ("proprietary", "proprietary and confidential"), ("all-rights-reserved", "all rights reserved"), ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
]
#: Notices that raise a name to a license statement: words before it, first letters by which the match is told, priority and confidence.
NOTICES = [("spdx licen[cs]e identifier", "spdx", 3, 1.0), ("licen[cs]ed under(?: the)?(?: terms of(?: the)?)?", "licen", 2, 1.0), ("(?:released|distributed|available|published) under(?: the)?(?: terms of(?: the)?)?", "", 2, 0.95)]

#: A word of the tagged text is followed by this and its number.
TAG = "#"


def signature(name: str, notice: bool = True) -> str:
    """A rule's pattern over words joined by blanks, behind any of the notices."""
    return "(?:(?:" + "|".join(n for n, _, _, _ in NOTICES) + ") )?" + name if notice else name


def tagged(pattern: str) -> str:
    """The same pattern over the tagged text, in which each word has its number behind it."""
    number = TAG + "[0-9]+"
    blank = re.sub(r" \?", f"(?:{number} )?", pattern).replace(" ", "\0")
    blank = re.sub(r"\(\?:" + re.escape(number) + "\0" + r"\)\?", f"(?:{number} )?", blank).replace("[^\0]+", f"[^ {TAG}]+")
    return f"(?<= ){blank.replace(chr(0), number + ' ')}{number}(?= )"


def trie(words: list[str]) -> str:
    """A pattern for any of the words that tries each letter once."""
    if "" in words:
        return ""  # a shorter word covers those that it begins
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + trie(rest) for c, rest in sorted(by.items())]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def keyword(name: str) -> str:
    """The letters and blanks that each match of a signature begins with."""
    plain = re.match(r"[a-z0-9 ]*", name)[0]
    return plain[:-1] if name[len(plain) :].startswith("?") else plain


KEYWORDS = [keyword(name) for _, name in RULES]
#: Some word of a text, and what follows it, must begin like this for any rule to match.
GATE = " " + trie(sorted(set(KEYWORDS)))
#: Detections are looked through in chunks of this size, so that no array grows one by one.
CHUNK = 32


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str) -> str:
    """SQL for the word ranges of a pattern's matches in the tagged text: numbers of the first and the last word, and the text."""
    return f"transform(regexp_extract_all(marked, {pattern}, 0), m -> named_struct('first', cast(substring_index(substring_index(m, ' ', 1), '{TAG}', -1) as int), 'last', cast(substring_index(m, '{TAG}', -1) as int), 'match', m))"


def _contained() -> str:
    """SQL that drops detections within others, of `dets` sorted by start and then by the longest: one lies within an earlier one of its
    priority or above if it ends no later than the furthest end so far. Chunks first give their furthest ends, by priority."""
    ends = [f"array_max(transform(c, d -> if(d.above <= -{p}, -d.rest, -1)))" for p in (1, 2, 3)]
    empty = "cast(array() as array<struct<first:int,rest:int,above:int,n:int,label:string,confidence:double>>)"
    chunks = f"transform(sequence(0, (size(dets) - 1) div {CHUNK}), i -> slice(dets, i * {CHUNK} + 1, {CHUNK}))"
    tops = f"transform(chunks, c -> named_struct('f1', {ends[0]}, 'f2', {ends[1]}, 'f3', {ends[2]}))"
    higher = lambda a, b: "named_struct(" + ", ".join(f"'f{p}', greatest({a}.f{p}, {b}.f{p})" for p in (1, 2, 3)) + ")"
    start = "named_struct('f1', -1, 'f2', -1, 'f3', -1)"
    before = f"aggregate(tops, named_struct('now', {start}, 'out', cast(array() as array<struct<f1:int,f2:int,f3:int>>)), (acc, t) -> named_struct('now', {higher('acc.now', 't')}, 'out', array_append(acc.out, acc.now)), acc -> acc.out)"
    own = "named_struct('f1', -d.rest, 'f2', if(d.above <= -2, -d.rest, -1), 'f3', if(d.above <= -3, -d.rest, -1))"
    far = "CASE d.above WHEN -1 THEN acc.now.f1 WHEN -2 THEN acc.now.f2 ELSE acc.now.f3 END"
    kept = f"aggregate(c, named_struct('now', b, 'out', {empty}), (acc, d) -> named_struct('now', {higher('acc.now', own)}, 'out', if({far} >= -d.rest, acc.out, array_append(acc.out, d))), acc -> acc.out)"
    return chunks, tops, before, f"flatten(zip_with(chunks, before, (c, b) -> {kept}))"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: the id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    One projection without a shuffle and without Python, and in proportion to the text. Words get their numbers in a text that passes the gate;
    of the rules only those are matched whose keyword, the plain beginning of the signature, it holds. Of two detections of which one lies within
    the other, the lower priority goes (at equal priority the shorter, then the one by the later rule); base labels always
    stay. `score` is the largest confidence of what is left, 0 without any; `detections` are its labels with word positions.

    A null, empty or wordless text has no words and no labels; a null id stays null; repeated rows give repeated results;
    an empty table gives none; other columns are ignored, whatever their names.
    """
    text: Column = F.concat(F.lit(" "), F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(" "))
    # no letter beyond ASCII lower-cases to one that a base phrase has, so lower() is as good as A-Z alone
    flat = docs.select(F.col(id_col).alias("id"), F.lower(F.regexp_replace(text, _SEPARATOR + "+", " ")).alias("flat"))
    words = "filter(split(flat, ' ', -1), w -> w <> '')"
    marked = flat.select("id", (F.length("flat") - F.length(F.replace("flat", F.lit(" "))) - 1).cast("long").alias("n_words"), F.when(F.col("flat").rlike(GATE), F.expr("flat")).alias("flat"))
    marked = marked.withColumn("marked", F.expr(f"if(flat is null, null, concat(' ', array_join(transform({words}, (w, i) -> concat(w, '{TAG}', cast(i as string))), ' '), ' '))"))
    rules = "array(" + ",".join(f"named_struct('n',{i},'label',{_literal(label)},'word',{_literal(' ' + word)},'pattern',{_literal(tagged(signature(name)))})" for i, ((label, name), word) in enumerate(zip(RULES, KEYWORDS, strict=True))) + ")"
    grade = lambda k: "CASE " + " ".join(f"WHEN startswith(m.match, '{start}') THEN {-n[2] if k == 2 else n[3]}{'' if k == 2 else 'D'}" for n in NOTICES[:2] for start in [n[1]]) + f" WHEN rlike(m.match, '^(?:released|distributed|available|published){TAG}') THEN {-NOTICES[2][2] if k == 2 else NOTICES[2][3]}{'' if k == 2 else 'D'} ELSE {'-1' if k == 2 else '0.8D'} END"
    found = f"flatten(transform(filter({rules}, r -> contains(flat, r.word)), r -> transform({_matches('r.pattern')}, m -> named_struct('first', m.first, 'rest', -m.last, 'above', {grade(2)}, 'n', r.n, 'label', r.label, 'confidence', {grade(3)}))))"
    base = "flatten(array(" + ",".join(f"transform({_matches(_literal(tagged(phrase)))}, m -> named_struct('at', m.first, 'label', {_literal(label)}))" for label, phrase in BASE.items()) + "))"
    chunks, tops, before, kept = _contained()
    out = marked.withColumn("dets", F.expr(f"if(flat is null, null, array_sort({found}))")).withColumn("base", F.expr(f"if(flat is null or not (contains(flat, ' license ') or contains(flat, ' cc by ')), null, {base})")).drop("flat", "marked")
    some = "if(coalesce(size(dets), 0) <= 0, null, {})"
    for name, expression in (("chunks", chunks), ("tops", tops), ("before", before), ("kept", kept)):
        out = out.withColumn(name, F.expr(some.format(expression)))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.expr("cast(if(base is null, 0, size(base)) as long)").alias("n_base"), F.expr("cast(array_min(transform(base, b -> b.at)) as long)").alias("first_word"), F.expr("cast(array_max(transform(base, b -> b.at)) as long)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(coalesce(transform(base, b -> b.label), array()))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(array_distinct(coalesce(transform(base, b -> b.label), array())), array_distinct(coalesce(transform(kept, d -> d.label), array())))), ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(kept, d -> d.confidence)), if(coalesce(size(base), 0) > 0, 0.8D, 0D))").alias("score"),
        F.expr("coalesce(transform(kept, d -> named_struct('label', d.label, 'first', d.first, 'last', -d.rest)), array())").alias("detections"),
    )
