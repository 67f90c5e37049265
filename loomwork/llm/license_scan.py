"""Operator 9, license scans by diagonal voting, with DataFrame functions only.

All rolling word k-gram hashes of a document are joined to the positions of the
license templates. Hits vote for a diagonal (document position less template
position); diagonals closer than ``gap`` are merged, since an inserted or lost
word moves the rest of a license by one. A merged span is verified: its grams
are compared word for word with the template's, and the share of the template's
words that they cover is the span's score.

The templates are a fixed list, so their grams are few (a few thousand words in
all); what looks them up is one set in the plan, whatever the corpus.

Defined results: null or empty text has no words, no labels and score 0. Every
input row gives one output row, rows that are equal or have no id included.
Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, texts, windows, words

# Base phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Public license notices, and whole texts of the short licenses, by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "this project is released under the terms of the mit license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc", "licensed under cc by 4 0"),
    ("cc", "licensed under cc by sa 4 0"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "licensed under cc by nc nd 4 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
]

#: What separates words: all ASCII but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM, GAP, MIN_SCORE = 4, 3, 0.6


def template_grams(spark, templates=TEMPLATES, gram: int = GRAM) -> DataFrame:
    """(hash, template, label, t_pos, t_gram, t_words): one row per k-gram of the fixed templates."""
    rows = [
        F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"))
        for i, (label, text) in enumerate(templates)
    ]
    tokens = (
        spark.range(1)
        .select(F.inline(F.array(*rows)))
        .select("template", "label", words(F.col("text"), NOT_WORD).alias("t"))
    )
    return tokens.select(
        "template",
        "label",
        F.size("t").alias("t_words"),
        F.explode(
            windows(F.col("t"), gram, lambda s, i: F.struct(F.xxhash64(s).alias("h"), i.alias("p"), s.alias("g")))
        ).alias("x"),
    ).select("template", "label", "t_words", F.col("x.h").alias("hash"), F.col("x.p").alias("t_pos"), F.col("x.g").alias("t_gram"))


def stands(parts: list[str]):
    """A predicate on a position: the words ``parts`` stand there."""

    def here(i):
        same = F.lit(True)
        for k, part in enumerate(parts):
            same = same & F.coalesce(F.get("w", i + k) == part, F.lit(False))
        return same

    return here


def scan(
    docs: DataFrame, templates=TEMPLATES, gram: int = GRAM, gap: int = GAP, min_score: float = MIN_SCORE
) -> DataFrame:
    """Documents with their base figures, and one row for each verified license span (span columns null if none).

    Columns: row (a number of the input row), doc_id, n_words, n_base, first_word, last_word, base, template,
    label, first, last (words from 0, inclusive), score.
    """
    known = template_grams(docs.sparkSession, templates, gram)
    # The templates are a short fixed list, so their hashes are few however many documents there are.
    # Looking a hash up before it leaves its row keeps the join to grams that some template has.
    hashes = [r.hash for r in known.select("hash").distinct().collect()]
    none = F.array().cast("array<int>")
    tokens = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", words(ascii_lower(F.col("text")), NOT_WORD).alias("w"))
    places, labels = [], []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")

        at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), stands(parts))
        places.append(F.when(F.array_contains("w", parts[-1]), at).otherwise(none))
        labels.append(label)
    found = tokens.select("row", "doc_id", "w", *[p.alias(f"at{k}") for k, p in enumerate(places)])
    every = F.concat(*[F.col(f"at{k}") for k in range(len(places))])
    base = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(x)) for k, x in enumerate(labels)]))
    grams = windows(
        F.col("w"), gram, lambda s, i: F.struct(F.xxhash64(s).alias("hash"), i.alias("pos"), s.alias("gram"))
    )
    rows = found.select(
        "row",
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"),
        F.filter(grams, lambda x: x["hash"].isin(hashes)).alias("grams"),
    )
    keys = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    hits = (
        rows.select(*keys, F.explode_outer("grams").alias("x"))
        .select(*keys, F.col("x.hash").alias("hash"), F.col("x.pos").alias("pos"), F.col("x.gram").alias("gram"))
        .join(F.broadcast(known.withColumnRenamed("hash", "t_hash")), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
    )
    # One row per diagonal before the window, so that its partition is bounded by a
    # document's diagonals for one template.
    diagonals = (
        hits.withColumn("diagonal", F.col("pos") - F.col("t_pos"))
        .groupBy(*keys, "template", "label", "t_words", "diagonal")
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("t_pos").alias("t_pos"))
    )
    order = Window.partitionBy(*keys, "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True))
    merged = diagonals.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(order))
    covered = F.array_distinct(
        F.flatten(F.transform(F.flatten(F.collect_list("t_pos")), lambda p: F.sequence(p, p + F.lit(gram - 1))))
    )
    scored = merged.groupBy(*keys, "template", "label", "t_words", "span").agg(
        F.min("first").alias("first"), (F.max("last") + gram - 1).alias("last"), F.size(covered).alias("n")
    )
    score = F.col("n") / F.col("t_words")
    good = score >= min_score
    return scored.select(
        *keys,
        *[F.when(good, F.col(c)).alias(c) for c in ("template", "label", "first", "last")],
        F.when(good, F.least(score, F.lit(1.0))).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    """One row per document with its base figures, labels and best score."""
    rows = scan(docs).groupBy("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").agg(
        F.collect_set("label").alias("more"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score")
    )
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        "score",
    )


def sql() -> str:
    """The query for DuckDB, over the view ``documents``."""
    templates = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    return rf"""
with w as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
ph as (select string_split(p, ' ') as p, label from (values {phrases}) v(p, label)),
e as (select doc_id, unnest(w) as w0, unnest(range(0, len(w))) as i from w),
f as (select doc_id, i, w0, lead(w0, 1) over o as w1, lead(w0, 2) over o as w2, lead(w0, 3) over o as w3
  from e window o as (partition by doc_id order by i)),
b as (select distinct doc_id, i, label from f join ph on p[1] = w0 and p[2] = w1 and (len(p) = 2 or p[3] = w2)),
bb as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word,
  list_sort(list_distinct(list(label))) as base from b group by doc_id),
t as (select t, label, string_split(x, ' ') as x from (values {templates}) v(t, label, x)),
g as (select t, label, len(x) as n, unnest(range(0, len(x) - {GRAM - 1})) as tp, x from t),
gg as (select t, label, n, tp, list_slice(x, tp + 1, tp + {GRAM}) as g from g),
h as (select doc_id, t, label, n, i as pos, tp, i - tp as d from f join gg on g[1] = w0 and g[2] = w1 and g[3] = w2 and g[4] = w3),
d as (select doc_id, t, label, n, d from h group by all),
s as (select *, sum(new) over (partition by doc_id, t order by d) as span from
  (select *, case when d - lag(d) over (partition by doc_id, t order by d) > {GAP} then 1 when lag(d) over (partition by doc_id, t order by d) is null then 1 else 0 end as new from d)),
c as (select distinct s.doc_id, s.t, s.label, s.n, s.span, h.tp + k.k as covered
  from s join h on s.doc_id = h.doc_id and s.t = h.t and s.d = h.d cross join range(0, {GRAM}) k(k)),
v as (select doc_id, label, least(count(*) / n, 1.0) as score from c group by doc_id, t, label, n, span having count(*) / n >= {MIN_SCORE}),
vv as (select doc_id, list(distinct label) as more, max(score) as score from v group by doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base,
  cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(array_to_string(base, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') as labels,
  cast(coalesce(score, 0) as double) as score
from w left join bb using (doc_id) left join vv using (doc_id)"""
