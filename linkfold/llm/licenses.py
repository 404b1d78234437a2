"""License scans as an exact set-similarity join, in DataFrame functions only.

Base: the places where a phrase's words stand one after the other.

Method: a text's words are cut into overlapping blocks (``2 * span`` words, one every ``span``), so any run of up to ``span + 1``
words lies whole in some block. Longer templates, whole license texts, take blocks two, four, ... times as wide, the
least width that holds them; only texts that hold enough of such a template get wide blocks. Each block is joined with every
template of its width of which it contains the share ``threshold``:

1. Tokens are ordered by how many documents of the whole table hold them, rarest first.
2. Prefix filter: a block that shares ``k`` of a template's ``n`` tokens must hold one of the template's first ``n - k + 1``,
   among the block's own first tokens; the join is on those tokens, with the templates as the small side (their size is a
   parameter). Documents that hold too little of every template as a whole leave the join before blocks are made: a prefix
   index over the templates, on an order known before the pass, says which templates a document has to be counted against.
3. Length filter: the block must hold ``k`` tokens of templates. Positional filter: what follows the shared token on both
   sides must be long enough for ``k``.
4. What is left is verified by the full intersection.

Cases: null text is the empty text (no words); ids may be null or repeated; rows equal in id and text have equal results; without
any place or block the labels are empty strings and the score 0; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.llm.common import stored, texts

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: fixed values: the phrases of the contract
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: fixed values: public license notices, by label
TEMPLATES = [
    ("agpl-3", "licensed under the GNU Affero General Public License version 3"),
    ("all-rights-reserved", "All rights reserved"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

#: fixed values: public license texts as a whole, by label
BODIES = [
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS "
            "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
            "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
            "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
            "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
            "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
            "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
            "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT "
            "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
            "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
            "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
            "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
TEMPLATES += BODIES


def words_of(text: Column) -> Column:
    """The words, A-Z lower-cased. ``lower`` also maps other letters, which never meet a template's; the two that it would
    turn into ASCII letters (the Kelvin sign, the dotted capital I) send a text to the slower ``translate``."""
    plain = ~(text.contains("\u212a") | text.contains("\u0130"))
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def template_words(text: str) -> list[str]:
    return sorted({w for w in re.findall(WORD, text.lower())})


def _strings(items) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def phrase_starts(words: Column, phrase: str) -> Column:
    """The places (from 0) where the phrase's words stand one after the other."""
    parts = phrase.split()
    def here(i):
        test = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + k) == p)
        return test
    none = F.array().cast("array<int>")
    # a text without one of the words is not walked through
    may = F.array_contains(words, max(parts, key=len)) & (F.size(words) >= len(parts))
    return F.when(may, F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))), here)).otherwise(none)


def template_span(text: str, span: int) -> int:
    """The least of ``span``, ``2 * span``, ``4 * span``, ... of which a block holds every run of the template's length."""
    n = len(re.findall(WORD, text.lower()))
    if not n:
        raise ValueError("a template has no word")
    while n > span + 1:
        span *= 2
    return span


def _needs(templates, threshold: float, span: int) -> list[tuple[str, list[str], int, int]]:
    """``(label, tokens, how many a block must hold, span of its blocks)`` of each template."""
    sets = [(label, template_words(t), template_span(t, span)) for label, t in templates]
    return [(label, tokens, math.ceil(threshold * len(tokens)), wide) for label, tokens, wide in sets]


def prefix_index(needs) -> dict[str, list[int]]:
    """``token -> templates`` (their numbers) that have it in their prefix: all but ``need - 1`` tokens, those of fewer templates first.
    A text that holds ``need`` of a template's tokens holds one of its prefix."""
    uses = Counter(t for _, tokens, *_ in needs for t in tokens)
    index: dict[str, list[int]] = {}
    for k, (_, tokens, need, _) in enumerate(needs):
        for t in sorted(tokens, key=lambda t: (uses[t], t))[:len(tokens) - need + 1]:
            index.setdefault(t, []).append(k)
    return index


def holds_enough(held: str, needs) -> Column:
    """Whether the tokens in ``held`` are enough of any template: only templates are counted that a prefix token leads to."""
    index = prefix_index(needs)
    if not index:
        return F.lit(False)
    templates_of = F.create_map(*[x for t, ks in index.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in ks]))])
    sets, least = F.array(*[_strings(tokens) for _, tokens, *_ in needs]), F.array(*[F.lit(need) for _, _, need, _ in needs])
    found = F.array_distinct(F.flatten(F.transform(F.array_intersect(held, _strings(sorted(index))), lambda t: F.element_at(templates_of, t))))
    return F.exists(found, lambda k: F.size(F.array_intersect(F.col(held), F.get(sets, k))) >= F.get(least, k))


def read_words(docs: DataFrame, phrases, needs) -> DataFrame:
    """One pass over the texts, stored: ``doc_id, doc_hash, n_words, at0, at1, ..`` (places of the phrases), ``held`` (template
    tokens in the text) and ``words``, all of them, of the texts that hold enough of a template as a whole, else null."""
    every = sorted(set().union(*(tokens for _, tokens, *_ in needs))) if needs else []
    src = texts(docs).select("doc_id", F.xxhash64("text").alias("doc_hash"), words_of(F.col("text")).alias("words"))
    src = src.select("*", F.array_intersect("words", _strings(every)).alias("held"))
    return stored(src.select("doc_id", "doc_hash", F.size("words").cast("long").alias("n_words"),
                             *[phrase_starts(F.col("words"), p).alias(f"at{i}") for i, p in enumerate(phrases.values())],
                             "held", F.when(holds_enough("held", needs), F.col("words")).alias("words")), "license-words")


def order_tokens(read: DataFrame, tokens: list[str]) -> list[str]:
    """The templates' tokens by the number of documents that hold them, over the whole table, rarest first; ties by code point."""
    held = read.select(F.explode("held").alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in held.collect()}   # at most one row for each template token
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def matching_blocks(read: DataFrame, needs) -> DataFrame:
    """``doc_id, doc_hash, span, block, label, template, score``: every block that holds enough of a template's tokens.

    ``block`` counts from 0 among those of its width; block ``b`` is the ``2 * span`` words from ``b * span`` on. ``doc_hash`` is the
    text's XXH64.
    """
    order = order_tokens(read, sorted(set().union(*(tokens for _, tokens, *_ in needs))))
    spans = sorted({wide for *_, wide in needs})
    found = [_blocks_of(read, [(k, *n) for k, n in enumerate(needs) if n[3] == span], order, span) for span in spans]
    return functools.reduce(DataFrame.unionByName, found)


def _blocks_of(read: DataFrame, needs, order: list[str], span: int) -> DataFrame:
    """``matching_blocks`` for the templates whose blocks are ``2 * span`` words."""
    order = [t for t in order if any(t in tokens for _, _, tokens, *_ in needs)]
    rank = {t: i for i, t in enumerate(order)}
    least = min(need for _, _, _, need, _ in needs)
    rows = []
    for k, label, tokens, need, _ in needs:
        ranks = sorted(rank[t] for t in tokens)
        rows += [(r, p, k, label, need, ranks) for p, r in enumerate(ranks[:len(ranks) - need + 1])]
    index = read.sparkSession.createDataFrame(
        rows, "token int, _p int, template int, label string, _need int, _ranks array<int>")
    prefix = sorted({order[r[0]] for r in rows})

    ranks_of = F.create_map(*[F.lit(x) for t in order for x in (t, rank[t])])
    near = read.where(F.col("words").isNotNull() & F.arrays_overlap("held", _strings(prefix))
                      & (F.size(F.array_intersect("held", _strings(order))) >= least))
    last = F.floor(F.greatest(F.col("n_words") - span - 1, F.lit(0)) / span).cast("int")
    blocks = (near.select("doc_id", "doc_hash", F.posexplode(F.transform(
                  F.sequence(F.lit(0), last),
                  lambda b: F.array_sort(F.transform(
                      F.array_intersect(F.slice("words", b * span + 1, F.lit(2 * span)), _strings(order)),
                      lambda w: F.element_at(ranks_of, w))))).alias("block", "_held"))
              .where(F.size("_held") >= least))
    size = F.size("_held")
    probes = blocks.select("*", F.posexplode(F.slice("_held", F.lit(1), size - least + 1)).alias("_q", "token"))
    found = (probes.join(F.broadcast(index), "token")
             .where(F.least(F.size("_ranks") - F.col("_p"), size - F.col("_q")) >= F.col("_need"))
             .withColumn("_both", F.size(F.array_intersect("_held", "_ranks")))
             .where("_both >= _need"))
    return found.select("doc_id", "doc_hash", F.lit(span).alias("span"), "block", "label", "template",
                        (F.col("_both") / F.size("_ranks")).alias("score")).distinct()


def scan_licenses(docs: DataFrame, phrases=None, templates=TEMPLATES, threshold: float = 0.9, span: int = 32) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is 1 where a phrase stands, else the greatest share of a template that a block holds, else 0.
    """
    phrases = PHRASES if phrases is None else phrases
    needs = _needs(templates, threshold, span)
    read = read_words(docs, phrases, needs)
    every = F.flatten(F.array(*[F.col(f"at{i}") for i in range(len(phrases))]))
    labels = F.array_compact(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, label in enumerate(phrases)]))
    base = read.select("doc_id", "doc_hash", "n_words", F.size(every).cast("long").alias("n_base"),
                       F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
                       F.array_distinct(labels).alias("_base"))
    more = (matching_blocks(read, needs).groupBy("doc_id", "doc_hash")
            .agg(F.collect_set("label").alias("_more"), F.max("score").alias("_score"))
            .select(F.col("doc_id").alias("_i"), F.col("doc_hash").alias("_h"), "_more", "_score"))
    both = base.join(more, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("doc_hash") == F.col("_h")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"))


def scan_sql(phrases=None, templates=TEMPLATES, threshold: float = 0.9, span: int = 32) -> str:
    """The same result in DuckDB SQL, with every block held against every template."""
    phrases = PHRASES if phrases is None else phrases
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    places = " union all ".join(
        f"select n, i, '{label}' as label from words, unnest(range(len(w))) as r(i) where "
        + " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split(), 1))
        for label, phrase in phrases.items())
    notices = ", ".join(f"('{label}', {quoted(template_words(t))}, {template_span(t, span)})" for label, t in templates)
    blocks = " union all ".join(
        f"select n, {wide} as span, list_intersect(list_distinct(w[b * {wide} + 1 : (b + 2) * {wide}]), every) as held "
        f"from words, tokens, unnest(range(greatest(len(w) - {wide} - 1, 0) // {wide} + 1)) as r(b)"
        for wide in sorted({template_span(t, span) for _, t in templates}))
    every = quoted(sorted({w for _, t in templates for w in template_words(t)}))
    return f"""
        with words as (
            select row_number() over () as n, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') as w
            from documents),
        places as ({places}),
        base as (select n, count(*) as n_base, min(i) as first_word, max(i) as last_word,
                        list(distinct label) as labels from places group by n),
        tokens as (select {every} as every),
        blocks as ({blocks}),
        notices(label, t, span) as (values {notices}),
        shares as (select n, label, len(list_intersect(held, t)) / len(t) as share, len(list_intersect(held, t)) as hits, len(t) as size
                   from blocks join notices using (span) where len(held) > 0),
        more as (select n, list(distinct label) as labels, max(share) as share from shares
                 where hits >= ceil({threshold} * size) group by n)
        select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
               last_word::bigint as last_word,
               array_to_string(list_sort(coalesce(base.labels, [])), ',') as base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') as labels,
               case when n_base > 0 then 1.0::double else coalesce(share, 0)::double end as score
        from words left join base using (n) left join more using (n)
    """
