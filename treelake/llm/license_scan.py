"""License scans by diagonal voting: rolling word k-grams of documents joined with the positions of known notices."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

K = 3
#: Stands before a document's k-grams: a row that meets no notice, by which repeated rows are counted.
MARK = np.int64(0)
#: Diagonals at most so far apart are one alignment (words inserted or left out).
GAP = 4
#: Share of a notice's k-grams that a verified span holds, and most words of a span relative to the notice.
LEAST, STRETCH = 0.6, 1.5

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices of at most 64 k-grams (their positions are bits of a long).
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
]

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case, words of letters, digits and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def grams(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the rolling word K-grams."""
    n = len(words) - K + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for i in range(K):
        out = (out ^ h[i : i + n]) * _STEP
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start word, label) of every place where a base phrase's words stand consecutively."""
    if not words:
        return []
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in BASE.items():
        p = f" {phrase} ".encode()
        at, last, word = joined.find(p), 0, 0
        while at >= 0:
            word += joined.count(b" ", last, at)
            last = at
            out.append((word, label))
            at = joined.find(p, at + 1)
    return sorted(out)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = np.array(sorted({x for _, text in NOTICES for x in grams(words_of(text)).tolist()}), np.int64)
    for f in frames:
        rows = []
        for i, t in zip(f["id"], f["text"]):
            w = words_of(t)
            found, g = phrase_places(w), grams(w)
            met = np.flatnonzero(known[np.searchsorted(known, g).clip(max=len(known) - 1)] == g).tolist()
            rows.append((
                i, xxhash.xxh3_128_digest(b" ".join(w)), len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found})),
                np.concatenate([[MARK], g]), met, [b" ".join(w[k : k + K]).decode("utf-8", "surrogatepass") for k in met],
            ))
        out = pd.DataFrame(rows, columns=["doc_id", "text_key", "n_words", "n_base", "first_word", "last_word", "base_labels", "grams", "met", "words"])
        yield out.astype({"first_word": "Int64", "last_word": "Int64"})


def notice_positions(spark: SparkSession) -> DataFrame:
    """(gram, said, notice, at, size, label): a few hundred rows whatever the corpus; said: the words themselves."""
    rows = []
    for k, (label, text) in enumerate(NOTICES):
        w = words_of(text)
        g = grams(w)
        rows += [(int(x), b" ".join(w[p : p + K]).decode(), k, p, len(g), label) for p, x in enumerate(g)]
    return spark.createDataFrame(rows, "gram long, said string, notice int, at int, size int, label string")


def best_runs(size: int, votes: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
    """(share, lo, hi) of the runs of hits that hold LEAST of a notice within the length allowed, in order, disjoint.

    ``votes``: (diagonal, bits of its positions).  The greatest share is taken first, then the shortest, then the
    earliest run, so a complete copy is never lost to fragments beside it.
    """
    most = max(STRETCH * size, size + 1)
    hits = sorted((d + p, p) for d, bits in votes for p in range(64) if bits >> p & 1)
    runs = []
    for i, (lo, _) in enumerate(hits):
        seen = 0
        for j in range(i, len(hits)):
            hi, p = hits[j]
            if hi - lo + 1 > most:
                break
            if not seen >> p & 1:
                seen |= 1 << p
                if seen.bit_count() / size >= LEAST:
                    runs.append((-seen.bit_count(), hi - lo, lo))
    taken: list[tuple[int, int, float]] = []
    for n, length, lo in sorted(set(runs)):
        at = bisect(taken, (lo,))
        if (at == 0 or taken[at - 1][1] < lo) and (at == len(taken) or taken[at][0] > lo + length):
            taken.insert(at, (lo, lo + length, -n / size))
    return [(share, lo, hi) for lo, hi, share in taken]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("share", T.DoubleType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])))
def _best_runs(size: pd.Series, diagonals: pd.Series, bits: pd.Series) -> pd.Series:
    """``best_runs`` of every row; null where diagonals are."""
    out = [None if d is None else [{"share": s, "lo": lo, "hi": hi} for s, lo, hi in best_runs(int(n), list(zip(map(int, d), map(int, b))))] for n, d, b in zip(size, diagonals, bits)]
    return pd.Series(out, dtype=object)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``, one row per input row.

    Every rolling k-gram of every whole text meets the notice positions in a broadcast join (their number is fixed).  A
    hit is verified on its words, which travel beside the few k-grams whose hash a notice has.  Hits
    vote for (document, notice, diagonal), diagonal = word of the document - word of the notice.  Neighbouring
    diagonals merge; a merged span counts if it holds LEAST of the notice's distinct k-grams in at most STRETCH times
    its length.  A longer one (copies close together, fragments beside a copy) is cut into the runs that do.  ``score``: best share of a notice found, 1 where a base phrase stands.

    A document is its id and its words: rows with a null id, or with one id and different texts, vote apart.  Null and
    empty texts have no words and score 0; repeated rows come back as often as they stand.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    found = rows.mapInPandas(_scan, "doc_id long, text_key binary, n_words long, n_base long, first_word long, last_word long, base_labels string, grams array<long>, met array<int>, words array<string>")
    keys = ["doc_id", "text_key", *own]
    hits = found.select(*keys, "met", "words", F.posexplode("grams").alias("pos", "gram")).withColumn("pos", F.col("pos") - 1)
    hits = hits.join(F.broadcast(notice_positions(docs.sparkSession)), "gram", "left")
    said = F.try_element_at("words", F.array_position("met", F.col("pos").cast("int")).cast("int"))
    # the mark, at -1, meets no notice: it stands for the row itself
    hits = hits.where((F.col("pos") < 0) | (F.col("said") == F.when(F.col("said").isNotNull(), said)))
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*keys, "notice", "size", "label", "diagonal").agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count_if(F.col("pos") < 0).alias("copies")
    )
    w = Window.partitionBy(*keys, "notice").orderBy("diagonal")
    jump = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > GAP).cast("int"), F.lit(0))
    merged = votes.withColumn("jump", jump).withColumn("group", F.sum("jump").over(w))
    spans = merged.groupBy(*keys, "notice", "size", "label", "group").agg(F.bit_or("bits").alias("bits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("copies").alias("copies"), F.collect_list(F.struct("diagonal", "bits")).alias("votes"))
    share = F.bit_count("bits") / F.col("size")
    near = F.col("notice").isNotNull() & (share >= LEAST)
    fits = F.col("hi") - F.col("lo") + 1 <= F.greatest(F.lit(STRETCH) * F.col("size"), F.col("size") + 1)
    cut = _best_runs("size", F.when(near & ~fits, F.col("votes.diagonal")), F.when(near & ~fits, F.col("votes.bits")))
    spans = spans.withColumn("runs", F.when(near & fits, F.array(F.struct(share.alias("share"), "lo", "hi"))).otherwise(cut))
    per = spans.groupBy(*keys).agg(
        F.collect_set(F.when(F.size("runs") > 0, F.col("label"))).alias("found"),
        F.max(F.array_max(F.transform("runs", lambda x: x["share"]))).alias("best"),
        F.array_sort(F.flatten(F.collect_list(F.transform("runs", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), F.col("label").alias("label")))))).alias("spans"),
        F.sum("copies").alias("copies"),
    )
    labels = F.array_sort(F.array_union(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.col("found")))
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return per.select("doc_id", *own, F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), F.to_json("spans").alias("spans"))
