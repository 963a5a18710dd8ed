"""License scans: sparse TF-IDF cosine of header lines and licence files to templates, then the nearest ancestor folder's
licence. DataFrame functions only.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ascii_lower, written

# Short and opening forms of public licences by SPDX id, as they stand in headers and licence files.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal"),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved"),
]

def _full_texts() -> list[tuple[str, str]]:
    """Whole licence texts by SPDX id. The AGPL's is made of the GPL's: its names and its section 13 tell them apart."""
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in Path(__file__).with_name("license_texts").glob("*.txt")}
    network = (
        "Remote Network Interaction. If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to "
        "receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge"
    )
    named = texts["GPL-3.0"].replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public")
    return sorted({**texts, "AGPL-3.0": f"{named}\n{network}"}.items())


FULL_TEXTS = _full_texts()
TEMPLATES += FULL_TEXTS
#: Function words, which any English text has; they tell no licence and would liken long prose to full texts.
STOP = ["a", "an", "and", "are", "as", "at", "be", "for", "from", "if", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "which", "with"]
#: The given templates have one of these, and a part without one is no licence; they spare the scan the other parts.
ANCHOR = r"(?i)licen[sc]e|rights reserved|copyright|permission|redistribut"
#: Names of licence files, whatever follows.
NAMED = r"(?i)^(un)?(licen[sc]e|copying|copyright|notice)"
#: A template with as many terms is a whole licence text: what it covers is a licence file, whatever its name.
FULL_TERMS = 80
_SPLIT = r"[^\p{L}\p{N}.\-]+"


def _terms(text: Column) -> Column:
    """Lower-cased words of letters, digits, dots and hyphens, without dots and hyphens at their ends; no function words."""
    bare = F.transform(F.split(ascii_lower(text), _SPLIT), lambda w: F.btrim(w, F.lit(".-")))
    return F.filter(bare, lambda w: ~w.isin("", *STOP))


def _template_terms(text: str) -> list[str]:
    import regex

    bare = [w.strip(".-") for w in regex.split(_SPLIT, text.translate(ASCII_LOWER))]
    return [w for w in bare if w and w not in STOP]


def _anchor_of(templates: list[tuple[str, str]]) -> str:
    """ANCHOR, and the longest term of each template that has none of its words."""
    import re

    others = {max(terms, key=lambda w: (len(w), w)) for _, t in templates if not re.search(ANCHOR, t) and (terms := _template_terms(t))}
    return "|".join([ANCHOR, *map(re.escape, sorted(others))])


def _counts(terms: Column) -> Column:
    """Each word of a sorted array with its number, in time linear in the array."""
    starts = F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda k: (k == 0) | (F.get(terms, k) != F.get(terms, k - 1)))
    pairs = F.zip_with(starts, F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(terms))), lambda k, end: F.struct(k.alias("k"), end.alias("end")))
    return F.transform(pairs, lambda p: F.struct(F.get(terms, p["k"]).alias("w"), (p["end"] - p["k"]).alias("c")))


#: Between blocks: lines without a word of any kind, as comment marks alone.
_BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"


def _folders(path: Column) -> Column:
    """A path's folders, the nearest first; the last is the root, an empty name."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan_licenses(
    files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.6, most_bytes: int = 32 << 20, key: str = "doc_id", path: str = "path", text: str = "text"
) -> DataFrame:
    """The licence of every file: its own, or that of the licence file in the nearest folder above it.

    A text is compared with all templates by the cosine of TF-IDF vectors: each of its lines, each block of lines between
    empty ones, and the whole, where these have an anchor word. Document frequencies of the templates' terms are counted over all texts and other terms weigh as if one text had
    them; function words don't count. A file's own licence is that of its best part at ``threshold`` or more. It is a licence file if it is named
    like one and has a licence, or if its whole text, of any length, reaches the threshold with a template that is a whole licence (``FULL_TERMS``); its
    licence is then that of the whole text, if that has one. A file without a licence of its own takes that of the nearest folder, from its own
    up to the root, that has a licence file; of several in one folder, the one with the best cosine, then the smallest id.

    Returns key, path, license, cosine (null if none), via (header, file, inherited, none) and folder (of the inherited). Null
    or empty texts have no licence of their own; a null path is a file in the root; a null key is a key like any other, after all others. Repeated rows are judged alike, one row
    for each; rows with an equal key and different texts each by their own. No rows: no rows. Extra columns are ignored. Tables with a row for each folder, or for each
    text with a licence, are sent to all executors if their strings have at most ``most_bytes``.
    """
    spark, templates = files.sparkSession, templates or TEMPLATES
    anchor = _anchor_of(templates)
    rows = files.select(F.col(key).alias("_key"), F.coalesce(F.col(path), F.lit("")).alias("_path"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    vocabulary = sorted({w for _, t in templates for w in _template_terms(t)})
    # at most a row for each term of the templates comes to the driver
    held = F.array_distinct(F.filter(_terms(F.col("_text")), lambda w: w.isin(vocabulary)))
    counted = {r[0]: r[1] for r in rows.select(F.explode(held).alias("w")).groupBy("w").count().collect()}
    total = rows.count()
    weight = {w: math.log((total + 1) / (counted.get(w, 0) + 1)) + 1 for w in vocabulary}
    other = math.log((total + 1) / 2) + 1

    file = ["_key", "_path", "_hash"]
    scanned = rows.where(F.col("_text").rlike(anchor))
    lines = F.transform(F.filter(F.split("_text", "\n"), lambda x: x.rlike(anchor)), lambda x: F.struct(x.alias("part"), F.lit(False).alias("whole")))
    blocks = F.transform(F.filter(F.split("_text", _BLANK), lambda x: x.rlike(anchor) & x.contains("\n")), lambda x: F.struct(x.alias("part"), F.lit(False).alias("whole")))
    parts = scanned.select(*file, F.inline(F.concat(lines, blocks, F.array(F.struct(F.col("_text").alias("part"), F.lit(True).alias("whole"))))))
    parts = parts.withColumn("terms", F.array_sort(_terms(F.col("part")))).where(F.size("terms") > 0)
    parts = written(parts.select(*file, "whole", F.monotonically_increasing_id().alias("_part"), _counts(F.col("terms")).alias("counts")), "license-parts")
    # a row for each term: its weight and what each template's unit vector has of it
    shares: dict[str, list[dict]] = {}
    for k, (_, body) in enumerate(templates):
        own = {w: n * weight[w] for w, n in Counter(_template_terms(body)).items()}
        size = math.sqrt(sum(x * x for x in own.values()))
        for w, x in own.items():
            shares.setdefault(w, []).append({"k": k, "y": x / size})
    listed = json.dumps([{"w": w, "x": weight[w], "shares": shares[w]} for w in vocabulary])
    weights = written(spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<w: string, x: double, shares: array<struct<k: int, y: double>>>>"))), "license-weights")
    # each part's products with all templates, and its squared length as that with template -1
    part = [*file, "whole", "_part"]
    counts = parts.select(*part, F.inline("counts")).join(F.broadcast(weights), "w", "left").withColumn("v", F.col("c") * F.coalesce("x", F.lit(other)))  # a row for each term of the templates
    length = F.array(F.struct(F.lit(-1).alias("k"), F.col("v").alias("y")))
    products = counts.select(*part, "v", F.inline(F.concat(length, F.coalesce("shares", F.array().cast("array<struct<k: int, y: double>>")))))
    products = products.groupBy(*part, "k").agg(F.sum(F.col("v") * F.col("y")).alias("product"))
    all_of = products.groupBy(*part).agg(F.sqrt(F.max(F.when(F.col("k") == -1, F.col("product")))).alias("length"), F.collect_list(F.when(F.col("k") >= 0, F.struct("k", "product"))).alias("products"))
    names = F.array(*[F.lit(name) for name, _ in templates])
    full = [k for k, (_, body) in enumerate(templates) if len(_template_terms(body)) >= FULL_TERMS]
    # rounded, as the order of a sum must not decide between equal parts
    cosines = F.transform("products", lambda p: F.struct(F.round(p["product"] / F.col("length"), 12).alias("cosine"), (-p["k"]).alias("order"), F.get(names, p["k"]).alias("license")))
    reached = all_of.select(*file, "whole", F.filter(cosines, lambda c: c["cosine"] >= threshold).alias("found")).where(F.size("found") > 0)
    covers = F.exists("found", lambda c: c["order"].isin([-k for k in full]))
    judged = reached.select(*file, F.array_max("found").alias("best"), "whole", (F.col("whole") & covers).alias("covered"))
    named = F.element_at(F.split("_path", "/"), -1).rlike(NAMED)
    # a struct of the licence file's text goes before its lines and blocks
    tops = judged.groupBy(*file).agg(F.max("covered").alias("covered"), F.max_by("best", F.struct("whole", "best")).alias("text"), F.max("best").alias("part"))
    own = tops.withColumn("is_file", F.col("covered") | named).select(*file, "is_file", F.when(F.col("is_file"), F.col("text")).otherwise(F.col("part")).alias("best"))
    own = written(own, "licenses")

    # folders with licence files, then each folder's nearest; both have a row for each folder
    near = F.get(_folders(F.col("_path")), F.lit(0))
    last = F.struct(F.col("best.cosine"), F.col("_key").isNotNull(), -F.col("_key"), -F.col("_hash"))
    by_folder = own.where("is_file").groupBy(near.alias("folder")).agg(F.max_by(F.col("best.license"), last).alias("inherited"))
    steps = rows.select(near.alias("_folder")).distinct().select("_folder", F.posexplode(_folders(F.concat(F.when(F.col("_folder") != "", F.concat("_folder", F.lit("/"))).otherwise(""), F.lit("x")))).alias("step", "folder"))
    nearest = steps.join(_sent(by_folder, most_bytes), "folder").groupBy("_folder").agg(F.min_by(F.struct("folder", "inherited"), "step").alias("above"))
    mine = _sent(own.select(F.col("_key").alias("_k"), F.col("_path").alias("_p"), F.col("_hash").alias("_h"), "is_file", "best"), most_bytes)
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_path") == F.col("_p")) & (F.col("_hash") == F.col("_h"))
    out = rows.select(*file, near.alias("_folder")).join(mine, same, "left").join(_sent(nearest, most_bytes), "_folder", "left")
    via = F.when(F.col("is_file"), "file").when(F.col("best").isNotNull(), "header").when(F.col("above").isNotNull(), "inherited").otherwise("none")
    return out.select(
        F.col("_key").alias(key),
        F.col("_path").alias("path"),
        F.coalesce("best.license", "above.inherited").alias("license"),
        F.col("best.cosine").alias("cosine"),
        via.alias("via"),
        F.when(via == "inherited", F.col("above.folder")).alias("folder"),
    )


def _sent(small: DataFrame, most_bytes: int) -> DataFrame:
    """A table, written and measured by its rows and strings, and sent to all executors only if it has at most ``most_bytes``."""
    small = written(small, "licenses")
    strings = [F.octet_length(c) for c, kind in small.dtypes if kind == "string"]
    size = small.agg(F.coalesce(F.sum(sum(strings, F.lit(200))), F.lit(0))).first()[0]  # 200: what a row's other columns take at most
    return F.broadcast(small) if size <= most_bytes else small


def brute_licenses(rows: list[tuple[int, str, str | None]], templates: list[tuple[str, str]], threshold: float) -> dict[int, tuple[str | None, str]]:
    """The same by plain dictionaries: id to (license, via). For small fixtures in tests."""
    import regex as re

    vocabulary = {w for _, t in templates for w in _template_terms(t)}
    df = {w: sum(w in set(_template_terms(t or "")) for _, _, t in rows) for w in vocabulary}
    idf = lambda w: math.log((len(rows) + 1) / (df.get(w, 0) + 1)) + 1 if w in vocabulary else math.log((len(rows) + 1) / 2) + 1

    def vector(text: str) -> dict[str, float]:
        return {w: n * idf(w) for w, n in Counter(_template_terms(text)).items()}

    full = {-k for k, (_, t) in enumerate(templates) if len(_template_terms(t)) >= FULL_TERMS}

    def all_of(text: str) -> list[tuple[float, int, str]]:
        v = vector(text)
        out = []
        for k, (name, body) in enumerate(templates):
            t = vector(body)
            size = math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in t.values()))
            out.append((round(sum(x * t.get(w, 0) for w, x in v.items()) / size, 12) if size else 0.0, -k, name))
        return [x for x in out if x[0] >= threshold] if re.search(ANCHOR, text) else []

    own, files = {}, {}
    for i, path, text in rows:
        text = text or ""
        whole = all_of(text)
        found = [f for x in [*text.split("\n"), *(b for b in re.split(_BLANK, text) if "\n" in b)] for f in all_of(x)] + whole
        if not found:
            continue
        is_file = re.search(NAMED, path.split("/")[-1]) or any(k in full for _, k, _ in whole)
        own[i] = max(whole or found) if is_file else max(found)
        if is_file:
            folder = "/".join(path.split("/")[:-1])
            files[folder] = max(files.get(folder, (0.0, 0, "")), (own[i][0], -i, own[i][2]))
    out = {}
    for i, path, _ in rows:
        parts = path.split("/")
        above = next((files[f] for f in ("/".join(parts[:n]) for n in range(len(parts) - 1, -1, -1)) if f in files), None)
        out[i] = (own[i][2], "own") if i in own else (above[2], "inherited") if above else (None, "none")
    return out
