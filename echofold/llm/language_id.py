"""Language of web pages by Bayesian fusion of four kinds of evidence.

Likelihoods of a page's text come from byte trigrams counted over all documents of each language. The language that the
markup declares and the language section and suffix of the address count as observations whose distribution given the true
language is estimated over all pages, from the language that the text alone suggests. The prior is the host's mix of languages,
smoothed towards its site's, which is smoothed towards that of all pages; a page doesn't count in its own prior. All of these are
grouped aggregations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.spark_util import cut, parts_by_bytes
from echofold.llm.url_filter import url_host, url_path
from echofold.llm.words import LOWER

BUCKETS = 1 << 14
#: Bytes of a text whose trigrams are counted at a time.
PART = 1 << 20
#: A trigram's evidence is scaled down, as neighbours aren't independent, and the whole text's is bounded.
TRIGRAM_WEIGHT, MOST_TRIGRAMS = 0.25, 400
#: Strength of the smoothing towards the next wider group, in pages, and of the observations' counts.
PRIOR_PAGES, SMOOTH = 5.0, 0.5
MOST_LANGUAGES = 500
_MARKUP = re.compile(rb"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]{1,9};", re.S | re.I)


def trigram_counts(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text, A-Z lower-cased, digits and marks left out."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    data = np.where(letter, data, 32).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    code = code[letter[:-2] | letter[1:-1] | letter[2:]]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def visible_text(html: bytes) -> bytes:
    return _MARKUP.sub(b" ", html)


def train_languages(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of the buckets by language, from all documents (text, lang) with a language."""
    rows = docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                name = lang.as_py()
                if name not in totals:
                    totals[name] = np.zeros(BUCKETS, np.int64)
                data = text.as_py()
                # Parts share two bytes, so that each trigram is counted once.
                for at in range(0, max(len(data) - 2, 0), PART):
                    totals[name] += np.bincount(trigram_counts(data[at : at + PART + 2]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["lang", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(counts, np.int64)
                totals[lang] = totals[lang] + values if lang in totals else values
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["lang", "counts"])

    schema = "lang string, counts binary"
    # One fixed-size row per language comes to the driver.
    sums = rows.mapInArrow(count, schema).repartition("lang").mapInArrow(add, schema).limit(MOST_LANGUAGES + 1).collect()
    if len(sums) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = sorted(sums, key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in sums], dtype=float).reshape(len(sums), BUCKETS) + 0.5
    return [r["lang"] for r in sums], np.log(counts / counts.sum(axis=1, keepdims=True))


def identify_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, section, text_lang, lang and probability for pages (page_id, url, html).

    Learns from documents (text, lang). A page without text has no text evidence, one without a declaration or a language
    section counts as such, and one without a url has the empty host. Ties go to the language that sorts first. Rows that
    repeat are judged alike, one result each. Without any labelled document lang is null. An empty table gives an empty result.
    Other columns are ignored.
    """
    names, log_p = train_languages(docs)
    languages = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    listed = names or [""]
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-zA-Z]+)""", 1))
    section = F.lower(F.regexp_extract(path, r"^/([a-zA-Z]{2,3})(?:/|$)", 1))
    rows = pages.select(
        F.col("page_id"),
        host.alias("host"),
        F.when(declared.isin(listed), declared).alias("declared"),
        F.when(section.isin(listed), section).alias("section"),
        F.regexp_replace(host, r"^[^.]*\.(?=[^.]*\.)", "").alias("site"),
        F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"),
    )
    if not names:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "host", "declared", "section", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("probability"))

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_bytes(batch, batch.num_columns - 1):
                out = []
                for html in part.column(part.num_columns - 1).to_pylist():
                    found = trigram_counts(visible_text(html))
                    scale = TRIGRAM_WEIGHT * min(1.0, MOST_TRIGRAMS / max(len(found), 1))
                    out.append((scale * log_p[:, found].sum(axis=1)).tolist() if len(found) else [0.0] * len(names))
                best = [int(np.argmax(x)) if any(x) else None for x in out]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.list_(pa.float64())), pa.array(best, pa.int32())], [*batch.schema.names[:-1], "text_log", "best"])

    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, declared string, section string, site string, suffix string, text_log array<double>, best int"
    seen = cut(rows.mapInArrow(likelihoods, schema))

    def counts(key: str) -> DataFrame:
        """One row per key: how many pages the text alone gives to each language."""
        each = [F.sum(F.when(F.col("best") == i, 1.0).otherwise(0.0)) for i in range(len(names))]
        return seen.groupBy(key).agg(F.array(*each).alias(f"{key}_n"))

    every = seen.agg(F.array(*[F.sum(F.when(F.col("best") == i, 1.0).otherwise(0.0)) for i in range(len(names))]).alias("n")).first()["n"]
    every = np.array([x or 0.0 for x in every])
    prior = F.array(*[F.lit(float(x)) for x in (every + 1) / (every + 1).sum()])
    totals = F.array(*[F.lit(float(x)) for x in every])
    own = F.array(*[F.when(F.col("best") == i, 1.0).otherwise(0.0) for i in range(len(names))])

    def less_own(column: str):
        return F.zip_with(column, "own", lambda n, o: F.greatest(n - o, F.lit(0.0)))

    def smoothed(n, wider):
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, wider, lambda c, p: (c + PRIOR_PAGES * p) / (total + PRIOR_PAGES))

    def observed(column: str, kinds: int):
        """log P(what is observed | language), the page itself left out; zeros where nothing is observed."""
        given = F.zip_with(less_own(f"{column}_n"), F.zip_with(totals, "own", lambda t, o: t - o), lambda n, t: F.log((n + SMOOTH) / (t + SMOOTH * kinds)))
        return F.when(F.col(column).isNull(), F.array(*[F.lit(0.0)] * len(names))).otherwise(given)

    out = seen.withColumn("own", own)
    for key in ("host", "site", "suffix", "declared", "section"):
        table = counts(key).withColumnRenamed(key, f"{key}_key")
        # One row per key; the page side of a hot key can be split.
        out = out.join(table, F.col(key) == F.col(f"{key}_key"), "left").drop(f"{key}_key")
    wide = smoothed(less_own("site_n"), prior)
    out = out.withColumn("site_prior", wide).withColumn("host_prior", smoothed(less_own("host_n"), F.col("site_prior")))
    parts = [
        F.col("text_log"),
        F.transform("host_prior", lambda p: F.log(p)),
        observed("declared", len(names) + 1),
        observed("section", len(names) + 1),
        observed("suffix", 64),
    ]
    out = out.withColumn("log_post", reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts))
    out = out.withColumn("top", F.array_max("log_post"))
    weight = F.aggregate("log_post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return out.select(
        "page_id",
        "host",
        "declared",
        "section",
        F.get(languages, F.col("best")).alias("text_lang"),
        F.get(languages, (F.array_position("log_post", F.col("top")) - 1).cast("int")).alias("lang"),
        (1.0 / weight).alias("probability"),
    )


def op7_evidence_fusion_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
