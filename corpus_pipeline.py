"""A training corpus from raw documents: five stages, each a Spark job over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``docs``;
``run`` writes each one's result as Parquet in the shared folder and rereads it for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.bpe import encode_documents
from echofold.llm.minhash import near_groups
from echofold.llm.mixing import WORD, mix_sources
from echofold.llm.quality_model import fit, score_quality
from echofold.llm.spark_util import cut, marked, parts_by_bytes, text_keys, text_or_empty
from echofold.llm.substring_dedup import dedup_substrings
from echofold.llm.words import SPACE
from echofold.scratch import delete, delete_on_exit, shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside the held-out fold, scores at 0.5 or more.

    A null text is scored as an empty one; rows that repeat are scored alike. Without labels every score is 0.5, and all stay.
    """
    vectors, net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return score_quality(docs, vectors, net, name).where(F.col(name) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


_KEY = ["id", "ha", "hb"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The row as one struct, and what tells documents apart: id (as text) and two hashes of the text."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, _id("doc_id").alias("id"), *[c.alias(k) for k, c in text_keys(F.encode(text_or_empty(), "UTF-8")).items()])


def _id(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("\0"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id (none last), of each group of near duplicates.

    Texts decide, not ids: unlike texts with one id both stay. Of rows that repeat, in id and text, one stays. Documents without words, null texts
    among them, are linked with nothing, and all of them stay. Only documents that may have to go are shuffled.
    """
    found = cut(near_groups(docs).where("group is not null").select(_id("doc_id").alias("id"), "ha", "hb", "group", F.struct(F.isnull("doc_id"), "doc_id", "ha", "hb").alias("at")))
    first = found.groupBy("group").agg(F.min("at").alias("first"))
    losers = cut(found.join(first, "group").where("at <> first").select(*_KEY).distinct())
    repeated = found.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_KEY)
    rows = marked(_keyed(docs), losers.unionByName(repeated), _KEY)
    asked = rows.where("_maybe").withColumn("words", F.coalesce(F.col("row.text").cast("string").rlike(WORD), F.lit(False)))
    left = asked.where("words").join(losers, _KEY, "left_anti").dropDuplicates(_KEY)
    return rows.where("not _maybe").select("row").unionByName(asked.where("not words").select("row")).unionByName(left.select("row")).select("row.*")


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes or more that occur more than once.

    All rows stay; a text all of which goes is empty, as is a null one. ``n_chars``, where there is such a column, is counted anew.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = dedup_substrings(docs, keep=others)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made[c].alias(c) if c in made else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def words_between(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text's words from first to last (exclusive) of each range, with what stands between them; ranges go on new lines."""
    data = text.encode()
    inside = ~SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    if ranges == [(0, len(starts))]:
        return text
    return "\n".join(data[starts[a] : stops[b - 1]].decode() for a, b in ranges)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each pass over a document, with the parts of its text that the pass takes.

    Null and empty texts have no words and give no row. A null source is one of its own. Of rows that repeat in id, text and source each gives its
    own passes. ``n_chars``, where there is such a column, is counted anew.
    """
    key = [*_KEY, "src"]
    source = F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("src")
    taken = mix_sources(docs, keep_spans=True).where("spans is not null").select(_id("doc_id").alias("id"), "ha", "hb", source, "spans")
    spans = cut(taken.groupBy(*key).agg(F.collect_list("spans").alias("turns"), F.count(F.lit(1)).alias("n")))
    # Of rows that repeat, one carries the spans of all.
    rows = marked(_keyed(docs).withColumn("src", F.coalesce(F.col("row.source").cast("string"), F.lit("\0"))), spans.where("n > 1"), key)
    rows = rows.where("not _maybe").unionByName(rows.where("_maybe").dropDuplicates(key))
    joined = rows.join(spans.drop("n").hint("shuffle_hash"), key)
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_bytes(batch, at):
                rows, texts = [], []
                for i, (text, copies) in enumerate(zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist())):
                    for spans in copies:
                        for turn in sorted({s["turn"] for s in spans}):
                            ranges: list[tuple[int, int]] = []
                            for a, b in sorted((s["first"], s["last"]) for s in spans if s["turn"] == turn):
                                if ranges and ranges[-1][1] == a:
                                    ranges[-1] = (ranges[-1][0], b)
                                else:
                                    ranges.append((a, b))
                            rows.append(i)
                            texts.append(words_between(text, ranges))
                columns = [c.take(pa.array(rows, pa.int64())) for c in part.columns[:-1]]
                columns[at] = pa.array(texts, columns[at].type)
                if chars is not None:
                    columns[chars] = pa.array([len(t) for t in texts], pa.int64()).cast(columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    # Only texts that have words are left.
    return joined.select("row.*", F.col("turns").alias("_turns")).mapInArrow(take, docs.schema)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their count, and digests of the ids and of the text decoded from them; each row of ``docs`` gives one."""
    return encode_documents(docs, keep_ids=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("source_mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage leaves is deleted once the next one is written, the last of them when the session ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)
    before = None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
