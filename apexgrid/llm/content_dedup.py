"""Exact deduplication by sorting the contents.

Method: Spark samples splitters and range-partitions the rows by (first bytes of the normalised text, its SHA-256,
document id), so equal texts lie next to each other and even one huge group of copies is spread over many tasks. Each
task sorts externally, the full normalised text being part of the order, and a stream over the sorted rows compares
each text in full with its neighbour. A run of equal texts inside a task is settled there. Only the first and the last run
of a task can go on in a neighbouring task; one row for each, with its text, is grouped by that text (at most two texts per
task), and the rows of such runs are joined to the outcome on (task, run), a key no larger than a task.

Splitters hold 64 bytes of text at most, so what is sampled to the driver does not depend on the length of the texts.

Cases: null is the empty text; the smallest id stays, null ids come last; of rows repeated with text and id one stays;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexgrid.llm.columns import SPACES, text_or_empty, prepare
from apexgrid.session import materialised

HEAD_BYTES = 64

_RUNS = "doc_id bigint, text_sha256 string, keep_id bigint, group_size bigint, first boolean, task bigint, run bigint, border_text binary"


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in sorted rows. The first and last run of the task are numbered 0 and 1 and left open."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "text_sha256", "keep_id", "group_size", "first", "task", "run", "border_text"]
    schema = pa.schema(list(zip(names, types)))

    def out(ids, shas, keep, size, first, run, text):
        n = len(ids)
        columns = [ids, shas, keep, size, first, pa.array([task] * n, pa.int64()), run, text]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], schema=schema)

    def open_run(ids: pa.Array, sha, text: bytes, run: int):
        """Rows of a run that may go on elsewhere; the first of them carries the text and the number of rows."""
        n = len(ids)
        rest = [None] * (n - 1)
        return out(
            ids,
            pa.array([sha] * n, pa.string()),
            pa.nulls(n, pa.int64()),
            pa.array([n, *rest], pa.int64()),
            pa.array([False] * n),
            pa.array([run] * n, pa.int64()),
            pa.array([text, *rest], pa.binary()),
        )

    text, sha, parts, runs_before = None, None, [], 0
    for b in batches:
        ids, shas, texts = b.column(0), b.column(1), b.column(2)
        n = len(ids)
        if not n:
            continue
        same = np.zeros(n, bool)
        same[0] = text is not None and texts[0].as_py() == text
        if n > 1:
            same[1:] = pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same)
        # the run carried over from the batch before
        upto = int(starts[0]) if len(starts) else n
        if upto:
            parts.append(ids.slice(0, upto))
        if len(starts) and text is not None:
            whole = pa.concat_arrays(parts)
            if runs_before == 0:
                yield open_run(whole, sha, text, 0)
            else:
                size = len(whole)
                yield out(
                    whole,
                    pa.array([sha] * size, pa.string()),
                    pa.array([whole[0].as_py()] * size, pa.int64()),
                    pa.array([size] * size, pa.int64()),
                    pa.array([True] + [False] * (size - 1)),
                    pa.nulls(size, pa.int64()),
                    pa.nulls(size, pa.binary()),
                )
            runs_before += 1
        if not len(starts):
            continue
        # runs that end inside this batch, but for a first run of the task
        inner = starts
        if text is None and len(starts) > 1:
            yield open_run(ids.slice(0, int(starts[1])), shas[0].as_py(), texts[0].as_py(), 0)
            runs_before += 1
            inner = starts[1:]
        if len(inner) > 1:
            low, high = int(inner[0]), int(inner[-1])
            sizes = np.diff(inner)
            at = np.repeat(inner[:-1], sizes)
            m = high - low
            first = np.zeros(m, bool)
            first[inner[:-1] - low] = True
            yield out(
                ids.slice(low, m),
                shas.slice(low, m),
                ids.take(pa.array(at)),
                pa.array(np.repeat(sizes, sizes)),
                pa.array(first),
                pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.binary()),
            )
            runs_before += len(sizes)
        last = int(starts[-1])
        text, sha, parts = texts[last].as_py(), shas[last].as_py(), [ids.slice(last)]
    if text is not None:
        yield open_run(pa.concat_arrays(parts), sha, text, 1 if runs_before else 0)


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    spark = df.sparkSession
    prepare(spark)
    norm = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), normalised(text).cast("binary").alias("norm"))
    keyed = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), "norm", F.substring("norm", 1, HEAD_BYTES).alias("head"))
    order = ["head", "text_sha256", F.col("doc_id").asc_nulls_last()]
    dealt = keyed.repartitionByRange(*([partitions] if partitions else []), *order)
    ordered = dealt.sortWithinPartitions("head", "text_sha256", "norm", F.col("doc_id").asc_nulls_last())
    runs = materialised(ordered.select("doc_id", "text_sha256", "norm").mapInArrow(_runs, _RUNS))

    border = runs.filter("border_text IS NOT NULL").select("task", "run", "doc_id", "group_size", "border_text")
    # full comparison once more: the runs at the borders are put together by their whole text
    whole = border.groupBy("border_text").agg(
        F.min("doc_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "task", "run")).alias("head"),
    )
    settled = border.select("task", "run", "border_text").join(whole, "border_text").select(
        F.col("task").alias("_task"),
        F.col("run").alias("_run"),
        F.col("keep_id").alias("_keep_id"),
        F.col("group_size").alias("_group_size"),
        ((F.col("head.task") == F.col("task")) & (F.col("head.run") == F.col("run"))).alias("_leads"),
    )
    opened = runs.filter("run IS NOT NULL").join(
        settled, (F.col("task") == F.col("_task")) & (F.col("run") == F.col("_run"))
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return (
        runs.filter("run IS NULL")
        .withColumnRenamed("first", "kept")
        .select(columns)
        .unionByName(
            opened.select(
                "doc_id",
                F.col("_keep_id").alias("keep_id"),
                F.col("_group_size").alias("group_size"),
                # the first row of a run has the run's smallest id; that of the leading run stays
                (F.col("_leads") & F.col("border_text").isNotNull()).alias("kept"),
                "text_sha256",
            )
        )
    )


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; of rows equal in id and text any one.

    Rows whose id occurs once meet only the ids of what goes, so that side is as small as can be. Rows with a null or
    repeated id go by id and digest; only for them are the texts normalised again.
    """
    number = df[doc_id].cast("bigint")
    groups = exact_groups(df, doc_id, text)
    known = groups.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
    ids = materialised(known.agg((F.count("*") == 1).alias("once"), F.bool_and("kept").alias("kept")).filter("NOT once OR NOT kept"))
    gone = materialised(ids.filter("once").select("_id"))
    reused = materialised(ids.filter("NOT once").select("_id"))
    some_reused, some_null = not reused.isEmpty(), not groups.filter("doc_id IS NULL").isEmpty()
    plain = df.join(gone, number == gone["_id"], "left_anti")
    if not (some_reused or some_null):
        return plain
    plain = plain.join(reused, number == reused["_id"], "left_anti").filter(number.isNotNull())
    odd = df.filter(number.isNull())
    if some_reused:
        odd = odd.unionAll(df.join(reused, number == reused["_id"], "left_semi"))
    sha = F.sha2(normalised(odd[text]).cast("binary"), 256)
    # one row for each id and text before the join, so that neither nulls nor copies are a hot key
    odd = odd.select(F.struct("*").alias("row"), odd[doc_id].cast("bigint").alias("id"), sha.alias("sha")).dropDuplicates(["id", "sha"])
    stays = groups.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    stays = stays.filter("_id IS NULL").unionAll(stays.join(reused, "_id", "left_semi"))
    return plain.unionAll(odd.join(stays, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left_semi").select("row.*"))
