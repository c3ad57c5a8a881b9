"""Gold set: venues whose chunks contain the query passage verbatim.

``contains(chunk.text, query)`` over every chunk and query would be a nested loop.  Instead each task builds an
Aho-Corasick automaton over the passages and runs every text through it once, whatever the number of passages;
a task sends each (query, venue) it found once, so what is shuffled is bounded by the hits.

The automaton travels with the tasks, so its size is bounded: the passages of a batch are dealt by a hash to groups of
about half of GROUP_BYTES, and each group takes a pass over the chunks of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP_BYTES = 16 << 20


def passage_groups(queries: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """query, ids (of the queries with this passage), part: distinct passages, dealt by a hash; and the number of parts."""
    total = queries.agg(F.sum(F.octet_length("query") + 64)).first()[0] or 0
    parts = max(1, -(-2 * total // group_bytes))         # half full, so that uneven parts stay below the bound
    q = queries.select("query_id", "query").groupBy("query").agg(F.sort_array(F.collect_set("query_id")).alias("ids"))
    return q.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")), parts


def _found(chunks: DataFrame, passages: list[tuple[str, list[int]]]) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(passages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        automaton, everywhere = ahocorasick.Automaton(), []
        for passage, ids in shared.value:
            if passage:
                automaton.add_word(passage, ids)
            else:
                everywhere = ids                         # the empty passage is in every text
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            hits: set[tuple[int, int | None]] = set()
            for hall, text in zip(b.column("hall_id").to_pylist(), b.column("text"), strict=True):
                if text.is_valid:
                    hits.update((i, hall) for i in everywhere)
                    if len(automaton):
                        hits.update((i, hall) for _, ids in automaton.iter(text.as_py()) for i in ids)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in hits], pa.int64()), pa.array([h for _, h in hits], pa.int64())],
                                             names=["query_id", "hall_id"])

    return chunks.select(F.col("venue_id").cast("long").alias("hall_id"), "text").mapInArrow(run, "query_id long, hall_id long")


def substring_gold(chunks: DataFrame, queries: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, hall_id: distinct venues with a chunk containing the query text."""
    groups, parts = passage_groups(queries.where(F.col("query").isNotNull()), group_bytes)
    found = None
    for part in range(parts):                                # a batch of passages, GROUP_BYTES at a time
        rows = groups.where(F.col("part") == part).collect()
        if rows:
            hits = _found(chunks, [(r["query"], list(r["ids"])) for r in rows])
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return chunks.select(F.lit(0).cast("long").alias("query_id"), F.col("venue_id").cast("long").alias("hall_id")).where("false")
    return found.distinct()
