"""Mentions in documents: many patterns by one automaton, and the checks that turn mentions into events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalar import relocated

#: Most patterns that go to a task at once; larger tables go in as many passes as they need.
PATTERNS = 200_000
FOUND = "start int, end int, pattern string, kind string"


def leftmost_longest(matches: list[tuple[int, int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, pattern, kind) without overlaps of (start, -length, priority, pattern, kind): from the left the longest, then the least priority, pattern and kind."""
    out, free = [], 0
    for start, minus, _, pattern, kind in sorted(matches):
        if start >= free:
            out.append((start, start - minus, pattern, kind))
            free = start - minus
    return out


def _all_matches(docs: DataFrame, patterns: list[tuple[str, str, int]], key: str, text: str) -> DataFrame:
    """(key, m array of (start, length, priority, pattern, kind)) of documents with any match, by one pass of an Aho-Corasick automaton over each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(patterns)
    id_kind = docs.schema[key].dataType.simpleString()
    entry = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("priority", pa.int32()), ("pattern", pa.string()), ("kind", pa.string())])

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        of: dict[str, list[tuple[int, str]]] = {}
        for pattern, kind, priority in sent.value:
            of.setdefault(pattern, []).append((priority, kind))
        for pattern, kinds in of.items():
            automaton.add_word(pattern, (pattern, min(kinds)))
        automaton.make_automaton()
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                rows.append([{"start": end + 1 - len(p), "length": len(p), "priority": rank, "pattern": p, "kind": kind} for end, (p, (rank, kind)) in automaton.iter(t)] if t else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(entry))], names=[key, "m"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {id_kind}, m array<struct<start:int,length:int,priority:int,pattern:string,kind:string>>").filter(F.size("m") > 0)


def find_mentions(docs: DataFrame, patterns: DataFrame, key: str, text: str, most: int = PATTERNS) -> DataFrame:
    """(key, start, end, pattern, kind) of the mentions of each document, leftmost and longest first, without overlaps; places are code points.

    patterns: pattern, kind, priority (the least wins where one pattern has several kinds). A table of more than `most` patterns is taken in
    as many passes by hash, whose matches meet per document before overlaps are resolved; keys are distinct. Null texts and empty
    patterns match nothing.
    """
    p = patterns.filter("pattern <> ''").select("pattern", "kind", F.coalesce(F.col("priority").cast("int"), F.lit(0)).alias("priority")).distinct()
    n = p.count()
    passes = max(1, -(-n * 5 // (4 * most)) if n > most else 1)  # hash parts differ a little in size
    part = F.pmod(F.xxhash64("pattern"), F.lit(passes))
    found = None
    for k in range(passes):
        here = _all_matches(docs, [tuple(r) for r in p.filter(part == k).collect()], key, text)
        found = here if found is None else found.unionByName(here)
    if passes > 1:
        found = found.groupBy(key).agg(F.flatten(F.collect_list("m")).alias("m"))
    schema = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("kind", pa.string())]))

    def resolve(batches):
        for b in batches:
            rows = [[dict(zip(("start", "end", "pattern", "kind"), r)) for r in leftmost_longest([(x["start"], -x["length"], x["priority"], x["pattern"], x["kind"]) for x in m])] for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, schema)], names=[key, "m"])

    kind = docs.schema[key].dataType.simpleString()
    return found.mapInArrow(resolve, f"`{key}` {kind}, m array<struct<start:int,end:int,pattern:string,kind:string>>").select(key, F.inline("m"))


def compile_mentions(mentions: DataFrame, chunks: DataFrame, taxonomy: DataFrame, whitelist: DataFrame) -> DataFrame:
    """mentions with `reasons` (what is wrong, in order), `accepted` (nothing is), and `place` (start, end, source of the quote in its chunk).

    mentions: document_id, mention_id, chunk_id, event_type, subject, role, quote, facts (array of name, raw).
    chunks: document_id, chunk_id, text. taxonomy: event_type, roles (allowed), required (names of facts). whitelist: document_id, subject, roles.
    Reasons: mention_event_type_unknown, mention_evidence_chunk_missing, mention_evidence_not_unique, mention_subject_missing,
    mention_subject_role_invalid, mention_fact_missing, mention_fact_not_in_quote. A chunk, type or subject that is listed twice counts once.
    """
    c = chunks.dropDuplicates(["document_id", "chunk_id"]).select("document_id", "chunk_id", F.col("text").alias("__text"))
    t = taxonomy.dropDuplicates(["event_type"]).select("event_type", F.col("roles").alias("__roles"), F.col("required").alias("__required"))
    w = whitelist.groupBy("document_id", "subject").agg(F.array_distinct(F.flatten(F.collect_list("roles"))).alias("__allowed"))
    d = mentions.join(c, ["document_id", "chunk_id"], "left").join(t, "event_type", "left").join(w, ["document_id", "subject"], "left")
    d = d.withColumn("place", relocated("__text", "quote"))
    facts = F.coalesce("facts", F.array().cast("array<struct<name:string,raw:string>>"))
    names = F.transform(facts, lambda f: f["name"])
    reasons = [
        ("mention_event_type_unknown", F.col("__required").isNull()),
        ("mention_evidence_chunk_missing", F.col("__text").isNull()),
        ("mention_evidence_not_unique", F.col("__text").isNotNull() & F.col("place").isNull()),
        ("mention_subject_missing", F.col("__allowed").isNull()),
        ("mention_subject_role_invalid", F.col("__allowed").isNotNull() & F.col("__roles").isNotNull() & ~(F.array_contains("__roles", F.col("role")) & F.array_contains("__allowed", F.col("role")))),
        ("mention_fact_missing", F.size(F.array_except(F.coalesce("__required", F.array().cast("array<string>")), names)) > 0),
        ("mention_fact_not_in_quote", F.exists(facts, lambda f: ~F.coalesce(F.contains(F.col("quote"), f["raw"]), F.lit(False)))),
    ]
    out = d.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in reasons])))
    return out.withColumn("accepted", F.size("reasons") == 0).drop("__text", "__roles", "__required", "__allowed")
