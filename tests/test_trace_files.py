"""Trace files: what a reader has to reject, in one split and in many."""

import json
import random
from collections import Counter

import pytest

from tessera.streaming import trace_files

HEADER = {"record_type": "trace_header", "format": "agent-exploration", "schema_version": 1, "trace_id": "t1", "started_at": "2026-08-19T10:00:00Z"}


def event(sequence, invocation="c1", phase="started", trace="t1", **more):
    return {"record_type": "event", "schema_version": 1, "trace_id": trace, "sequence": sequence, "invocation_id": invocation, "occurred_at": "2026-08-19T10:00:01Z", "elapsed_ms": 10 * sequence, "phase": phase, "tool_name": "x", "label": "y", "references": [], **more}


def write(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


GOOD = [HEADER, event(1), event(2, phase="completed"), event(5, "c2"), event(6, "c3"), event(9, "c2", "failed")]
BAD = {
    "mixed": ([HEADER, event(1), event(2, "c2", trace="t2"), event(3, "c3", trace="t2")], {"mixed trace ids": 2}),
    "falling": ([HEADER, event(3), event(1, "c2"), event(2, "c3")], {"falling sequence": 1}),
    "repeated": ([HEADER, event(3), event(3, "c2")], {"repeated sequence": 1}),
    "zero": ([HEADER, event(0)], {"repeated sequence": 1}),
    "three faults": ([event(3, "i"), event(1, "i", "completed"), event(2, "i", "failed", trace="t2")], {"falling sequence": 1, "mixed trace ids": 1, "repeated end": 1}),
    "two starts": ([HEADER, event(1), event(2)], {"repeated start": 1}),
    "start after end": ([HEADER, event(1), event(2, phase="completed"), event(3)], {"repeated start": 1}),
    "two ends": ([HEADER, event(1), event(2, phase="completed"), event(3, phase="failed")], {"repeated end": 1}),
    "end alone": ([HEADER, event(1, phase="completed")], {"end without a start": 1}),
    "end first": ([HEADER, event(1, phase="completed"), event(2)], {"end without a start": 1}),
    "version": ([{**HEADER, "schema_version": 2}, event(1)], {"unknown version": 1}),
    "format": ([{**HEADER, "format": "another"}, event(1)], {"unknown format": 1}),
    "broken": ([HEADER, "{broken", event(1)], {"line is no JSON": 1}),
    "no event": ([HEADER, event(1), '{"record_type": "event", "sequence": 2}', event(3, "c2")], {"line is no event": 1}),
    "second header": ([HEADER, event(1), HEADER, event(2, "c2")], {"header within the events": 1}),
    "no header": ([event(1)], {"no header": 1}),
}


def test_broken_traces_have_their_problems(spark, tmp_path):
    for name, (lines, _) in BAD.items():
        write(tmp_path / f"{name.replace(' ', '-')}.jsonl", *lines)
    got = {}
    for r in trace_files.trace_problems(spark, str(tmp_path), form="agent-exploration", headed=True).collect():
        got.setdefault(r.file.rsplit("/", 1)[1].removesuffix(".jsonl").replace("-", " "), {})[r.problem] = r.n
    want = {name: dict(problems) for name, (_, problems) in BAD.items()}
    want["three faults"]["no header"] = 1
    assert got == want
    with pytest.raises(ValueError, match="repeated-sequence|two-ends|broken|falling"):
        trace_files.read_valid(spark, str(tmp_path / "two-ends.jsonl"))


def test_valid_traces_are_read(spark, tmp_path):
    write(tmp_path / "a.jsonl", *GOOD, '{"torn')
    write(tmp_path / "b.jsonl", *[{**x, "trace_id": "t2"} for x in GOOD], "", "  ")
    events, heads = trace_files.read_valid(spark, str(tmp_path), form="agent-exploration", headed=True)
    assert Counter(r.trace_id for r in events.collect()) == {"t1": 5, "t2": 5}
    assert sorted((r.trace_id, r.torn, r.events) for r in heads.collect()) == [("t1", True, 5), ("t2", False, 5)]
    assert trace_files.trace_problems(spark, str(tmp_path)).count() == 0


def sequential(lines):
    """The problems of a file by reading it line by line."""
    found, before, starts, ends = Counter(), 0, Counter(), Counter()
    for e in lines:
        if e["trace_id"] != "t1":
            found["mixed trace ids"] += 1
        if e["sequence"] <= before:
            found["repeated sequence" if e["sequence"] == before else "falling sequence"] += 1
        before = e["sequence"]
        if e["phase"] == "started":
            found["repeated start"] += starts[e["invocation_id"]] > 0
            starts[e["invocation_id"]] += 1
        else:
            found["end without a start"] += starts[e["invocation_id"]] == 0 and ends[e["invocation_id"]] == 0
            found["repeated end"] += ends[e["invocation_id"]] > 0
            ends[e["invocation_id"]] += 1
    return +found


def test_a_file_of_many_splits(spark, tmp_path, seed=1):
    """Faults at split borders and far apart; an invocation with most of the events."""
    rng = random.Random(seed)
    lines, at = [], 0
    for i in range(6000):
        at += rng.choice([1, 1, 1, 1, 2, 5, 0, -3]) if rng.random() < 0.02 else 1
        who = "hot" if rng.random() < 0.4 else f"c{rng.randrange(2500)}"
        lines.append(event(max(1, at), who, rng.choice(["started", "completed"]), "t1" if rng.random() < 0.999 else "t9"))
    path = write(tmp_path / "a.jsonl", HEADER, *lines)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        scanned = trace_files.scan(spark, path)
        assert scanned.select("start").distinct().count() > 40
        got = Counter()
        for r in trace_files.problems_of(scanned).collect():
            got[r.problem] += r.n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == sequential(lines)


def test_no_traces(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("")
    events, heads = trace_files.read_valid(spark, str(tmp_path))
    assert events.count() == 0 and heads.count() == 0
