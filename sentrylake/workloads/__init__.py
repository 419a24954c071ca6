"""Registered queries over the given tables."""

from __future__ import annotations


def all_cases():
    from sentrylake.workloads import cases, ingest, mail, net, packets, streams, windows
    out = []
    for module in (net, windows, packets, mail, ingest, cases, streams):
        out.extend(module.CASES)
    names = [c.name for c in out]
    assert len(names) == len(set(names)), "duplicate query names"
    return out
