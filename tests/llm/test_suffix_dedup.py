import hashlib

import numpy as np
import pytest

from ledgerlens.llm import suffix_dedup as sd


def brute(rows):
    """Result per row, by a dictionary of all 100-byte strings; rows that repeat an id are one document."""
    first, out = {}, {}
    for d, t in sorted({(d, t or "") for d, t in rows if d is not None}):
        b = t.encode()
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 99):
            if first.setdefault(b[i:i + 100], (d, i)) < (d, i):
                mark[i] += 1
                mark[i + 100] -= 1
        gone = np.cumsum(mark[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, spans string")
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))) for r in sd.remove_repeats(sd.repeated_spans(frame)).collect()]


def texts(seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words, n))
    line, base = prose(30), prose(120)
    rows = [(100 - i, prose(rng.integers(0, 60)) + line + prose(rng.integers(0, 60))) for i in range(30)]
    for i in range(12):
        parts = base.split()
        parts[rng.integers(len(parts))] = "zzz"
        rows.append((200 + i, " ".join(parts)))
    rows += [(300, base), (301, base), (302, "ab" * 400), (303, "x" * 99), (304, "x" * 100), (305, "x" * 101), (306, "Wher. " * 60 + "Th " * 90),
             (307, None), (308, ""), (309, (prose(50) + " ") * 3)]
    return rows


@pytest.mark.parametrize("leaf", [1024, 2])
def test_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(sd, "LEAF", leaf)
    rows = texts(leaf)
    rows += [rows[3], rows[-3]]                       # repeated rows are one document
    want = brute(rows)
    assert sorted(run(spark, rows)) == sorted((d, want[d]) for d, _ in rows)


def test_without_broadcast_and_with_far_ids(spark, monkeypatch):
    monkeypatch.setattr(sd, "BROADCAST_ROWS", 0)
    rows = [((-1) ** i * (1 << 60) + i, t) for i, (_, t) in enumerate(texts(5))]
    want = brute(rows)
    assert sorted(run(spark, rows)) == sorted((d, want[d]) for d, _ in rows)


def test_nulls_and_empty_tables(spark):
    text = "z" * 150
    empty = hashlib.sha256(text.encode()).hexdigest()
    got = run(spark, [(None, text), (None, text)])
    assert got == [(None, (150, 0, 0, empty, text.encode()))] * 2
    assert run(spark, []) == []
    assert run(spark, [(1, "short"), (2, "short")])[0][1][:3] == (5, 0, 0)


def test_cut_runs_of_one_letter():
    data = np.frombuffer(b"a" * 1000, np.uint8)
    h, context, start, size, periodic = sd.samples(data)
    assert size.sum() == 901 and size.max() <= sd.PIECE and periodic.all() and len(set(h.tolist())) == 1
