"""Substring operators against brute force on small corpora with repeats, ties, nulls and clashing columns."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest

from tickloom.llm import overlaps, spans, suffixes


def corpus(letters, piece, seed=5):
    draw = random.Random(seed)
    make = lambda n: piece.join(draw.choice(letters) for _ in range(n))
    shared = [make(150 if not piece else 60) for _ in range(5)]
    rows = []
    for i in range(250):
        parts = [draw.choice([make(draw.randint(0, 40)), draw.choice(shared), "x" * draw.randint(0, 200), "a b " * draw.randint(0, 40), draw.choice(shared)[draw.randint(0, 60) :]]) for _ in range(draw.randint(0, 4))]
        rows.append((i, draw.choice([" ", "\n", " \t "]).join(parts) if draw.random() > 0.05 else None))
    rows[7] = (7, rows[6][1])
    return rows


def table(spark, rows):
    """Columns named as the operators' own ones must not disturb them."""
    return spark.createDataFrame([(k, t, "k", 1, None) for k, t in rows], "doc_id bigint, text string, key string, part int, codes string").repartition(4)


def words_without(rows, window):
    texts = {k: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for k, t in rows}
    seen = collections.Counter(tuple(w[i : i + window]) for w in texts.values() for i in range(len(w) - window + 1))
    for k, w in texts.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()


def bytes_without(rows, window):
    seen = set()
    for k, t in sorted(rows):
        body = (t or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - window + 1):
            if body[i : i + window] in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(body[i : i + window])
        kept = bytes(x for x, g in zip(body, gone, strict=True) if not g)
        yield k, len(body), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("window,gram", [(35, 11), (12, 4), (6, 3)])
def test_word_spans(spark, window, gram):
    rows = corpus("abcdefghij", " ")
    assert sorted(map(tuple, spans.span_report(table(spark, rows), window, gram).collect())) == sorted(words_without(rows, window))


@pytest.mark.parametrize("window,gram", [(100, 36), (20, 9), (7, 3)])
def test_byte_suffixes(spark, window, gram):
    rows = corpus("abcdefghijé", "")
    assert sorted(map(tuple, suffixes.byte_report(table(spark, rows), window, gram).collect())) == sorted(bytes_without(rows, window))


def test_a_line_in_many_surroundings_is_spread(spark, monkeypatch):
    draw = random.Random(8)
    make = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    line, long_line = make(30), make(40)
    rows = [(i, f"{make(5)} {line} {make(5)}") for i in range(600)]
    rows += [(1000 + i, f"{make(5)} {long_line} {make(5)}") for i in range(100)]
    rows += [(2000 + i, rows[i][1]) for i in range(0, 600, 50)] + [rows[3], rows[3]]
    exchanged, deal = [], type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, *a: exchanged.append(self) or deal(self, *a))
    df = table(spark, rows)
    exchanged.clear()
    got = sorted(map(tuple, spans.span_report(df).collect()))
    truth = dict((r[0], r) for r in words_without([(i, t) for i, (_, t) in enumerate(rows)], 35))
    assert got == sorted((rows[i][0], *r[1:]) for i, r in truth.items())
    for sent, kinds in zip(exchanged, (["u8", "u8", "i8", "u4", "u1"], ["u8", "u8", "i8", "i8", "i8", "u1"]), strict=True):
        load = collections.Counter()
        for r in sent.collect():
            columns = overlaps.unsqueeze(r.blob, kinds)
            load[r.part] += int((columns[-1] > 0).sum())  # records to compare
        assert max(load.values()) < 0.45 * sum(load.values())


def test_byte_lines_in_many_surroundings_fill_no_range(spark, monkeypatch):
    draw = random.Random(9)
    make = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    line, passage = make(70), make(170)
    rows = [(i, f"{make(150)}{line}{make(150)}") for i in range(500)]
    rows += [(1000 + i, f"{make(80)}{passage}{make(80)}") for i in range(300)]
    rows += [(2000 + i, rows[i][1][20:]) for i in range(0, 800, 20)] + [(3000, passage[30:]), (3001, passage * 3), (None, line + line)]
    monkeypatch.setattr(suffixes, "RANGE", 256)
    dealt, sent, deal = [], [], type(spark.range(0)).repartition
    ranges = suffixes.ranges
    monkeypatch.setattr(suffixes, "ranges", lambda *a: dealt.append(ranges(*a)) or dealt[-1])
    df = table(spark, rows)
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, *a: sent.append(self) or deal(self, *a))
    got = [tuple(r) for r in suffixes.byte_report(df).collect()]
    truth = bytes_without([(-1 if k is None else k, t) for k, t in rows], 100)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(truth)
    assert len(dealt[0].wide) and len(dealt[0].windows) > 4
    load = collections.Counter()
    for part, blob in sent[-1].collect():
        if blob[:1] == b"\0":
            load[part] += len(suffixes._unpack(blob[1:])[1])
    assert max(load.values()) <= 3 * suffixes.RANGE < sum(load.values()) / 8


@pytest.mark.parametrize("rate", [1, 7])
def test_a_thin_sample_changes_no_result(spark, monkeypatch, rate):
    rows = corpus("abcdefghijé", "", seed=11)
    monkeypatch.setattr(suffixes, "SAMPLE", 700 // rate)
    monkeypatch.setattr(suffixes, "RANGE", 8)
    assert sorted(map(tuple, suffixes.byte_report(table(spark, rows)).collect())) == sorted(bytes_without(rows, 100))


def test_texts_with_repeats_cut_out(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, f"one\n two {shared}\nthree"), (2, f"{shared}"), (3, " own  text\n")]
    got = {r.doc_id: (r.text, r.changed, r.lang) for r in spans.without_repeats(spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string"), carry=("lang",)).collect()}
    assert got == {1: ("one\n two three", True, "en"), 2: ("", True, "en"), 3: (" own  text\n", False, "en")}


def test_merge_of_runs_keeps_shared_lengths():
    draw = random.Random(1)
    strings = sorted("".join(draw.choice("ab") for _ in range(draw.randint(0, 9))).encode() for _ in range(200))
    parts = [sorted(strings[i::7]) for i in range(7)]
    runs, tag = [], 0
    for part in parts:
        shared, body = suffixes.front_code(part)
        runs.append(suffixes._decode(shared, np.array([len(x) for x in part]), body, tag))
        tag += len(part)
    out, lengths, tags = suffixes.merge_runs(runs)
    assert out == strings and sorted(tags) == list(range(200))
    assert lengths[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(out, out[1:])]


@pytest.mark.parametrize("report", [spans.span_report, suffixes.byte_report])
def test_empty_tables(spark, report):
    assert report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_ids_and_equal_rows(spark):
    text = "z" * 150
    got = suffixes.byte_report(spark.createDataFrame([(None, text), (5, text), (5, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 150), (False, 150), (True, 149)]
