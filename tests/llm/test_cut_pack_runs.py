"""Rearranged, packed and periodic texts: exact round trips, the tokenizer itself and brute force, and odd rows."""

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm import fill_in_middle, packing, periodic_runs
from tallyline.llm.blocks import flat, tokenizer_file

LONG = "the cat sat on the mat\nand then it went to sleep for a while.\n" * 4000
ODD = [
    (1, "one line\nand another\n\nand the last without an end"),
    (1, "one line\nand another\n\nand the last without an end"),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, " \n\t \n"),
    (None, "no number\nhere é\n"),
    (6, "é" * 40_000 + "\u0000 \U0001f600 ▁ ſK İ\nx"),
    (7, "a <P> mark\nin the text"),
    (8, "\n" * 70_000),
    (9, "ends with <\nS>\n<S\n"),
]
CLASH = ("n", "form", "frames", "output", "piece", "start", "length", "ids", "offset", "sequence_id", "runs", "collapsed", "n_runs", "period", "_nth")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit(-1) for c in CLASH} | {"own": F.lit("kept")}).persist()


def parts_of(text, doc_id, seed=7):
    """Form, prefix, middle and suffix by plain slicing of all lines."""
    units = [x for x in text.split("\n")]
    units = [u + "\n" for u in units[:-1]] + ([units[-1]] if units[-1] else [])
    s = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) else "spm" if h[3] % 100 < 50 else "psm"
    return len(units), form, "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


@pytest.mark.parametrize("size", [8, 1 << 15])
def test_rearranged_texts_equal_plain_slicing(odd, size):
    out = fill_in_middle.transformed(fill_in_middle.stored(odd, size=size))
    assert {"own", "piece"} <= set(out.columns)
    rows = out.collect()
    texts = {d: t or "" for d, t in ODD}
    assert len(rows) == len(ODD)
    for r in rows:
        n, form, prefix, middle, suffix = parts_of(texts[r["doc_id"]], r["doc_id"])
        plain = form == "plain"
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, None if plain else len(prefix), None if plain else len(middle))
        made = {"plain": texts[r["doc_id"]], "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        assert r["output"] == made and r["restored"] == texts[r["doc_id"]] and r["own"] == "kept"
    assert fill_in_middle.transformed(fill_in_middle.stored(odd.where("false"))).count() == 0


def test_digests_are_those_of_the_texts(odd):
    store = fill_in_middle.stored(odd)
    whole = {(r["doc_id"], r["output"]): r for r in fill_in_middle.transformed(store).collect()}
    for r in fill_in_middle.transformed(store, full=False).collect():
        assert any(d == r["doc_id"] and hashlib.sha256(o.encode()).hexdigest() == r["output_sha256"] for d, o in whole)
    assert {r["form"] for r in fill_in_middle.transformed(store, rate=0).collect()} == {"plain"}
    assert "psm" not in {r["form"] for r in fill_in_middle.transformed(store, spm_rate=100).collect()}


def test_frames_find_units_and_marks_across_their_edges():
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = "".join(rng.choice(["é", "x", "\n", "<", "S", ">", "\U0001f600"], int(rng.integers(0, 80)))).encode()
        f = fill_in_middle.Frames.of([text[:7], text[7:]] if text[:7].decode(errors="ignore").encode() == text[:7] else [text], size=int(rng.integers(4, 12)))
        lines = text.decode().split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        assert f.units == len(lines) and b"".join(f.stream(0, f.size)) == text and f.find(b"<S>") == text.find(b"<S>")
        for k in range(len(lines) + 1):
            head = "".join(lines[:k])
            assert f.after(k) == (len(head.encode()), len(head))
        a, b = sorted(rng.integers(0, len(text) + 1, 2).tolist())
        assert b"".join(f.stream(a, b)) == text[a:b]


def held(plan):
    """Length and place of every piece of a plan by (length, rank)."""
    out = {}
    for length, rank, n, sequence, each, offset in plan.runs:
        for i in range(n):
            assert (length, rank + i) not in out
            out[length, rank + i] = (sequence + i // each, offset + i % each * length)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_plans_place_every_piece_once_without_gaps(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 60))
    counts = {int(s): int(rng.integers(1, 60)) for s in rng.integers(1, capacity + 1, int(rng.integers(0, 9)))}
    plan = packing.planned(counts, capacity)
    places = held(plan)
    assert set(places) == {(s, r) for s, n in counts.items() for r in range(n)}
    by = defaultdict(list)
    for (length, _), (sequence, offset) in places.items():
        by[sequence].append((offset, length))
    assert sorted(by) == list(range(plan.sequences))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1].tolist()] and sum(n for _, n in x) <= capacity


def first_fit(counts, capacity):
    """Sequences of first fit by falling length, piece by piece."""
    rooms = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        k = next((k for k, r in enumerate(rooms) if r >= s), None)
        if k is None:
            rooms.append(capacity - s)
        else:
            rooms[k] -= s
    return len(rooms)


def test_plans_are_near_the_least():
    rng = np.random.default_rng(5)
    spread = {int(s): int(n) for s, n in zip(*np.unique(np.minimum(np.exp(rng.normal(6.4, 1.1, 4000)).astype(int) + 1, 4096), return_counts=True), strict=True)}
    assert packing.planned(spread).sequences == -(-sum(s * n for s, n in spread.items()) // 4096)
    few = {1366: 600, 1365: 300, 700: 900, 1330: 900}  # 1366 + 1330 + 1365, 1366 + 1330 + 1330 and the like leave little; falling lengths alone waste more
    assert packing.planned(few).sequences <= first_fit(few, 4096)
    assert packing.planned({4096: 7}).sequences == 7 and packing.planned({}).sequences == 0 and packing.planned({2048: 1001}).sequences == 501
    three = {44: 500, 36: 500, 20: 500}  # whole by configurations alone: falling lengths pair 44 with 44
    assert packing.planned(three, 100).sequences == 500 < first_fit(three, 100)


def test_packed_pieces_are_the_tokenizers(odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = packing.placed(packing.pieces(odd, "word_bpe_49k.json", capacity=500), capacity=500).repartition(3)
    got = rows.collect()
    want = sorted((d is None, d or 0, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t in ODD)
    by, placed = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) and r["length"] == len(r["ids"]) and r["start"] == 500 * r["piece"]
        by[r["doc_id"], r["piece"]].append(r["ids"])
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in dict(ODD).items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 500):
            assert all(x == ids[k : k + 500] for x in by[d, k // 500]) and len(by[d, k // 500]) == sum(e == d for e, _ in ODD)
    assert sum(r["length"] for r in got) == sum(len(w[2]) for w in want)
    for x in placed.values():
        x.sort()
        assert [o for o, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1].tolist()] and sum(n for _, n in x) <= 500
    ranked = packing.placed(packing.pieces(odd, "word_bpe_49k.json", capacity=500, ranked=True), capacity=500)
    assert ranked.columns == rows.columns and ranked.select("sequence_id").distinct().count() == len(placed)
    whole = packing.sequences(rows)
    assert whole.count() == len(placed) and whole.agg(F.sum(F.size("ids"))).first()[0] == sum(len(w[2]) for w in want)
    assert packing.placed(packing.pieces(odd.where("false"), "word_bpe_49k.json")).count() == 0


def test_ranks_over_many_tasks_and_one_hot_length(spark):
    rows = spark.range(0, 30_000, 1, 13).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(90))).cast("long").alias("length"), F.lit(0).alias("offset"))
    out = packing.placed(rows, capacity=100).collect()
    assert sorted(r["id"] for r in out) == list(range(30_000))
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1].tolist()] and sum(n for _, n in x) <= 100
    assert len(by) <= 1.02 * sum(r["length"] for r in out) / 100


def brute_runs(words, least=6, exponent=4):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and all(any(words[x] != words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def without(words, run_list):
    gone = {x for s, n, q in run_list for x in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_texts(rng, n):
    out = []
    for _ in range(n):
        parts = []
        for _ in range(int(rng.integers(0, 5))):
            base = list(rng.choice(["a", "b", "c", "dé"], int(rng.integers(1, 8))))
            again = base * int(rng.integers(1, 9))
            parts += again[: len(again) - int(rng.integers(0, len(base)))] + list(rng.choice(["a", "b", "x"], int(rng.integers(0, 3))))
        out.append(str(rng.choice([" ", "\n", " \t"])).join(parts) + str(rng.choice(["", "\n", " "])))
    return out


@pytest.mark.parametrize("least,exponent", [(6, 4), (4, 2), (2, 2), (9, 3)])
def test_runs_equal_brute_force(least, exponent):
    rng = np.random.default_rng(least)
    for _ in range(60):
        docs = periodic_texts(rng, 20)
        data, offsets = flat(pa.array(docs, pa.large_string()))
        block = periodic_runs.Block(data, offsets, list(range(20)), None, least, exponent)
        for text, got, collapsed in zip(docs, block.runs, block.collapsed(), strict=True):
            want = brute_runs(text.split(), least, exponent)
            assert got == want and collapsed.decode() == without(text.split(), want)


def test_digests_of_changed_texts_equal_brute_force(spark):
    docs = list(enumerate(periodic_texts(np.random.default_rng(9), 300) + ["one two three four five six seven eight nine ten eleven twelve " * 9] * 60))
    out = periodic_runs.detected(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), full=False, change=periodic_runs.tail)
    texts, n_changed = dict(docs), 0
    for r in out.collect():
        words = texts[r["doc_id"]].split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            n_changed += 1
        found = brute_runs(words)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if found else None
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(found), *best, milli)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(without(words, found).encode()).hexdigest()
    assert n_changed > 20


def test_runs_on_odd_rows(odd):
    got = {r["doc_id"]: r for r in periodic_runs.detected(odd).collect()}
    assert set(got) == {d for d, _ in ODD} and got[1]["own"] == "kept" and "text" not in got[1]
    assert got[2]["runs"] == [] and got[2]["collapsed"] == got[3]["collapsed"] == got[5]["collapsed"] == got[8]["collapsed"] == ""
    line = LONG.split()
    assert [tuple(r) for r in got[4]["runs"]] == [(0, len(line), len(line) // 4000)] and got[4]["collapsed"] == " ".join(line[: len(line) // 4000])
    assert periodic_runs.detected(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.detected(odd, exponent=1)
