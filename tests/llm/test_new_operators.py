"""Repair of conversations, importance resampling and packing against plain versions, and on odd rows."""

import itertools
import random
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import conversations, packing, queries, resampling
from tests.compare import SF
from tests.llm import plain

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
CONVERSATION = "conv_id long, turn long, role string, text string, step long, low string"


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def made(seed=5, conversations=60):
    r = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(r.choice([0, 1, 2, 5, 9, 30])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Yes.", "No!", "Why?", "so", "", " \n", None, f"Line {r.randint(0, 9)}.\n ", "Schön. é", "é "])
            rows.append((c if c else None, None if r.random() < 0.05 else t // r.choice([1, 1, 1, 2]), role, text))
    return rows + rows[3:5] + [(7, 3, "user", "word " * 40_000 + "."), (-1, -5, "user", "a."), (-1, 5, "user", "b.")]


def written(spark, rows, folder, name="conversations"):
    spark.createDataFrame([(*r, 0, "clash") for r in rows], CONVERSATION).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


AUDIT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversations(spark):
    with tempfile.TemporaryDirectory() as folder:
        for rows in (made(), []):
            written(spark, rows, folder)
            assert listed(queries.op11_conversation_repair(spark, folder), *AUDIT) == sorted(plain.audits(rows), key=str)


def test_conversations_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert listed(queries.op11_conversation_repair(spark, SF), *AUDIT) == sorted(plain.audits(rows), key=str)


def test_conversations_giant(spark):
    """Giant conversations have duplicates told by Spark; the result is the same."""
    rows = spark.createDataFrame([(*r, 0, "clash") for r in made(8)], CONVERSATION)
    few, many = (listed(conversations.audits(conversations.repair(rows, giant=g)), *AUDIT) for g in (3, 10**6))
    assert few == many and len(few) > 20


def brute_costs(rows):
    """The least (cost, edits) by trying all edits of a few rows."""
    found = None
    faults = []
    for i, (role, text) in enumerate(rows):
        faults.append("gone" if not text.strip() or (role, text) in rows[:i] else "cut" if text.strip()[-1] not in ".!?" else "")
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(f == "gone" and e != "D" for f, e in zip(faults, edits)):
            continue
        for holes in itertools.product(range(3), repeat=len(rows) + 1):
            # one way to fill: roles that may be chosen are tried as both
            slots = []
            for i in range(len(rows) + 1):
                slots += [("ua", 2, "I")] * holes[i]
                if i < len(rows):
                    e = edits[i]
                    slots.append(({"D": "", "K": rows[i][0][:1], "R": "ua"}[e], {"D": 3, "K": 0, "R": 2}[e] + (faults[i] == "cut" and e != "D"), e))
            cost = sum(s[1] for s in slots)
            if found and (cost, "".join(s[2] for s in slots)) >= found:
                continue
            states = {""}
            for choices, _, e in slots:
                if e != "D":
                    states = {to for s in states for c in choices for to in [{"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[s].get(c)] if to}
            if states & {"", "a"}:
                found = (cost, "".join(s[2] for s in slots))
    return found


@pytest.mark.parametrize("seed", range(12))
def test_conversation_costs_of_all_edits(seed):
    r = random.Random(seed)
    rows = [(r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b!", "c", ""])) for _ in range(r.randint(0, 4))]
    out = []
    one = conversations._Repair(1, out)
    for k, row in enumerate(rows):
        one.row(k, *row)
    one.end()
    audit = "".join(x[2] for x in out)
    cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[x[2]] + (x[7] == "truncated" and x[2] != "D") for x in out)
    assert (cost, audit) == brute_costs(rows)


@pytest.mark.parametrize("roles", [["tool"], ["user", "assistant"], ["user"], ["assistant", "tool", "system"]])
def test_conversation_waits_in_files(monkeypatch, roles):
    """Rows that no way agrees on wait in files, decided as if they had not."""
    r = random.Random(3)
    rows = [(k, r.choice(roles), r.choice([f"{k}.", f"{k}!", f"{k}"])) for k in range(5000)]
    whole = plain.repaired(rows)
    for spill, look in ((8 << 20, 512), (2000, 16), (100, 10**9)):
        monkeypatch.setattr(conversations, "SPILL", spill)
        monkeypatch.setattr(conversations, "LOOK", look)
        out = []
        one = conversations._Repair(1, out)
        for row in rows:
            one.row(*row)
        one.end()
        assert "".join(x[2] for x in out) == whole[6]
        assert [(x[4], x[5]) for x in out if x[2] != "D"] == whole[7]


WORDS = "Alpha beta, gamma-DELTA é ß x1 2 the of (to) été".split()


def corpus(seed=2, n=120):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    docs = [(k, r.choice([None, "", "..", text(3), text(19), text(20), text(60), text(300)])) for k in range(n)]
    return docs + [docs[50], docs[50], (None, text(40)), (9, text(33)), (n, text(90_000))], [text(12), None, "", text(30) + " nothing else"]


def test_resampling(spark):
    docs, target = corpus()
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, row string, rank int").repartition(5)
    items = spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string")
    for percent in (5, 40):
        got = resampling.resample(df, items, percent=percent)
        assert listed(got, "doc_id", "n_features", "weight", "score", "rank") == sorted(plain.resampled(docs, target, percent), key=str)
    picked = resampling.drawn(df, got)
    assert picked.columns == df.columns
    by_key = defaultdict(list)
    for (key, text), r in zip(docs, plain.resampled(docs, target, 40)):
        if r[4]:
            by_key[key].append(text)
    assert listed(picked, "doc_id", "text") == sorted(((k, t) for k, x in by_key.items() for t in x), key=str)
    none = resampling.resample(df.limit(0), items)
    assert none.count() == 0 and resampling.drawn(df, none).count() == 0
    assert resampling.resample(df, items.limit(0)).where("rank is not null").count() == 3


def test_resampling_whole_table(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    docs = [(r.doc_id, r.text) for r in read("documents").collect()]
    wanted = plain.resampled(docs, [r.text for r in read("benchmark").collect()])
    assert listed(queries.op12_importance_resampling(spark, SF), "doc_id", "n_features", "weight", "score", "rank") == sorted(wanted, key=str)


@pytest.mark.parametrize("orders", [1, 2, 3, 4])
def test_resampling_slices(monkeypatch, orders):
    """Slices of matches meet at any word, and orders may be others."""
    monkeypatch.setattr(resampling, "_SLICE", 5)
    for n in range(23):
        text = " ".join(WORDS[k % len(WORDS)] for k in range(n))
        words, buckets = resampling.features(text, orders, 1000)
        grams = plain._grams(text, orders)
        assert (words, list(buckets)) == (grams[0], sorted(resampling.crc32(g.encode()) % 1000 for g in grams[1]))


def check_pieces(rows, docs, ids_of, window, slack):
    """Pieces cover each document's ids once; sequences are gapless and hold little padding."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        documents[r.doc_id].append((r.start, tuple(ids), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    wanted = Counter()
    for key, text in docs:
        ids = (*ids_of(text or ""), 0)
        wanted[key] += len(ids)
        if sum(k == key for k, _ in docs) == 1:
            at = 0
            for start, part, total in sorted(documents[key]):
                assert start == at and part == ids[at : at + len(part)] and total == len(ids)
                at += len(part)
            assert at == len(ids)
    assert {k: sum(len(p[1]) for p in x) for k, x in documents.items()} == dict(wanted)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and packing.padding(at, window) <= slack


@pytest.mark.parametrize("group", [4096, 7])
def test_packing(spark, group):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    docs, _ = corpus()
    docs = docs + [(1000, "<|endoftext|> and  two\n\nlines \t ends "), (1001, "Ἀθῆναι 東京 ไทย 😀 Ᲊ\U0001f6dc x\x1dy")]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, start string, ids int").repartition(4)
    for window in (1024, 64):
        rows = packing.pack(df, BPE, window=window, group=group).collect()
        check_pieces(rows, docs, lambda t: whole.encode(t, add_special_tokens=False).ids, window, window // 64)
    assert packing.pack(df.limit(0), BPE).count() == 0


def test_packing_whole_table(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(df, BPE).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in df.collect()], lambda t: whole.encode(t, add_special_tokens=False).ids, 1024, 16)
    used = sum(r.length for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.sequence_id] += r.length
    assert sum(packing.padding(n, 1024) for n in sizes.values()) < used / 200
    got = queries.op13_packing(spark, SF)
    columns = ("doc_id", "start", "length", "sequence_id", "offset")
    assert listed(got, *columns) == sorted((tuple(r[c] for c in columns) for r in rows), key=str)
    assert got.schema["ids_crc32"].dataType.simpleString() == "bigint"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from(" \n\t\r\x1d ​'sabéЖ字1٣.,<|>endoftext"), max_size=40))
def test_packing_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    global _whole
    _whole = globals().get("_whole") or Tokenizer.from_file(BPE)
    assert list(packing.encoder(BPE)(text)) == _whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit(lengths):
    windows = packing.best_fit(lengths, 40)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert sorted(sum(lengths[i] for i in w) for w in windows) == plain.fitted(lengths, 40)
