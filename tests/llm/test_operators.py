"""The ten operators over a small table with every odd row, against plain Python."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from frostlake.llm import exact_dedup, fingerprints, hashed_text, html_extraction, mixing, packing, pii, quality, simhash, substring_dedup, textvec, toxicity, training
from frostlake.llm.components import components
from frostlake.llm.html_blocks import blocks

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS[i * i % 397] for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
TEXTS: list[tuple[int | None, str | None]] = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"), (6, LONG), (7, LONG), (7, LONG), (8, f"a b c {PASSAGE} x y z"),
    (9, f"{PASSAGE} tail words here"), (None, "null id text with some words"), (None, "null id text with some words"), (10, "One  Two\tthree four"), (11, "one two three four"),
    (12, " ".join(WORDS[:120])), (13, " ".join(WORDS[:119] + ["edited"])), (14, "é ß Ünï  x ✓ \U0001f600 emoji " * 3), (15, " ".join(["rep"] * 60)), (16, " ".join(["rep"] * 70)),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, norm int, rest int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 4 else "en", "src0", None, "clash", "clash", 1, 2) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return -1 if i is None else i


def test_exact_mark(docs, empty):
    got = exact_dedup.mark(docs).collect()
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    assert sorted((key(r.doc_id), r.text_sha256) for r in got) == sorted((key(i), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in TEXTS)
    groups: dict = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append(key(i))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v), len(v)) for k, v in groups.items()}
    assert all((key(r.keep_id), r.group_size) == want[r.text_sha256] for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.mark(empty).count() == 0


def test_exact_hot_group_over_many_parts(spark):
    rows = spark.range(900).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same  text', concat('text ', id % 50)) AS text")
    got = exact_dedup.mark(rows).toPandas()
    same = got[got.doc_id % 3 == 0]
    assert (same.keep_id == 0).all() and (same.group_size == 300).all() and got.kept.sum() == 51
    assert sorted(exact_dedup.distinct_rows(rows).toPandas().doc_id) == sorted(got[got.kept].doc_id)


def test_exact_runs_over_many_batches(spark):
    """Runs that go over batches and parts, of identifiers that are null or repeated too."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if i % 11 == 0 else i // 2, ("same", f"pair {i % 40}", f"own {i}")[i % 3]) for i in range(400)]
        got = exact_dedup.mark(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(key(i))
    assert sorted((key(r.doc_id), r.text_sha256) for r in got) == sorted((i, h) for h, v in groups.items() for i in v)
    assert all((key(r.keep_id), r.group_size) == (min(groups[r.text_sha256]), len(groups[r.text_sha256])) for r in got)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(groups) and all(key(r.doc_id) == key(r.keep_id) for r in kept)


def test_exact_distinct_rows_keep_columns(docs, empty):
    got = exact_dedup.distinct_rows(docs)
    assert got.columns == docs.columns and got.count() == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in TEXTS})
    assert exact_dedup.distinct_rows(empty).count() == 0


def substring_brute(rows, window=13):
    first: dict = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        out.append((key(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def test_substring(docs, empty):
    got = sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == substring_brute(TEXTS)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_hot_minimisers(spark, monkeypatch):
    rows = [(i, " ".join([f"u{i}_{j}" for j in range(i % 9)] + PASSAGE.split() + [f"v{i}_{j}" for j in range(20)])) for i in range(300)]
    seen = []
    real = substring_dedup._hot_minimisers
    monkeypatch.setattr(substring_dedup, "_hot_minimisers", lambda docs, w, m, share: seen.append(real(docs, w, m, 0.01)) or seen[-1])
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(seen[0]) > 0 and got == substring_brute(rows)


def test_substring_of_rows_without_identifiers(spark):
    rows = [(None if i % 3 else i, f"x{i} {PASSAGE} y{i % 5} {PASSAGE}") for i in range(60)]
    got = sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == substring_brute(rows)


def test_substring_finds_hot_minimisers_in_any_number_of_tasks(spark):
    rows = spark.range(400).selectExpr("id AS doc_id", f"encode(concat('u', id, ' v', id, ' w', id, ' {PASSAGE} x', id, ' y', id, ' z', id), 'UTF-8') AS text")
    found = [set(substring_dedup._hot_minimisers(rows.repartition(n), 13, 3, 0.02).tolist()) for n in (1, 3, 200)]
    assert len(found[0]) > 0 and all(f == found[0] for f in found)


def fingerprint_brute(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs, tile=4).collect()
    prints = [(i, fingerprint_brute(t)) for i, t in TEXTS]
    assert sorted((key(r.doc_id), r.fingerprint) for r in got) == sorted((key(i), f"{f:016x}") for i, f in prints)
    group = list(range(len(prints)))
    for _ in prints:
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least: dict = {}
    for g, (i, _) in zip(group, prints, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = {f"{f:016x}": least.get(g) for g, (_, f) in zip(group, prints, strict=True)}
    assert all(r.component_id == want[r.fingerprint] for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_of_a_giant_component(spark):
    """A third of all rows in one component, of many fingerprints, with repeated and null identifiers."""
    base = WORDS[:60]
    texts = [(None if i % 17 == 0 else 1000 - i // 2, " ".join([*base[: i % 30], "edit", *base[i % 30 + 1 :]]) if i % 3 == 0 else " ".join(WORDS[(i * 31 + k * k * 7) % 400] for k in range(30))) for i in range(150)]
    got = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), tile=16).collect()
    prints = [(i, fingerprint_brute(t)) for i, t in texts]
    group = list(range(len(prints)))
    for _ in range(8):
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least: dict = {}
    for g, (i, _) in zip(group, prints, strict=True):
        least[g] = min(least.get(g, 1 << 63), 1 << 63 if i is None else i)
    assert sorted((key(r.doc_id), r.fingerprint, key(r.component_id)) for r in got) == sorted((key(i), f"{f:016x}", -1 if least[g] == 1 << 63 else least[g]) for g, (i, f) in zip(group, prints, strict=True))


def test_simhash_tiles_find_all_links():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    near = base ^ (np.uint64(1) << r.integers(0, 63, 60).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 60).astype(np.uint64))
    u, v = simhash._links_of(np.sort(np.concatenate([base, near])), None, 4)
    joined = {tuple(sorted(x)) for x in zip(u.tolist(), v.tolist(), strict=True)}
    pairs = {tuple(sorted((int(a), int(b)))) for a, b in zip(base.view(np.int64), near.view(np.int64), strict=True) if a != b}
    assert pairs <= joined


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (1, 0)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(links.where("u < 0")).count() == 0


MARKS = "\u0300\u0301\u0307\u0308\u030a\u0327\u0331\u0345\u05b4\u093c\u0e31\u1161\u11a8\u3099\u20dd"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab cÉé \t\n1.,'!ſİ<|endoftx>", max_size=40), st.text(alphabet="aThWJISÅßσΣ\u1e97가각" + MARKS + " .'\x00\x1c\x85\u200d", max_size=12), st.text(max_size=12)), max_size=5))
def test_encoder_is_the_tokenizer(texts):
    encoder = packing._encoder(packing.vocabulary())
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(docs, empty):
    rows = packing.pack(docs, packing.vocabulary()).collect()
    encoder = packing._encoder(packing.vocabulary())
    by: dict = {}
    for r in rows:
        by.setdefault(key(r.doc_id), []).append(r)
    for i, t in TEXTS:
        ids = np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        times = sum(key(j) == key(i) for j, _ in TEXTS)
        own = sorted(by[key(i)], key=lambda r: r.start)[::times]
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in own)
    windows: dict = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, packing.vocabulary()).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 2047), min_size=1, max_size=80))
def test_windows_hold_everything_within_capacity(sizes):
    window = packing.windows_for(np.array(sizes))
    loads = np.bincount(window, sizes)
    assert len(window) == len(sizes) and loads.max() <= 2048


def test_differencing_evens_out():
    sizes = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(packing.divide(sizes, 2), sizes).tolist()) == [14, 16]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=12))
def test_differencing_of_two_is_the_textbook_one(sizes):
    left = sorted(sizes)
    while len(left) > 1:  # the two largest are put apart, and their difference stays
        left = sorted([*left[:-2], left[-1] - left[-2]])
    loads = np.bincount(packing.divide(np.array(sizes), 2), sizes, 2)
    assert abs(loads[0] - loads[1]) == left[0]


def test_windows_are_nearly_equal():
    r = np.random.default_rng(2)
    for windows in (3, 7, 20):
        sizes = r.integers(1, 65, 40 * windows)
        loads = np.bincount(packing.divide(sizes, windows), sizes, windows)
        assert loads.sum() == sizes.sum() and loads.max() - loads.min() <= 4


def test_fingerprints(docs, empty, spark):
    rows = [(i, t) for i, t in TEXTS if i is not None and i != 7]
    got = {r.doc_id: r for r in fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    down = sorted(rows, reverse=True, key=lambda x: x[0])
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.encode().lower().split()] for k in range(max(1, len(w) - 4)) if w}
    for n, (i, t) in enumerate(down):
        t, after = t or "", down[(n + 1) % len(down)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        for told, other in ((r.near_edited, new), (r.near_next, after)):
            a, b = shingles(t), shingles(other)
            true = 1.0 if not a | b else len(a & b) / len(a | b)
            assert abs(told - true) < (0.2 if len(a | b) > fingerprints.K else 1e-9)
    assert got[5].fingerprint == got[11].fingerprint and got[2].fingerprint == ""
    assert fingerprints.edited(docs).count() == len(TEXTS) and fingerprints.edited(empty).count() == 0


def test_fingerprints_of_much_repeated_ids(spark):
    """Rows of one identifier, and of none, go over several parts, and each still meets the one after it."""
    rows = [(5 if i % 3 == 0 else None if i % 3 == 1 else i, " ".join(WORDS[(i * 7 + k * k) % 400] for k in range(5 + i % 40))) for i in range(300)]
    got = fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    told = {t: fingerprints.encode(fingerprints.sketches(pa.array([t]))[0]) for _, t in rows}
    by = {f: t for t, f in told.items()}
    assert len(got) == 300 and len(by) == len({t for _, t in rows})
    # Each text is the next one's once, in descending order of identifiers; inside one the order is of the operator's choice.
    order = {i: n for n, i in enumerate(sorted({i for i, _ in rows}, key=lambda i: (i is None, -(i or 0))))}
    mine = {t: i for i, t in rows}
    sha = lambda t, u: hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()
    turns = 0
    for r in got:
        t = by[r.fingerprint]
        after = {mine[u] for _, u in rows if sha(t, u) == r.edited_sha256}
        step = {(order[i] - order[r.doc_id]) % len(order) for i in after}
        assert step & {0, 1}
        turns += not step & {0}
    assert turns <= len(order)


def test_sketches_of_many_keys_merge(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "KEYS", 3)
    rows = [(f"k{i % 7}" if i % 2 else "hot", fingerprints.encode(fingerprints.sketches(pa.array([f"a{i} b c d e f{i}"]))[0])) for i in range(60)]
    want: dict = {}
    for k, f in rows:
        want[k] = fingerprints.merge([want.get(k, np.zeros(0, np.uint64)), fingerprints.decode(f)])
    got = fingerprints.merged(spark.createDataFrame(rows, "k string, fingerprint string").repartition(3), "k").collect()
    assert {r.k: r.fingerprint for r in got} == {k: fingerprints.encode(x) for k, x in want.items()} and len(got) == len(want)


def test_sketches_merge_and_estimate(spark):
    a, b = (fingerprints.sketches(pa.array([" ".join(f"{p}{i}" for i in range(n))]))[0] for p, n in (("x", 3000), ("y", 1000)))
    both = fingerprints.merge([a, b])
    assert abs(fingerprints.distinct(both) - 3992) < 1200 and fingerprints.containment(b, both) > 0.7
    rows = spark.createDataFrame([("k", fingerprints.encode(a)), ("k", fingerprints.encode(b)), (None, "")], "k string, fingerprint string")
    got = {r.k: r.fingerprint for r in fingerprints.merged(rows, "k").collect()}
    assert got == {"k": fingerprints.encode(both), None: ""}


def test_pii_spans_and_redaction(spark, empty):
    texts = [(1, None), (2, "mail a@b.co or a@b.c%d@e.f, ip 10.0.0.256 1.2.3.4.5.6.7.8"), (3, "card 4111 1111 1111 1111 not 4111 1111 1111 1112, call +1 (555) 010-9999"), (4, "IBAN DE89 3704 0044 0532 0130 00 ssn: 219-09-9999"), (5, "219-09-9999 é@x.y ✓ b@c.d"), (6, " ".join(["a@b.co"] * 900))]
    found = pii.find(spark.createDataFrame(texts, "doc_id long, text string"))
    spans = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.spans] for r in found.collect()}
    assert spans[1] == [] and spans[2] == [("email", "a@b.co"), ("email", "a@b.c"), ("email", "%d@e.f"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8")]
    assert spans[3] == [("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    assert spans[4] == [("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "219-09-9999")]
    assert spans[5] == [("email", "b@c.d")] and spans[6] == [("email", "a@b.co")] * 900
    clean = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert clean[3] == "card [CARD] not 4111 1111 1111 1112, call [PHONE]" and clean[1] == ""
    assert pii.find(empty).count() == 0


def test_pii_context_moves_scores_over_the_threshold(spark):
    key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0ffeedd99"
    texts = [f"the api token = \"{key}\" is", f"commit {key} is", f"TOKEN {'x' * 60} {key}", "token aaaaaaaaaaaaaaaaaaaaaaaaaaaa11111", "my ssn: 219-09-9999", "part 219-09-9999", "call +49 (30) 123456-78", "no +49 (30) 123456-78"]
    got = {r.doc_id: [(s.kind, round(s.score, 6)) for s in r.spans] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: [("secret", 0.8)], 1: [], 2: [], 3: [], 4: [("ssn", 0.8)], 5: [], 6: [("phone", 0.9)], 7: [("phone", 0.6)]}


def test_pii_odd_rows(spark):
    text = "✓ a@b.co 1.2.3.4"
    schema = "doc_id long, text string, id string, m_email string, spans string, start int"
    long = "x " * 200_000 + "a@b.co " + "9" * 100_000
    rows = [(1, text, "clash", "clash", "clash", 1), (1, text, None, None, None, None), (None, text, None, None, None, None), (None, None, None, None, None, None), (2, long, None, None, None, None)]
    got = pii.find(spark.createDataFrame(rows, schema)).collect()
    assert sorted((key(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans]) for r in got if r.doc_id != 2) == [(-1, []), (-1, [("email", 2, 8), ("ip", 9, 16)]), (1, [("email", 2, 8), ("ip", 9, 16)]), (1, [("email", 2, 8), ("ip", 9, 16)])]
    assert [(s.kind, s.start, s.end) for r in got if r.doc_id == 2 for s in r.spans] == [("email", 400_000, 400_006)]


def test_pii_iban_before_other_words(spark):
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "FR1420041010050500013M02606"]
    after = [" Bank of X", " Please pay", " 2024-01-01", " A", ", B", "", " GB82WEST12345698765432"]
    rows = [(i * 10 + j, f"pay {x}{y}") for i, x in enumerate(ibans) for j, y in enumerate(after)] + [(90, "DE89370400440532013001 Bank"), (91, "DE893704004405320130001 x"), (92, "XDE89370400440532013000")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] for r in found.collect()}
    assert all(got[i * 10 + j] == [x] + ["GB82WEST12345698765432"] * (j == 6) for i, x in enumerate(ibans) for j in range(len(after)))
    assert got[90] == got[91] == got[92] == []
    assert {r.doc_id: r.text for r in pii.redact(found).collect()}[0] == "pay [IBAN] Bank of X"


def labelled(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(240):
        w = r.choice(WORDS, 40).tolist()
        if i % 3 == 0:
            w[int(r.integers(40))] = "nastyword"
        rows.append((i, " ".join(w) if i % 4 else " ".join(x + "%%%" for x in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 != 0)) for i in range(0, 240, 2)] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_toxicity(spark, docs, empty):
    r = np.random.default_rng(3)
    rows = [(i, " ".join([*r.choice(WORDS, 40).tolist(), *(["NastyWord!"] if i % 3 == 0 else [])])) for i in range(600)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 600, 2)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(own, toxicity.fitted(own, labels)).toPandas()
    held = got[got.doc_id % 2 == 1]
    assert ((held.score >= 0.5) == (held.doc_id % 3 == 0)).mean() > 0.98
    model = toxicity.fitted(empty, labels)
    odd = toxicity.score(docs, toxicity.fitted(own, labels)).toPandas()
    assert sorted(map(key, [None if np.isnan(x) else int(x) for x in odd.doc_id])) == sorted(key(i) for i, _ in TEXTS) and odd.score.between(0, 1).all()
    assert len({round(x, 9) for x, i in zip(odd.score, odd.doc_id, strict=True) if i in (1, 2, 3)}) == 1  # null, empty and blank: the bias
    assert toxicity.score(docs, model).count() == len(TEXTS) and toxicity.score(empty, model).count() == 0


def test_toxicity_by_skip_grams(spark):
    """The order of two words around a third tells the classes; words and neighbouring pairs don't."""
    r = np.random.default_rng(4)
    texts, labels = [], []
    for i in range(900):
        w = r.choice(WORDS[:60], 20).tolist()
        at = int(r.integers(2, 16))
        w[at], w[at + 2] = ("bad", "sign") if i % 2 else ("sign", "bad")
        texts.append(" ".join(w))
        labels.append(i % 2)
    held = pa.array(texts[600:])
    right = {}
    for skips in (True, False):
        bias, weights = toxicity._dense(toxicity.train(pa.array(texts[:600]), pa.array(labels[:600], pa.int32()), skips))
        right[skips] = np.mean((bias + hashed_text.linear(held, weights, toxicity.BITS, skips=skips) >= 0) == np.array(labels[600:]))
    assert right[True] > 0.97 and right[False] < 0.75


def test_training_is_ftrl_by_the_book():
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(WORDS[:30], int(r.integers(0, 12)))) for _ in range(80)]
    labels = [int("w3" in t.split()) for t in texts]
    rows = [dict(zip(c.tolist(), v.tolist(), strict=True)) | {1 << toxicity.BITS: 1.0} for c, v in hashed_text.matrix(pa.array(texts), toxicity.BITS)]
    z: dict = {}
    n: dict = {}

    def weight(i):
        l1 = 0.0 if i == 1 << toxicity.BITS else toxicity.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            own = {i: weight(i) for i in rows[k]}
            p = 1 / (1 + np.exp(-sum(own[i] * v for i, v in rows[k].items())))
            for i, v in rows[k].items():
                g = (p - labels[k]) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * own[i], n.get(i, 0.0) + g * g
    bias, weights = toxicity._dense(toxicity.train(pa.array(texts), pa.array(labels, pa.int32())))
    want = {i: weight(i) for i in z if i != 1 << toxicity.BITS and weight(i)}
    assert abs(bias - weight(1 << toxicity.BITS)) < 1e-4 and {i: w for i, w in want.items()}.keys() == set(np.flatnonzero(weights).tolist()) and len(want) > 0
    assert all(abs(weights[i] - w) < 1e-4 for i, w in want.items())


def test_one_row_of_each_labelled_identifier(spark):
    own = spark.createDataFrame([(1, f"t{i}") for i in range(50)] + [(2, "b"), (None, "c")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = training.labelled_sample(own, labels, "toxic", 100, "doc_id", "text").collect()
    assert sorted((r.label, r.text) for r in got) == [(0, "b"), (1, "t0")]


def test_quality(spark, docs, empty):
    own, labels = labelled(spark)
    model = quality.fitted(own, labels)
    got = quality.grade(own, model).select("row.doc_id", "expected_grade", "tail_probability").toPandas()
    assert ((got.tail_probability >= 0.5) == (got.doc_id % 4 != 0)).mean() > 0.95
    assert quality.select(docs, model).columns == docs.columns and quality.select(empty, model).count() == 0
    none = quality.fitted(empty, labels)
    assert quality.grade(docs, none).where("expected_grade = 0").count() == len(TEXTS)


def test_quality_of_odd_grades(spark, docs):
    """Grades are levels in their order, whatever numbers they are."""
    rows = [(i, " ".join([f"g{i % 3}"] * 5 + [WORDS[i]])) for i in range(150)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, (-7, 2, 2_000_000_000)[i % 3]) for i in range(150)] + [(0, None)], "doc_id long, quality int")
    model = quality.fitted(own, labels)
    got = quality.grade(own, model, wanted=2).select("row.doc_id", "expected_grade", "tail_probability").toPandas()
    assert ((got.tail_probability >= 0.5) == (got.doc_id % 3 > 0)).mean() > 0.9 and got.expected_grade.between(-7, 2e9).all()
    assert (quality.grade(own, model, wanted=-7).toPandas().tail_probability == 1).all() and (quality.grade(own, model, wanted=2_000_000_001).toPandas().tail_probability == 0).all()
    many = quality.train(pa.array([f"a{i}" for i in range(200)]), pa.array(range(0, 2000, 10), pa.int32()))
    assert len(quality._loaded(many)[0]) == quality.LEVELS
    assert quality.grade(docs, model).count() == len(TEXTS)


def test_quality_held_out(spark):
    """On the test tables: fitted without a fifth of the labels, which it then tells."""
    at = "/root/testdata/sf0.01"
    own, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = quality.fitted(own, labels.where("doc_id % 5 <> 0"))
    got = quality.grade(own.join(labels.where("doc_id % 5 = 0"), "doc_id"), model).selectExpr("row.quality AS quality", "tail_probability >= 0.5 AS good").toPandas()
    assert len(got) > 50 and (got.good == (got.quality == 1)).mean() > 0.95


def test_quality_grades_are_ordered(spark):
    rows = [(i, " ".join([f"g{i % 4}"] * 5 + [WORDS[i]])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4) for i in range(200)], "doc_id long, quality int")
    got = quality.grade(docs, quality.fitted(docs, labels), wanted=2).select("row.doc_id", "expected_grade", "tail_probability").toPandas()
    means = got.groupby(got.doc_id % 4).expected_grade.mean()
    assert means.is_monotonic_increasing and ((got.tail_probability >= 0.5) == (got.doc_id % 4 >= 2)).mean() > 0.9


def test_mixing_meets_targets(spark, docs, empty):
    rows = [(i, " ".join(f"{'ab'[i % 10 < 8]}{(i * 7 + k) % 60}" for k in range(30 + i % 9)), "ab"[i % 10 < 8]) for i in range(400)]
    own = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.classifier(own, own.where("doc_id % 2 = 0"), ["a", "b"])
    known = mixing.posteriors(own, model)
    rated = mixing.copies(mixing.rates(known, [0.5, 0.5])).toPandas()
    total = rated.tokens.sum()
    for p in ("p0", "p1"):
        assert abs((rated[p] * rated.tokens * rated.rate).sum() / total - 0.5) < 0.005
    assert (rated.rate >= 0).all() and ((rated.copies - rated.rate).abs() < 1).all()
    capped = mixing.rates(known, [0.3, 0.7], budget=0.6, most=1.0)
    mixed = mixing.mix(own, capped)
    assert mixed.columns == own.columns and 0 < mixed.count() < 400 and mixed.count() == mixed.distinct().count()
    odd = mixing.mix(docs, mixing.rates(mixing.posteriors(docs, model), [0.5, 0.5], most=1.0))
    assert odd.columns == docs.columns
    assert mixing.rates(mixing.posteriors(empty, model), [0.5, 0.5]).count() == 0


def best_rates(tokens, p, goal, most):
    """Of the same objective, by coordinate descent over the documents."""
    share, rate = tokens / tokens.sum(), np.ones(len(tokens))
    got = (share * rate) @ p
    for _ in range(4000):
        before = got.copy()
        for i in range(len(rate)):
            a = share[i] * p[i]
            new = np.clip(rate[i] - (a @ ((got - goal) / goal)) / (a @ (a / goal)), 0, most)
            got += (new - rate[i]) * a
            rate[i] = new
        if np.abs(got - before).max() < 1e-9:
            break
    return got


@pytest.mark.parametrize(("targets", "budget", "most"), [((0.4, 0.3, 0.2, 0.1), 1.0, None), ((0.1, 0.3, 0.3, 0.3), 1.0, 1.0), ((0.82, 0.08, 0.05, 0.05), 1.0, None)])
def test_rates_are_the_best_ones(spark, targets, budget, most):
    """Targets in reach, beyond the upper bound, and such that rates of other domains go down to nothing."""
    r = np.random.default_rng(11)
    scores = r.normal(0, 1, (120, 4))
    scores[np.arange(120), r.choice(4, 120, p=[0.6, 0.2, 0.1, 0.1])] += 3
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    tokens = r.integers(1, 400, 120)
    known = spark.createDataFrame([(i, int(t), *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "id long, tokens long, p0 double, p1 double, p2 double, p3 double").coalesce(2)
    rated = mixing.rates(known, list(targets), budget, most).orderBy("id").toPandas()
    goal = np.array(targets) * budget
    got = (rated.tokens.to_numpy() / tokens.sum() * rated.rate.to_numpy()) @ p
    want = best_rates(tokens.astype(float), p, goal, np.inf if most is None else most)
    cost = lambda x: ((x - goal) ** 2 / goal).sum() / 2
    assert rated.rate.min() >= 0 and (most is None or rated.rate.max() <= most)
    assert cost(got) <= 1.01 * cost(want) + 1e-5 and np.abs(got - want).max() < 0.005


def test_html_blocks_and_extraction(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/x>Menu</a></nav><!-- c --><div class='ad'>Buy this. Now.</div><article><h1>Head</h1><p><b>First &eacute;&amp;x<br>line.<p>Second\n  <i>part</i>y.</p><div class=comments><p>Nice one. Thanks.</p></div></article><script>var a='</p>'</script><footer>&copy; me</footer>"
    assert [b.text for b in blocks(page)] == ["Menu", "Buy this. Now.", "Head", "First é&x line.", "Second party.", "Nice one. Thanks.", "© me"]
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (2, "v", ""), (None, "w", "<p")], "page_id long, url string, html string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extraction.main_text(rows).collect()}
    want = "Head\nFirst é&x line.\nSecond party."
    assert got[1, "u"] == (want, len(want)) and got[2, None] == ("", 0) and got[2, "v"] == ("", 0)
    assert html_extraction.main_text(rows.limit(0)).count() == 0


def right_labels(model, pages):
    right = total = 0
    for page, content in pages:
        found = blocks(page)
        for b, y in zip(found, html_extraction.decode(model, html_extraction.features(found, model.index)), strict=True):
            right += y == int(b.text.replace(" & ", " ") in content or b.text in content)
            total += 1
    return right / total


def test_html_held_out_pages():
    assert right_labels(html_extraction.default_model(), html_extraction.training_pages(150, seed=77)) > 0.99


def test_html_neighbours_decide_where_markup_tells_nothing():
    model = html_extraction.default_model()
    alone = html_extraction.Model(model.index, model.weights, np.zeros((2, 2)), np.zeros(2))
    pages = list(html_extraction.training_pages(100, seed=78, unmarked=1.0))
    assert right_labels(model, pages) > 0.98 and right_labels(alone, pages) < 0.9


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 7))
def test_viterbi_is_the_best_of_all_sequences(seed, n):
    r = np.random.default_rng(seed)
    model = html_extraction.Model({f"f{i}": i for i in range(4)}, r.normal(0, 1, (5, 2)), r.normal(0, 1, (2, 2)), r.normal(0, 1, 2))
    rows = [[f"f{i}" for i in range(6) if r.random() < 0.5] for _ in range(n)]

    def score(labels):
        own = sum(model.weights[[*[model.index[f] for f in row if f in model.index], 4]].sum(axis=0)[y] for row, y in zip(rows, labels, strict=True))
        return own + model.opening[labels[0]] + sum(model.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))

    assert abs(score(html_extraction.decode(model, rows)) - max(score(x) for x in product((0, 1), repeat=n))) < 1e-9


def test_html_reads_tags_as_browsers_do():
    text = lambda page: [b.text for b in blocks(page)]
    assert text("<p>a <svg><title>no</title><text>no</text></svg> b <math><mi>x</mi><mo>=</mo><mn>2</mn></math> c</p>") == ["a b x=2 c"]
    assert text("<p>a<svg><g><p>b</p>") == ["a", "b"] and text("<object><p>in</p></object><template><p>no</p></template>x") == ["in", "x"]
    assert text("<script>a</script >b<style>c") == ["b"] and text('<p title="a > b">c</p><p x=\'>\'>d<a b="e>f') == ["c", "df"]
    assert text("a < b &lt;c&gt; <3 </x>d<!-- e") == ["a < b <c> <3", "d"]


def test_html_odd_pages_and_columns(spark):
    deep = "<div class=x>" * 30_000 + "<p>deep text</p>"
    line = "A sentence of some words, which goes on. And another one."
    wide = "<article>" + f"<p>{line}</p>" * 3000
    schema = "page_id long, url string, html string, id string, text string, n_chars string"
    rows = spark.createDataFrame([(1, "u", deep, "c", "c", "c"), (1, "u", wide, None, None, None), (None, None, None, None, None, None)], schema)
    began = time.time()
    got = html_extraction.main_text(rows).collect()
    assert time.time() - began < 60 and len(got) == 3 and max(r.n_chars for r in got) == 3000 * (len(line) + 1) - 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aé b\t\n\x0b✓", max_size=30)), max_size=8))
def test_words_are_those_of_split(texts):
    w = textvec.words(pa.array(texts, pa.string()))
    got = [[bytes(w.data[a:b]) for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]
    h = dict(zip([x for g in got for x in g], w.hashes().tolist(), strict=True))
    assert all(h[x] == y for x, y in zip([x for g in got for x in g], w.hashes().tolist(), strict=True))
