"""The pipeline's stages on a small corpus: each works on what the one before kept, and its decisions hold."""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from frostlake.llm import mixing, near_copies, packing, quality, simhash


def corpus(spark, path):
    r = np.random.default_rng(5)
    languages = {"en": "the of and to", "fr": "le la des pour", "de": "der die und mit", "es": "el los que por"}
    rows = []
    for i in range(160):
        lang = (["en"] * 12 + ["fr"] * 3 + ["de"] * 3 + ["es"] * 2)[i * 7 % 20]  # near the wanted shares
        words = [w + str(int(r.integers(50))) if r.random() < 0.6 else w for w in r.choice(languages[lang].split(), 60)]
        text = " ".join(words)
        if i % 10 == 3:
            text = " ".join(w + "%%%" for w in words)
        rows.append([i, text, lang, f"src{i % 3}", len(text)])
    rows[41][1], rows[81][1] = rows[1][1], rows[1][1].replace(" ", "  ", 3)  # exact copies of 1
    long = " ".join(f"unique{k}" for k in range(900))
    rows[5][1], rows[45][1] = long, long.replace("unique450", "changed", 1)  # near copies
    rows += [[None, "no identifier here but words of the", "en", None, None], [200, None, None, None, None]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(x) for x in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    path = f"file://{tmp_path}"
    corpus(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept, columns = [docs], docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], path).write.parquet(f"{path}/stage{n}")
        kept.append(spark.read.parquet(f"{path}/stage{n}"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing", "packing"]
    assert all(k.columns == columns for k in kept[:-1])
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    # Rejected by the classifier: just the rows that the operator rejects; the spoilt ones are, clean ones are not.
    model = quality.fitted(docs, spark.read.parquet(f"{path}/labels.parquet"))
    graded = {r.doc_id: r.tail_probability for r in quality.grade(docs, model, carry=["doc_id"]).select("row.doc_id", "tail_probability").collect()}
    assert ids[1] == {i for i, p in graded.items() if p >= 0.5}
    assert not {i for i in ids[1] if i is not None and i < 160 and i % 10 == 3} and {1, 5, 41, 45, 81} <= ids[1]
    # Of equal texts the smallest identifier stays.
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    first: dict = {}
    for r in sorted(kept[1].collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        first.setdefault(norm(r.text), r.doc_id)
    assert ids[2] == set(first.values()) and 41 not in ids[2] and 81 not in ids[2] and 1 in ids[2]
    # Of linked documents the smallest identifier stays.
    prints = [(r.doc_id, simhash.fingerprint_of((r.text or "").encode())) for r in kept[2].collect()]
    linked = {a for a, x in prints for b, y in prints if a is not None and b is not None and b < a and (x ^ y).bit_count() <= simhash.RADIUS}
    assert ids[3] == ids[2] - linked and 45 in linked and None in ids[3]
    # Mixing repeats nothing and leaves most.
    assert kept[4].count() == kept[4].distinct().count() and len(ids[4]) > 0.6 * len(ids[3])
    # All ids of what is left are packed.
    encoder = packing._encoder(packing.vocabulary())
    want = sum(len(encoder.encode(r.text or "")) // 4 + 1 for r in kept[4].collect())
    assert kept[5].agg({"length": "sum"}).first()[0] == want and ids[5] == ids[4]


def fitted_shares(tokens, p, goal, n=20_000):
    """Expected shares of tokens of the bounded least-squares rates, by accelerated projected gradient on all documents."""
    share = tokens / tokens.sum()
    step = 1 / np.linalg.eigvalsh((p * share[:, None]).T @ p / np.sqrt(np.outer(goal, goal))).max()
    rate = ahead = np.ones(len(tokens))
    k = 1.0
    for _ in range(n):
        new = np.clip(ahead - step * (p @ (((share * ahead) @ p - goal) / goal)), 0, 1)
        if (ahead - new) @ (new - rate) > 0:
            k = 1.0
        after = (1 + np.sqrt(1 + 4 * k * k)) / 2
        ahead, rate, k = new + (k - 1) / after * (new - rate), new, after
    return (share * rate) @ p


def check_fit(rated):
    p, tokens = rated[["p0", "p1", "p2", "p3"]].to_numpy(), rated.tokens.to_numpy(float)
    goal = np.array(list(corpus_pipeline.MIX.values())) * corpus_pipeline.BUDGET
    got = (tokens / tokens.sum() * rated.rate.to_numpy()) @ p
    want = fitted_shares(tokens, p, goal)
    assert want[0] < 0.75 * goal[0] and np.abs(got / goal - want / goal).max() < 0.002


def test_rates_are_the_bounded_fit_of_every_domain(spark):
    r = np.random.default_rng(7)
    domain, scores = r.choice(4, 400, p=[0.4, 0.2, 0.2, 0.2]), r.normal(0, 1, (400, 4))
    scores[np.arange(400), domain] += 3
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    known = spark.createDataFrame([(i, int(r.integers(20, 400)), *map(float, x)) for i, x in enumerate(p)], "id long, tokens long, p0 double, p1 double, p2 double, p3 double")
    check_fit(mixing.rates(known, list(corpus_pipeline.MIX.values()), corpus_pipeline.BUDGET, most=1.0).toPandas())


def test_mixing_with_targets_out_of_reach(spark, tmp_path):
    languages = {"en": "the of and to", "fr": "le la des pour", "de": "der die und mit", "es": "el los que por"}
    r = np.random.default_rng(6)
    mixed = [w for x in languages.values() for w in x.split()]
    rows = []
    for i in range(160):
        lang = list(languages)[i % 4]  # equal languages: the target of en cannot be met
        rows.append((i, " ".join(r.choice(languages[lang].split() if r.random() < 0.6 else mixed) for _ in range(40 + i % 30)), lang, f"src{i % 3}", 0))
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = mixing.classifier(docs, docs.select("doc_id", F.col("lang").alias("domain")), list(corpus_pipeline.MIX))
    rated = mixing.rates(mixing.posteriors(docs, model), list(corpus_pipeline.MIX.values()), corpus_pipeline.BUDGET, most=1.0).toPandas()
    check_fit(rated)
    kept = corpus_pipeline.mix_sources(spark, docs, path)
    assert kept.count() == kept.distinct().count() == mixing.copies(spark.createDataFrame(rated)).where("copies > 0").count()


#: Mixing, the fourth stage, in a process of its own: heaps are a process's.
IN_A_SMALL_HEAP = """
import json, sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
import corpus_pipeline

path = sys.argv[1]
conf = {"spark.driver.memory": "512m", "spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": path}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{path}/documents.parquet"), path).write.parquet(f"{path}/mixed")
print(json.dumps(spark.read.parquet(f"{path}/mixed").agg(F.count("*"), F.sum(F.length("text"))).first()))
"""


def test_long_texts_are_read_in_a_small_heap(spark, tmp_path):
    # One file whose 4,096 texts of 64 KB are more than half of the heap; all in the language wanted most, so that few are left out.
    path = f"file://{tmp_path}"
    rows = spark.range(4096, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("the "), F.lpad("id", 4092, "x")), 16).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(65536).cast("long").alias("n_chars"))
    rows.write.parquet(f"{path}/documents.parquet")
    rows.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{path}/labels.parquet")
    done = subprocess.run([sys.executable, "-c", IN_A_SMALL_HEAP, path], env={k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    count, size = json.loads(done.stdout.splitlines()[-1])
    assert size == count * 65536 and 0.5 * 4096 < count <= 4096


def edited(r, words, n):
    words = list(words)
    for at in r.choice(len(words), n, replace=False):
        words[at] = f"edit{r.integers(10**6)}"
    return words


def test_near_copies_are_those_of_similarity(spark):
    r = np.random.default_rng(8)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in r.integers(0, 500, int(r.integers(60, 500)))]
        texts += [base] + [edited(r, base, int(r.integers(0, max(2, len(base) // 25)))) for _ in range(3)]
    texts += [edited(r, texts[0], 1) for _ in range(200)] + [[], ["one", "two"], ["One", "two"], ["one", "three"]]
    sets = [{tuple(w.lower() for w in t[k : k + 5]) for k in range(max(1, len(t) - 4)) if t} for t in texts]
    group = list(range(len(texts)))
    for _ in range(6):
        for a, x in enumerate(sets):
            for b in range(a):
                if group[a] != group[b] and (x == sets[b] or len(x & sets[b]) >= 0.8 * len(x | sets[b])):
                    group[a] = group[b] = min(group[a], group[b])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    left = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert left == {i for i, g in enumerate(group) if i == g} and 60 < len(left) < 200
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_one_row_of_each_group_of_near_copies(spark):
    r = np.random.default_rng(9)
    a, b, c, d = ([f"w{x}" for x in r.integers(0, 500, 200)] for _ in range(4))
    rows = [(3, a), (5, edited(r, a, 1)), (5, b), (7, c), (7, edited(r, c, 1)), (None, d), (None, edited(r, d, 1)), (None, edited(r, a, 1)), (9, c)]
    docs = spark.createDataFrame([(i, " ".join(t), 1) for i, t in rows], "doc_id long, text string, row int")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    got = [(x.doc_id, x.text.split()) for x in left.collect()]
    assert sorted(str(i) for i, _ in got) == ["3", "5", "7", "None"] and (3, a) in got and (5, b) in got


def test_empty_tables_and_repeated_identifiers(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("same", [(1, f"the {i} of and to words of its own {i * i}", "en", "s", 1) for i in range(6)] + [(None, None, None, None, None)] * 2)):
        path = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, path)
        assert docs.count() == (7 if rows else 0)  # texts of one identifier are documents of their own
        assert corpus_pipeline.run(spark, path).count() <= docs.count()


def test_forests_span_what_links_join():
    r = np.random.default_rng(3)
    for _ in range(30):
        size = int(r.integers(2, 40))
        u, v, apart = r.integers(0, size, 60), r.integers(0, size, 60), r.random(60).round(1)

        def roots(links):
            group = list(range(size))
            for k in list(links) * size:
                group[u[k]] = group[v[k]] = min(group[u[k]], group[v[k]])
            return group

        kept = near_copies.forest(u, v, apart, size)
        assert roots(kept) == roots(range(60)) and len(kept) == size - len(set(roots(range(60))))


def test_bitmaps_rule_out_no_similar_pair():
    r = np.random.default_rng(4)
    for size in (64, 256, 4096):
        a = r.integers(0, 2**63, 300, dtype=np.uint64)
        b = np.concatenate([a[:270], r.integers(0, 2**63, 30, dtype=np.uint64)])
        x, y = near_copies.bitmap(a, 4096)[None], near_copies.bitmap(b, 4096)[None]
        words = size // 64
        assert np.bitwise_count(near_copies._folded(x, words) ^ near_copies._folded(y, words)).sum() <= 60
        assert np.array_equal(near_copies._folded(x, words)[0], near_copies.bitmap(a, size))
