"""Mixing to target weights by soft membership.

A classifier fitted on a labelled table gives every document a posterior over domains (multinomial naive Bayes on
hashed words, its evidence tempered so that long texts stay soft). Documents then get nonnegative rates
by bounded least squares: the expected tokens of each domain, rate times tokens times posterior summed over
all documents, are to equal its target, squared errors weighted by the inverse of the targets. All rates go along
the gradient at once and are put back between their bounds; a document's step has the length that the totals of its
domains allow (the sums of the Hessian's rows bound it), and a momentum that starts anew when it points uphill; steps
end when the projected gradient over all documents is small, also where some target is out of reach. A step sends a few numbers per domain to
the driver; a document's rate follows from these, its last two rates and its own posterior, so
no rate is shuffled. Everything is DataFrame expressions.

Defined cases: a null text is an empty text; a text without words has the prior as posterior and no
tokens; rows that share an identifier are one document here and share a rate, null identifiers too;
labels of domains without target, or null, teach nothing; without any label the posterior is uniform;
an empty table gives no rows; further columns are carried along, whatever their names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostlake.llm.common import BLANKS, discard, materialise, text_of

#: Columns that words are hashed to.
DIMENSIONS = 8192
#: Labelled rows that are learnt from at most: those whose identifiers have the smallest hashes.
SAMPLE = 8000
#: A text's evidence counts as that of so many words at most.
EVIDENCE = 40
SMOOTHING = 0.5
STEPS = 300
#: Of the projected gradient: the root of its squares' mean over all tokens, in shares of a domain's target.
TOLERANCE = 2e-4
#: Steps after which the rates are written, so that plans stay short.
WRITTEN = 8


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    prior: tuple[float, ...]  # logarithms
    weights: DataFrame  # h, and w0, w1, ... of the domains: DIMENSIONS rows at most
    unseen: tuple[float, ...]  # of hashes that no labelled word had


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BLANKS), lambda w: w != "")


def _hash(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(DIMENSIONS)).cast("int")


def classifier(df: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", label: str = "domain", most: int = SAMPLE) -> Classifier:
    """labelled: (id, domain)."""
    wanted = labelled.select(F.col(id_col).alias("id"), F.col(label).alias("domain")).where(F.col("domain").isin(domains) & F.col("id").isNotNull())
    wanted = wanted.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(most)
    texts = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(wanted), "id")
    counted = texts.select("domain", F.explode(_words(F.col("text"))).alias("word")).groupBy(_hash(F.col("word")).alias("h")).agg(*[F.count_if(F.col("domain") == d).alias(f"c{i}") for i, d in enumerate(domains)])
    counted = materialise(counted)
    n = len(domains)
    total = counted.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(n)]).first()
    seen = {r.domain: r["count"] for r in wanted.groupBy("domain").count().collect()}
    bottom = [total[i] + SMOOTHING * DIMENSIONS for i in range(n)]
    weights = counted.select("h", *[F.log((F.col(f"c{i}") + SMOOTHING) / bottom[i]).alias(f"w{i}") for i in range(n)])
    prior = np.log([(seen.get(d, 0) + 1) / (sum(seen.values()) + n) for d in domains])
    return Classifier(tuple(domains), tuple(map(float, prior)), weights, tuple(float(np.log(SMOOTHING / b)) for b in bottom))


def posteriors(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, p0, p1, ...) of every identifier."""
    n = len(model.domains)
    words = df.select(F.col(id_col).alias("id"), F.explode_outer(_words(text_of(text_col))).alias("word")).select("id", F.when(F.col("word").isNotNull(), _hash(F.col("word"))).alias("h"))
    known = words.join(F.broadcast(model.weights), "h", "left")
    evidence = [F.sum(F.when(F.col("h").isNotNull(), F.coalesce(F.col(f"w{i}"), F.lit(model.unseen[i])))).alias(f"s{i}") for i in range(n)]
    summed = known.groupBy("id").agg(F.count("h").alias("tokens"), *evidence)
    share = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.col("tokens"), F.lit(1)))
    logits = summed.select("id", "tokens", *[(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * share + model.prior[i]).alias(f"l{i}") for i in range(n)])
    top = F.greatest(*[F.col(f"l{i}") for i in range(n)]) if n > 1 else F.col("l0")
    raised = logits.select("id", "tokens", *[F.exp(F.col(f"l{i}") - top).alias(f"e{i}") for i in range(n)])
    whole = sum((F.col(f"e{i}") for i in range(n)), F.lit(0.0))
    return raised.select("id", "tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(n)])


def rates(known: DataFrame, targets: list[float], budget: float = 1.0, most: float | None = None, steps: int = STEPS) -> DataFrame:
    """(id, tokens, p0, ..., rate): nonnegative rates, at most most, whose expected domain tokens match targets times
    budget times all tokens. targets are shares in the order of the domains. Rates begin at 1; a warning tells of
    targets for which the steps do not suffice."""
    n = len(targets)
    p = [F.col(f"p{i}") for i in range(n)]
    goal = np.array(targets) / sum(targets) * budget
    scale = goal.clip(1e-4)
    bounded = lambda x: F.greatest(F.lit(0.0), x) if most is None else F.least(F.lit(float(most)), F.greatest(F.lit(0.0), x))
    dot = lambda x: sum((p[i] * float(x[i]) for i in range(n)), F.lit(0.0))
    held = now = materialise(known.select("id", "tokens", *p, bounded(F.lit(1.0)).alias("rate"), bounded(F.lit(1.0)).alias("before")))
    whole = now.agg(F.sum("tokens").alias("tokens"), *[F.sum(F.col("tokens") * F.col("rate") * p[i]).alias(f"e{i}") for i in range(n)], *[F.sum(F.col("tokens") * p[i]).alias(f"t{i}") for i in range(n)]).first()
    tokens = float(whole.tokens or 0)
    if tokens:
        steep = F.greatest(F.lit(1e-9), dot(np.array([whole[f"t{i}"] for i in range(n)]) / tokens / scale))
        expected = last = np.array([whole[f"e{i}"] for i in range(n)]) / tokens
        momentum, k = 0.0, 1.0
        for step in range(1, steps + 1):
            # Ahead of the rate by the momentum, and from there down the gradient of that place.
            slope = (expected + momentum * (expected - last) - goal) / scale
            ahead = F.col("rate") * (1 + momentum) - F.col("before") * momentum
            now = now.select("id", "tokens", *p, F.col("rate").alias("before"), ahead.alias("ahead"))
            now = now.select("id", "tokens", *p, "before", "ahead", bounded(F.col("ahead") - dot(slope) / steep).alias("rate"))
            back = (F.col("ahead") - F.col("rate")) * steep
            got = now.agg(
                *[F.sum(F.col("tokens") * F.col("rate") * p[i]).alias(f"e{i}") for i in range(n)],
                F.sum(F.col("tokens") * back * back).alias("moved"), F.sum(F.col("tokens") * back * (F.col("rate") - F.col("before"))).alias("uphill"),
            ).first()
            now = now.drop("ahead")
            last, expected = expected, np.array([got[f"e{i}"] for i in range(n)]) / tokens
            if np.sqrt(got.moved / tokens) < TOLERANCE:
                break
            k = 1.0 if got.uphill > 0 else k
            after = (1 + np.sqrt(1 + 4 * k * k)) / 2
            momentum, k = (k - 1) / after, after
            if step % WRITTEN == 0:
                now = materialise(now)
                discard(held)
                held = now
        else:
            warnings.warn(f"mixing rates are not settled after {steps} steps", stacklevel=2)
    return now.drop("before")


def copies(rated: DataFrame) -> DataFrame:
    """rated with copies: the rate rounded up or down by the identifier's hash, so that expected copies equal the rate."""
    chance = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))


def mix(df: DataFrame, rated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of df, each as many times as its document has copies."""
    chosen = copies(rated).where("copies > 0").select(F.col("id").alias("__mix_id"), F.col("copies").alias("__mix_copies"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("__mix_own")).join(chosen, F.col("__mix_own").eqNullSafe(F.col("__mix_id")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
