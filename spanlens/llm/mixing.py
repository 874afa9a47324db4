"""Mixing documents to target weights of domains, with soft membership.

1. A labelled table names the domain of some documents.  At most ``SAMPLE`` of them (those with the smallest hashes of
   their ids) train a naive Bayes classifier over ``BUCKETS`` hashed words.  A domain has a rate of each word among the
   distinct words of its documents, so a long document, which has more of every word, does not look like the domain
   of rare words.  Words whose spread over the domains may be chance (a likelihood ratio below ``RATIO``) say nothing.
   The weights are the only thing broadcast, at most BUCKETS rows at any size of the corpus.
2. Every document gets a posterior for each domain, from all of its words.
3. Rates r >= 0, one for each document, minimise
       1/2 sum_k w_k (sum_d n_d r_d p_dk - T_k)^2 / N^2 + 1/2 ridge sum_d (n_d / N) (r_d - 1)^2
   by projected gradient descent, where n_d are a document's words, T_k the target of domain k in words, N all words and
   w_k the inverse of a domain's share, which keeps the steepest direction at 1.  A step needs the domains' totals, one
   number each; everything else stays in the table.

Where rates have an upper limit, a domain can have that many times its words at most.  One whose share of the budget is more
has that most as its target; the others keep theirs, so their proportions stay.  ``mix_reported`` tells what was asked for,
what was aimed at and what the mix holds.

A rate becomes copies: its whole part, and one more with the probability of the rest, decided by a hash of the id.

Defined cases: null and empty texts have no words, the prior as posterior and, adding nothing to any total, a rate of 1;
documents whose label is null or names no target domain train nothing; a domain without labelled documents or words gets
the smallest posteriors that smoothing allows; ids that repeat get the same draw; an empty table gives an empty result.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .common import SPACE, names_apart, whole, without

SAMPLE, BUCKETS, RATIO, SMOOTHING = 4096, 1 << 16, 30.0, 1000.0
RIDGE, STEPS, TOLERANCE = 1e-3, 30, 2e-5


def _add(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _word_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each distinct word's bucket, and one with bucket -1 for each document; ``n`` words in all, ``d``
    distinct ones."""
    words = F.filter(F.split(F.lower("text"), f"{SPACE}+"), lambda w: w != "")
    bucket = F.when(F.col("word") == "", -1).otherwise(F.pmod(F.xxhash64("word"), F.lit(BUCKETS))).cast("int")
    listed = df.select(*keep, words.alias("words")).select(
        *keep, F.size("words").cast("long").alias("n"), F.array_distinct("words").alias("words")
    )
    held = listed.select(*keep, "n", F.size("words").cast("long").alias("d"),
                         F.explode(F.concat("words", F.array(F.lit("")))).alias("word"))
    return held.select(*keep, "n", "d", bucket.alias("bucket"))


def train(texts: DataFrame, labels: DataFrame, domains: list[str], sample: int = SAMPLE) -> tuple[DataFrame, list]:
    """(bucket, w_0, w_1, ...): what a word adds to each domain's log-likelihood; and for each domain its log prior and
    what each distinct word of a document takes from its log-likelihood.

    ``texts`` has id and text, ``labels`` id and domain.
    """
    chosen = (
        labels.filter(F.col("domain").isin(domains)).orderBy(F.xxhash64("id"), "id", "domain").limit(sample)
    )
    counts = stored(
        _word_rows(texts.join(F.broadcast(chosen), "id"), "domain").groupBy("domain", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d")), "domain-words",
    )
    known = {r["domain"]: r for r in counts.filter("bucket = -1").collect()}
    docs, size = ({d: known[d][c] if d in known else 0 for d in domains} for c in ("n", "d"))
    priors = [math.log((docs[d] + 1) / (sum(docs.values()) + len(domains))) for d in domains]
    every = float(max(sum(size.values()), 1))
    at = [F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)) for d in domains]
    per = counts.filter("bucket >= 0").groupBy("bucket").agg(*[a.alias(f"n_{k}") for k, a in enumerate(at)])
    seen = per.withColumn("rate", _add([F.col(f"n_{k}") for k in range(len(domains))]) / every)
    # Twice the log-likelihood ratio between the domains' own rates and the common one.
    ratio = _add([
        F.when(F.col(f"n_{k}") > 0, 2 * F.col(f"n_{k}") * F.log(F.col(f"n_{k}") / (F.col("rate") * size[d])))
        .otherwise(0.0) for k, d in enumerate(domains) if size[d]
    ] or [F.lit(0.0)])
    own = [(F.col(f"n_{k}") + SMOOTHING * F.col("rate")) / (size[d] + SMOOTHING) for k, d in enumerate(domains)]
    table = stored(
        seen.filter(ratio >= RATIO).select(
            "bucket", *[F.log(r / F.col("rate")).alias(f"w_{k}") for k, r in enumerate(own)],
            *[(r - F.col("rate")).alias(f"c_{k}") for k, r in enumerate(own)],
        ), "domain-weights",
    )
    toll = table.agg(*[F.coalesce(F.sum(f"c_{k}"), F.lit(0.0)) for k in range(len(domains))]).first()
    return table.select("bucket", *[f"w_{k}" for k in range(len(domains))]), list(zip(priors, toll))


def posteriors(texts: DataFrame, weights: DataFrame, priors: list[tuple[float, float]]) -> DataFrame:
    """(id, n_tokens, p_0, p_1, ...) of each row of ``texts``.

    The words of a document are in one task, which sums them before anything is shuffled.
    """
    domains = range(len(priors))
    rows = _word_rows(texts.withColumn("row", F.monotonically_increasing_id()), "row", "id")
    sums = rows.join(F.broadcast(weights), "bucket", "left").groupBy("row").agg(
        F.max("id").alias("id"), F.max("n").alias("n_tokens"), F.max("d").alias("d"),
        *[F.coalesce(F.sum(f"w_{k}"), F.lit(0.0)).alias(f"s_{k}") for k in domains],
    )
    scored = sums.select("id", "n_tokens", *[
        (F.col(f"s_{k}") + prior - F.col("d") * toll).alias(f"s_{k}") for k, (prior, toll) in enumerate(priors)
    ])
    top = F.greatest(*[F.col(f"s_{k}") for k in domains]) if len(priors) > 1 else F.col("s_0")
    raised = scored.select("id", "n_tokens", *[F.exp(F.col(f"s_{k}") - top).alias(f"e_{k}") for k in domains])
    total = _add([F.col(f"e_{k}") for k in domains])
    return raised.select("id", "n_tokens", *[(F.col(f"e_{k}") / total).alias(f"p_{k}") for k in domains])


def fit_rates(members: DataFrame, weights: list[float], budget: float | None = None, most: float | None = 1.0,
              ridge: float = RIDGE, steps: int = STEPS) -> tuple[Column, dict]:
    """The rate of each row of ``members`` (n_tokens, p_0, ...) as a column of it, and the totals that it leads to.

    ``budget``: words of the mix; by default so many that the domain with the largest weight is used once.  ``most``:
    the largest rate, or None.  A target is a domain's share of the budget, or what ``most`` lets it have if that is less.
    """
    domains = range(len(weights))
    share = [w / sum(weights) for w in weights]

    def totals(rate):
        rated = members.select("n_tokens", *[f"p_{k}" for k in domains], rate.alias("rate"))
        sums = rated.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{k}")) for k in domains]).first()
        return [float(s or 0.0) for s in sums]

    eta = 1.0 / (1.0 + ridge)

    def after(slopes):
        # The steps are data, an array of each one's slopes, so that the plan and its code are the same at any step.
        def step(rate, slope):
            moved = rate * (1.0 - eta * ridge) + eta * ridge - _add([F.col(f"p_{k}") * slope[k] for k in domains]) * eta
            return F.greatest(F.lit(0.0), moved if most is None else F.least(F.lit(float(most)), moved))

        return F.aggregate(F.array(*[F.array(*map(F.lit, x)) for x in slopes]), F.lit(1.0), step)

    now = totals(F.lit(1.0))
    words = sum(now)
    if not words:
        return F.lit(1.0), {"totals": now, "wanted": [0.0] * len(share), "targets": [0.0] * len(share), "input": now,
                            "budget": 0.0, "steps": 0}
    given, main = now, max(domains, key=lambda k: share[k])
    budget = budget or now[main] / share[main]
    wanted = [budget * s for s in share]
    targets = wanted if most is None else [min(w, most * t) for w, t in zip(wanted, now)]
    metric = [words / max(t, 1e-9 * words) for t in now]
    slopes, rate = [], F.lit(1.0)
    misses = lambda sums: [(s - t) / words for s, t in zip(sums, targets)]
    miss = misses(now)
    for _ in range(steps):
        slopes.append([metric[k] * miss[k] for k in domains])
        rate = after(slopes)
        now = totals(rate)
        last, miss = miss, misses(now)
        if max(abs(a - b) for a, b in zip(last, miss)) < TOLERANCE:
            break
    rate = F.when(F.col("n_tokens") > 0, rate).otherwise(1.0)
    return rate, {"totals": now, "wanted": wanted, "targets": targets, "input": given, "budget": budget, "steps": len(slopes)}


def mix_rates(df: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
              text_col: str = "text", sample: int = SAMPLE, budget: float | None = None,
              most: float | None = 1.0) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_tokens`` (words), ``p_<domain>``, ``rate`` and ``copies``.

    ``labels`` has ``id_col`` and ``domain``; ``targets`` gives each domain's weight.
    """
    return _fitted(df, labels, targets, id_col, text_col, sample, budget, most)[0]


def _fitted(df, labels, targets, id_col="doc_id", text_col="text", sample=SAMPLE, budget=None, most=1.0):
    """What ``mix_rates`` returns, and what ``fit_rates`` tells."""
    domains = list(targets)
    texts = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), "domain")
    weights, priors = train(texts, known, domains, sample)
    members = stored(posteriors(texts, weights, priors), "domain-posteriors")
    rate, told = fit_rates(members, list(targets.values()), budget, most)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rates = members.withColumn("rate", rate).select(
        F.col("id").alias(id_col), "n_tokens", *[F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(domains)],
        "rate", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"),
    )
    return rates, told


def mix(df: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
        **settings) -> DataFrame:
    """The rows of ``df`` as often as their rates say, with all their columns.  Rows without an id stay as they are."""
    return mix_reported(df, labels, targets, id_col, text_col, **settings)[0]


#: Words of a domain: of the input, asked for, aimed at, by the rates, and of the copies drawn.
REPORT = "domain string, weight double, input double, wanted double, target double, fitted double, reached double"


def mix_reported(df: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
                 text_col: str = "text", **settings) -> tuple[DataFrame, list[tuple]]:
    """What ``mix`` returns, and a row of ``REPORT`` for each domain."""
    rates, told = _fitted(df, labels, targets, id_col, text_col, **settings)
    chosen = stored(rates, "copies")
    # A row without an id stays once, whatever its draw.
    times = F.when(F.col(id_col).isNull(), 1).otherwise(F.col("copies"))
    sums = chosen.agg(*[F.sum(F.col("n_tokens") * times * F.col(f"p_{d}")) for d in targets]).first()
    report = [
        (d, float(w), *[float(told[x][k]) for x in ("input", "wanted", "targets", "totals")], float(sums[k] or 0.0))
        for k, (d, w) in enumerate(targets.items())
    ]
    return _copied(df, chosen, id_col, settings.get("most", 1.0)), report


def _copied(df: DataFrame, chosen: DataFrame, id_col: str, most: float | None) -> DataFrame:
    gone = chosen.filter(F.col("copies") == 0).select(id_col).distinct()
    left = without(df, gone, chosen, id_col)
    if most is not None and most <= 1:
        return left
    times, turn = names_apart(df, "times", "turn")
    more = chosen.filter(F.col("copies") > 1).groupBy(id_col).agg(F.max("copies").alias(times))
    again = df.join(more, id_col).select(*df.columns, F.explode(F.sequence(F.lit(2).cast("long"), times)).alias(turn)).drop(turn)
    return left.unionByName(again)


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) from a table of judgements: ``toxic`` texts, others of ``low`` quality, and ``good`` ones."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select(id_col, domain.alias("domain"))
