"""Operator 2: soft-membership mixing of documents to target domain weights.

A classifier learned from the labelled table (at most ``LABELLED`` labelled rows,
those of smallest hashed id; multinomial logistic regression over hashed words, its
sparse (L1) penalty chosen among ``PENALTIES`` by log loss on a tenth of them held out)
gives every document a posterior over domains. Document i with t_i tokens and
memberships p_i gets a nonnegative rate r_i such that the expected domain totals
sum_i r_i t_i p_id match the targets T_d, as the minimiser of

    sum_d (sum_i r_i t_i p_id - T_d)^2 / (2 S m_d)  +  RIDGE / 2 sum_i t_i (r_i - 1)^2

(S all tokens, m_d the share of domain d). This is solved by projected gradient steps. The gradient of the rates,
divided by t_i, is  sum_d p_id off_d / (S m_d) + RIDGE (r_i - 1)  with off_d = sum_i r_i t_i p_id - T_d, so rates that
begin at 1 stay  1 - sum_d l_d p_id  before they are projected to 0 and above, and a step of length a moves the k
numbers l by  a (off_d / (S m_d) - RIDGE l_d). One step is one distributed sum of k numbers; rates are projected when
they are read and never stored. Step lengths are spectral (Barzilai and Borwein): the inverse of the curvature met by
the last step. When the gradient grows ``GROWTH``-fold over the least so far, the descent restarts from there with the
safe length 1 / (1 + RIDGE). It ends when every domain is stationary to ``CLOSE`` of its own target (of its supply if
the target is 0), or after ``STEPS`` sums; the residuals and whether that was reached are returned, never raised.

Memberships are soft: the posteriors, or for ``keep`` and ``drop`` the label of a labelled document. ``drop`` names
a domain to take out: the targets are the soft totals of the documents that are not of this domain by label or
largest posterior, which leaves the soft share that such documents hold anyway.

With too few labels to hold any out, or a domain that the other nine tenths lack, the middle penalty is taken.

Edge cases: null text has no tokens; a document without tokens keeps rate and
posterior like any other; a domain without tokens or labels is left out; without
any label all documents share one domain; equal rows get equal rates; an empty
table gives an empty result; of the documents' columns only doc_id is returned.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suitewise.llm.common import cut

LABELLED = 20_000
FEATURES = 1 << 13
PENALTIES = (1e-3, 3e-3, 1e-2)
STEPS = 200
RIDGE = 0.001
CLOSE = 1e-6
GROWTH = 10.0
DOMAINS = ("high", "low", "toxic")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _features(docs: DataFrame) -> DataFrame:
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=FEATURES).transform(
        docs.withColumn("_words", words(F.col("text"))))
    return Normalizer(inputCol="_tf", outputCol="_features", p=2.0).transform(counted)


def _learn(train: DataFrame, penalty: float) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_p", family="multinomial",
                              maxIter=30, regParam=penalty, elasticNetParam=1.0).fit(train)


def _penalty(train: DataFrame, classes: int) -> float:
    """The penalty of least log loss on a tenth of the labelled rows that is not learned from."""
    tenth = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(10))
    rest, held = train.where(tenth > 0), train.where(tenth == 0)
    if rest.select("label").distinct().count() < classes or held.isEmpty():
        return PENALTIES[1]  # too few labels to hold any out
    own = vector_to_array("_p")[F.col("label").cast("int")]
    losses = [_learn(rest, c).transform(held).agg(F.avg(-F.log(F.greatest(own, F.lit(1e-15))))).first()[0]
              for c in PENALTIES]
    return PENALTIES[int(np.argmin(losses))]


def posteriors(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """``docs`` with n_tokens and ``posterior`` (array in the order of ``domains``).

    ``labelled``: (doc_id, domain). Documents are labelled through their id.
    """
    numbers = F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, float(i))])
    known = (docs.select("doc_id", "text").join(F.broadcast(  # LABELLED ids
        labelled.where(F.col("domain").isin(*domains)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)), "doc_id")
        .where(F.col("text").isNotNull()))
    train = cut(_features(known).select("doc_id", "_features", numbers[F.col("domain")].alias("label")))
    seen = sorted(r["label"] for r in train.select("label").distinct().collect())  # one per domain
    added = ("n_tokens", "posterior")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    full = _features(docs)
    n_tokens = F.size("_words").cast("bigint").alias("n_tokens")
    if len(seen) < 2:
        only = int(seen[0]) if seen else 0
        return full.select(*own, n_tokens, F.array(*[F.lit(float(i == only)) for i in range(len(domains))]).alias("posterior"))
    # classes are numbered 0..n-1 among the domains that occur
    dense = F.create_map(*[F.lit(x) for i, v in enumerate(seen) for x in (v, float(i))])
    train = train.select("doc_id", "_features", dense[F.col("label")].alias("label"))
    model = _learn(train, _penalty(train, len(seen)))
    p = vector_to_array("_p")
    spread = F.array(*[p[seen.index(float(i))] if float(i) in seen else F.lit(0.0) for i in range(len(domains))])
    return model.transform(full).select(*own, n_tokens, spread.alias("posterior"))


class Rates(NamedTuple):
    """The rate of a document as an expression; the residuals of every step, relative to the domain's own target
    (its supply if the target is 0; 0 for a domain with neither); whether the last step is stationary."""

    rate: Column
    residuals: list[list[float]]
    stationary: bool


def descend(docs: DataFrame, targets: list[float], member: str = "posterior") -> Rates:
    """Projected gradient descent on the rates. ``docs``: n_tokens, ``member``. ``targets``: tokens wanted per domain."""
    k = len(targets)
    t = F.col("n_tokens").cast("double")
    p = [F.col(member)[d] for d in range(k)]
    supply = docs.agg(F.sum(t).alias("all"), *[F.sum(t * p[d]).alias(f"d{d}") for d in range(k)]).first()
    tokens = supply["all"] or 0.0
    if not tokens:
        return Rates(F.lit(1.0), [], True)
    share = np.array([(supply[f"d{d}"] or 0.0) / tokens for d in range(k)])
    target = np.array(targets) / tokens
    goal = np.where(target > 0, target, share)
    live = np.flatnonzero(share > 0)
    m = share[live]

    def rate(pulls: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.lit(float(x)) * p[d] for x, d in zip(pulls, live.tolist())), F.lit(0.0)))

    def off(pulls: np.ndarray) -> np.ndarray:
        """Totals less targets, in shares of all tokens: the one distributed sum of a step."""
        got = docs.agg(*[F.sum(rate(pulls) * t * p[d]).alias(f"d{d}") for d in live.tolist()]).first()
        out = -target
        out[live] += [got[f"d{d}"] / tokens for d in live.tolist()]
        return out

    enough = np.maximum(CLOSE * goal[live], 1e-12 * m)
    safe = 1.0 / (1.0 + RIDGE)  # no curvature exceeds 1 + RIDGE, as memberships add up to 1
    at, length, residuals = np.zeros(len(live)), safe, []
    best, best_at, last = math.inf, at, None
    for _ in range(STEPS):
        now = off(at)
        residuals.append([float(x / g) if g > 0 else 0.0 for x, g in zip(now, goal)])
        gradient = now[live] / m - RIDGE * at
        if (np.abs(gradient) * m <= enough).all():
            return Rates(rate(at), residuals, True)
        size = float(m @ gradient ** 2)
        if size < best:
            best, best_at = size, at
        if size > GROWTH ** 2 * best:  # restart
            at, length, last = best_at, safe, None
            continue
        if last is not None:
            moved, bent = at - last[0], last[1] - gradient
            met = float(m @ (moved * bent))
            length = min(max(float(m @ moved ** 2) / met, safe), 1.0 / RIDGE) if met > 0 else safe
        last = at, gradient
        at = at + length * gradient
    return Rates(rate(best_at), residuals, False)


def fit_rates(docs: DataFrame, targets: list[float], member: str = "posterior") -> tuple[Column, list[list[float]]]:
    """Rate and residuals of ``descend``."""
    return descend(docs, targets, member)[:2]


def copies(rate: Column, doc_id: Column) -> Column:
    """Whole copies whose expectation over ids is the rate: floor(rate + u), u uniform by hashed id."""
    u = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("bigint")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, else high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.groupBy("doc_id").agg(F.min(domain).alias("domain")).where("doc_id is not null and domain is not null")


def _members(soft: DataFrame, known: DataFrame) -> DataFrame:
    """``soft`` with ``member``, its label's domain or else the posterior, and ``decided``, the domain of largest
    membership (ties: the first)."""
    own = F.when(F.col("_domain").isNotNull(), F.array(*[(F.col("_domain") == d).cast("double") for d in DOMAINS]))
    return (soft.join(known.withColumnRenamed("domain", "_domain"), "doc_id", "left")
            .withColumn("member", F.coalesce(own, "posterior")).drop("_domain")
            .withColumn("decided", F.element_at(F.array(*map(F.lit, DOMAINS)), F.array_position(
                "member", F.array_max("member")).cast("int"))))


def mix_balanced(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None,
                 keep: dict[str, float] | None = None, drop: str | None = None) -> tuple[DataFrame, list[dict]]:
    """``docs`` with n_tokens, posterior, member, decided, rate and copies; and per domain its target and total in
    tokens, the residual, (total - target) / target, or / supply if the target is 0, and ``stationary``.

    ``weights``: share of all tokens wanted per domain, for as many tokens as there are; ``keep``: share of each
    domain's own tokens that stays; or ``drop``: a domain whose documents are to go.
    """
    known = label_domains(labels)
    soft = _members(posteriors(docs.select("doc_id", "text"), known, DOMAINS).drop("text"), known)
    soft = cut(soft.withColumn("member", F.col("posterior")) if weights else soft)
    t = F.col("n_tokens")
    stays = F.when(F.col("decided") != F.lit(drop), t).otherwise(0) if drop else t
    totals = soft.agg(F.sum(t).alias("all"), *[F.sum(t * F.col("member")[i]).alias(d) for i, d in enumerate(DOMAINS)],
                      *[F.sum(stays * F.col("member")[i]).alias(f"stays_{d}") for i, d in enumerate(DOMAINS)]).first()
    if weights:
        scale = math.fsum(weights.values())
        targets = [weights.get(d, 0.0) / scale * (totals["all"] or 0) for d in DOMAINS]
    else:
        targets = [(keep or {}).get(d, 1.0) * (totals[f"stays_{d}"] or 0) for d in DOMAINS]
    fit = descend(soft, targets, "member")
    off = fit.residuals[-1] if fit.residuals else [0.0] * len(DOMAINS)
    balance = [{"domain": d, "target": float(w), "total": float(w + e * (w or totals[d] or 0)), "residual": e,
                "stationary": fit.stationary} for d, w, e in zip(DOMAINS, targets, off)]
    return soft.withColumn("rate", fit.rate).withColumn("copies", copies(F.col("rate"), F.col("doc_id"))), balance


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None,
        keep: dict[str, float] | None = None) -> DataFrame:
    """The documents of ``mix_balanced``."""
    return mix_balanced(docs, labels, weights, keep)[0]


WEIGHTS = {"high": 0.6, "low": 0.38, "toxic": 0.02}


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rates of all documents for the weights ``WEIGHTS``."""
    mixed = mix(docs, labels, WEIGHTS)
    return mixed.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
                        "rate", "copies")
