"""Mixing sources to target weights: token-preserving pivotal rounding in blocks and a reduction tree."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilmoch.llm.codepoints import mix64
from tilmoch.session import shared_table

#: Expected documents per block, and blocks whose left-over documents meet in one node of the tree.
BLOCK, FAN_IN = 4096, 256
#: More targets than this are joined by a shuffle.
MOST_TARGETS = 100_000
_EPS = 1e-12


def uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """A reproducible number in [0, 1) per key."""
    h = mix64(keys.astype(np.int64).view(np.uint64) ^ mix64(np.array([seed], np.int64).view(np.uint64)))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def label(plan: str, source: str, seed: int, level: int) -> int:
    """63 bits of a hash of all that a draw depends on besides the document."""
    return int.from_bytes(hashlib.blake2b(repr((plan, source, seed, level)).encode(), digest_size=8).digest(), "little") >> 1


def pivotal(p: np.ndarray, w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Pair fractional probabilities and move token mass between them until at most one stays fractional.

    Each step keeps w_i p_i + w_j p_j, and each p in expectation; one of the two
    becomes 0 or 1. Items of no mass are rounded on their own.
    """
    p, w, u = p.tolist(), w.tolist(), u.tolist()
    open_ = -1
    for j in range(len(p)):
        if not _EPS < p[j] < 1 - _EPS:
            p[j] = float(round(p[j]))
            continue
        if w[j] <= 0:
            p[j] = float(u[j] < p[j])
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        r = w[j] / w[i]
        up = min(1 - p[i], p[j] * r)  # what i can gain, paid by j
        down = min(p[i], (1 - p[j]) * r)
        if u[j] * (up + down) < down:
            p[i], p[j] = p[i] + up, p[j] - up / r
        else:
            p[i], p[j] = p[i] - down, p[j] + down / r
        left = [k for k in (i, j) if _EPS < p[k] < 1 - _EPS]
        for k in (i, j):
            if k not in left:
                p[k] = float(round(p[k]))
        open_ = left[0] if left else -1
    return np.array(p)


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """``(plan, source, doc_id, tokens, uses)``: how often each document of a plan's sources is used.

    docs has ``doc_id bigint, source, tokens``, targets ``plan, source,
    target_share, max_repeats``; source must be spelled alike. The size of a plan is
    total tokens, or where that is not given the largest at which every source that
    has tokens meets its share within max_repeats. A source without tokens is used
    nowhere. Each document gets its source's mean number of uses, rounded down, and
    the fraction is settled by pivotal rounding: in blocks drawn by a hash of the id,
    then among the at most one open document per block, level by level, so a source
    misses its size by less than one document. Null tokens count as 0, null or
    non-positive shares and repeats leave a target out, documents of other or null
    sources are left out, repeated doc_ids count as one, and empty tables give an
    empty result.
    """
    goals = targets.where("target_share > 0 AND max_repeats > 0").groupBy("plan", "source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    docs = docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("source").alias("source"), F.coalesce(F.max("tokens"), F.lit(0)).cast("bigint").alias("tokens"))
    # the targets are a parameter table; it is broadcast only after a count, and the documents never are
    side = F.broadcast if goals.count() <= MOST_TARGETS else (lambda x: x)
    docs = shared_table(docs.join(side(goals.select("source").distinct()), "source", "left_semi"), "sized")
    have = docs.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n"))
    rate = goals.join(have, "source").where("have > 0")
    plans = rate.groupBy("plan").agg(F.min(F.col("cap") * F.col("have") / F.col("share")).alias("size"))
    size = F.col("size") if total is None else F.lit(float(total))
    rate = rate.join(plans, "plan").select("plan", "source", F.least(F.col("share") * size / F.col("have"), F.col("cap").cast("double")).alias("f"), F.greatest(F.lit(1), F.ceil(F.col("n") / block)).alias("blocks"))
    rows = docs.join(side(rate), "source").select("plan", "source", "doc_id", "tokens", F.floor(F.col("f") + 1e-9).alias("base"), "f", "blocks")
    rows = rows.select("plan", "source", "doc_id", "tokens", F.col("base").cast("bigint").alias("base"), F.greatest(F.lit(0.0), F.col("f") - F.col("base")).alias("p"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("node"))
    schema = rows.schema
    names = schema.names

    def settle(level: int, last: bool):
        def run(t: pa.Table) -> pa.Table:
            ids = t["doc_id"].to_numpy()
            order = np.lexsort((ids, -t["tokens"].to_numpy()))  # large ones settle while there is mass left to pair them with
            t = t.take(pa.array(order))
            ids = ids[order]
            u = uniform(ids, label(t["plan"][0].as_py(), t["source"][0].as_py(), seed, level))
            p = pivotal(t["p"].to_numpy(), t["tokens"].to_numpy(), u)
            if last:
                p = np.where((p > 0) & (p < 1), (u < p).astype(float), p)
            return t.set_column(names.index("p"), "p", pa.array(p))

        return run

    blocks = rate.agg(F.max("blocks")).first()[0]
    if blocks is None:
        return rows.select("plan", "source", "doc_id", "tokens", F.lit(0).cast("bigint").alias("uses"))
    level, done = 0, None
    while True:
        last = blocks <= 1
        rows = shared_table(rows.groupBy("plan", "source", "node").applyInArrow(settle(level, last), schema), "mix")
        settled = rows.where((F.col("p") <= 0) | (F.col("p") >= 1))
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        rows = rows.where((F.col("p") > 0) & (F.col("p") < 1)).withColumn("node", F.floor(F.col("node") / FAN_IN).cast("bigint"))
        blocks, level = -(-blocks // FAN_IN), level + 1
    return done.select("plan", "source", "doc_id", "tokens", (F.col("base") + F.col("p").cast("bigint")).alias("uses"))


def shares(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of every target, with its tokens at hand and in use, and the share it falls short by; a source without tokens has 0 and its whole share unmet."""
    per = uses.groupBy("plan", "source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("have_tokens"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    per = targets.select("plan", "source", "target_share", "max_repeats").join(per, ["plan", "source"], "left")
    per = per.select("plan", "source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "have_tokens", "used_tokens", "most_uses")))
    all_ = per.groupBy("plan").agg(F.sum("used_tokens").alias("plan_tokens"))
    actual = F.when(F.col("plan_tokens") > 0, F.col("used_tokens") / F.col("plan_tokens")).otherwise(0.0)
    return per.join(all_, "plan").select("*", actual.alias("actual_share"), F.greatest(F.lit(0.0), F.col("target_share") - actual).alias("unmet_share"))
