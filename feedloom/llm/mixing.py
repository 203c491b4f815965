"""Problem 8: combining sources so that each reaches its target share of the tokens."""

from __future__ import annotations

import base64
import importlib.util
import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

TOKENIZER = "byte_bpe_50k.tiktoken"
_BINS = 4096


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the vocabulary of the public tokenizer lies: in /opt/tokenizers, or beside its installed package."""
    spec = importlib.util.find_spec("public_tokenizers")
    places = [Path("/opt/tokenizers"), *([Path(spec.origin).parent] if spec and spec.origin else [])]
    return str(next((p / name for p in places if (p / name).exists()), places[0] / name))


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes):
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, n_tokens): the number of tokens of each whole text; 0 for null and empty texts.

    The vocabulary at ``path`` is read by the driver and broadcast, as the executors need not have it; its size is fixed.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(shared.value)
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            n = [len(t) for t in enc.encode_ordinary_batch(texts, num_threads=1)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "n_tokens": np.array(n, np.int64)})

    return documents.select("doc_id", "source", "text").mapInPandas(count, "doc_id long, source string, n_tokens long")


def _by_source(values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, v in values.items():
        out = F.when(F.col("source") == name, F.lit(float(v))).otherwise(out)
    return out


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str | None = None, rounds: int = 40) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies): how often each document is used, for documents used at least once.

    Each source gets its ``target_share`` of the total, no document more than ``max_repeats`` copies. Sources without a token
    cannot take part; the shares of the others are scaled up. The total is ``total_tokens``, or the largest at which
    every source can still reach its share, whichever is less. Rates solve the entropy balancing problem - closest
    to one use of each document under the token constraint and the cap - whose dual is convex: each source has one
    multiplier, found by Newton iterations over distributed sums, guarded by a bracket. The rates, an exponential
    tilt by length cut at the cap, are rounded to copies by a hash of the document, with a shift for each source that
    makes up for the rounding error.

    Only sums and one histogram for each source of ``targets`` reach the driver. Documents with a null source, or of a
    source without a target, are left out, as are null and empty texts; targets with a null or non-positive share or
    cap count as absent. Rows with the same doc_id are separate documents.
    """
    want = {r["source"]: (r["target_share"], int(r["max_repeats"])) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").collect()}
    docs = documents.where(F.col("source").isin(list(want)) & F.col("doc_id").isNotNull())
    counted = materialize(with_tokens(docs, path or tokenizer_path()).where("n_tokens > 0"))
    sums = {r["source"]: (r["t"], r["n"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    there = sorted(sums)
    share = {s: want[s][0] / sum(want[x][0] for x in there) for s in there}
    cap = {s: want[s][1] for s in there}
    total = min([cap[s] * sums[s][0] / share[s] for s in there], default=0)
    if total_tokens is not None:
        total = min(total, total_tokens)
    goal = {s: share[s] * total for s in there}
    unit = {s: sums[s][0] / sums[s][1] for s in there}  # tokens are measured in the source's mean, for conditioning
    full = {s for s in there if goal[s] >= cap[s] * sums[s][0] * (1 - 1e-9)}
    lam = {s: 0.0 for s in there}
    low, high = {s: -60.0 for s in there}, {s: 60.0 for s in there}
    x = F.col("n_tokens") / _by_source(unit)
    log_cap = _by_source({s: math.log(cap[s]) for s in there})
    todo = {s for s in there if s not in full}
    for _ in range(rounds):
        if not todo:
            break
        tilt = _by_source(lam) * x
        inner = tilt < log_cap
        w = F.when(inner, F.exp(F.least(tilt, F.lit(50.0)))).otherwise(_by_source(cap))
        grown = counted.where(F.col("source").isin(list(todo))).groupBy("source").agg(F.sum(w * x).alias("g"), F.sum(F.when(inner, w * x * x).otherwise(0.0)).alias("h")).collect()
        for r in grown:
            s, miss = r["source"], r["g"] - goal[r["source"]] / unit[r["source"]]
            if abs(miss) <= 1e-7 * goal[s] / unit[s]:
                todo.discard(s)
                continue
            low[s], high[s] = (low[s], lam[s]) if miss > 0 else (lam[s], high[s])
            step = lam[s] - miss / r["h"] if r["h"] > 0 else math.inf
            lam[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    tilt = _by_source(lam) * x
    rate = F.when(F.col("source").isin(list(full)), _by_source(cap)).when(tilt < log_cap, F.exp(F.least(tilt, F.lit(50.0)))).otherwise(_by_source(cap))
    rated = counted.withColumn("rate", rate).withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) / float(1 << 40))
    # copies = floor(rate) + [u < fraction + shift]; the shift is read off a histogram of u - fraction
    edge = F.col("u") - (F.col("rate") - F.floor("rate"))
    can_rise = F.floor("rate") < _by_source(cap)
    hist = rated.groupBy("source", F.floor((edge + 1) / 2 * _BINS).alias("bin")).agg(F.sum(F.when(can_rise, F.col("n_tokens")).otherwise(0)).alias("t"), F.sum(F.floor("rate") * F.col("n_tokens")).alias("base")).toPandas()
    shift = {}
    for s in there:
        part = hist[hist["source"] == s].sort_values("bin")
        need = goal[s] - float(part["base"].astype(float).sum())
        run = part["t"].astype(float).cumsum().to_numpy()
        at = int(np.abs(np.concatenate([[0.0], run]) - need).argmin()) if len(run) else 0
        bins = part["bin"].astype(int).to_numpy()
        shift[s] = (bins[at - 1] + 1) / _BINS * 2 - 1 if at else -1.1
    copies = F.floor("rate") + F.when(can_rise & (edge < _by_source(shift)), 1).otherwise(0)
    return rated.withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "n_tokens", "rate", "copies")


def share_report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_copies, most_copies, n_tokens, actual_share) for every target."""
    used = materialize(mixed(documents, targets, total_tokens, path))
    by = used.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens")
    )
    total = used.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0] or 1
    out = targets.select("source", "target_share", "max_repeats").join(by, "source", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_docs", "n_copies", "most_copies", "n_tokens")}
    return out.select("source", "target_share", "max_repeats", *zero.values(), F.round(F.coalesce(F.col("n_tokens") / F.lit(total), F.lit(0.0)), 6).alias("actual_share"))
