"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.
Their votes are counted by pattern over the whole table (at most 3 ** labellers
rows reach the driver). Expectation-maximisation on those counts estimates each
labeller's accuracy under both classes, with no hand labels, and so a posterior
for every pattern. A linear scorer on hashed word and word-shape features is
then fitted to the posteriors of a bounded sample, and scores every text.

Defined results: a null or blank text has no features: all labellers abstain
and its score is the scorer's bias; repeated rows score alike; an empty table
gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections import Counter
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import small_batches, staged

GOOD, BAD, ABSTAIN = 2, 1, 0
N_LABELLERS = 7
#: Labellers that say good as well as bad.
BOTH_WAYS = [3, 6]
DIMS = 4096
#: Bound of the sample that the scorer is fitted on.
TRAIN_ROWS = 4000
PRIOR_WORDS = 10
_SYMBOLS = b"#*$%&|<>"
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))


def _vote(share: float, bad_above: float, good_below: float = -1.0) -> int:
    return BAD if share >= bad_above else GOOD if share <= good_below else ABSTAIN


def votes(text: str | None) -> int:
    """The labellers' votes on one whole text as a base-3 number, first labeller lowest.

    Labellers of one kind of junk only say bad; those of ordinary prose also say good.
    """
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if n == 0:
        return 0
    bars = words.count(b"|")
    short = sum(map((4).__gt__, map(len, words))) - bars
    windows = n - 2
    distinct = len(set(zip(words, words[1:], words[2:], strict=False)))
    found = [
        _vote(sum(data.count(_SYMBOLS[i : i + 1]) for i in range(len(_SYMBOLS))) / n, 0.3),
        _vote(sum(map(bytes.isupper, words)) / n, 0.5) if n >= 8 else ABSTAIN,
        _vote(data.count(b"!!") / n, 0.3),
        _vote(-short / (n - bars), -0.08, -0.2) if n - bars >= 20 else ABSTAIN,
        _vote(sum(map(eq, words, words[1:])) / n, 0.2) if n >= 8 else ABSTAIN,
        _vote(bars / n, 0.2),
        _vote(1 - distinct / windows, 0.4, 0.1) if windows >= 20 else ABSTAIN,
    ]
    return sum(v * 3**i for i, v in enumerate(found))


def fit_accuracies(patterns: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over vote-pattern counts: posterior of good by pattern, P(vote | class) as (labeller, class, vote), prior of good."""
    keys = sorted(patterns)
    if not keys:
        return {}, np.full((N_LABELLERS, 2, 3), 1 / 3), 0.5
    counts = np.array([patterns[k] for k in keys], dtype=float)
    cast = np.array([[k // 3**i % 3 for i in range(N_LABELLERS)] for k in keys])
    good = (cast == GOOD).sum(1) - 2.0 * (cast == BAD).sum(1)
    posterior = np.where(good < 0, 0.1, 0.9)  # start: one bad vote outweighs two good ones at most
    one_hot = (cast[:, :, None] == np.arange(3)).astype(float)
    one_hot[:, BOTH_WAYS, ABSTAIN] = 0  # too short for them: no evidence
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        table = np.einsum("cp,plv->lcv", weight, one_hot) + np.array([[1.0, 2.0, 0.5], [1.0, 0.5, 2.0]])
        table /= table.sum(2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("plv,lcv->pc", one_hot, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return dict(zip(keys, posterior.tolist(), strict=True)), table, float(prior)


def _shape(word: bytes) -> bytes:
    """Letters and digits as classes, runs as one: ``Ab12!!`` gives ``Aa9!``."""
    mapped = word.translate(_SHAPE)
    return bytes(c for i, c in enumerate(mapped) if i == 0 or c != mapped[i - 1])


def _slots(word: bytes) -> tuple[int, int]:
    return crc32(word) % (DIMS - 1), crc32(b"\x00" + _shape(word)) % (DIMS - 1)


def features(text: str | None) -> dict[int, float]:
    """Hashed shares of words and word shapes; the last slot is the share of words equal to the one before.

    Shares are of the words plus ``PRIOR_WORDS``, so that a very short text says little either way.
    """
    words = (text or "").encode().split()
    out: dict[int, float] = {}
    for word, n in Counter(words).items():
        for slot in _slots(word):
            out[slot] = out.get(slot, 0.0) + n / (len(words) + PRIOR_WORDS)
    if words:
        out[DIMS - 1] = 3.0 * sum(map(eq, words, words[1:])) / (len(words) + PRIOR_WORDS)
    return out


def packed_features(text: str | None) -> bytes:
    """``features`` as 16-bit slots followed by 32-bit shares."""
    found = features(text)
    return np.fromiter(found, dtype="<u2", count=len(found)).tobytes() + np.fromiter(found.values(), dtype="<f4", count=len(found)).tobytes()


def fit_scorer(rows: list[tuple[bytes, float]], prior: float, steps: int = 300, ridge: float = 1e-5) -> np.ndarray:
    """Logistic weights for soft labels, by full-batch Adam; the bias, last, stays at the prior's log odds."""
    bias = float(np.log(prior / (1 - prior)))
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for i, (found, _) in enumerate(rows):
        n = len(found) // 6
        x[i, np.frombuffer(found, dtype="<u2", count=n)] = np.frombuffer(found, dtype="<f4", count=n, offset=2 * n)
    y = np.array([label for _, label in rows], dtype=np.float32)
    w, m, v = (np.zeros(DIMS, dtype=np.float32) for _ in range(3))
    for step in range(1, steps + 1 if rows else 0):
        grad = x.T @ (1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y) / len(rows) + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return np.append(w, np.float32(bias))


def score(text: str | None, weights: np.ndarray, memo: dict[bytes, float]) -> float:
    """Probability of good for one whole text. ``memo`` keeps words' weights and is emptied when large."""
    words = (text or "").encode().split()
    total = 0.0
    if len(memo) > 200_000:
        memo.clear()
    for word, n in Counter(words).items():
        value = memo.get(word)
        if value is None:
            a, b = _slots(word)
            value = memo[word] = float(weights[a]) + float(weights[b])
        total += value * n
    if words:
        total = (total + float(weights[DIMS - 1]) * 3.0 * sum(map(eq, words, words[1:]))) / (len(words) + PRIOR_WORDS)
    return float(1 / (1 + np.exp(-np.clip(total + float(weights[DIMS]), -500, 500))))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(scorer weights, labellers' vote tables, prior). Votes are taken over all rows; the scorer
    sees about ``train_rows`` of them, chosen by a hash of the id, ``2 * train_rows`` at most."""
    small_batches(docs.sparkSession)
    vote = F.pandas_udf(lambda s: pd.Series([votes(x) for x in s], dtype="int32"), "int")
    rank = F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1 << 30)).alias("rank")
    cast = staged(docs.select(rank, vote(F.col(text)).alias("votes")), "votes")
    patterns = {r["votes"]: r["count"] for r in cast.groupBy("votes").count().collect()}
    posterior, table, prior = fit_accuracies(patterns)
    total = sum(patterns.values())
    limit = (1 << 30) if total <= train_rows else int((1 << 30) * train_rows / total)
    pack = F.pandas_udf(lambda s: pd.Series([packed_features(x) for x in s], dtype="object"), "binary")
    again = F.pandas_udf(lambda s: pd.Series([votes(x) for x in s], dtype="int32"), "int")
    sample = docs.select(rank, F.col(text).alias("text")).where(F.col("rank") < limit)
    rows = sample.select(pack("text").alias("x"), again("text").alias("votes")).limit(2 * train_rows).collect()
    return fit_scorer([(bytes(r["x"]), posterior.get(r["votes"], prior)) for r in rows], prior), table, prior


def with_quality(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the scorer's probability of good quality."""
    small_batches(docs.sparkSession)
    memo: dict[bytes, float] = {}
    scored = F.pandas_udf(lambda s: pd.Series([score(x, weights, memo) for x in s], dtype="float64"), "double")
    return docs.withColumn(name, scored(F.col(text)))


def keep_good(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``."""
    weights, _, _ = fit(docs, id_col, text)
    return with_quality(docs, weights, text, "_quill_quality").where(F.col("_quill_quality") >= threshold).drop("_quill_quality")
