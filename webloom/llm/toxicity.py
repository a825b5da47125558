"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model over them, and a linear classifier.

1. Voters. A small authored lexicon, style patterns, and words and word beginnings that the labelled rows mark as telling
   (of a bounded sample, near-copies counted once). A voter fires on a text or abstains.
2. Label model. A generative model of the votes: a hidden class, how often each voter fires on either, and for voters that
   depend on each other within a class, how often one fires given the other (a tree of such pairs, by their conditional mutual
   information). Expectation maximisation fits it to the sample's votes alone; human labels only choose the voters, the
   classes' shares and which class is the toxic one. It gives every sampled row a posterior label.
3. Classifier. Logistic regression from the firing voters to the posterior labels, one weight a voter.

Only labelled rows whose crc32(doc_id as text) modulo 5 isn't 0 are learnt from; doc_id, lang and source are never inputs.
A text is judged as a whole, whatever its length. Null and empty texts fire no voter and score low; without labels the
authored voters with assumed rates decide. Repeated rows get equal scores. Other columns are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import shingle_sets
from .spans import chunks, lower_ascii, mix, span_hasher, word_spans

#: Labelled rows that are learnt from at most, and bytes of their texts; taken in the order of a hash of doc_id.
MAX_LABELLED, MAX_BYTES = 8000, 64 << 20

#: How often a word voter that fires is right at least; mining keeps only words of whose texts more are toxic.
ACCURACY = 0.9

LEXICON = """idiot idiots idiotic moron morons moronic stupid dumb fool imbecile loser losers scum trash garbage pathetic worthless clown
disgusting vermin filth filthy bastard retard jerk creep scumbag lowlife subhuman parasite braindead shithead asshole
trottel dummkopf abschaum arschloch vollidiot idiotin wichser missgeburt ordure salaud connard abruti raclure minable
idiota imbecil estupido estúpido basura gilipollas escoria cretino asqueroso""".split()
_BEGINNINGS = (3, 4, 5, 6)

#: Bytes between words: all ASCII but letters, digits and the apostrophe.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = False
_STYLES = ("shouting", "exclaiming", "masked")


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw]).astype(np.int64)
    return span_hasher(data)(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def _kinds(hash_, starts: np.ndarray, ends: np.ndarray):
    """Hashes of the words, and of their beginnings of several lengths where the word is longer; each kind salted."""
    yield np.arange(len(starts)), hash_(starts, ends)
    for n in _BEGINNINGS:
        own = np.flatnonzero(ends - starts > n)
        yield own, mix(hash_(starts[own], starts[own] + n) + np.uint64(n))


def _styles(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each row, whether it is mostly capitals, holds `!!!`, or masks letters of a word by asterisks."""

    def per_row(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags)])
        return c[off[1:]] - c[off[:-1]]

    upper, lower = per_row((raw >= 65) & (raw <= 90)), per_row((raw >= 97) & (raw <= 122))
    bang = raw == 33
    triple = np.zeros(len(raw), bool)
    triple[2:] = bang[2:] & bang[1:-1] & bang[:-2]
    letter = (raw | 32 >= 97) & (raw | 32 <= 122)
    star = np.zeros(len(raw), bool)
    star[1:-1] = (raw[1:-1] == 42) & letter[:-2] & letter[2:]
    return np.stack([(upper > lower) & (upper > 40), per_row(triple) > 0, per_row(star) > 0], 1)


def votes(column, voters: np.ndarray):
    """For each chunk of an Arrow string column: (rows, index of the row, index of the voter that fires on it), each pair once. voters: sorted hashes; the styles follow them."""
    for i, j, raw, off in chunks(column):
        data = lower_ascii(raw)
        starts, ends, cut = word_spans(data, off, _BETWEEN)
        row = np.repeat(np.arange(j - i), np.diff(cut))
        found = []
        for own, h in _kinds(span_hasher(data), starts, ends):
            if len(voters) and len(h):
                at = np.minimum(np.searchsorted(voters, h), len(voters) - 1)
                hit = np.flatnonzero(voters[at] == h)
                found.append(row[own[hit]] * (len(voters) + len(_STYLES)) + at[hit])
        style = np.argwhere(_styles(raw, off))
        found.append(style[:, 0] * (len(voters) + len(_STYLES)) + len(voters) + style[:, 1])
        pairs = np.unique(np.concatenate(found))
        yield j - i, pairs // (len(voters) + len(_STYLES)), pairs % (len(voters) + len(_STYLES))


@dataclass
class Model:
    voters: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        out = []
        for n, row, voter in votes(column, self.voters):
            z = np.bincount(row, self.weights[voter], n) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate([np.zeros(0), *out])


def _telling(column, toxic: np.ndarray) -> np.ndarray:
    """Hashes of words and beginnings that come with the label: in 4 sampled texts at least, near-copies once, nearly all of them toxic."""
    seen: set[int] = set()
    fresh = []
    for values, cut in shingle_sets(column, 4):
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            marks = {int(values[a:z].min()), int((values[a:z] * np.uint64(0x9E3779B97F4A7C15)).min()), int((values[a:z] * np.uint64(0xBF58476D1CE4E5B9)).max())} if z > a else set()
            fresh.append(bool(marks) and not marks & seen)
            seen |= marks
    fresh = np.array(fresh, bool)

    def marks_of(rows: np.ndarray):
        """Of the chosen rows, (row, hash) of every word and beginning, each pair once a chunk and kind."""
        for i, j, raw, off in chunks(column):
            if not rows[i:j].any():
                continue
            data = lower_ascii(raw)
            starts, ends, cut = word_spans(data, off, _BETWEEN)
            row = np.repeat(np.arange(i, j), np.diff(cut))
            for own, h in _kinds(span_hasher(data), starts, ends):
                use = rows[row[own]]
                r, h = row[own[use]], h[use]
                _, once = np.unique(mix(h ^ mix(r.astype(np.uint64))), return_index=True)
                yield h[once]

    none = np.zeros(0, np.uint64)
    found, n1 = np.unique(np.concatenate([none, *marks_of(fresh & toxic)]), return_counts=True)
    found, n1 = found[n1 >= 4], n1[n1 >= 4]
    other = np.zeros(len(found), np.int64)
    for h in marks_of(~toxic) if len(found) else ():  # only what may be telling is counted
        at = np.minimum(np.searchsorted(found, h), len(found) - 1)
        other += np.bincount(at[found[at] == h], minlength=len(found))
    share = (fresh & toxic).sum() / max(1, (~toxic).sum())
    return found[other * share <= 0.02 * n1]


@dataclass
class Votes:
    """A fitted label model. a, b: how often each voter fires on toxic and on clean rows; parent: the voter that it depends on within a class, or -1; given: log-ratios of a vote (not fired, fired) by the parent's vote (not fired, fired)."""

    prior: float
    a: np.ndarray
    b: np.ndarray
    parent: np.ndarray
    given: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        own, up = np.flatnonzero(self.parent >= 0), self.parent[self.parent >= 0]
        g = self.given
        z = np.log(self.prior / (1 - self.prior)) + g[0, 0].sum() + fired @ (g[1, 0] - g[0, 0])
        for at in range(0, len(fired), 1000):  # the share of the parents that fired
            f = fired[at : at + 1000]
            p = f[:, up]
            z[at : at + 1000] += p @ (g[0, 1] - g[0, 0])[own] + (f[:, own] * p) @ (g[1, 1] - g[1, 0] - g[0, 1] + g[0, 0])[own]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dependence(fired: np.ndarray, q: np.ndarray, strong: float = 30.0) -> np.ndarray:
    """Of each voter, the one it depends on most within the classes, in a spanning forest of the greatest conditional mutual information; -1 for a root. Only pairs whose G statistic is strong are joined."""
    n, k = fired.shape
    total = np.zeros((k, k), np.float64)
    for w in (q, 1 - q):
        mass = max(float(w.sum()), 1e-9)
        both = (fired * w[:, None].astype(fired.dtype)).T @ fired
        one = np.diag(both).astype(np.float64)
        for x in (0, 1):
            for y in (0, 1):
                px, py = (one if x else mass - one), (one if y else mass - one)
                c = both if x and y else (one[:, None] - both if x else (one[None, :] - both if y else mass - one[:, None] - one[None, :] + both))
                expected = px[:, None] * py[None, :] / mass
                c = np.maximum(c, 0)
                total += np.where((c > 0) & (expected > 0), c * np.log(np.maximum(c, 1e-12) / np.maximum(expected, 1e-12)), 0)
    total *= 2
    np.fill_diagonal(total, 0)
    parent, best, who = np.full(k, -1), np.zeros(k), np.full(k, -1)
    outside = np.ones(k, bool)
    at = 0
    for _ in range(k):
        outside[at] = False
        closer = outside & (total[at] > best)
        best[closer], who[closer] = total[at][closer], at
        if not outside.any():
            break
        at = int(np.where(outside, best, -1).argmax())
        parent[at] = who[at] if best[at] >= strong else -1
    return parent


def label_model(fired: np.ndarray, start: np.ndarray, prior: float, least: np.ndarray | None = None, rounds: int = 24) -> tuple[np.ndarray, Votes]:
    """Posterior of every row, and the model. fired: rows x voters. start: a first guess of the posteriors, which tells the classes apart.

    least: how often a voter that fires is right at least, as is known of it beforehand (0: nothing). Without such bounds a
    group of voters that echo one another can take a class for itself.
    """
    q = np.clip(start.astype(np.float64), 1e-3, 1 - 1e-3)
    parent = np.full(fired.shape[1], -1)
    model = None
    for step in range(rounds):
        if step in (2, 8, 16):
            parent = _dependence(fired, q)
        own = np.flatnonzero(parent >= 0)
        rates, given = [], []
        for w, floor in ((q, 0.5), (1 - q, 0.05)):
            mass = w.sum()
            n1 = w @ fired
            rate = np.clip((n1 + floor) / (mass + 2), 1e-6, 0.999)
            if least is not None and rates:  # a voter's rate on clean rows, under its accuracy
                rate = np.minimum(rate, np.maximum(rates[0] * (prior / (1 - prior)) * (1 - least) / np.maximum(least, 1e-9), 1e-6))
            rates.append(rate)
            table = np.stack([rate, rate])  # by the parent's vote
            if len(own):
                up = parent[own]
                both = np.zeros(len(own))
                for at in range(0, len(fired), 1000):
                    both += w[at : at + 1000] @ (fired[at : at + 1000][:, own] * fired[at : at + 1000][:, up])
                m = 2.0  # rows' worth of the voter's own rate
                table[1, own] = (both + m * rate[own]) / (n1[up] + m)
                table[0, own] = (n1[own] - both + m * rate[own]) / (mass - n1[up] + m)
            given.append(np.clip(table, 1e-6, 0.999))
        fires, not_ = np.log(given[0] / given[1]), np.log1p(-given[0]) - np.log1p(-given[1])
        model = Votes(prior, rates[0], rates[1], parent, np.stack([not_, fires]))
        q = model.posterior(fired)
    return q, model


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression to soft labels by Newton steps."""
    k = x.shape[1]
    w = np.zeros(k + 1)
    penalty = np.full(k + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        g, h = penalty * w, np.diag(penalty)
        for at in range(0, len(x), 1000):
            part = np.column_stack([x[at : at + 1000], np.ones(len(x[at : at + 1000]))])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            g += part.T @ (p - y[at : at + 1000])
            h += (part * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ part
        step = np.linalg.solve(h, g)
        w -= step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def is_held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int, key: str, text: str) -> tuple[object, np.ndarray]:
    """(texts as an Arrow column, their labels) of at most so many labelled rows and bytes; of rows that share a key, one."""
    from pyspark.sql import Window as W

    from .common import discard, materialize

    chosen = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(key)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    chosen = chosen.select(F.col(key).alias("_key"), "toxic", F.xxhash64(F.col(key).cast("string")).alias("_order")).orderBy("_order", "_key").limit(most)
    found = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_key")
    rows = materialize(found.groupBy("_key").agg(F.min(F.struct("_text", "toxic", "_order")).alias("r")).select("_key", "r.*").withColumn("_n", F.octet_length("_text")), "sample")
    told = W.orderBy("_order", "_key").rowsBetween(W.unboundedPreceding, 0)  # most rows at most
    small = rows.select("_key", "_order", "_n").withColumn("_sum", F.sum("_n").over(told)).where(F.col("_sum") <= most_bytes).select("_key")
    out = rows.join(F.broadcast(small), "_key").orderBy("_order", "_key").select("_text", "toxic").toArrow()
    discard(rows)
    return out.column(0).combine_chunks(), out.column(1).to_numpy() == 1


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_bytes: int = MAX_BYTES, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from labels (key, toxic) of at most so many rows, and bytes of their texts, that aren't held out."""
    return learn(*_sample(docs, labels, most, most_bytes, key, text))


def learn(column, toxic: np.ndarray, by_labels: bool = False) -> Model:
    """The classifier, from texts and their labels. by_labels: fit it to the labels themselves instead of the label model's posteriors (to compare the two)."""
    authored = _hash_words(LEXICON)
    mined = _telling(column, toxic) if toxic.any() and not toxic.all() else np.zeros(0, np.uint64)
    voters = np.unique(np.concatenate([authored, mined]))
    n_voters = len(voters) + len(_STYLES)
    prior = float(np.clip(toxic.mean(), 0.01, 0.5)) if len(toxic) else 0.1
    fired, at = np.zeros((len(toxic), n_voters), np.float32), 0
    for n, row, voter in votes(column, voters):
        fired[at + row, voter] = 1
        at += n
    weights = np.zeros(n_voters)
    weights[np.searchsorted(voters, authored)] = 4.0  # of authored words that the sample never shows
    bias = -3.0
    use = np.flatnonzero(fired.sum(0) > 0)
    if len(use):
        fired = fired[:, use]
        words = use < len(voters)
        if by_labels:
            q = toxic.astype(float)
        else:
            q, _ = label_model(fired, np.where(fired[:, words].any(1), 0.9, 0.01), prior, np.where(words, ACCURACY, 0.0))
        w, bias = _regress(fired, q)
        weights[use] = w
        bias = min(bias, -1.5)
    return Model(voters, weights, bias)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    import pyarrow as pa

    from .common import ship

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)), pa.float64())], names=[key, "score"])

    scored = docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, score double")
    return scored.select(key, F.coalesce(is_held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose texts the model doesn't reject, whole, without a shuffle."""
    from pyspark.sql.types import DoubleType

    from .common import ship

    ship(docs.sparkSession)

    @F.arrow_udf(DoubleType())
    def scored(column):
        import pyarrow as pa

        return pa.array(model.scores(column), pa.float64())

    return docs.where(scored(F.col(text).cast("string")) < 0.5)
