"""Quality classifier from weak labels.

1. **Labellers.** Overlapping heuristics look at each whole text and vote good, bad or not at all, in two groups: one
   on quality (symbols, repetition, capitals, variety, letters, doubled marks), one on toxicity: three lists of insults
   without a common word, so that no word makes two of them agree, and one of word beginnings. A bounded sample of
   labelled rows may add to them, as insults differ between languages: each learned word to one list (its hash says
   which), and beginnings of ``STEM`` letters, which also find forms that no labelled text has.
2. **Label model.** A text's votes are a pattern; the patterns are counted over all texts (at most 3^6 + 3^4 numbers,
   whatever the size of the corpus). Expectation-maximisation on these counts estimates each labeller's accuracy in
   both classes (how often it votes bad in each) and the share of the classes (Dawid and Skene, 1979), and
   from them each pattern's posterior.
3. **Scorer.** Posteriors of a sample train two hashed linear scorers (logistic regression on the presence of hashed
   words, of binned shape features and of bad votes). The sample is the only bounded part: about ``sample`` distinct texts
   (those of the smallest hashes, twice as many at most), of each the shape and vote features and ``MOST`` hashed words.
   Learned words come from at most ``rows`` labelled texts; a word or beginning is taken if it stands in ``LEAST``
   different contexts of toxic texts, three times as often as in clean ones, with a likelihood ratio of 24 or more.
4. **Decision.** All texts are scored; a text is kept if its quality is at least, and its toxicity below, one half.

Defined cases: very long texts are read whole; repeated rows and null ids don't matter; null and empty texts get no votes and keep the prior (they are kept); equal texts get equal results;
with no texts at all, or none of one class, the prior decides; an empty table gives no rows; further columns are kept
by ``quality_filter`` and ignored elsewhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import lean, sliced, texts_of
from tidemark.shared import fresh


ABSTAIN, BAD, GOOD = 0, 1, 2
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[!?]{2,}|([#$%&*~^=+<>\\|])\1+")
_PAIRS = ("!!", "??", "!?", "?!", *(2 * c for c in "#$%&*~^=+<>\\|"))
SYMBOLS = "|#$%&*<>{}[]\\^~="
#: Fixed lists of insults, for three labellers; they share no word.
INSULTS_A = frozenset("idiot moron dumb imbecile clown trash garbage vermin freak bastard liar".split())
INSULTS_B = frozenset("stupid fool loser pathetic filth creep jerk bitch crap ugly".split())
INSULTS_C = frozenset("scum worthless disgusting hate hateful".split())
STEM = 5
LEAST = 5
MOST = 2048
TOXIC = 4


def _band(x: float, good: float, bad: float) -> int:
    """A vote by a measure that is low in good texts."""
    return GOOD if x <= good else BAD if x >= bad else ABSTAIN


@dataclass(frozen=True)
class Shape:
    """Measures of a text that the labellers and the scorer share."""

    n: int
    symbols: float
    letters: float
    top: float
    run: int
    variety: float
    capitals: float
    marks: float

    @classmethod
    def of(cls, text: str, words: list[str] | None = None) -> Shape:
        """``words``: all runs of letters, if at hand."""
        tokens = text.split()
        n = len(tokens)
        if not n:
            return cls(0, 0, 1, 0, 0, 1, 0, 0)
        counts = Counter(tokens)
        solid = len("".join(tokens))
        again = list(map(eq, tokens, islice(tokens, 1, None)))
        run = 1 + max((len(list(g)) for same, g in groupby(again) if same), default=0) if any(again) else 1
        letters = len("".join(_WORD.findall(text) if words is None else words))
        symbols = sum(map(text.count, SYMBOLS))
        marks = len(_MARKS.findall(text)) if any(map(text.__contains__, _PAIRS)) else 0
        return cls(n, symbols / solid, letters / solid, max(counts.values()) / n, run, len(counts) / n, sum(map(str.isupper, tokens)) / n, marks / n)


def quality_votes(s: Shape) -> list[int]:
    if not s.n:
        return [ABSTAIN] * 6
    long = s.n >= 20
    return [
        _band(s.symbols, 0.01, 0.04),
        (BAD if s.run >= 6 or s.top >= 0.3 else _band(s.top, 0.15, 0.3)) if long else ABSTAIN,
        _band(s.capitals, 0.1, 0.3) if s.n >= 5 else ABSTAIN,
        _band(-s.variety, -0.55, -0.4) if long else ABSTAIN,
        _band(-s.letters, -0.85, -0.75) if long else ABSTAIN,
        _band(s.marks, 0.02, 0.1),
    ]


#: Three lists of words, and one of beginnings.
Lists = tuple[frozenset, frozenset, frozenset, frozenset]
LISTS: Lists = (INSULTS_A, INSULTS_B, INSULTS_C, frozenset())


def toxic_votes(words: set[str], lists: Lists = LISTS) -> list[int]:
    """Toxic is BAD here; a list that finds nothing in a text with words says good. No beginnings, no vote of theirs."""
    if not words:
        return [ABSTAIN] * TOXIC
    votes = [GOOD if words.isdisjoint(x) else BAD for x in lists[:3]]
    stems = lists[3]
    return [*votes, ABSTAIN if not stems else GOOD if stems.isdisjoint(w[:STEM] for w in words) else BAD]


def with_learned(marks, lists: Lists = LISTS) -> Lists:
    """Learned words, each for one of the three lists, and beginnings (they end in ``*``)."""
    out = [set(x) for x in lists]
    fixed = set().union(*lists[:3])
    for w in marks:
        if w.endswith("*"):
            out[3].add(w[:-1])
        elif w not in fixed:
            out[xxhash.xxh32_intdigest(w) % 3].add(w)
    return tuple(map(frozenset, out))


def stems_of(words) -> set[str]:
    """Beginnings of words that are longer than that, as marks."""
    return {f"{w[:STEM]}*" for w in words if len(w) > STEM}


def association(bad: np.ndarray, clean: np.ndarray, n_bad: int, n_clean: int) -> np.ndarray:
    """Likelihood-ratio statistic of words for the bad class, 0 where they lean to the other."""
    n = bad + clean
    rate = n_bad / max(1, n_bad + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(bad > 0, bad * np.log(bad / (n * rate)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - rate))), 0))
    return np.where(bad > n * rate, g, 0.0)


def learned_insults(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = 20_000, least: float = 24.0) -> list[str]:
    """Words, and beginnings of words (with a ``*``), that mark texts labelled toxic, from at most ``rows`` labelled rows
    (those of the smallest id hashes)."""
    picked = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).filter("__toxic is not null").orderBy(F.xxhash64("__id"), "__toxic").limit(rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(picked), "__id").select("__toxic", "__text")

    def run(batches):
        lean()
        clean: Counter = Counter()
        for b in sliced(batches, 1):
            found, around = [], []
            for toxic, text in zip(b.column(0).to_pylist(), texts_of(b, 1), strict=True):
                if not toxic:
                    words = words_of(text)
                    clean.update((*words, *stems_of(words), ""))
                    continue
                words = list(map(str.lower, _WORD.findall(text)))
                uses = {w: f"{x} {y}" for x, w, y in zip(["", *words], words, [*words[1:], ""], strict=False)}
                uses |= {f"{w[:STEM]}*": around for w, around in uses.items() if len(w) > STEM}
                uses[""] = text
                found += uses.keys()
                around += [xxhash.xxh64_intdigest(c) >> 1 for c in uses.values()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(around), pa.nulls(len(found), pa.int64())], names=["w", "around", "clean"])
        if clean:
            yield pa.RecordBatch.from_arrays([pa.array(list(clean)), pa.nulls(len(clean), pa.int64()), pa.array(list(clean.values()), pa.int64())], names=["w", "around", "clean"])

    # A word counts once in a text. Of toxic texts, those with the same neighbours of it (of its last use) count as one,
    # so that copies of a passage don't make its words suspect.
    counts = texts.mapInArrow(run, "w string, around bigint, clean bigint").groupBy("w").agg(F.count_distinct("around").alias("bad"), F.coalesce(F.sum("clean"), F.lit(0)).alias("clean"))
    # At most ``rows`` texts stand behind these counts, and only words that lean to the toxic ones come to the driver.
    rows_ = counts.filter(f"w = '' or (bad >= {LEAST} and bad >= 3 * clean)").toPandas()
    total = rows_[rows_["w"] == ""]
    if not len(total):
        return []
    g = association(rows_["bad"].to_numpy(float), rows_["clean"].to_numpy(float), int(total["bad"].iloc[0]), int(total["clean"].iloc[0]))
    return sorted(rows_["w"][(g >= least) & (rows_["w"] != "")])


def words_of(text: str) -> set[str]:
    return set(map(str.lower, set(_WORD.findall(text))))


def pattern(votes: list[int]) -> int:
    p = 0
    for v in votes:
        p = 3 * p + v
    return p


def votes_of(p: int, m: int) -> list[int]:
    return [p // 3**i % 3 for i in range(m - 1, -1, -1)]


@dataclass
class LabelModel:
    """The share of good texts and, for each labeller and class, the shares of its bad and good votes; no vote says nothing."""

    prior: float  # share of good
    good: np.ndarray  # (labellers, 3)
    bad: np.ndarray

    @classmethod
    def fit(cls, counts: dict[int, int], m: int, prior: float = 0.85, rounds: int = 300) -> LabelModel:
        """EM on pattern counts. It starts, and is held by a light Dirichlet prior, at labellers that seldom blame a
        good text and find a part of the bad ones."""
        start_good = np.tile([1, 0.02, 0.98], (m, 1))
        start_bad = np.tile([1, 0.5, 0.5], (m, 1))
        model = cls(prior, start_good, start_bad)
        votes = np.array([votes_of(p, m) for p in counts]).reshape(-1, m)
        weight = np.array(list(counts.values()), float)
        if not len(weight):
            return model
        answer = (votes[:, :, None] == np.arange(3)).astype(float)
        answer[:, :, ABSTAIN] = 0
        for _ in range(rounds):
            post = model._posterior(votes)
            good = np.einsum("p,pjk->jk", weight * post, answer) + 20 * start_good
            bad = np.einsum("p,pjk->jk", weight * (1 - post), answer) + 20 * start_bad
            share = float(((weight * post).sum() + 20 * prior) / (weight.sum() + 20))
            good[:, 1:] /= good[:, 1:].sum(1, keepdims=True)
            bad[:, 1:] /= bad[:, 1:].sum(1, keepdims=True)
            good[:, ABSTAIN] = bad[:, ABSTAIN] = 1
            new = cls(share, good, bad)
            done = abs(share - model.prior) < 1e-9 and np.abs(new.bad - model.bad).max() < 1e-7
            model = new
            if done:
                break
        return model

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        j = np.arange(votes.shape[1])
        z = np.log(self.prior) - np.log1p(-self.prior) + (np.log(self.good[j, votes]) - np.log(self.bad[j, votes])).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def posterior(self, votes: list[int]) -> float:
        return float(self._posterior(np.array([votes]))[0])


def shape_features(s: Shape) -> list[str]:
    """Binned shape features, under names that no word has."""
    if not s.n:
        return []
    cut = lambda x, edges: sum(x >= e for e in edges)
    size = cut(s.n, (5, 20))
    return [
        f"#sym{cut(s.symbols, (0.01, 0.02, 0.04, 0.1))}",
        f"#let{cut(s.letters, (0.6, 0.7, 0.75, 0.8, 0.85))}/{size}",
        f"#top{cut(s.top, (0.1, 0.15, 0.2, 0.3))}/{size}",
        f"#run{cut(s.run, (2, 3, 6))}",
        f"#var{cut(s.variety, (0.2, 0.4, 0.55))}/{size}",
        f"#cap{cut(s.capitals, (0.1, 0.2, 0.3, 0.6))}/{size}",
        f"#mrk{cut(s.marks, (0.02, 0.05, 0.1, 0.3))}",
    ]


def vote_features(quality: list[int], toxic: list[int]) -> list[str]:
    return [f"#q{i}" for i, v in enumerate(quality) if v == BAD] + [f"#t{i}" for i, v in enumerate(toxic) if v == BAD]


def bucket(feature: str, bits: int) -> int:
    """Words share 2^bits buckets; the few other features have 4096 of their own behind them."""
    h = xxhash.xxh32_intdigest(feature)
    return (1 << bits) + (h >> 20) if feature[0] == "#" else h >> (32 - bits)


def features_of(text: str, lists: Lists) -> tuple[list[str], list[int], list[int]]:
    """Features, quality votes and toxicity votes of a text."""
    found = _WORD.findall(text)
    s, words = Shape.of(text, found), set(map(str.lower, set(found)))
    q, t = quality_votes(s), toxic_votes(words, lists)
    return [*words, *shape_features(s), *vote_features(q, t)], q, t


def votes_for(text: str, lists: Lists) -> tuple[list[int], list[int]]:
    found = _WORD.findall(text)
    return quality_votes(Shape.of(text, found)), toxic_votes(set(map(str.lower, set(found))), lists)


class Weights(dict):
    """Feature -> weights in both scorers, remembered up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.bits, self.good, self.clean = model.good.bits, model.good.weights, model.clean.weights

    def __missing__(self, feature: str) -> complex:
        b = bucket(feature, self.bits)
        # Two sums at once: the real part is quality, the imaginary one toxicity.
        got = complex(self.good.get(b, 0.0), self.clean.get(b, 0.0))
        if len(self) < 300_000:
            self[feature] = got
        return got


@dataclass
class Scorer:
    """Sum of the weights of a text's features, through the logistic function."""

    bits: int
    bias: float
    weights: dict[int, float]

    @classmethod
    def fit(cls, rows: list[np.ndarray], target: np.ndarray, bits: int, min_df: int, rounds: int = 150, rate: float = 0.3, l2: float = 2e-3) -> Scorer:
        """Full-batch Adagrad on soft labels, classes weighted alike."""
        if not len(rows) or target.min() > 0.5 or target.max() < 0.5:
            mean = float(np.clip(target.mean(), 0.01, 0.99)) if len(rows) else 0.99
            return cls(bits, float(np.log(mean / (1 - mean))), {})
        flat = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        known, code, df = np.unique(flat, return_inverse=True, return_counts=True)
        keep = df[code] >= min_df
        code, owner = code[keep], owner[keep]
        share = target.mean()
        weight = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
        w, bias = np.zeros(len(known)), 0.0
        shrink = np.where(known < 1 << bits, l2, l2 / 300)
        h, hb = np.full(len(known), 1e-8), 1e-8
        for _ in range(rounds):
            z = np.bincount(owner, w[code], len(rows)) + bias
            err = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
            g = np.bincount(code, err[owner], len(known)) / len(rows) + shrink * w
            gb = err.mean()
            h += g * g
            hb += gb * gb
            w -= rate * g / np.sqrt(h)
            bias -= rate * gb / np.sqrt(hb)
        used = np.unique(code)
        # Multiples of 2^-20 add up to the same sum in any order.
        return cls(bits, float(bias), {int(known[i]): round(float(w[i]) * (1 << 20)) / (1 << 20) for i in used})

    def score(self, features) -> float:
        return logistic(self.bias + sum(self.weights.get(bucket(f, self.bits), 0.0) for f in features))


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


@dataclass
class Model:
    quality: LabelModel
    toxicity: LabelModel
    good: Scorer
    clean: Scorer
    lists: Lists


def fit(docs: DataFrame, text_col: str = "text", labels: DataFrame | None = None, id_col: str = "doc_id", sample: int = 12_000, bits: int = 18, min_df: int = 5) -> Model:
    """Label models from all texts, scorers from about ``sample`` of them. ``labels`` (doc_id, toxic), if given, adds
    words to the lists of insults."""
    lists = LISTS if labels is None else with_learned(learned_insults(docs, labels, id_col, text_col))

    @F.pandas_udf("struct<q:int,t:int>")
    def votes(col: pd.Series) -> pd.DataFrame:
        lean()
        rows = [(pattern(q), pattern(t)) for q, t in (votes_for(x or "", lists) for x in col)]
        return pd.DataFrame(rows, columns=["q", "t"])

    voted = docs.select(votes(F.col(text_col)).alias("v"))
    counts = voted.groupBy("v.q", "v.t").agg(F.count(F.lit(1)).alias("n")).collect()
    quality, toxicity = Counter(), Counter()
    for r in counts:
        quality[r["q"]] += r["n"]
        toxicity[r["t"]] += r["n"]
    qm, tm = LabelModel.fit(quality, 6), LabelModel.fit(toxicity, TOXIC)
    total = sum(quality.values())
    part = F.pmod(F.xxhash64(text_col), F.lit(1 << 32)) < int(min(1.0, sample / max(1, total)) * (1 << 32))

    @F.pandas_udf("struct<f:binary,q:int,t:int>")
    def features(col: pd.Series) -> pd.DataFrame:
        lean()
        rows = []
        for x in col:
            found, q, t = features_of(x or "", lists)
            known = np.unique([bucket(f, bits) for f in found] or [-1]).astype("<i4")
            own = int(np.searchsorted(known, 1 << bits))
            rows.append((np.concatenate([known[:own][:MOST], known[own:]]).tobytes(), pattern(q), pattern(t)))
        return pd.DataFrame(rows, columns=["f", "q", "t"])

    # Equal texts share a hash, so each text counts once: a group of copies can't flood the sample.
    once = docs.select(F.col(text_col).alias("text")).filter(part).distinct()
    rows = once.select(features(F.col("text")).alias("x"), F.xxhash64("text").alias("h")).select("x.*", "h").orderBy("h", "f").limit(2 * sample).toPandas()
    feats = [np.frombuffer(f, "<i4") for f in rows["f"]]
    q = np.array([qm.posterior(votes_of(p, 6)) for p in rows["q"]])
    t = np.array([tm.posterior(votes_of(p, TOXIC)) for p in rows["t"]])
    return Model(qm, tm, Scorer.fit(feats, q, bits, min_df), Scorer.fit(feats, t, bits, min_df), lists)


def score_text(model: Model, text: str, weights: Weights) -> tuple[float, float]:
    """Probabilities of good quality and of no toxicity."""
    if not text.strip():
        return model.quality.prior, model.toxicity.prior
    z = sum(map(weights.__getitem__, features_of(text, model.lists)[0]), 0j)
    return logistic(model.good.bias + z.real), logistic(model.clean.bias + z.imag)


def scores(model: Model, text: Column) -> Column:
    """struct(quality, toxicity): probabilities."""

    @F.pandas_udf("struct<quality:double,toxicity:double>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lean()
        weights = Weights(model)
        for col in it:
            rows = [score_text(model, x or "", weights) for x in col]
            yield pd.DataFrame([(a, 1 - b) for a, b in rows], columns=["quality", "toxicity"])

    return run(text)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, quality, toxicity, keep."""
    model = fit(docs, text_col, id_col=id_col, **options)
    out = docs.select(F.col(id_col).alias("doc_id"), scores(model, F.col(text_col)).alias("s"))
    return out.select("doc_id", "s.quality", "s.toxicity", ((F.col("s.quality") >= 0.5) & (F.col("s.toxicity") < 0.5)).alias("keep"))


def quality_filter(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows that are kept, with the same columns."""
    model = fit(docs, text_col, **options)
    (s,) = fresh(docs, "__score")
    out = docs.withColumn(s, scores(model, F.col(text_col)))
    return out.filter((F.col(s)["quality"] >= 0.5) & (F.col(s)["toxicity"] < 0.5)).select(*docs.columns)
